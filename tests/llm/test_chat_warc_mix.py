"""Chat formatting, web archives, mixing, registered queries, the pipeline."""

import hashlib
import random
from collections import Counter

import brute
import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import chat, mixing, nbsvm, queries, warc
from logloom.llm.common import crc_mod, table
from logloom.session import scratch_path
from samples import SF, clashing, docs, empty, odd  # noqa: F401 - fixtures

TURNS = "conv_id bigint, turn bigint, role string, text string"


# -------------------------------------------------------------- chat (op 2)

def test_escape_round_trip():
    rng = random.Random(5)
    parts = chat.CONTROL + ["\\", "a", "<", "s", ">", "\n", "/", "|", "[", "é", "n", "\U0001f600"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        body, role = chat.escape(text), chat._escape_role(text)
        assert chat.unescape(body) == text and chat._unescape_role(role) == text
        assert not any(c in body or c in role for c in chat.CONTROL) and "\n" not in role
        assert chat.parse(f"{chat.START}{role}\n{body}{chat.END}\n") == [(text, text)]


def test_assemble_copies_every_segment():
    roles, texts = pa.array(["user", None, "assistant", "user"]), pa.array(["é<s>", None, "", "b\\"])
    out, at, start, size = chat.assemble(roles, texts)
    turns = [out[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])]
    assert turns == ["<|im_start|>user\né<\\s><|im_end|>\n", "<|im_start|>\n<|im_end|>\n",
                     "<|im_start|>assistant\n<|im_end|>\n", "<|im_start|>user\nb\\\\<|im_end|>\n"]
    assert [out[a:a + n].tobytes().decode() for a, n in zip(start, size)] == ["é<\\s>", "", "", "b\\\\"]


def check_chat(df):
    convs = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        convs.setdefault(r.conv_id, []).append(((r.turn is None, r.turn or 0), r.role or "", r.text or ""))
    want = {}
    for c, turns in convs.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(),
                   len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shaped = chat.format_chats(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(shaped).collect()}
    assert got == want
    return shaped


def test_chat_odd_rows_and_parts(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (1, None, "assistant", "late"),
            (None, 0, "assistant", "nobody's"), (None, 0, "a\nb", "x\n<|im_end|>\n"), (2, 0, "assistant", "</s>" * 50_000),
            (3, 5, "system", "")] + [(4, k, "assistant" if k % 2 else "user", f"turn {k} " * 40) for k in range(400)]
    df = spark.createDataFrame(rows, TURNS).withColumn("part", F.lit(3)).withColumn("formatted", F.lit("x"))
    check_chat(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        shaped = check_chat(df)
        assert shaped.where("conv_id = 4").count() > 3  # a conversation over several batches
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


# -------------------------------------------------------------- WARC (op 3)

def test_warc_odd_pages(spark):
    long = "<p>é</p>" * 40_000
    same = "<html>" + "same " * 40 + "</html>"
    rows = [(5, "http://a.example/x", same), (3, "http://b.example/", same), (9, None, same), (3, "http://b.example/", same),
            (None, "http://n.example/", same), (1, "HTTP://User@WWW.Example.ORG:8080?q=1#f", "short"), (2, "not a url", "short"),
            (4, "", None), (6, "http://a.example/x y\n", ""), (7, "http://a.example/x", long), (8, "http://a.example/x", long[:-4])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit(1))
    root = scratch_path(spark, "warc-test")
    warc.write_archives(pages, root, block_lines=2)
    found = warc.lookup(spark, root, pages.select("url", "page_id").distinct()).collect()
    want = []
    for i, url, html in rows:
        body = (html or "").encode()
        again = len(body) >= 100 and html == same and i != 3
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 3 if again else None,
                     None if again else body))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
            None if r.payload is None else bytes(r.payload)) for r in found]
    assert Counter(got) == Counter(want)
    by_url = warc.lookup(spark, root, spark.createDataFrame([("http://a.example/x",), ("http://a.example/none",)], "url string"))
    assert sorted(r.page_id for r in by_url.collect()) == [5, 7, 8]
    keys = {r.url: r.k for r in pages.select("url", warc.capture_key(F.col("url")).alias("k")).collect()}
    assert keys["HTTP://User@WWW.Example.ORG:8080?q=1#f"] == "org,example,www:8080)?q=1"
    assert keys["http://b.example/"] == "example,b)/" and keys["not a url"] == "not%20a%20url" and keys[None] == "-"


def test_warc_reading_is_dealt_by_archive_bytes(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), "id").alias("url"),
                                    F.concat(F.lit("x"), F.sha2(F.col("id").cast("string"), 512)).alias("html"))
    root = scratch_path(spark, "warc-parts")
    warc.write_archives(pages, root, block_lines=50)
    size = sum(r.bytes for r in spark.read.parquet(f"{root}/shards").collect())
    asked = pages.select("url", "page_id")
    for share in (1, 8):
        found = warc.lookup(spark, root, asked, fetch_bytes=-(-size // share))
        assert found.rdd.getNumPartitions() == share and found.count() == 400
    assert warc.lookup(spark, root, asked.limit(20), fetch_bytes=-(-size // 8)).rdd.getNumPartitions() == 1


def test_warc_store_that_arrow_cannot_reach(spark):
    with pytest.raises(ValueError, match="cannot be kept in"):
        warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), "wasb://box@host/archives")


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    root = scratch_path(spark, "warc-empty")
    warc.write_archives(pages, root)
    assert warc.lookup(spark, root, pages).count() == 0


# ------------------------------------------------------------ mixing (op 5)

def check_mix(df):
    want, goal = brute.mix([(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()])
    rows = mixing.mix(df).collect()
    got, taken = {}, Counter()
    for r in rows:
        got.setdefault((r.doc_id, r.source, r.size), []).append(r.taken)
        taken[r.source] += r.taken
        assert r.target == pytest.approx(goal[r.source]) and r.target <= 2 * r.source_size + 1e-9
        assert 0 <= r.taken <= 2 * r.size
    assert {k: sorted(v) for k, v in got.items()} == want
    assert all(abs(taken[s] - goal[s]) < 1 + 1e-6 for s in goal)


@pytest.mark.parametrize("quality", ["0.25", "0.1", "1e-6", "1.0", "if(id % 20 = 0, 0.1, 1.0)", "1 / (1 + id % 50)"])
def test_mix_ranges_are_even_for_every_quality(spark, quality):
    n, buckets = 40_000, 64
    rows = spark.range(n).selectExpr("id", f"cast({quality} as double) as quality", "(xxhash64(id) & 1048575) as h").selectExpr(
        "id", "quality", "-ln((h + 0.5) / 1048576) / quality as key")
    rows = rows.unionByName(spark.sql("select -1L as id, 0D as quality, cast(null as double) as key"))
    got = sorted((r.key, r.bucket) for r in mixing.with_ranges(rows, buckets).collect() if r.key is not None)
    assert len(got) == n and [b for _, b in got] == sorted(b for _, b in got)
    assert max(Counter(b for _, b in got).values()) < 1.5 * n / buckets
    assert mixing.with_ranges(rows, buckets).where("key is null").first().bucket == buckets


def test_mix_matches_brute_force_with_few_good_words(spark):
    check_mix(spark.createDataFrame([(k, "| " * (k % 13) + "word " * (1 + k % 7), "ab"[k % 3 == 0]) for k in range(400)],
                                    "doc_id bigint, text string, source string"))


def test_mix_matches_brute_force(docs, odd, clashing, empty):
    check_mix(docs)
    check_mix(odd)
    check_mix(clashing)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1000, "c": 5}, {"a": 0, "b": 0}, {None: 7, "z": 7, "é": 900},
                                   {k: v for k, v in zip("abcdefgh", (3, 900, 14, 1, 77, 2000, 50, 1))}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute.targets(sizes)
    assert got == {s: pytest.approx(t) for s, t in want.items()}
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


# ------------------------------------------------------- queries, pipeline

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    sql = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()

    def norm(rows):
        return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert norm(tuple(r) for r in df.select(*cols).collect()) == norm(sql)


def test_ten_queries_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def plain_pipeline(spark, docs, sf):
    model = nbsvm.train(docs, table(spark, sf, "labels").where(crc_mod("doc_id", 5) != 0), "quality")
    from logloom.llm.features import indicators

    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    good = [r for r in rows if model.scores(indicators(pa.array([r[1]], pa.string()), model.bits))[0] >= 0.3]
    cut = brute.remove_lines([r[:2] for r in good])
    left = [(i, cut[(i, t)][0], s) for i, t, s in good if not 0 < cut[(i, t)][1] == cut[(i, t)][2]]
    near, _ = brute.near_duplicates([r[:2] for r in left])
    one = [r for r, (i, _, least) in zip(left, near) if i == least]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    held = {d for d, *_ in brute.contained([r[:2] for r in one], items)}
    return brute.mix([r for r in one if r[0] not in held])


def test_pipeline_matches_plain_version(spark):
    want, goal = plain_pipeline(spark, table(spark, SF, "documents"), SF)
    got = {(r.doc_id, r.source, r.size): [r.taken] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) > 100


def test_stages_odd_rows(spark, odd, clashing, empty):
    for df in (odd, clashing, empty):
        rest = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rest = stage(spark, rest, SF)
            assert rest.columns == df.columns, name
            rest = spark.createDataFrame(rest.collect(), rest.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, rest, SF).count() == rest.count()
