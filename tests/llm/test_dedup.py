"""Line dedup, SimHash and MinHash near duplicates, containment."""

import hashlib
import itertools
import weakref
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import containment, lines, minhash, simhash
from logloom.llm.components import connected_components
from samples import ODD, clashing, docs, empty, odd  # noqa: F401 - fixtures



def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ lines

def check_lines(df):
    want = brute.remove_lines(pairs(df))
    got = lines.remove_repeated_lines(df, counts=True)
    rows = Counter((a, t) for a, t in pairs(df))
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == Counter(
        {(k[0], *want[k]): n for k, n in rows.items()} if len(want) == len(rows) else {})


def test_lines_match_brute_force(docs):
    check_lines(docs)


def test_lines_odd_rows(odd):
    check_lines(odd)


def test_lines_clashing_columns_and_lengths(clashing, odd):
    got = lines.remove_repeated_lines(clashing)
    assert got.columns == clashing.columns and got.count() == len(ODD)
    by = {(r.doc_id): r for r in got.collect()}
    assert by[9].text == "x\n\nz" and by[9].n_chars == 4 and by[8].n_chars == 12 and by[9]["pos"] == by[8]["pos"]
    kept = lines.remove_repeated_lines(odd, drop_emptied=True)
    assert kept.where("doc_id = 10").isEmpty() and kept.count() == len(ODD) - 1


def test_lines_empty(empty):
    assert lines.remove_repeated_lines(empty, counts=True, drop_emptied=True).count() == 0


# ---------------------------------------------------------------- simhash

def test_golay_code():
    words = np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)
    code = words | simhash._remainder(words)
    assert (simhash.decode(code) == np.arange(1 << 12)).all()
    for flips in [(0,), (3, 22), (1, 10, 17)]:
        assert (simhash.decode(code ^ np.uint32(sum(1 << i for i in flips))) == np.arange(1 << 12)).all()
    least = min(int(x).bit_count() for x in code[1:])
    assert least == 7


def test_golay_keys_meet_up_to_four_bits():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, np.uint64) << np.uint64(1)
    other = base.copy()
    for i in range(len(other)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    for a, b in zip(simhash.golay_keys(base), simhash.golay_keys(other)):
        assert set(a.tolist()) & set(b.tolist())


def check_simhash(df):
    want, _ = brute.near_duplicates(pairs(df))
    got = [(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert Counter(got) == Counter(want)


def test_simhash_matches_brute_force(docs):
    check_simhash(docs)


def test_simhash_odd_rows(odd):
    check_simhash(odd)


def test_simhash_chain_of_fingerprints(spark):
    rng = np.random.default_rng(9)
    prints = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)]
    for start in prints[:10]:
        for step in range(30):
            start ^= sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 6), replace=False))
            prints.append(start)
    values = sorted(set(prints))
    links = [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) % (1 << 64)).bit_count() <= 4]
    want = brute.components(len(values), links)
    df = spark.createDataFrame([(v,) for v in prints], "fingerprint bigint")
    got = {r.node: r.component for r in simhash.fingerprint_components(df).collect()}
    groups = {}
    for v, c in zip(values, want):
        groups.setdefault(c, set()).add(v)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
        frozenset(k for k in got if got[k] == c) for c in set(got.values())}


@pytest.mark.parametrize("free", [(0, 22), (22, 21), (43, 21)])
def test_simhash_crowded_buckets(spark, free):
    """Fingerprints that agree in two segments: dense, thin and scattered members of one bucket."""
    rng = np.random.default_rng(free[0])
    start, width = free
    rest = int(rng.integers(0, 1 << 62)) & ~(((1 << width) - 1) << start)
    low = [int(x) for x in np.concatenate([rng.integers(0, 1 << 9, 250), rng.integers(0, 1 << width, 700)])]
    values = np.array(sorted({rest | x << start for x in low}), np.uint64)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    want = brute.components(len(values), np.argwhere(np.triu(apart <= 4, 1)).tolist())
    groups = {}
    for v, c in zip(values.view(np.int64).tolist(), want):
        groups.setdefault(c, set()).add(v)
    assert any(len(g) == 1 for g in groups.values()) and len([g for g in groups.values() if len(g) > 1]) > 1
    df = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fingerprint bigint")
    got = {}
    for r in simhash.fingerprint_components(df).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_keep_one(docs, odd, clashing, empty):
    for df in (docs, odd):
        rows, comp = brute.near_duplicates(pairs(df))
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and kept.count() == len(set(comp))
        assert Counter(r.doc_id for r in kept.collect()) == Counter(
            least for least in dict(zip(comp, (r[2] for r in rows))).values())
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and set(r.row_mark for r in kept.collect()) == {12}
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)],
                                   [(i, i ^ 5) for i in range(64)] + [(3, 70), (70, 71), (70, 3)]])
def test_components(spark, links):
    nodes = sorted({x for l in links if l[0] != l[1] for x in l})
    at = {x: i for i, x in enumerate(nodes)}
    want = brute.components(len(nodes), [(at[a], at[b]) for a, b in links if a != b])
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(links + [(None, 4)], "a bigint, b bigint")).collect()}
    assert set(got) == set(nodes)
    assert all((got[a] == got[b]) == (want[at[a]] == want[at[b]]) for a, b in itertools.combinations(nodes, 2))
    assert set(got.values()) <= set(nodes)


# ---------------------------------------------------------------- minhash

def shingles(text, n=5):
    words = brute.ASCII_BLANK.findall(brute.lower(text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def check_edited(df, partitions=None):
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (i, text) in enumerate(rows):
        n = len(text)
        edited = text[:n - n // 3] + rows[(k + 1) % len(rows)][1][:n // 3]
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest()))
    got = minhash.with_edited(df).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    return got, rows


def test_edited_texts(docs):
    got, rows = check_edited(docs)
    by, text = {r.doc_id: r for r in got}, dict(rows)
    off = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)]
        edited = t[:len(t) - len(t) // 3] + other[1][:len(t) // 3]
        for near, with_ in ((by[i].near_edited, edited), (by[i].near_next, other[1])):
            a, b = shingles(t), shingles(with_)
            off.append(abs(near - len(a & b) / max(1, len(a | b))))
    assert np.mean(off) < 0.03 and max(off) < 0.2
    same = {}
    for i, t in rows:
        same.setdefault(t, set()).add(by[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_edited_odd_rows(odd, empty, spark):
    check_edited(odd)
    assert minhash.with_edited(empty).count() == 0
    check_edited(spark.createDataFrame([(3, "only one text of nine words is in here")], "doc_id bigint, text string"))


def test_minhash_classes_match_brute_force(spark, docs, odd):
    base = [f"w{k}" for k in range(60)]
    near = [(k, " ".join(base[:30] + [f"x{k}"] * (k % 2) + base[30:])) for k in range(1000, 1006)]
    more = spark.createDataFrame(near, "doc_id bigint, text string")
    for df in (docs.select("doc_id", "text").unionByName(more), odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = pairs(df)
        sets = [shingles(t) for _, t in rows]
        links = [(i, j) for i in range(len(rows)) for j in range(i)
                 if sets[i] == sets[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        comp = brute.components(len(rows), links)
        least = {}
        for (i, _), c in zip(rows, comp):
            least[c] = min(least.get(c, i), i)
        different = {s: len({o for o in sets if o != s and s and o and len(s & o) >= 0.8 * len(s | o)}) for s in sets}
        got = {r.doc_id: (r.class_id, r.links) for r in minhash.classes(df).collect()}
        assert got == {i: (least[c], different[s]) for (i, _), c, s in zip(rows, comp, sets)}


# ------------------------------------------------------------ containment

def check_contained(docs, items, **kw):
    want = brute.contained(pairs(docs), [(r.item_id, r.text) for r in items.collect()])
    got = containment.find_items(docs, items, **kw)
    assert Counter((r.doc_id, r.item_id, r.n_shingles, r.shared) for r in got.collect()) == Counter(want)
    return want


def test_containment_matches_brute_force(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert check_contained(docs, items)
    check_contained(docs, items, block_items=7)
    held = {r[0] for r in brute.contained(pairs(docs), [(r.item_id, r.text) for r in items.collect()])}
    clean = containment.drop_contaminated(docs, items, block_items=16)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in pairs(docs)} - held


def test_containment_blocks_are_built_one_at_a_time(spark, docs, monkeypatch):
    made, most, sizes = [], [], []
    build = containment.Block.__init__

    def counted(self, ids, texts, *args):
        build(self, ids, texts, *args)
        made.append(weakref.ref(self))
        most.append(sum(r() is not None for r in made))
        sizes.append((len(texts), sum(len(t.encode()) for t in texts)))

    monkeypatch.setattr(containment.Block, "__init__", counted)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = items.unionByName(spark.createDataFrame([(-1, "long item " * 3000), (None, "é" * 900)], items.schema))
    held = check_contained(docs, items, block_items=50, block_bytes=8000)
    assert held and len(sizes) > 3 and set(most) == {1}
    assert all(n <= 50 and (size <= 8000 or n == 1) for n, size in sizes)
    assert sum(n for n, _ in sizes) == items.where("text is not null").distinct().count()
    containment.drop_contaminated(docs, items, block_items=50)
    assert set(most) == {1}


def test_containment_items_come_in_few_jobs(spark, monkeypatch):
    """One job per block, also where the session deals rows to more partitions."""
    items = spark.createDataFrame([(i, f"w{i} b c d e f") for i in range(300)], "item_id bigint, text string")
    deal = type(items).repartition
    monkeypatch.setattr(type(items), "repartition", lambda df, n, *cols: deal(df, max(n, 80) if cols else n, *cols))
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    for block_items, blocks in ((300, 1), (100, 3)):
        before = jobs()
        found = [b.ids for b in containment._blocks(items, 0.8, 5, block_items, 1 << 20)]
        assert sorted(i for ids in found for i in ids) == list(range(300)) and len(found) >= blocks
        assert jobs() - before < 20


def test_containment_scattered_and_partial(spark):
    words = [f"q{k}" for k in range(40)]
    filler = ["z%d" % k for k in range(5000)]
    whole = " ".join(filler[:2000] + words + filler[2000:])
    split = " ".join(words[:20] + filler[:3000] + words[20:])           # loses 4 of 36 shingles
    half = " ".join(words[:25] + filler)
    docs = spark.createDataFrame([(1, whole), (2, split), (3, half), (4, whole.upper().replace(" ", "; "))],
                                 "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(words)), (10, "q3 q4"), (11, "nowhere at all"), (12, " .. "), (9, None)],
                                  "item_id bigint, text string")
    want = check_contained(docs, items)
    assert {(d, i) for d, i, _, _ in want} == {(1, 9), (2, 9), (4, 9), (1, 10), (2, 10), (3, 10), (4, 10)}


def test_containment_odd_rows(spark, odd, clashing, empty):
    items = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "no id here"), (2, None), (3, "")],
                                  "item_id bigint, text string")
    check_contained(odd, items)
    assert containment.drop_contaminated(clashing, items).columns == clashing.columns
    assert containment.find_items(empty, items).count() == 0
    none = items.where("false")
    assert containment.find_items(odd, none).count() == 0 and containment.drop_contaminated(odd, none).count() == len(ODD)


def test_sketch_meets_every_holding_document():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 40, 200):
        words = [f"a{k}" for k in range(n + 4)]
        block = containment.Block([1], [" ".join(words)], 0.8, 5)
        for _ in range(20):
            gone = int(0.2 * n)
            at = rng.choice(n + 4, size=min(gone // 5, n), replace=False)  # each changed word costs up to 5
            text = pa.array([" ".join(f"b{k}" if k in at else w for k, w in enumerate(words))])
            from logloom.llm.features import lay_out
            assert list(block.find(lay_out(text, containment._WORDS), text))
