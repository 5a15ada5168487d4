"""Removal of passages that repeat across documents, by windows of lines.

Every run of ``window`` consecutive non-blank lines (ends stripped of blanks,
tabs and carriage returns) is hashed to 128 bits.  Windows that occur more
than once anywhere keep their first occurrence, in order of (doc_id, text
hash, position); the positions that later occurrences cover are merged and
removed.
"""

from __future__ import annotations

import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import arrow_map

WINDOW = 3
_ENDS = " \t\r"


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(id, mark, pos, h1, h2): one row per window, pos counts non-blank lines."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_ENDS))), lambda x: x != "")
    keys = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b")))
    at = F.sequence(F.lit(1), F.size("keys") - (window - 1))

    def of(i: Column, part: str, *salt: Column) -> Column:
        return F.xxhash64(*[F.element_at("keys", i + k)[part] for k in range(window)], *salt)

    each = F.transform(at, lambda i: F.struct((i - 1).alias("pos"), of(i, "a").alias("h1"),
                                              of(i, "b", F.lit(2)).alias("h2")))
    return (docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), lines.alias("lines"))
            .where(F.size("lines") >= window)
            .select("id", "mark", keys.alias("keys"))
            .select("id", "mark", F.inline(each)))


def repeated_positions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, mark, starts): per document that has any, the positions at which a
    window starts that has occurred before (in no order)."""
    seen = _windows(docs, window)
    place = F.struct(F.col("id").isNull().alias("n"), "id", "mark", "pos")
    first = (seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"))
             .where("times > 1").select("h1", "h2", "first"))
    later = seen.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("id", "mark").agg(F.collect_set("pos").alias("starts"))


def remove_repeated_lines(docs: DataFrame, window: int = WINDOW, drop_emptied: bool = False,
                          counts: bool = False) -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut out of ``text``
    (and ``n_chars``, if there is one, set to the new length).

    Lines keep their bytes and order; blank lines stay and belong to no
    window; texts of fewer than ``window`` non-blank lines have no window.
    Null texts stay null.  Rows equal in doc_id and text are one document and
    get the same result; null ids come last in the order.  ``drop_emptied``:
    leave out documents that lost their last non-blank line.  ``counts``: add
    n_lines (non-blank lines before) and n_removed, in place of columns of
    these names.
    """
    starts = repeated_positions(docs, window)
    names = [c for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_mark"))
    joined = rows.join(starts, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark")),
                       "left").select("row", "starts")
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else -1
    schema = docs.select(*names).schema
    if counts:
        schema = schema.add("n_lines", "long").add("n_removed", "long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols, marked = batch.column(0).flatten(), batch.column(1)
        texts, sizes = cols[text_at], cols[chars_at] if chars_at >= 0 else None
        stays = [True] * batch.num_rows
        n_lines, n_removed = [0] * batch.num_rows, [0] * batch.num_rows
        rows = [i for i, s in enumerate(marked) if s.is_valid]
        changed = {}
        for i in range(batch.num_rows) if counts else rows:
            text = texts[i].as_py()
            if text is None:
                continue
            lines = text.split("\n")
            solid = [k for k, x in enumerate(lines) if x.strip(_ENDS)]
            n_lines[i] = len(solid)
            if marked[i].is_valid:
                gone = {solid[p + k] for p in marked[i].as_py() for k in range(window)}
                n_removed[i] = len(gone)
                stays[i] = len(gone) < len(solid)
                changed[i] = "\n".join([x for k, x in enumerate(lines) if k not in gone])
        if changed:
            new = texts.to_pylist()
            for i, text in changed.items():
                new[i] = text
            cols[text_at] = pa.array(new, texts.type)
            if sizes is not None:
                new = sizes.to_pylist()
                for i, text in changed.items():
                    new[i] = len(text)
                cols[chars_at] = pa.array(new, sizes.type)
        if counts:
            cols += [pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
        out = pa.RecordBatch.from_arrays(cols, schema.names)
        return out.filter(pa.array(stays)) if drop_emptied else out

    return arrow_map(joined, run, schema)


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
solid AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS k,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
windows AS (
  SELECT doc_id, p, k || chr(10) || lead(k, 1) OVER w || chr(10) || lead(k, 2) OVER w AS body
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS nth
    FROM windows WHERE body IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, (VALUES (0), (1), (2)) AS t(k)),
gone_lines AS (SELECT doc_id, i FROM solid JOIN gone USING (doc_id, p)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone_lines USING (doc_id, i)
  GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(n.c, 0) AS n_lines, coalesce(g.c, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS c FROM solid GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS c FROM gone_lines GROUP BY doc_id) g USING (doc_id)
"""
