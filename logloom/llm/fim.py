"""Fill-in-middle transformation.

A text's units are its runs of ASCII letters and every other single code
point.  The text is cut after ``a`` and after ``b`` units (a <= b, from a hash
of the document's id) into prefix, middle and suffix, which are put together
again with sentinels between them: ``psm`` as prefix, suffix, middle, ``spm``
as suffix, prefix, middle.  A text that is empty or holds a sentinel stays
``plain``, as do all those that the hash leaves out.

The cuts are found over UTF-8 bytes.  A text is divided into blocks of
``BLOCK`` bytes; a Fenwick tree over the blocks holds how many units and how
many code points begin in each.  Binary lifting goes down the tree to the
block in which a unit begins, and only that block is searched byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import arrow_map, raw_bytes

#: Bytes per leaf of the tree.
BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Fenwick:
    """Partial sums of rows of numbers; node k (from 1) holds the sum of the
    ``k & -k`` rows that end with row k - 1."""

    def __init__(self, rows: np.ndarray):
        n = len(rows)
        total = np.zeros((n + 1, rows.shape[1]), np.int64)
        np.cumsum(rows, axis=0, out=total[1:])
        k = np.arange(1, n + 1)
        self.nodes = np.concatenate([total[:1], total[1:] - total[k - (k & -k)]])
        self.top = 1 << n.bit_length() - 1 if n else 0

    def add(self, row: int, change) -> None:
        k = row + 1
        while k < len(self.nodes):
            self.nodes[k] += change
            k += k & -k

    def before(self, row: int) -> np.ndarray:
        """Sums of all rows before ``row``."""
        out = np.zeros(self.nodes.shape[1], np.int64)
        while row:
            out += self.nodes[row]
            row -= row & -row
        return out

    def descend(self, target: int) -> tuple[int, np.ndarray]:
        """The last row before which the first column sums to ``target`` or
        less (the number of rows at most), and the sums there."""
        at, sums, step = 0, np.zeros(self.nodes.shape[1], np.int64), self.top
        while step:
            nxt = at + step
            if nxt < len(self.nodes) and sums[0] + self.nodes[nxt, 0] <= target:
                at, sums = nxt, sums + self.nodes[nxt]
            step >>= 1
        return at, sums


class Units:
    """Units and code points of one UTF-8 text."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        letter = _LETTER[data]
        self.point = (data & 0xC0) != 0x80
        self.unit = self.point.copy()
        self.unit[1:] &= ~(letter[1:] & letter[:-1])
        self.size, self.block = len(data), block
        edges = np.arange(0, len(data), block)
        both = np.stack([self.unit, self.point], axis=1).astype(np.int64)
        self.tree = Fenwick(np.add.reduceat(both, edges, axis=0) if len(edges) else np.zeros((0, 2), np.int64))
        self.n, self.points = (int(x) for x in self.tree.before(len(edges)))

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` units."""
        if units >= self.n:
            return self.size, self.points
        block, (seen, points) = self.tree.descend(units)
        at = block * self.block
        inside = int(np.flatnonzero(self.unit[at:at + self.block])[units - seen])
        return at + inside, int(points) + int(self.point[at:at + inside].sum())


def draws(doc_id: int | None, salt: str) -> list[int]:
    """Four unsigned 32-bit numbers; a null id counts as no digits."""
    head = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(head[k:k + 8], 16) for k in range(0, 32, 8)]


def transform(docs: DataFrame, rate: int = 90, spm_rate: int = 20, salt: str = "1") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of
    ``docs`` (doc_id, text): n units, the form, the code points of prefix and
    middle (null if plain), the whole text put together anew.

    ``rate`` per cent of the ids are transformed, ``spm_rate`` per cent of
    those as spm.  Null and empty texts are plain and empty; repeated rows
    each give a row, rows of one id are drawn alike; further columns are left
    out; an empty table gives an empty table.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = raw_bytes(batch.column(1))
        rows = []
        for doc_id, a, b in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            units, whole = Units(data[a:b]), data[a:b].tobytes()
            h = draws(doc_id, salt)
            if not whole or h[2] % 100 >= rate or any(m in whole for m in marks):
                rows.append((units.n, "plain", None, None, whole))
                continue
            ends = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
            (i, p), (j, q) = (units.cut(e) for e in ends)
            head, mid, tail = whole[:i], whole[i:j], whole[j:]
            spm = h[3] % 100 < spm_rate
            parts = (marks[1], tail, marks[0], head, marks[2], mid) if spm else (marks[0], head, marks[1], tail, marks[2], mid)
            rows.append((units.n, "spm" if spm else "psm", p, q - p, b"".join(parts)))
        n, form, prefix, middle, out = zip(*rows) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
             pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run,
                     "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of which ``transform`` made ``output``; null for a null or
    for a form that it does not have."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digests(found: DataFrame) -> DataFrame:
    """Output and restored text as SHA-256."""
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (
  SELECT *, len(u) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS head,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
         array_to_string(u[greatest(c1, c2) + 1:n], '') AS tail
  FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
