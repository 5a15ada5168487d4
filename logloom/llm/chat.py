"""Chat formatting by columnar byte assembly.

A conversation's turns become one text: per turn ``<|im_start|>`` role,
line feed, text, ``<|im_end|>``, line feed.  Roles and texts are escaped so
that no control string stands inside them: each backslash is doubled and a
backslash follows the first character of every control string (in a role a
line feed becomes backslash n).  ``unescape`` takes that back.

The loss mask covers exactly the texts of assistant turns.

Turns are sorted by conversation within partitions and pass through in
batches: segment lengths, cumulative offsets and scatter indices are computed
in numpy, and headers, texts and ends are copied into one preallocated Arrow
buffer.  A conversation that spans batches gives several parts, so no
conversation has to fit in memory.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import raw_bytes, slices
from logloom.session import ship_package

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that some chat template gives a meaning to.
CONTROL = [START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]
LOSS_ROLE = "assistant"
_SPECIAL = re.compile("(?=(" + "|".join(map(re.escape, CONTROL)) + r"))|\\")
_NEEDS = "|".join(map(re.escape, CONTROL)) + r"|\\"


def escape(text: str) -> str:
    out, done = [], 0
    for m in _SPECIAL.finditer(text):
        at = m.start()
        out += [text[done:at + 1], "\\"]
        done = at + 1
    return "".join(out) + text[done:] if out else text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"n": "\n", "\\": "\\"}.get(m.group(1), ""), role)


def scatter(out: np.ndarray, data: np.ndarray, src: np.ndarray, dst: np.ndarray, size: np.ndarray) -> None:
    """Copy the segments ``data[src[i]:src[i] + size[i]]`` to ``out[dst[i]:]``."""
    total = int(size.sum())
    if total:
        first = np.cumsum(size) - size
        step = np.arange(total)
        out[step + np.repeat(dst - first, size)] = data[step + np.repeat(src - first, size)]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns in order, the offsets of the turns (n + 1 of them),
    and where each turn's escaped text starts and how long it is."""
    texts = texts.fill_null("")
    risky = np.flatnonzero(pc.match_substring_regex(texts, _NEEDS).to_numpy(zero_copy_only=False))
    if len(risky):
        new = texts.to_pylist()
        for i in risky:
            new[i] = escape(new[i])
        texts = pa.array(new, pa.string())
    data, off = raw_bytes(texts)
    coded = roles.fill_null("").dictionary_encode()
    heads = [f"{START}{_escape_role(r)}\n".encode() for r in coded.dictionary.to_pylist()]
    head_data = np.frombuffer(b"".join(heads), np.uint8)
    head_size = np.array([len(h) for h in heads], np.int64)
    head_src = np.cumsum(head_size) - head_size
    tail_data = np.frombuffer(f"{END}\n".encode(), np.uint8)
    which = coded.indices.to_numpy()
    n = len(texts)
    sizes = np.stack([head_size[which], np.diff(off), np.full(n, len(tail_data))], axis=1) if n else np.zeros((0, 3), np.int64)
    ends = np.cumsum(sizes.reshape(-1)).reshape(-1, 3)
    starts = ends - sizes
    out = np.empty(int(ends[-1, 2]) if n else 0, np.uint8)
    scatter(out, head_data, head_src[which], starts[:, 0], sizes[:, 0])
    scatter(out, data, off[:-1], starts[:, 1], sizes[:, 1])
    scatter(out, tail_data, np.zeros(n, np.int64), starts[:, 2], sizes[:, 2])
    return out, np.append(starts[:, 0], len(out)), starts[:, 1], sizes[:, 1]


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss ARRAY<STRUCT<start, size>>): the turns
    of each conversation, sorted by turn (nulls last; ties by role, then
    text), as template text; loss spans are bytes of this part.

    Conversations are whole in the order of ``part`` (0, 1, ...): a part ends
    where a batch of turns ends.  Null texts and roles are empty, turns with a
    null conv_id are one conversation, repeated rows are repeated turns.
    """
    ship_package(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"),
                        F.col("text").cast("string"))
    spread = rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")),
        F.coalesce("text", F.lit("")))
    return spread.select("conv_id", "role", "text").mapInArrow(
        _format_batches, "conv_id bigint, part bigint, formatted string, loss array<struct<start:bigint,size:bigint>>")


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))


def _format_batches(batches):
    last, part = (), 0
    for batch in batches:
        for rows in slices(batch):
            if rows.num_rows == 0:
                continue
            ids = rows.column(0).to_pylist()
            out, offsets, text_at, text_size = assemble(rows.column(1), rows.column(2))
            firsts = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
            stops = firsts[1:] + [len(ids)]
            parts = [0] * len(firsts)
            parts[0] = part + 1 if last == (ids[0],) else 0
            text = pa.StringArray.from_buffers(
                len(firsts), pa.py_buffer(offsets[firsts + [len(ids)]].astype(np.int32)), pa.py_buffer(out))
            counted = pc.equal(rows.column(1), LOSS_ROLE).fill_null(False).to_numpy(zero_copy_only=False)
            loss = [[{"start": int(text_at[i] - offsets[a]), "size": int(text_size[i])}
                     for i in range(a, b) if counted[i]] for a, b in zip(firsts, stops)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[a] for a in firsts], pa.int64()), pa.array(parts, pa.int64()), text,
                 pa.array(loss, _LOSS)], ["conv_id", "part", "formatted", "loss"])
            last, part = (ids[-1],), parts[-1]


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(_unescape_role(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read from the template text:
    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)."""
    ship_package(formatted.sparkSession)
    parts = formatted.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_last(), "part")
    return parts.mapInArrow(_digest_batches, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                             "loss_sha256 string, formatted_chars bigint")


def _digest_batches(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    key, state = None, None

    def close():
        return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        done = []
        for conv, text, loss in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                    batch.column(3).to_pylist()):
            if key != (conv,):
                if key is not None:
                    done.append(close())
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            whole = text.encode()
            for span in loss:
                body = unescape(whole[span["start"]:span["start"] + span["size"]].decode())
                state[2] += len(body)
                state[3].update(body.encode())
            state[4] += len(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(), types)], names)


#: The conversation that the query adds.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    len('<|im_start|>') + len(role) + 1 + len('<|im_end|>') + 1 + len(text)
    + len(regexp_extract_all(text, '\\'))
    + len(regexp_extract_all(text,
        '<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|endoftext\|>')) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN len(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
