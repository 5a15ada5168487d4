"""Posting lists: where each stem occurs, (term, id, pos, log_date).

Stored as blocks: one row per (day, term, range of ``IDS_PER_BLOCK`` ids) with
the least and greatest id, and for each occurrence the id's offset from the
least one and the position, sorted.  Offsets are small numbers that Parquet
keeps in a few bits; the blocks of a term lie together in files sorted by
term, and a block is a bounded number of messages, however common its term.
The appends' blocks of one range merge into one.

:func:`occurrences` gives the blocks' rows back.  A predicate on ``term`` or on
the day is pushed below that expansion, down to the files, so a search reads
the blocks of its own stems only and joins on the unique id; AQE switches to a
broadcast join at run time when the hits are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.functions.timestamps import floor_div
from logloom.operators.search import Initial, Match, Near, Phrase, _And, _Negated, _Not, _Or, with_terms

IDS_PER_BLOCK = 4096
BLOCK_SCHEMA = "term string, min_id bigint, max_id bigint, offs array<int>, pos array<bigint>, log_date date"


def build_postings(logs: DataFrame) -> DataFrame:
    """One row per token occurrence: term, id, position (0-based)."""
    base = with_terms(logs)
    cols = ["id"] + (["log_date"] if "log_date" in base.columns else [])
    return base.select(*cols, F.posexplode("terms").alias("pos", "term")).select(
        "term", "id", F.col("pos").cast("long").alias("pos"), *cols[1:])


# ------------------------------------------------------------------ blocks

_POS_BITS = 48  # an id's place in its range and a position are one number, in their order


def _packed(place: Column, pos: Column) -> Column:
    return F.shiftleft(F.coalesce(place, F.lit(0)).cast("bigint"), _POS_BITS) + pos


def _blocks(held: DataFrame) -> DataFrame:
    """Packed occurrences ``at``, in any order, of every range -> blocks."""
    def at_id(e: Column) -> Column:
        return F.shiftright(e, _POS_BITS)

    ends = held.withColumn("at", F.sort_array("at")).withColumns({
        "low": at_id(F.element_at("at", 1)), "high": at_id(F.element_at("at", -1)), "base": F.col("range") * F.lit(IDS_PER_BLOCK)})
    return ends.select("term", (F.col("base") + F.col("low")).alias("min_id"), (F.col("base") + F.col("high")).alias("max_id"),
                       F.transform("at", lambda e: (at_id(e) - F.col("low")).cast("int")).alias("offs"),
                       F.transform("at", lambda e: e.bitwiseAND(F.lit((1 << _POS_BITS) - 1))).alias("pos"), "log_date")


def to_blocks(found: DataFrame) -> DataFrame:
    """Occurrences (term, id, pos, log_date) -> blocks (BLOCK_SCHEMA)."""
    where = floor_div(F.col("id"), IDS_PER_BLOCK)
    place = F.col("id") - where * F.lit(IDS_PER_BLOCK)
    packed = found.select("log_date", "term", where.alias("range"), _packed(place, F.col("pos")).alias("at"))
    return _blocks(packed.groupBy("log_date", "term", "range").agg(F.collect_list("at").alias("at")))


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of one range (several appends') as one, as they are stored: no
    block is expanded to rows, and one shuffle both groups and orders them."""
    where = floor_div(F.col("min_id"), IDS_PER_BLOCK)
    first = F.col("min_id") - where * F.lit(IDS_PER_BLOCK)
    at = F.zip_with("offs", "pos", lambda o, p: _packed(first + o, p))
    each = blocks.select("log_date", "term", where.alias("range"), at.alias("at"))
    key = ["log_date", "term", "range"]
    held = each.repartitionByRange(*key).groupBy(*key).agg(F.flatten(F.collect_list("at")).alias("at"))
    return _blocks(held).sortWithinPartitions("log_date", "term", "min_id")


def occurrences(blocks: DataFrame, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Blocks -> (term, id, pos, log_date); with bounds only blocks that reach
    into them are read."""
    if first_id is not None:
        blocks = blocks.where(F.col("max_id") >= first_id)
    if last_id is not None:
        blocks = blocks.where(F.col("min_id") <= last_id)
    each = blocks.select("term", "log_date", "min_id", F.inline(F.arrays_zip("offs", "pos")))
    out = each.select("term", (F.col("min_id") + F.col("offs")).alias("id"), "pos", "log_date")
    if first_id is not None:
        out = out.where(F.col("id") >= first_id)
    return out if last_id is None else out.where(F.col("id") <= last_id)


def sorted_blocks(blocks: DataFrame, partitions: int | None = None) -> DataFrame:
    """Blocks as they are stored: ranges of (day, term), sorted."""
    order = ["log_date", "term", "min_id"]
    dealt = blocks.repartitionByRange(partitions, *order) if partitions else blocks.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def without_ids(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """The blocks without the occurrences of some ids; blocks that share no
    id range with them are not opened."""
    near = ids.select(floor_div(F.col("id"), IDS_PER_BLOCK).alias("range")).distinct()
    ranged = blocks.withColumn("range", floor_div(F.col("min_id"), IDS_PER_BLOCK))
    touched = ranged.join(near, "range", "left_semi").drop("range")
    rest = ranged.join(near, "range", "left_anti").drop("range")
    return rest.unionByName(to_blocks(occurrences(touched).join(ids.select("id"), "id", "left_anti")))


# ----------------------------------------------------------------- answers

def posting_hits(postings: DataFrame, match: Match) -> DataFrame:
    """Ids whose messages match, from occurrences alone: terms, prefixes,
    phrases and NEAR (by position), AND, OR and NOT."""
    if isinstance(match, Phrase):
        return _phrase_hits(postings, match)
    if isinstance(match, Near):
        return _near_hits(postings, match)
    if isinstance(match, Initial):
        return postings.where((F.col("term") == match.stem) & (F.col("pos") == 0)).select("id")
    if isinstance(match, _Or):
        return posting_hits(postings, match.a).unionAll(posting_hits(postings, match.b)).distinct()
    if isinstance(match, _Not):
        return posting_hits(postings, match.a).join(posting_hits(postings, match.b), "id", "left_anti")
    if isinstance(match, _And):
        if isinstance(match.b, _Negated):
            return posting_hits(postings, match.a).join(posting_hits(postings, match.b.inner), "id", "left_anti")
        return posting_hits(postings, match.a).join(posting_hits(postings, match.b), "id", "left_semi")
    raise ValueError("NOT needs a left operand: use a & ~b or a - b")


def _phrase_starts(postings: DataFrame, phrases: list[list[Column]]) -> DataFrame:
    """(id, which, start) of every phrase, each a list of conditions on
    ``term``: one scan.  A phrase starts where all its stems agree."""
    at = [F.when(c, F.struct(F.lit(k).alias("which"), F.lit(j).alias("nth"), (F.col("pos") - j).alias("start")))
          for k, conditions in enumerate(phrases) for j, c in enumerate(conditions)]
    wanted = None
    for conditions in phrases:
        for c in conditions:
            wanted = c if wanted is None else wanted | c
    rows = postings.where(wanted).select("id", F.inline(F.array_compact(F.array(*at))))
    length = F.element_at(F.array(*[F.lit(len(p)) for p in phrases]), F.col("which") + 1)
    agreed = rows.groupBy("id", "which", "start").agg(F.collect_set("nth").alias("nths"))
    return agreed.where(F.size("nths") == length).select("id", "which", "start")


def _phrase_hits(postings: DataFrame, match: Phrase) -> DataFrame:
    stems = match.stems
    if not stems:
        return postings.where("false").select("id")
    each = [F.col("term") == F.lit(s) for s in stems]
    if match.prefix:
        each[-1] = F.col("term").startswith(stems[-1])
    if len(stems) == 1:
        return postings.where(each[0]).select("id").distinct()
    return _phrase_starts(postings, [each]).select("id").distinct()


def _near_hits(postings: DataFrame, match: Near) -> DataFrame:
    """The position join: the starts of all phrases of an id are merged in
    order, and at each of them a running maximum holds the last start of every
    phrase.  They are the tightest cluster that ends there."""
    if not all(match.phrases):
        return postings.where("false").select("id")
    starts = _phrase_starts(postings, [[F.col("term") == F.lit(s) for s in p] for p in match.phrases])
    # an id without one of the phrases cannot match: it leaves before the sort
    ids = starts.groupBy("id").agg(F.count_distinct("which").alias("n")).where(F.col("n") == len(match.phrases)).select("id")
    merged = Window.partitionBy("id").orderBy("start", "which").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("which") == k, F.col("start"))).over(merged) for k in range(len(match.phrases))]
    rows = starts.join(ids, "id", "left_semi").select("id", "start", *[c.alias(f"last{k}") for k, c in enumerate(last)])
    ends = [F.col(f"last{k}") + len(p) for k, p in enumerate(match.phrases)]
    met = None
    for k in range(len(match.phrases)):
        here = F.col(f"last{k}").isNotNull()
        met = here if met is None else met & here
    first_end = F.least(*ends) if len(ends) > 1 else ends[0]
    return rows.where(met & (F.col("start") - first_end <= match.n)).select("id").distinct()


def search_postings(logs: DataFrame, postings: DataFrame, match: Match) -> DataFrame:
    """Log rows that match, answered from the postings (occurrences)."""
    return logs.join(posting_hits(postings, match), "id", "left_semi")
