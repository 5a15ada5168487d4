"""Order, limit and cursor paging (keyset paging on ``id``).

A page is ``TakeOrderedAndProject`` of ``limit + 1`` rows: per-partition
top-k, merged on the driver, bounded by the page size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logloom.operators.query import LogQuery, apply_query


def _order(q: LogQuery):
    return F.col("id").asc() if q.order == "asc" else F.col("id").desc()


def _rows(df: DataFrame, q: LogQuery, postings: DataFrame | None = None) -> DataFrame:
    # the search index column never leaves the store (and is not read at all
    # when no search is asked for, or posting lists answer it)
    return apply_query(df, q, postings=postings).drop("terms")


def fetch(df: DataFrame, q: LogQuery, postings: DataFrame | None = None) -> DataFrame:
    """The filtered rows in page order, one more than the page size."""
    return _rows(df, q, postings).orderBy(_order(q)).limit(q.page_size + 1)


def page(df: DataFrame, q: LogQuery, postings: DataFrame | None = None) -> DataFrame:
    """The page rows, in page order; full text from ``postings`` where given."""
    return _rows(df, q, postings).orderBy(_order(q)).limit(q.page_size)


def page_info(df: DataFrame, q: LogQuery, postings: DataFrame | None = None) -> DataFrame:
    """One row: rows on the page, has_more, next_cursor (id of the first row
    of the next page, kept as the store reports it), resume_id (last id on
    the page: the cursor to pass on), total_estimate (-1: not available)."""
    n = q.page_size
    rows = fetch(df, q, postings).select("id")
    edge = F.min("id") if q.order != "asc" else F.max("id")
    ranked = rows.withColumn("rn", F.row_number().over(Window.orderBy(_order(q))))
    return ranked.agg(
        F.least(F.count("*"), F.lit(n)).cast("long").alias("n_rows"),
        (F.count("*") > n).alias("has_more"),
        F.when(F.count("*") > n, edge).alias("next_cursor"),
        F.max_by("id", F.when(F.col("rn") <= n, F.col("rn"))).alias("resume_id"),
        F.lit(-1).cast("long").alias("total_estimate"),
    )


def next_page_query(q: LogQuery, resume_id: int) -> LogQuery:
    """Cursor for the next page: DESC pages continue with before_id, ASC with after_id."""
    if q.order == "asc":
        return q.with_(after_id=resume_id)
    return q.with_(before_id=resume_id)


def tail_initial(df: DataFrame, q: LogQuery, n: int = 50, postings: DataFrame | None = None) -> DataFrame:
    """Newest ``n`` matching rows, shown oldest first."""
    newest = _rows(df, q.with_(end_ns=None), postings).orderBy(F.col("id").desc()).limit(n)
    return newest.orderBy(F.col("id").asc())


def entry_neighbours(page_df: DataFrame, order: str = "desc") -> DataFrame:
    """Previous / next id within a page (clamped at the ends)."""
    o = F.col("id").asc() if order == "asc" else F.col("id").desc()
    w = Window.orderBy(o)
    return page_df.select(
        "id",
        F.coalesce(F.lag("id").over(w), F.col("id")).alias("prev_id"),
        F.coalesce(F.lead("id").over(w), F.col("id")).alias("next_id"),
    )


# ------------------------------------------------- pages of a stored table

#: Appends that a page asks the append log for at first.
_FEW_APPENDS = 16


def _covering(spark, path: str, q: LogQuery, rows: int) -> tuple[list | None, bool]:
    """The first append ranges, in page order, that hold ``rows`` ids or more
    between the cursors, and whether these are all of them; None where the
    table keeps no append log.  The log is asked for few rows at a time."""
    from logloom.sinks.appends import ranges as append_ranges

    after = q.after_id if q.after_id and q.after_id > 0 else None
    before = q.before_id if q.before_id and q.before_id > 0 else None
    most = _FEW_APPENDS
    while True:
        found = append_ranges(spark, path, after, before, q.order == "asc", most)
        if found is None:
            return None, True
        held = 0
        for k, (low, high, _) in enumerate(found):
            held += high - low + 1
            if held >= rows:
                return found[:k + 1], k + 1 == len(found) and len(found) < most
        if len(found) < most:
            return found, True
        most *= 4


def scope(table: DataFrame, ranges: list) -> DataFrame:
    """The rows of some append ranges: their days, and their ids there."""
    if not ranges:
        return table.where("false")
    days = sorted({d for r in ranges for d in r[2]})
    return table.where(F.col("log_date").isin(days) & F.col("id").between(min(r[0] for r in ranges),
                                                                          max(r[1] for r in ranges)))


def _postings(spark, path: str | None, ranges: list | None) -> DataFrame | None:
    """The posting lists of some append ranges."""
    from logloom.sources.logs import read_postings

    if path is None or ranges == []:
        return None
    if ranges is None:
        return read_postings(spark, path)
    days = sorted({d for r in ranges for d in r[2]})
    found = read_postings(spark, path, min(r[0] for r in ranges), max(r[1] for r in ranges))
    return found.where(F.col("log_date").isin(days))


def _stored(spark, path: str, q: LogQuery, postings_path: str | None, want: int) -> tuple[DataFrame, DataFrame | None]:
    """The part of a stored table that holds ``want`` matching rows, and its
    posting lists: the newest appends (oldest, in ascending order) until they
    give enough rows, four times as many ids at each attempt.  A table without
    an append log is read whole."""
    from logloom.sources.logs import read_logs

    table, ids = read_logs(spark, path), want
    while True:
        some, everything = _covering(spark, path, q, ids)
        part = table if some is None else scope(table, some)
        lists = _postings(spark, postings_path, some)
        if everything or _rows(part, q, lists).select("id").limit(want).count() >= want:
            return part, lists
        ids *= 4


def stored_scope(spark, path: str, q: LogQuery, postings_path: str | None = None) -> DataFrame:
    """The part of a stored table that holds the page of ``q``."""
    return _stored(spark, path, q, postings_path, q.page_size + 1)[0]


def stored_page(spark, path: str, q: LogQuery, postings_path: str | None = None) -> DataFrame:
    """A page of a stored table; full text from its posting lists where their
    path is given."""
    part, lists = _stored(spark, path, q, postings_path, q.page_size + 1)
    return page(part, q, lists)


def stored_page_info(spark, path: str, q: LogQuery, postings_path: str | None = None) -> DataFrame:
    part, lists = _stored(spark, path, q, postings_path, q.page_size + 1)
    return page_info(part, q, lists)


def stored_tail_initial(spark, path: str, q: LogQuery, n: int = 50, postings_path: str | None = None) -> DataFrame:
    """What a viewer of a stored table gets on connecting."""
    newest = q.with_(end_ns=None, order="desc", after_id=None, before_id=None)
    part, lists = _stored(spark, path, newest, postings_path, n)
    return tail_initial(part, newest, n, lists)


def stored_tail_resume(spark, path: str, q: LogQuery, last_id: int, limit: int = 100, postings_path: str | None = None) -> DataFrame:
    """The next ``limit`` rows of a stored table after ``last_id``, ascending."""
    later = q.with_(end_ns=None, after_id=last_id, before_id=None, order="asc")
    part, lists = _stored(spark, path, later, postings_path, limit)
    return _rows(part, later, lists).orderBy("id").limit(limit)


def get_by_id(spark, path: str, entry_id: int) -> DataFrame:
    """One stored entry (no row: not found), from the days its append wrote."""
    from logloom.sinks.appends import ranges as append_ranges
    from logloom.sources.logs import read_logs

    table, ranges = read_logs(spark, path), append_ranges(spark, path, entry_id - 1, entry_id + 1)
    if ranges is not None:
        table = scope(table, ranges)
    return table.where(F.col("id") == entry_id).limit(1)
