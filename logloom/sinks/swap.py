"""Replacing and removing files of a table, safe against a lost driver.

A job first stages all it will do below its own folder: the new files, and one
row per step.  Then it takes the steps: ``hide`` renames a replaced file to a
name that readers skip, ``show`` renames a staged file into the table, and only
when every staged file is in its place with its number of bytes are hidden
files and those of ``remove`` steps deleted.  Each step does nothing when it
was done before, so a job that died is finished by whichever job of the table
comes next (:func:`resume`).  A file that was not there when the job was staged
is never touched, so appends may go on meanwhile.

No reader sees a row twice.  One that lists a day while a job takes its steps
misses the rows of the files that are hidden just then.
"""

from __future__ import annotations

import datetime as _dt
import zlib

from pyspark.sql import DataFrame, SparkSession

from logloom.sinks import fs

_READY, _TRASH = "ready", ".done"
_STEP = "action string, file string, target string, size bigint"


def stage_name(path: str, job: str) -> str:
    """Name of the stage folder of a job of the table at ``path``."""
    return f"swap-{zlib.crc32(path.rstrip('/').encode()):08x}-{job}"


def day_files(spark: SparkSession, root: str) -> dict[_dt.date, list[str]]:
    """Data files of every day of a table."""
    out = {}
    for name, full in fs.list_dirs(spark, root):
        if name.startswith("log_date="):
            day = _dt.date.fromisoformat(name.split("=", 1)[1])
            out[day] = [f for n, f in fs.list_dirs(spark, full) if n.endswith(".parquet") and n[0] not in "._"]
    return out


def removal(files: list[str]) -> list[tuple]:
    return [("remove", f, None, None) for f in files]


def replacement(spark: SparkSession, rows: DataFrame, replaced: list[str], at: str, tag: str) -> list[tuple]:
    """Stage ``rows`` below ``at``; the steps that put them in the place of the
    ``replaced`` files of one day."""
    rows.write.mode("overwrite").parquet(at)
    folder = replaced[0].rsplit("/", 1)[0]
    return _hidden(replaced, tag) + _shown(spark, at, folder, tag)


def replacement_of_days(spark: SparkSession, rows: DataFrame, root: str, replaced: dict[_dt.date, list[str]], at: str,
                        tag: str) -> list[tuple]:
    """The same for files of several days (``rows`` with ``log_date``), staged
    in one job; a day may have no file to replace."""
    return replacement_by(spark, rows, "log_date", root, [f for files in replaced.values() for f in files], at, tag)


def replacement_by(spark: SparkSession, rows: DataFrame, by: str, root: str, replaced: list[str], at: str, tag: str,
                   below: str = "") -> list[tuple]:
    """The same for files of any folders: ``rows`` go to the folder of their
    ``by`` under ``root`` (there to the folder ``below``)."""
    rows.write.mode("overwrite").partitionBy(by).parquet(at)
    steps = _hidden(replaced, tag)
    for name, full in fs.list_dirs(spark, at):
        if name.startswith(f"{by}="):
            steps += _shown(spark, full, f"{root.rstrip('/')}/{name}{below}", tag)
    return steps


def _hidden(files: list[str], tag: str) -> list[tuple]:
    return [("hide", f, "{}/_old-{}-{}".format(f.rsplit("/", 1)[0], tag, f.rsplit("/", 1)[1]), None) for f in files]


def _shown(spark: SparkSession, at: str, folder: str, tag: str) -> list[tuple]:
    return [("show", f, f"{folder}/{tag}-{n}", fs.size(spark, f)) for n, f in fs.list_dirs(spark, at) if n.endswith(".parquet")]


def commit(spark: SparkSession, stage: str, steps: list[tuple], result: int) -> int:
    """Write the steps down, take them, and return ``result``."""
    spark.createDataFrame(steps, _STEP).coalesce(1).write.mode("overwrite").parquet(f"{stage}/steps")
    spark.createDataFrame([(result,)], "result bigint").coalesce(1).write.mode("overwrite").parquet(f"{stage}/{_READY}.tmp")
    _moved(spark, f"{stage}/{_READY}.tmp", f"{stage}/{_READY}")
    return _finish(spark, stage)


def resume(spark: SparkSession, path: str, stage_root: str) -> dict[str, int]:
    """Finish the staged jobs of a table; their results by stage name."""
    out = {}
    for entry, full in fs.list_dirs(spark, stage_root.rstrip("/")):
        if not entry.startswith(stage_name(path, "")):
            continue
        if entry.endswith(_TRASH) or not fs.exists(spark, f"{full}/{_READY}"):
            fs.delete(spark, full)  # finished, or died while staging: nothing was touched
        else:
            out[entry] = _finish(spark, full)
    return out


def _moved(spark: SparkSession, src: str, dst: str) -> None:
    """Rename, done before or now; an error where neither is so."""
    if fs.exists(spark, src):
        if fs.exists(spark, dst):
            raise RuntimeError(f"both {src} and {dst} exist")
        if not fs.rename(spark, src, dst):
            raise RuntimeError(f"could not rename {src} to {dst}")
    if not fs.exists(spark, dst):
        raise RuntimeError(f"{dst} is missing after the rename of {src}")


def _finish(spark: SparkSession, stage: str) -> int:
    result = int(spark.read.parquet(f"{stage}/{_READY}").first()[0])
    steps = spark.read.schema(_STEP).parquet(f"{stage}/steps").collect()  # one row per file that the job touches
    shown = [s for s in steps if s.action == "show"]
    hidden = [s for s in steps if s.action == "hide"]
    if not all(fs.exists(spark, s.target) for s in shown) or not shown:  # else everything is in its place
        for s in hidden:
            _moved(spark, s.file, s.target)
        for folder in {s.target.rsplit("/", 1)[0] for s in shown}:
            fs.make_dir(spark, folder)
        for s in shown:
            _moved(spark, s.file, s.target)
    for s in shown:
        if fs.size(spark, s.target) != s.size:
            raise RuntimeError(f"{s.target} has not the {s.size} bytes that were staged")
    for s in steps:
        if s.action != "show":
            fs.delete(spark, s.target or s.file)
    for folder in {s.file.rsplit("/", 1)[0] for s in steps if s.action == "remove"}:
        if all(n[0] in "._" for n, _ in fs.list_dirs(spark, folder)):
            fs.delete(spark, folder)
    if not fs.rename(spark, stage, stage + _TRASH):  # in one step: from here on the job is over
        raise RuntimeError(f"could not rename {stage}")
    try:
        fs.delete(spark, stage + _TRASH)
    except Exception:  # the next job removes it
        pass
    return result
