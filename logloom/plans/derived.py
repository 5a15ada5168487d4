"""More line shapes derived from ``events`` (exercising aliases, the cap,
logfmt escapes, severity patterns and severity spellings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.severity import SEVERITY_LABELS
from logloom.plans.fixtures import log_view

CAP_EVERY = 50
EXTRA_FIELDS = 20


def _label(sev: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in SEVERITY_LABELS]), (sev + 1).cast("int"))


def alias_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies spelled with aliases (lvl, message, userId, traceId,
    span-id, requestID, file, app); every 50th carries 20 extra numeric
    fields so the 20-attribute cap applies."""
    lv = log_view(spark, sf_dir)
    eid = F.col("event_id")
    extras = F.concat(*[F.lit(f',"f{i:02d}":{i}') for i in range(1, EXTRA_FIELDS + 1)])
    body = F.concat(
        F.lit('{"lvl":"'), F.lower(_label(F.col("severity"))), F.lit('","message":"'), F.col("message"),
        F.lit('","userId":'), F.col("user_id").cast("string"),
        F.lit(',"traceId":"t'), eid.cast("string"), F.lit('","span-id":"s'), F.col("k"),
        F.lit('","requestID":"r'), eid.cast("string"), F.lit('","file":"main.go","app":"shop"'),
        F.when(eid % CAP_EVERY == 0, extras).otherwise(F.lit("")), F.lit("}"))
    return lv.select(F.col("id").alias("arrival"), body.alias("line"))


def escaped_logfmt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""logfmt bodies with an escaped quote and tab, a hyphenated alias key,
    an empty value, a path, two bad tokens and a repeated key."""
    lv = log_view(spark, sf_dir)
    body = F.concat(
        F.lit("lvl="), F.lower(_label(F.col("severity"))),
        F.lit(' msg="'), F.col("message"), F.lit(' \\"quoted\\"\\tend"'),
        F.lit(" trace-id=t"), F.col("event_id").cast("string"),
        F.lit(" empty= path=/api/items/"), F.col("k"),
        F.lit(' weird"tok junk flag=on flag=off'))
    return lv.select(F.col("id").alias("arrival"), body.alias("line"))


def pattern_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unstructured bodies: ``[level] msg`` (lower case), ``LEVEL: msg``, or a
    level in parentheses (no pattern)."""
    lv = log_view(spark, sf_dir)
    eid, lab = F.col("event_id"), _label(F.col("severity"))
    body = (F.when(eid % 3 == 0, F.concat(F.lit("["), F.lower(lab), F.lit("] "), F.col("message")))
            .when(eid % 3 == 1, F.concat(lab, F.lit(": "), F.col("message")))
            .otherwise(F.concat(F.col("message"), F.lit(" ("), lab, F.lit(")"))))
    return lv.select("id", body.alias("body"))


def severity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity spellings: upper, lower, capitalised (not accepted), and the
    WARNING / PANIC synonyms on even ids."""
    lv = log_view(spark, sf_dir)
    eid, sev = F.col("event_id"), F.col("severity")
    lab = (F.when((sev == 4) & (eid % 2 == 0), F.lit("WARNING"))
           .when((sev == 6) & (eid % 2 == 0), F.lit("PANIC")).otherwise(_label(sev)))
    word = (F.when(eid % 3 == 0, lab).when(eid % 3 == 1, F.lower(lab))
            .otherwise(F.concat(F.substring(lab, 1, 1), F.lower(F.substring(lab, 2, 100)))))
    return lv.select("id", word.alias("word"))
