"""Names for SQL: functions of this library as temporary SQL functions, which Catalyst inlines; no Python runs in them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from . import category, dates, text

ENTITIES = "ARRAY<STRUCT<original: STRING, category: STRING, placeholder: STRING, enabled: BOOLEAN>>"


def _sql(spark: SparkSession, made: Column, **args: str) -> str:
    """An expression without lambdas over columns of the given names and types, as SQL."""
    frame = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {a}" for a, t in args.items()))
    return frame.select(made.alias("made"))._jdf.queryExecution().analyzed().projectList().head().child().sql()


def _redacted(by: str) -> str:
    """Enabled entities of any length put in turn, the longest in bytes first, as the renderers do."""
    live = "filter(entities, e -> e.enabled AND length(e.original) > 0)"
    order = f"array_sort(transform({live}, (e, i) -> struct(-octet_length(e.original) AS n, i AS i, e.original AS o, e.placeholder AS p)))"
    return f"aggregate({order}, body, (acc, x) -> replace(acc, x.o, {by}))"


def _parsed(spark: SparkSession) -> str:
    """dates.parsed of t."""
    found = []
    for kind, hit, fields in dates.rules(F.col("t")):
        test, parts = (_sql(spark, x, t="STRING") for x in (hit, fields))
        found.append(f"CASE WHEN {test} THEN get(transform(array({parts}), p -> {_sql(spark, dates.made(F.col('p'), kind), p='ARRAY<STRING>')}), 0) END")
    return f"CASE WHEN {_sql(spark, F.col('t').rlike(dates.DIGIT), t='STRING')} THEN coalesce({', '.join(found)}) END"


def register(spark: SparkSession) -> list[str]:
    """Create or replace the functions in this session; their names: normalize_category(raw), parse_date(input), redacted_tagged(body, entities), redacted_plain(body, entities)."""
    o, p = F.col("x.o"), F.col("x.p")
    clean = _sql(spark, dates.cleaned(F.col("input")), input="STRING")
    plain = _sql(spark, F.when(text.age_like(p), p).otherwise(text.blocks(o)), x="STRUCT<o: STRING, p: STRING>")
    made = {
        "normalize_category(raw STRING) RETURNS STRING": _sql(spark, category.normalize_category(F.col("raw")), raw="STRING"),
        "parse_date(input STRING) RETURNS DATE": f"get(transform(array({clean}), t -> {_parsed(spark)}), 0)",
        f"redacted_tagged(body STRING, entities {ENTITIES}) RETURNS STRING": _redacted("x.p"),
        f"redacted_plain(body STRING, entities {ENTITIES}) RETURNS STRING": _redacted(plain),
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in made]
