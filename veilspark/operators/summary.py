"""Counts and summaries of entity lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.category import turkish


def summary(ents: Column, lang: Column) -> Column:
    """How many entities there are and how many of each category, in the order of their first appearance."""
    cats = F.array_distinct(F.transform(ents, lambda e: e["category"]))
    n = lambda c: F.size(F.filter(ents, lambda e: e["category"] == c)).cast("string")
    parts = F.transform(cats, lambda c: F.concat(n(c), F.lit(" "), F.when(lang == "tr", turkish(c)).otherwise(c)))
    head = F.concat(F.size(ents).cast("string"), F.when(lang == "tr", F.lit(" KV tespit edildi: ")).otherwise(F.lit(" PII entities found: ")))
    return F.concat(head, F.array_join(parts, ", "))


def enabled_summary(ents: Column) -> Column:
    return F.concat(F.size(F.filter(ents, lambda e: e["enabled"])).cast("string"), F.lit("/"), F.size(ents).cast("string"), F.lit(" entities enabled"))


def exploded(df: DataFrame, array: Column, *keys: str) -> DataFrame:
    """(keys, ord, e) for each element. The outer form: the inner one would add a filter on the array's size, which goes below the projections and computes the array again."""
    return df.select(*keys, F.posexplode_outer(array).alias("ord", "e")).where("ord IS NOT NULL")


def rows(df: DataFrame, key: str, ents: str = "entities") -> DataFrame:
    """One row for each entity: key, ord and its fields."""
    return exploded(df, F.col(ents), key).select(key, "ord", "e.*")


def category_counts(df: DataFrame, key: str, ents: str = "entities") -> DataFrame:
    return rows(df, key, ents).groupBy(key, "category").agg(F.count("*").alias("n"))


def corpus_rollup(df: DataFrame, by: str, ents: str = "entities") -> DataFrame:
    """An addition: entities by a column and category, with subtotals."""
    return exploded(df, F.col(ents), by).cube(by, F.col("e.category").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("e.enabled")).alias("n_enabled"))


def entity_table(df: DataFrame, key: str) -> DataFrame:
    """(key, row, original, category, placeholder, percent): entities as a numbered list, confidence in whole per cent."""
    return rows(df, key).select(key, (F.col("ord") + 1).alias("row"), "original", "category", "placeholder", F.round(F.col("confidence") * 100).cast("int").alias("percent"))
