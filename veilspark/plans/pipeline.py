"""The three ways in: scan documents, work on found entities again, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.dates import parse_date
from ..operators import birth, detect, entities as E, render, spans, summary
from ..sources import readers, sink


def with_birth(df: DataFrame, as_of: Column, override: Column | None = None) -> DataFrame:
    """df (text, entities) with dates and found (birth, ord)."""
    df = df.withColumn("dates", birth.dated(F.col("entities"))).withColumn("scan", birth.scanned(F.col("text"), as_of))
    found = birth.overridden(F.col("dates"), parse_date(override)) if override is not None else birth.detected(F.col("dates"), F.col("text"), F.col("scan"))
    return df.withColumn("found", found)


def with_ages(df: DataFrame, age_mode: bool = True, as_of: Column | None = None, override: Column | None = None) -> DataFrame:
    """df (text, lang, entities) with ages for dates and detected_birth_date; without age_mode the date is found alone."""
    df = with_birth(df, as_of if as_of is not None else F.current_date(), override)
    if age_mode:
        df = df.withColumn("entities", birth.aged(F.col("entities"), F.col("dates"), F.col("found.birth"), F.col("found.ord"), F.col("lang")))
    return df.withColumn("detected_birth_date", F.date_format("found.birth", "dd.MM.yyyy")).drop("dates", "scan", "found")


def rendered(df: DataFrame) -> DataFrame:
    df = df.withColumn("spans", spans.kept_spans(spans.all_spans(F.col("text"), F.col("entities"))))
    t, e, s = F.col("text"), F.col("entities"), F.col("spans")
    return df.withColumns({"highlighted_html": render.highlighted_html(t, e, s), "redacted_html": render.redacted_html(t, e, s)}).drop("spans")


def scan(docs: DataFrame, detector: detect.Detector | None = None, age_mode: bool = True, as_of: Column | None = None) -> DataFrame:
    """docs (text, lang, ...) with entities, highlighted_html, redacted_html, summary, detected_birth_date and error. All steps work row by row: no shuffle."""
    df = detect.corrected((detector or detect.RuleDetector()).detect(docs))
    df = with_ages(df.withColumn("entities", E.numbered(F.col("entities"))), age_mode, as_of)
    return rendered(df).withColumn("summary", summary.summary(F.col("entities"), F.col("lang")))


def recalc(df: DataFrame, age_mode: bool = True, as_of: Column | None = None, override: Column | None = None) -> DataFrame:
    """Numbers, ages and forms again over entities that are known; manual entities are numbered like all others."""
    out = with_ages(df.withColumn("entities", E.numbered(F.col("entities"))), age_mode, as_of, override)
    return rendered(out).withColumn("summary", summary.enabled_summary(F.col("entities")))


def scan_folder(spark: SparkSession, folder: str, out: str, fmt: str, checkpoint: str, detector: detect.Detector | None = None, delay: str = "1 day", lang: str = "en") -> DataStreamWriter:
    """A stream from files of a folder to redacted files in another: each file that comes is opened, scanned and exported once.

    A file is known by its name and content, and one that comes again within `delay` (a copy job
    that ran twice, a folder moved back) is dropped by state that the watermark bounds. The clock
    is that of the batches, not of the files, so an old file is never late. Files that cannot be
    read pass by with no output. The sink replaces a batch that runs again.
    """
    files = readers.read_folder_stream(spark, folder).where("error IS NULL")
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    docs = files.select(name.alias("name"), "text", F.lit(lang).alias("lang"), F.current_timestamp().alias("at"), F.sha2("text", 256).alias("digest"))
    once = docs.withWatermark("at", delay).dropDuplicatesWithinWatermark(["name", "digest"])
    return sink.save_stream(scan(once, detector, age_mode=False), "name", fmt, out, checkpoint)


def toggle(df: DataFrame, index: Column, value: Column) -> DataFrame:
    out = rendered(df.withColumn("entities", E.toggled(F.col("entities"), index, value)))
    return out.withColumn("summary", summary.enabled_summary(F.col("entities"))).withColumn("detected_birth_date", F.lit(None).cast("string"))
