"""Where entities stand in a text, and which of overlapping places count."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .entities import enabled

SPAN = "struct<start:int,end:int,ord:int>"
SPANS = f"array<{SPAN}>"


def places(text: Column, original: Column) -> Column:
    """Start of each non-overlapping occurrence, from left to right, in characters."""
    quoted = F.concat(F.lit("\\Q"), F.replace(original, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.split(text, quoted, -1)
    n = F.length(original)
    out = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, p: F.struct((a["at"] + F.length(p) + n).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out")),
    )
    return F.when(n > 0, out["out"]).otherwise(F.array().cast("array<int>"))


def all_spans(text: Column, ents: Column) -> Column:
    """(start, end, ord) of every occurrence of every enabled entity; ord is the place in the list."""
    each = F.transform(ents, lambda e, i: F.when(e["enabled"], F.transform(places(text, e["original"]), lambda s: F.struct(s.alias("start"), (s + F.length(e["original"])).alias("end"), i.alias("ord")))).otherwise(F.array().cast(SPANS)))
    return F.flatten(each)


def kept_spans(spans: Column) -> Column:
    """Of spans that overlap the first to start stays, then the longest, then the first of the list."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["ord"].alias("ord"))))
    folded = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("last"), F.array().cast(SPANS).alias("kept")),
        lambda a, s: F.when(s["start"] >= a["last"], F.struct((-s["back"]).alias("last"), F.array_append(a["kept"], F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["ord"].alias("ord"))).alias("kept"))).otherwise(a),
    )
    return folded["kept"]


__all__ = ["all_spans", "enabled", "kept_spans", "places"]
