"""Entity lists: one array of structs for each document, in the order in which entities were found."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.category import date_like, label, normalize_category, subcategory, trimmed

ENTITY = "struct<original:string,category:string,subcategory:string,placeholder:string,confidence:double,enabled:boolean,start:bigint,end:bigint,manual:boolean>"
ENTITIES = f"array<{ENTITY}>"
ID_PATTERN = r"(?U)\b(?!0)\d{11}\b"


def entity(original, category, subcategory=None, placeholder="", confidence=0.9, enabled=True, start=None, end=None, manual=None) -> Column:
    """A struct of the entity type; plain values become literals."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    names = ("original", "category", "subcategory", "placeholder", "confidence", "enabled", "start", "end", "manual")
    values = (original, category, subcategory, placeholder, confidence, enabled, start, end, manual)
    return F.struct(*[col(v).alias(n) for n, v in zip(names, values, strict=True)]).cast(ENTITY)


def empty() -> Column:
    return F.array().cast(ENTITIES)


def from_model(rows: Column) -> Column:
    """Entities from a model's (original, category, confidence) rows: rows without text or category go, labels become canonical, confidence is 0.9 unless given."""
    good = F.filter(rows, lambda r: r["original"].isNotNull() & r["category"].isNotNull() & (F.length(trimmed(r["original"])) > 0))
    return F.transform(
        good,
        lambda r: entity(trimmed(r["original"]), normalize_category(r["category"]), subcategory(r["category"], normalize_category(r["category"])), confidence=F.coalesce(r["confidence"], F.lit(0.9))),
    )


def reclassified(ents: Column) -> Column:
    """Phones that read like dates become dates."""
    hit = lambda e: (e["category"] == "phone") & date_like(e["original"])
    return F.transform(ents, lambda e: F.when(hit(e), e.withField("category", F.lit("date")).withField("subcategory", F.lit("date"))).otherwise(e))


def national_ids(text: Column) -> Column:
    """The distinct 11-digit numbers of a text that do not begin with 0, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ID_PATTERN), 0))


def supplemented(ents: Column, text: Column) -> Column:
    """The list, then the national ids of the text that no entity holds yet. Offsets are bytes, as of the id's first place."""
    new = F.filter(national_ids(text), lambda x: ~F.exists(ents, lambda e: e["original"] == x))
    first = lambda x: F.octet_length(F.substring(text, F.lit(1), F.position(x, text) - 1)).cast("bigint")
    return F.concat(ents, F.transform(new, lambda x: entity(x, "id", "national_id", confidence=0.85, start=first(x), end=first(x) + 11)))


def numbered(ents: Column) -> Column:
    """Placeholders [LABEL_n], n counting a category's entities in list order."""
    rank = lambda e, i: F.size(F.filter(F.slice(ents, F.lit(1), i + 1), lambda x: x["category"] == e["category"]))
    return F.transform(ents, lambda e, i: e.withField("placeholder", F.concat(F.lit("["), label(e["category"]), F.lit("_"), rank(e, i).cast("string"), F.lit("]"))))


def enabled(ents: Column) -> Column:
    return F.filter(ents, lambda e: e["enabled"])


def toggled(ents: Column, index: Column, value: Column) -> Column:
    """The list with one entity switched; an index outside it is an error."""
    out = F.transform(ents, lambda e, i: F.when(i == index, e.withField("enabled", value)).otherwise(e))
    return F.when((index >= 0) & (index < F.size(ents)), out).otherwise(F.raise_error(F.lit("entity index out of range")))


def toggled_category(ents: Column, category: Column, value: Column) -> Column:
    return F.transform(ents, lambda e: F.when(e["category"] == category, e.withField("enabled", value)).otherwise(e))


def all_set(ents: Column, value: bool) -> Column:
    return F.transform(ents, lambda e: e.withField("enabled", F.lit(value)))


def with_manual(ents: Column, original: Column) -> Column:
    """The list and a manual entity [REDACTED_n], unless one with that text is there."""
    n = F.size(F.filter(ents, lambda e: F.coalesce(e["manual"], F.lit(False)))) + 1
    new = entity(original, "manual", placeholder=F.concat(F.lit("[REDACTED_"), n.cast("string"), F.lit("]")), confidence=1.0, manual=True)
    return F.when(F.exists(ents, lambda e: e["original"] == original), ents).otherwise(F.array_append(ents, new))


def without_manual(ents: Column, index: Column) -> Column:
    return F.filter(ents, lambda e, i: ~((i == index) & F.coalesce(e["manual"], F.lit(False))))
