"""Categories of personal data: canonical names, labels, colours and their corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: The canonical categories in order, their placeholder labels, colours and Turkish names.
CATEGORIES = ("name", "date", "id", "address", "phone", "email", "institution", "age")
LABELS = {"name": "NAME", "date": "DATE", "id": "ID", "address": "ADDR", "phone": "PHONE", "email": "EMAIL", "institution": "INST", "age": "AGE"}
COLOURS = {"name": "#d46b6b", "date": "#d4884e", "id": "#d4a04e", "address": "#6bbd6b", "phone": "#5ba8b5", "email": "#7aabdb", "institution": "#9b8ec4", "age": "#c47a8e", "manual": "#6b8fd4"}
TURKISH = {"name": "ad", "date": "tarih", "id": "kimlik", "address": "adres", "phone": "telefon", "email": "e-posta", "institution": "kurum", "age": "yaş"}
#: For each category, in the order they are tried, what a label contains or equals.
CONTAINS = {
    "name": ("name", "ad", "soyad"),
    "date": ("date", "tarih", "birth", "doğum", "visit", "muayene"),
    "id": ("id", "kimlik", "tc", "ssn", "protocol", "protokol"),
    "address": ("address", "adres", "location", "konum", "city", "şehir"),
    "phone": ("phone", "telefon", "tel", "mobile", "cep"),
    "email": ("email", "e-posta", "mail"),
    "institution": ("institution", "hospital", "hastane", "university", "üniversite", "kurum", "clinic", "klinik", "school", "pharmacy", "eczane"),
    "age": ("age", "yaş"),
}
EQUALS = {"name": ("doctor", "doktor", "patient", "hasta"), "institution": ("organization", "org")}

EDGE = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, EDGE, "")


def lookup(c: Column, values: dict[str, str], other: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(other) if isinstance(other, str) else other)


def normalize_category(raw: Column, strict: bool = False) -> Column:
    """The canonical category of a free label: the first whose cues it holds, else name. strict: a label that is canonical already stays."""
    low = trimmed(F.lower(raw))
    out = F.lit("name")
    for cat in reversed(CATEGORIES):
        cues = [low.contains(x) for x in CONTAINS[cat]] + [low == x for x in EQUALS.get(cat, ())]
        out = F.when(reduce(lambda a, b: a | b, cues), F.lit(cat)).otherwise(out)
    out = F.when(low.isin(*CATEGORIES), low).otherwise(out) if strict else out
    return F.when(raw.isNotNull(), out)


def subcategory(raw: Column, category: Column) -> Column:
    low = F.lower(raw)
    return F.when(low != category, low)


DATE_LIKE = r"(?U)\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}"


def date_like(c: Column) -> Column:
    return c.rlike(DATE_LIKE)


def label(category: Column) -> Column:
    return lookup(category, LABELS, "PII")


def colour(category: Column) -> Column:
    return lookup(category, COLOURS, "#808080")


def turkish(category: Column) -> Column:
    return lookup(category, TURKISH, "diğer")
