"""Birth dates found in documents, and dates turned into ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.dates import age_diff, age_phrase, parse_date, plausible_birth

#: Subcategories that mean a birth date, and cues before and behind a date.
SUBCATEGORIES = ("birth_date", "date_of_birth", "dob", "dogum_tarihi", "doğum_tarihi", "dogum", "doğum")
BEFORE = (
    "doğum tarihi", "dogum tarihi", "doğum tar.", "d.tarihi", "dtarihi", "d. tarihi", "d tarihi", "doğum:", "dogum:", "doğ.tar.", "doğ.tar:", "doğ tar",
    "d.t.", "d.t:", "dt:", "dt.", "yaş:", "yas:", "yaşı:", "yasi:", "doğ:", "dog:", "date of birth", "birth date", "birthdate", "born on", "born:",
    "dob:", "dob ", "dob.", "d.o.b.", "d.o.b:", "doğum", "dogum",
)
AFTER = ("doğumlu", "dogumlu", "doğ.", "doğumludur", "dogumludur", "born", "d.t.", "doğum tarihli", "dogum tarihli")
#: Parts of the patterns.
NUM, ISO, NAMED, PAREN = r"(\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4})", r"(\d{4}-\d{1,2}-\d{1,2})", r"(\d{1,2}\s+\w+\s+\d{4})", r"(?:\s*\([^)]*\))?"
ENGLISH = r"(?:date\s*of\s*birth|dob|birth\s*date)"
#: Patterns of a labelled birth date in the order they are tried.
SCANS = (
    rf"do[gğ]um\s*tarihi{PAREN}\s*[:=]?\s*{NUM}", rf"do[gğ]um\s*tarihi{PAREN}\s*[:=]?\s*{ISO}", rf"do[gğ]um\s*tarihi{PAREN}\s*[:=]?\s*{NAMED}",
    rf"d\.?\s*tarihi{PAREN}\s*[:=]?\s*{NUM}", rf"d\.?\s*tarihi{PAREN}\s*[:=]?\s*{ISO}", rf"d\.?\s*t\.?\s*[:=]\s*{NUM}",
    rf"do[gğ]umlu\s*[:=]?\s*{NUM}", rf"{NUM}\s*do[gğ]umlu", rf"do[gğ]\.?\s*tar\.?\s*[:=]?\s*{NUM}",
    rf"{ENGLISH}{PAREN}\s*[:=]?\s*{NUM}", rf"{ENGLISH}{PAREN}\s*[:=]?\s*{ISO}", rf"born\s+(?:on\s+)?{NUM}", rf"d\.o\.b\.?\s*[:=]?\s*{NUM}",
)
#: Cheap cues without one of which none of the first nine patterns, none of the other four can match.
GATES = ((9, r"(?iU)do[gğ]|d\.?\s*t"), (4, r"(?iU)birth|dob|born|d\.o\.b"))
BEFORE_CHARS, AFTER_CHARS = 120, 40
FOUND = "struct<birth:date,ord:int>"


def scanned(text: Column, as_of: Column) -> Column:
    """The date of the first pattern whose first match gives a plausible birth date."""
    parts, at = [], 0
    for n, gate in GATES:
        parts.append(F.when(text.rlike(gate), F.array(*[F.regexp_extract(text, f"(?iU){p}", 1) for p in SCANS[at : at + n]])).otherwise(F.array().cast("array<string>")))
        at += n
    dates = F.transform(F.filter(F.concat(*parts), lambda x: x != ""), parse_date)
    return F.get(F.filter(dates, lambda d: d.isNotNull() & plausible_birth(d, as_of)), F.lit(0))


def dated(ents: Column) -> Column:
    """(birth, ord, category, subcategory, original) of all entities; birth is the date that the text of a date, or of a birth subcategory, gives."""
    asked = lambda e: (e["category"] == "date") | F.coalesce(F.lower(e["subcategory"]).isin(*SUBCATEGORIES), F.lit(False))
    return F.transform(ents, lambda e, i: F.struct(F.when(asked(e), parse_date(e["original"])).alias("birth"), i.alias("ord"), e["category"].alias("category"), e["subcategory"].alias("subcategory"), e["original"].alias("original")))


def _first(dates: Column, test) -> Column:
    hits = F.filter(dates, lambda d: d["birth"].isNotNull() & test(d))
    return F.get(F.transform(hits, lambda d: F.struct(d["birth"].alias("birth"), d["ord"].alias("ord"))), F.lit(0)).cast(FOUND)  # the hits are read once


def by_scan(dates: Column, scan: Column) -> Column:
    return _first(dates, lambda d: (d["category"] == "date") & (d["birth"] == scan))


def by_subcategory(dates: Column) -> Column:
    return _first(dates, lambda d: F.lower(d["subcategory"]).isin(*SUBCATEGORIES))


def by_context(dates: Column, text: Column) -> Column:
    """The first date with a cue in the 120 characters before its first occurrence or in the 40 behind it."""
    before, after = ("|".join(rf"\Q{c}\E" for c in cues) for cues in (BEFORE, AFTER))

    def near(d: Column, low: Column) -> Column:
        o = F.lower(d["original"])

        def cued(at: Column) -> Column:
            head = F.substring(low, F.greatest(at - BEFORE_CHARS, F.lit(1)), F.least(at - 1, F.lit(BEFORE_CHARS)))
            return (at > 0) & (head.rlike(before) | F.substring(low, at + F.length(o), F.lit(AFTER_CHARS)).rlike(after))

        return (d["category"] == "date") & F.exists(F.array(F.position(o, low)), cued)

    return F.get(F.transform(F.array(F.lower(text)), lambda low: _first(dates, lambda d: near(d, low))), F.lit(0))


def earliest(dates: Column) -> Column:
    """The earliest of two dates or more, of equal ones the first."""
    ok = F.filter(dates, lambda d: (d["category"] == "date") & d["birth"].isNotNull())
    return F.when(F.size(ok) >= 2, F.array_min(F.transform(ok, lambda d: F.struct(d["birth"].alias("birth"), d["ord"].alias("ord"))))).cast(FOUND)


def detected(dates: Column, text: Column, scan: Column) -> Column:
    """Birth date and its entity: a labelled date, else a subcategory, else a cue nearby, else the earliest."""
    return F.coalesce(by_scan(dates, scan), by_subcategory(dates), by_context(dates, text), earliest(dates))


def aged(ents: Column, dates: Column, birth: Column, ord_: Column, lang: Column) -> Column:
    """Date entities with an age for a placeholder: all that give a date but the birth date's own; without a birth date nothing changes."""

    def one(e: Column, i: Column) -> Column:
        d = F.get(dates, i)["birth"]
        years, months = age_diff(birth, d)
        use = birth.isNotNull() & (e["category"] == "date") & d.isNotNull() & ~F.coalesce(i == ord_, F.lit(False))
        return F.when(use, e.withField("placeholder", age_phrase(years, months, lang))).otherwise(e)

    return F.transform(ents, one)


def overridden(dates: Column, birth: Column) -> Column:
    """A given birth date and the first entity that has it, if any."""
    hit = F.get(F.filter(dates, lambda d: (d["category"] == "date") & (d["birth"] == birth)), F.lit(0))
    return F.when(birth.isNotNull(), F.struct(birth.alias("birth"), hit["ord"].alias("ord")).cast(FOUND))
