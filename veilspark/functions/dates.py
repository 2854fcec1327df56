"""Dates in free text, ages between dates and how they read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .category import trimmed

#: Month names in Turkish (and without its letters) and English (and short).
MONTHS = {
    "ocak": 1, "şubat": 2, "subat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "mayis": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "agustos": 8,
    "eylül": 9, "eylul": 9, "ekim": 10, "kasım": 11, "kasim": 11, "aralık": 12, "aralik": 12,
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
WORD = "([a-zA-ZçğıöşüÇĞİÖŞÜ]+)"
GAP = r"[\s.\-]+"
#: Patterns in the order they are tried, and which groups are year, month and day ("1": the first of the year or month).
RULES = (
    (r"^(\d{1,2})[./\-](\d{1,2})[./\-](\d{2,4})\b", "short", 3, 2, 1),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})\b", "full", 1, 2, 3),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})\b", "full", 1, 2, 3),
    (rf"^(\d{{1,2}}){GAP}{WORD}{GAP}(\d{{4}})\b", "named", 3, 2, 1),
    (rf"^{WORD}{GAP}(\d{{1,2}}),?\s*(\d{{4}})\b", "named", 3, 1, 2),
    (rf"^{WORD}{GAP}(\d{{4}})\b", "named", 2, 1, None),
    (rf"^(\d{{4}}){GAP}{WORD}\b", "named", 1, 2, None),
    (r"^(\d{1,2})[./](\d{4})\b", "full", 2, 1, None),
    (r"^(\d{4})$", "year", 1, None, None),
    (r"(\d{1,2})[./\-](\d{1,2})[./\-](\d{2,4})", "short", 3, 2, 1),
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", "full", 1, 2, 3),
    (r"\b(\d{4})\b", "year", 1, None, None),
)
FIRST_YEAR, LAST_YEAR = 1900, 2100
DIGIT = r"(?U)\d"


def expand_year(y: Column) -> Column:
    return F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)


def calendar(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where the calendar has none."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), two(m), F.lit("-"), two(d)).try_cast("date")


def parse_date(text: Column) -> Column:
    """The date that a text gives by the first rule with a valid one; an invalid date falls through to later rules."""
    return F.get(F.transform(F.array(cleaned(text)), parsed), F.lit(0))  # a lambda's variable is computed once, however often rules use it


def cleaned(text: Column) -> Column:
    return F.replace(trimmed(text), F.lit("\u00a0"), F.lit(" "))


def made(part: Column, kind: str) -> Column:
    """The date of (year, month, day) as a rule of this kind reads them."""
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    year = part[0].try_cast("int")
    month = F.try_element_at(months, F.lower(part[1])) if kind == "named" else part[1].try_cast("int")
    out = calendar(expand_year(year) if kind == "short" else year, month, part[2].try_cast("int"))
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), out) if kind == "year" else out


def rules(t: Column) -> list[tuple[str, Column, Column]]:
    """For each rule its kind, whether it matches, and (year, month, day) by one match."""
    out = []
    for pattern, kind, y, m, d in RULES:
        whole = rf"(?sU){pattern}.*\z" if pattern.startswith("^") else rf"(?sU)^.*?{pattern}.*\z"
        out.append((kind, t.rlike(f"(?U){pattern}"), F.split(F.regexp_replace(t, whole, "|".join("1" if g is None else f"${g}" for g in (y, m, d))), r"\|")))
    return out


def parsed(t: Column) -> Column:
    found = [F.when(hit, F.get(F.transform(F.array(fields), lambda p: made(p, kind)), F.lit(0))) for kind, hit, fields in rules(t)]
    return F.when(t.rlike(DIGIT), F.coalesce(*found))


def age_diff(birth: Column, event: Column) -> tuple[Column, Column]:
    """Years and months by calendar fields, each no less than 0."""
    months = F.month(event) - F.month(birth) - F.when(F.dayofmonth(event) < F.dayofmonth(birth), 1).otherwise(0)
    years = F.year(event) - F.year(birth)
    return F.greatest(years - F.when(months < 0, 1).otherwise(0), F.lit(0)), F.greatest(F.when(months < 0, months + 12).otherwise(months), F.lit(0))


def age_phrase(years: Column, months: Column, lang: Column) -> Column:
    turkish = lang == "tr"
    y, m = years.cast("string"), months.cast("string")
    return (
        F.when((years == 0) & (months == 0), F.when(turkish, "doğduğu gün").otherwise("at birth"))
        .when(months == 0, F.when(turkish, F.concat(y, F.lit(" yaşında"))).otherwise(F.concat(F.lit("age "), y)))
        .otherwise(F.when(turkish, F.concat(y, F.lit(" yıl "), m, F.lit(" ay"))).otherwise(F.concat(F.lit("age "), y, F.lit(" yr "), m, F.lit(" mo"))))
    )


def plausible_birth(d: Column, as_of: Column) -> Column:
    """An age of 0 to 120 on the day as_of."""
    not_yet = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(d) * 100 + F.dayofmonth(d))
    return (F.year(as_of) - F.year(d) - F.when(not_yet, 1).otherwise(0)).between(0, 120)
