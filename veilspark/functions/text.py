"""Text functions: escapes, markup, replies of a model before they are parsed, names of files and models."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, functions as F

from .category import trimmed

HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
XML = (*HTML, ("'", "&apos;"))
#: Quantisation tokens in the order they are looked for, and sizes in GiB below which one is inferred.
QUANTISATIONS = ("Q2_K", "Q3_K_S", "Q3_K_M", "Q3_K_L", "Q4_0", "Q4_1", "Q4_K_S", "Q4_K_M", "Q5_0", "Q5_1", "Q5_K_S", "Q5_K_M", "Q6_K", "Q8_0", "F16", "F32")
BY_SIZE = ((3.0, "Q4_0"), (5.0, "Q4_K_M"), (8.0, "Q5_K_M"), (12.0, "Q6_K"))


def replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def html_escape(c: Column) -> Column:
    return replaced(c, HTML)


def xml_escape(c: Column) -> Column:
    return replaced(c, XML)


def strip_markup(xml: Column) -> Column:
    """Text of word-processing XML (or of any markup): paragraphs end lines, breaks and tabs stay, other tags go, five entities decode, at most one empty line remains."""
    end, brk, tab = "\ue000", "\ue001", "\ue002"
    t = F.regexp_replace(xml, r"(?s)<[^<>]*(?=<)", "")  # a tag that another interrupts
    t = F.regexp_replace(t, r"</w:p>", end)
    t = F.regexp_replace(t, r"(?s)<w:br(?:/| [^>]*)?>", brk)
    t = F.regexp_replace(t, r"(?s)<w:tab(?:/| [^>]*)?>", tab)
    t = F.regexp_replace(t, r"(?s)<[^>]*(?:>|$)", "")
    t = F.replace(t, F.lit(">"), F.lit(""))
    t = replaced(t, ((brk, "\n"), (tab, "\t")))
    t = F.regexp_replace(t, f"(?<=\n){end}+", "")
    t = F.regexp_replace(t, f"{end}+", "\n")
    t = replaced(t, (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")))
    return trimmed(F.regexp_replace(t, "\n{3,}", "\n\n"))


def think_strip(raw: Column) -> Column:
    """Without closed thinking blocks, and without everything from an unclosed one on."""
    return F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")


def fence_strip(raw: Column) -> Column:
    t = trimmed(raw)
    t = F.regexp_replace(t, r"^(?:```json)+", "")
    t = F.regexp_replace(t, r"^(?:```)+", "")
    return trimmed(F.regexp_replace(t, r"(?:```)+$", ""))


def truncate_input(text: Column, most: int = 90_000) -> Column:
    """At most `most` bytes of a text, cut back to its last line end where there is one."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    head = F.regexp_replace(head, "\ufffd+$", "")
    return F.when(F.octet_length(text) <= most, text).when(head.contains("\n"), F.regexp_extract(head, r"(?s)^(.*)\n", 1)).otherwise(head)


def quantisation(name: Column, size_gb: Column) -> Column:
    up = F.upper(name)
    out = F.lit("Q8_0")
    for size, q in reversed(BY_SIZE):
        out = F.when(size_gb < size, q).otherwise(out)
    for q in reversed(QUANTISATIONS):
        out = F.when(up.contains(q), q).otherwise(out)
    return out


def export_name(path: Column, ext: str) -> Column:
    """The file beside `path` that an export goes to: its stem, cut at the last dot, and _redacted."""
    stem = F.regexp_extract(path, r"(?s)^(.*?)(?:\.[^./\\]*)?$", 1)
    return F.concat(stem, F.lit(f"_redacted.{ext}"))


def selection(chosen: Column, text: Column) -> Column:
    """A selected passage as it stands in the text: trimmed, with white space collapsed or line ends changed if only that is found; under 2 characters null."""
    t = trimmed(chosen)
    flat, lines = F.regexp_replace(t, r"(?U)\s+", " "), F.replace(t, F.lit("\r\n"), F.lit("\n"))
    return F.when(F.length(t) >= 2, F.coalesce(F.when(text.contains(t), t), F.when(text.contains(flat), flat), F.when(text.contains(lines), lines), t))


def age_like(placeholder: Column) -> Column:
    return (placeholder != "") & ~placeholder.startswith("[")


def blocks(original: Column) -> Column:
    return F.repeat(F.lit("█"), F.greatest(F.octet_length(original), F.lit(3)))


def file_type(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def safe_name(key: object) -> str:
    """A key as part of a file name: nothing in it leads to another folder, two keys give two names, and long ones end in a digest."""
    s = "null" if key is None else str(key)
    name = "".join(c if c.isalnum() or (i and c in "-_.@ ") else "".join(f"%{b:02X}" for b in c.encode()) for i, c in enumerate(s)) or "%"
    return name if len(name.encode()) <= 160 else f"{name.encode()[:100].decode(errors='ignore')}%{hashlib.sha256(s.encode()).hexdigest()}"
