"""Redacted and highlighted forms of a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.category import COLOURS, colour
from ..functions.text import age_like, blocks, html_escape
from .entities import enabled
from .spans import all_spans, kept_spans

#: The style of a highlighted and of a blocked span.
HIGHLIGHT = "background:{c}22;color:{c};border:1px solid {c}66;border-radius:2px;padding:0 2px;font-weight:600"
BLOCKED = "background:#808080;color:#808080;border-radius:1px;letter-spacing:-0.5px;font-size:0.65rem;user-select:none"


def _outside(text: Column) -> Column:
    return F.replace(html_escape(text), F.lit("\n"), F.lit("<br>"))


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def _html(text: Column, ents: Column, spans: Column, inner) -> Column:
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("html")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["html"], _outside(_between(text, a["at"], s["start"])), inner(F.get(ents, s["ord"]), s)).alias("html")),
    )
    return F.concat(done["html"], _outside(_between(text, done["at"], F.length(text))))


def _style(c: Column) -> Column:
    parts = HIGHLIGHT.split("{c}")
    return F.concat(F.lit(parts[0]), c, F.lit(parts[1]), c, F.lit(parts[2]), c, F.lit(parts[3]))


def highlighted_html(text: Column, ents: Column, spans: Column) -> Column:
    """spans: kept_spans(all_spans(text, ents)), as a column of its own so that it is computed once."""

    def inner(e: Column, s: Column) -> Column:
        return F.concat(
            F.lit('<span class="pii highlight '), e["category"], F.lit('" style="'), _style(colour(e["category"])), F.lit('" title="'), F.upper(e["category"]), F.lit(": "), e["placeholder"], F.lit('">'),
            html_escape(_between(text, s["start"], s["end"])), F.lit("</span>"),
        )

    return _html(text, ents, spans, inner)


def redacted_html(text: Column, ents: Column, spans: Column) -> Column:
    age = HIGHLIGHT.replace("{c}", COLOURS["age"])

    def inner(e: Column, s: Column) -> Column:
        phrase = F.concat(F.lit(f'<span class="pii highlight age" style="{age}">'), html_escape(e["placeholder"]), F.lit("</span>"))
        block = F.concat(F.lit(f'<span class="pii redacted" style="{BLOCKED}">'), blocks(e["original"]), F.lit("</span>"))
        return F.when(age_like(e["placeholder"]), phrase).otherwise(block)

    return _html(text, ents, spans, inner)


def _replaced(text: Column, ents: Column, by) -> Column:
    """Each enabled entity's text replaced in turn, the longest in bytes first; what one puts in, a later one may replace."""
    live = F.filter(enabled(ents), lambda e: F.length(e["original"]) > 0)
    order = F.array_sort(F.transform(live, lambda e, i: F.struct((-F.octet_length(e["original"])).alias("n"), i.alias("i"), e["original"].alias("o"), by(e).alias("by"))))
    return F.aggregate(order, text, lambda acc, x: F.replace(acc, x["o"], x["by"]))


def redacted_tagged(text: Column, ents: Column) -> Column:
    return _replaced(text, ents, lambda e: e["placeholder"])


def redacted_plain(text: Column, ents: Column) -> Column:
    return _replaced(text, ents, lambda e: F.when(age_like(e["placeholder"]), e["placeholder"]).otherwise(blocks(e["original"])))


def redacted_spans(text: Column, ents: Column) -> Column:
    """An addition: placeholders put in by kept spans, so nothing is replaced twice."""
    spans = kept_spans(all_spans(text, ents))
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], _between(text, a["at"], s["start"]), F.get(ents, s["ord"])["placeholder"]).alias("out")),
    )
    return F.concat(done["out"], _between(text, done["at"], F.length(text)))
