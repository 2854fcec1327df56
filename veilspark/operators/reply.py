"""Entities from the raw replies of a model, however broken their JSON is.

Built-in functions take off what surrounds the JSON, and a reply that then parses as an object
of well-typed entities is read as a VARIANT: its text never leaves the JVM. Only what does not
parse goes to the tolerant steps, one Arrow function of strict JSON with exact types at each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import fence_strip, think_strip
from .entities import ENTITIES, entity
from ..functions.category import normalize_category, subcategory, trimmed

PREVIEW = 300
FLAT_CONFIDENCE, CONFIDENCE = 0.7, 0.9
COMMA = re.compile(r",\s*\]")
ROW = pa.struct([("original", pa.string()), ("category", pa.string()), ("confidence", pa.float64())])
Row = tuple[str | None, str | None, float | None]


def _no_constant(name: str):
    raise ValueError(name)


def load(s: str):
    """Strict JSON: no NaN, no Infinity, nothing behind the value."""
    return json.loads(s, parse_constant=_no_constant)


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def typed(x) -> Row:
    """An entity object; any field of a wrong type fails it."""
    if not isinstance(x, dict):
        raise ValueError("not an object")
    o, c, p = x.get("original"), x.get("category"), x.get("confidence")
    if not all(v is None or isinstance(v, str) for v in (o, c)) or not (p is None or _number(p)):
        raise ValueError("a field of another type")
    return o, c, None if p is None else float(p)


def whole(s: str) -> list[Row] | None:
    """An object with a list of entities, all of them well typed."""
    try:
        x = load(s)
        if isinstance(x, dict) and isinstance(x.get("entities"), list):
            return [typed(e) for e in x["entities"]]
    except (ValueError, RecursionError):
        pass
    return None


def balanced(s: str, at: int, left: str, right: str) -> int:
    """Where the bracket at `at` is closed, counting brackets only; -1 if it is not."""
    depth = 0
    for m in re.compile(f"[{re.escape(left + right)}]").finditer(s, at):
        depth += 1 if m[0] == left else -1
        if depth == 0:
            return m.end()
    return -1


def objects(s: str) -> Iterator[str]:
    at = s.find("{")
    while at >= 0 and (end := balanced(s, at, "{", "}")) > 0:
        yield s[at:end]
        at = s.find("{", end)


def listed(s: str) -> list[Row] | None:
    """The first array as entities; if it is cut off, its complete objects that are well typed."""
    end = balanced(s, 0, "[", "]")
    try:
        x = load(COMMA.sub("]", s[:end] if end > 0 else s))
        if isinstance(x, list):
            return [typed(e) for e in x]
    except (ValueError, RecursionError):
        pass
    if end > 0:
        return None
    found = []
    for o in objects(s):
        try:
            found.append(typed(load(o)))
        except (ValueError, RecursionError):
            continue
    return found or None


def flat(s: str) -> list[Row] | None:
    """Objects whose keys are labels and whose texts and numbers are the entities; keys in sorted order."""
    cut = s
    if not s.strip().endswith("]") and "}" in s:
        cut = s[: s.rfind("}") + 1] + "]"
    for attempt in (s, COMMA.sub("]", cut)):
        try:
            x = load(attempt)
            if not isinstance(x, list) or not all(isinstance(o, dict) for o in x):
                continue
        except (ValueError, RecursionError):
            continue
        pairs = [(k, v.strip() if isinstance(v, str) else json.dumps(v)) for o in x for k, v in sorted(o.items()) if isinstance(v, str) or _number(v)]
        return [(v, k, FLAT_CONFIDENCE) for k, v in pairs if v] or None
    return None


def parse(cleaned: str) -> list[Row] | None:
    """(original, label, confidence) rows, or None where no step succeeds."""
    found = whole(cleaned)
    at = cleaned.find("[")
    if found is None and at >= 0:
        found = listed(cleaned[at:])
        if found is None:
            found = flat(cleaned[at:])
    return found


ROWS = T.ArrayType(T.StructType([T.StructField("original", T.StringType()), T.StructField("category", T.StringType()), T.StructField("confidence", T.DoubleType())]))


def well_typed(cleaned: Column) -> Column:
    """The rows of whole(), by built-in functions; null where the reply is no object with a list of well-typed entities.

    The parser stops at a value's end and accepts what stands behind it. It is given the reply
    as the one element of an array and as the one field of an object: what is behind the value
    could close one of them, never both.
    """
    array, field = F.try_parse_json(F.concat(F.lit("["), cleaned, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), cleaned, F.lit("}")))
    alone = field.isNotNull() & (F.size(F.try_variant_get(array, "$", "array<variant>")) == 1)
    ents = F.when(alone, F.try_variant_get(array, "$[0].entities", "array<variant>"))
    kind = lambda e, name: F.coalesce(F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant")), F.lit("VOID"))
    number = r"^(BIGINT|FLOAT|DOUBLE|DECIMAL\(.*|VOID)$"
    good = F.forall(ents, lambda e: F.schema_of_variant(e).startswith("OBJECT") & kind(e, "original").isin("STRING", "VOID") & kind(e, "category").isin("STRING", "VOID") & kind(e, "confidence").rlike(number))
    rows = F.transform(ents, lambda e: F.struct(*[F.try_variant_get(e, f"$.{n}", t).alias(n) for n, t in (("original", "string"), ("category", "string"), ("confidence", "double"))]))
    return F.when(good, rows)


@F.arrow_udf(ROWS)
def _salvaged(cleaned: pa.Array) -> pa.Array:
    rows = [None if s is None else parse(s) for s in cleaned.to_pylist()]
    return pa.array([None if r is None else [dict(zip(("original", "category", "confidence"), x, strict=True)) for x in r] for r in rows], pa.list_(ROW))


def parsed(df: DataFrame, raw: str = "raw_response", salvage: bool = True) -> DataFrame:
    """df with entities (null if the reply cannot be read) and error. A null reply is an error. Without salvage what is not well typed is an error too, and the plan has no Python."""
    df = df.drop("entities", "error").withColumn("_cleaned", fence_strip(think_strip(F.col(raw)))).withColumn("_rows", well_typed(F.col("_cleaned")))
    if salvage:
        df = df.withColumn("_rows", F.coalesce("_rows", _salvaged(F.when(F.col("_rows").isNull(), F.col("_cleaned")))))
    good = F.filter("_rows", lambda r: r["original"].isNotNull() & r["category"].isNotNull() & (F.length(trimmed(r["original"])) > 0))
    made = F.transform(
        good,
        lambda r: entity(trimmed(r["original"]), normalize_category(r["category"]), subcategory(r["category"], normalize_category(r["category"])), confidence=F.coalesce(r["confidence"], F.lit(CONFIDENCE))),
    )
    preview = F.concat(F.lit("the reply is not JSON: "), F.substring(F.coalesce(F.col(raw), F.lit("")), 1, PREVIEW))
    return df.withColumn("entities", made.cast(ENTITIES)).withColumn("error", F.when(F.col("_rows").isNull(), preview)).drop("_rows", "_cleaned")
