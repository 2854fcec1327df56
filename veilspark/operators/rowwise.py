"""Entities as rows of a table function, for SQL: SELECT ... FROM notes, LATERAL entities_of(text, entities)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.category import DATE_LIKE
from .entities import ID_PATTERN

NAME = "entities_of"
#: Python reads decimal digits and word boundaries of all scripts unasked.
ID, DATE = (re.compile(p.replace("(?U)", "")) for p in (ID_PATTERN, DATE_LIKE))
FIELDS = {"original": StringType(), "category": StringType(), "subcategory": StringType(), "confidence": DoubleType(), "enabled": BooleanType(), "start": LongType(), "end": LongType()}


class EntitiesOf:
    """detect.corrected as a table function: of a text and its list each entity as a row, misread phones as dates, national ids that the list has not behind it."""

    @staticmethod
    def analyze(text: AnalyzeArgument, entities: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError(f"{NAME}: the first argument is a text")
        if entities is not None:
            kind = entities.dataType
            have = kind.elementType.names if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) else []
            if not {"original", "category"} <= set(have):
                raise ValueError(f"{NAME}: the second argument is a list of entities with original and category")
        return AnalyzeResult(StructType([StructField("ord", IntegerType()), *[StructField(n, t) for n, t in FIELDS.items()]]))

    def eval(self, text: str | None, entities: list[Row] | None = None) -> Iterator[tuple]:
        known, n = set(), 0
        for e in entities or ():
            row = {k: v for k, v in e.asDict().items() if k in FIELDS}
            known.add(row["original"])
            if row["category"] == "phone" and row["original"] is not None and DATE.search(row["original"]):
                row |= {"category": "date", "subcategory": "date"}
            yield (n, *[row.get(k) for k in FIELDS])
            n += 1
        for m in ID.finditer(text or ""):
            if m[0] not in known:
                known.add(m[0])
                start = len(text[: text.index(m[0])].encode())
                yield n, m[0], "id", "national_id", 0.85, True, start, start + 11
                n += 1


def register(spark: SparkSession) -> str:
    """Make entities_of known to the session's SQL."""
    spark.udtf.register(NAME, udtf(EntitiesOf))
    return NAME
