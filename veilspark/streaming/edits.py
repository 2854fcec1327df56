"""Edits of entity lists as an ordered log: folded in batch by built-in functions, and in a stream by a stateful processor.

An edit is (doc_id, seq, op, index, category, value, original):
toggle (index, value), category (category, value), all (value), add (original), delete (index).
Edits of a document take effect in the order of seq, whenever they arrive; one that comes
again changes nothing, and one for an entity that is not there is passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import entities as E

EDIT = "seq long, op string, index int, category string, value boolean, original string"
FIELDS = ("seq", "op", "index", "category", "value", "original")


def _applied(ents: Column, e: Column) -> Column:
    toggled = F.transform(ents, lambda x, i: F.when(i == e["index"], x.withField("enabled", e["value"])).otherwise(x))
    by_op = {
        "toggle": toggled, "category": E.toggled_category(ents, e["category"], e["value"]), "all": F.transform(ents, lambda x: x.withField("enabled", e["value"])),
        "add": E.with_manual(ents, e["original"]), "delete": E.without_manual(ents, e["index"]),
    }
    out = ents
    for op, made in by_op.items():
        out = F.when(e["op"] == op, made).otherwise(out)
    return out


def folded(docs: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """docs (key, entities, ...) after all their edits. Of edits with one seq the least counts; a document's log is as long as its readers' work on it."""
    log = edits.groupBy(key, "seq").agg(F.min(F.struct(*FIELDS)).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("log"))
    found = docs.join(log, key, "left")
    ents = F.aggregate(F.coalesce("log", F.array().cast(f"array<struct<{EDIT.replace(' ', ':').replace(',:', ',')}>>")), F.col("entities").cast(E.ENTITIES), lambda a, e: _applied(a, e).cast(E.ENTITIES))
    return found.withColumn("entities", ents).drop("log")


def fold(ents: list[dict], edits: list[dict]) -> list[dict]:
    """The fold of one document's edits, in order."""
    for e in edits:
        op, i, on = e["op"], e["index"], e["value"]
        if op == "add" and not any(x["original"] == e["original"] for x in ents):
            n = sum(bool(x["manual"]) for x in ents) + 1
            ents = [*ents, dict.fromkeys(ents[0] if ents else E_FIELDS) | {"original": e["original"], "category": "manual", "placeholder": f"[REDACTED_{n}]", "confidence": 1.0, "enabled": True, "manual": True}]
        elif op == "delete":
            ents = [x for k, x in enumerate(ents) if k != i or not x["manual"]]
        elif op in ("toggle", "category", "all"):
            hit = (lambda k, x: k == i) if op == "toggle" else (lambda k, x: x["category"] == e["category"]) if op == "category" else (lambda k, x: True)
            ents = [x | {"enabled": on} if hit(k, x) else x for k, x in enumerate(ents)]
    return ents


E_FIELDS = ("original", "category", "subcategory", "placeholder", "confidence", "enabled", "start", "end", "manual")


class Editor(StatefulProcessor):
    """State of a document: its list before any edit, and its log by seq. Late edits find their place in the log, and the list is folded anew."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "entities string")
        self.log = handle.getMapState("log", "seq long", "edit string")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.base.update((initialState["entities"],))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = False
        for r in rows:
            edit = json.dumps([r[f] for f in FIELDS])
            old = self.log.getValue((r["seq"],))[0] if self.log.containsKey((r["seq"],)) else None
            if old is None or _order(edit) < _order(old):
                self.log.updateValue((r["seq"],), (edit,))
                new = True
        if new and self.base.exists():
            log = [dict(zip(FIELDS, json.loads(v[0]), strict=True)) for _, v in sorted((k[0], v) for k, v in self.log.iterator())]
            yield Row(**{self.key: key[0], "edits": len(log), "entities": json.dumps(fold(json.loads(self.base.get()[0]), log))})

    def close(self) -> None:
        pass


def _order(edit: str) -> list:
    """Of two edits with one seq the lesser counts, as in a comparison of structs: nulls first."""
    return [(x is not None, x if x is not None else 0) for x in json.loads(edit)]


def edited_stream(edits: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, edits, entities) after each batch, for documents that it edited: `edits` counts those folded so far. edits is a stream, docs (key, entities) a table."""
    start = docs.select(key, F.to_json(F.col("entities"), {"ignoreNullFields": "false"}).alias("entities")).groupBy(key)
    kind = docs.schema[key].dataType.simpleString()
    out = edits.select(key, *FIELDS).groupBy(key).transformWithState(Editor(key), f"{key} {kind}, edits int, entities string", "Update", "None", start)
    return out.withColumn("entities", F.from_json("entities", E.ENTITIES))
