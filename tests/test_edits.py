"""A log of edits folded in a stream, late and repeated ones among them, against the fold in batch."""

import json
import random

from pyspark.sql import functions as F

from veilspark.operators import entities as E
from veilspark.streaming import edits as L

SCHEMA = f"doc_id long, {L.EDIT}"


def log(seed):
    r = random.Random(seed)
    out = []
    for d in range(6):
        for seq in range(r.randint(0, 14)):
            op = r.choice(("toggle", "category", "all", "add", "add", "delete", "other"))
            out.append((d, seq, op, r.choice((0, 1, 2, 3, 4, -1, 99, None)), r.choice(("name", "date", "manual", None)), r.random() < 0.5, r.choice(("a", "b", "x", "y"))))
    return out


def docs(spark):
    found = [("a", "name"), ("b", "date"), ("c", "name")]
    df = spark.createDataFrame([(d, found[: d % 4]) for d in range(6)], "doc_id long, f array<struct<o:string,c:string>>")
    return df.withColumn("entities", E.numbered(F.transform("f", lambda e: E.entity(e["o"], e["c"])))).drop("f")


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log(1)
    batch = {r.doc_id: r.entities for r in L.folded(docs(spark), spark.createDataFrame([*rows, *rows[::3]], SCHEMA), "doc_id").collect()}
    for d, ents in batch.items():
        start = next(r.entities for r in docs(spark).where(F.col("doc_id") == d).collect())
        mine = [dict(zip(L.FIELDS, x[1:])) for x in rows if x[0] == d]
        assert [e.asDict() for e in ents] == L.fold([e.asDict() for e in start], mine)
    r = random.Random(2)
    sent = [*rows, *r.sample(rows, len(rows) // 3)]
    r.shuffle(sent)  # late ones, and some twice
    (tmp_path / "in").mkdir()
    for i in range(4):
        part = tmp_path / "in" / f"{i}.json"
        part.write_text("\n".join(json.dumps(dict(zip(("doc_id", *L.FIELDS), x))) for x in sent[i::4]))

    def run():
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = L.edited_stream(src, docs(spark), "doc_id")
        q = out.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"b={i}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    extra = (1, 99, "add", None, None, None, "late news")
    (tmp_path / "in" / "9.json").write_text(json.dumps(dict(zip(("doc_id", *L.FIELDS), extra))))
    run()  # goes on from its checkpoint
    last = {}
    for r_ in spark.read.parquet(str(tmp_path / "out")).collect():
        if r_.doc_id not in last or r_.edits >= last[r_.doc_id].edits:
            last[r_.doc_id] = r_
    batch = {r.doc_id: r.entities for r in L.folded(docs(spark), spark.createDataFrame([*rows, extra], SCHEMA), "doc_id").collect()}
    assert {d: [tuple(e) for e in r.entities] for d, r in last.items()} == {d: [tuple(e) for e in batch[d]] for d in {x[0] for x in rows} | {1}}
    assert {d: r.edits for d, r in last.items()} == {d: len({x[1] for x in [*rows, extra] if x[0] == d}) for d in last}
