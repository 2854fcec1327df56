"""Replies read as VARIANT against the strict parse in Python, and plans without Python."""

import json
import random

from pyspark.sql import functions as F

from veilspark.operators import reply


def replies():
    r = random.Random(4)
    value = lambda: r.choice([None, "A", " b ", "", 1, 0.5, 1e400, -7, True, [], {}, ["x"], {"k": 1}, 10**30, 0.1234567890123456789, "é\U0001f600\\\"\n"])
    out = []
    for _ in range(300):
        ents = [r.choice([value(), *[{k: value() for k in r.sample(("original", "category", "confidence", "more"), r.randint(0, 4))}] * 6]) for _ in range(r.randint(0, 3))]
        out.append(json.dumps(r.choice([{"entities": ents}, {"entities": ents, "summary": value()}, ents, {"entities": value()}, value()])))
    good = [json.dumps({"entities": [{"original": r.choice(["A", " b", None]), "category": r.choice(["name", "dob", None]), "confidence": r.choice([None, 1, 0.25, 0.95])}], "x": value()}) for _ in range(100)]
    odd = ['{"entities": []}', '{"entities": [{}]}', '{"entities": [null]}', '{"entities": [], "entities": [{"original": "A"}]}', '{"entities": [{"original": NaN}]}', '{"entities": []} x', '{"entities": []} ]', '{"entities": []} }', '{"entities": []}, {}', '{"entities": []}]}', "  {\"entities\": [] }  ", "{'entities': []}", "", "[]", "null", '{"Entities": []}', "{" * 600]
    return out + good + odd


def test_variant_equals_the_strict_parse(spark):
    rows = replies()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string").select("i", reply.well_typed(F.col("s")).alias("v"))
    n = 0
    for x in df.collect():
        expected = reply.whole(rows[x.i])
        if x.v is not None:  # what the JVM reads it reads alike; what it leaves is read later
            assert [tuple(e) for e in x.v] == expected, rows[x.i]
            n += 1
    assert n > 120
    both = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, raw_response string")
    salvaged = {x.i: x for x in reply.parsed(both).collect()}
    for i, x in enumerate(rows):
        assert (salvaged[i].error is None) == (reply.parse(x) is not None), x


def test_well_typed_replies_need_no_python(spark):
    df = spark.createDataFrame([("{}",)], "raw_response string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan(reply.parsed(df)) and "Python" not in plan(reply.parsed(df, salvage=False)).replace("PythonUDF0", "")
    got = reply.parsed(spark.createDataFrame([("no",), (None,), ('{"entities": [{"original": "A", "category": "name"}]}',)], "raw_response string"), salvage=False).collect()
    assert [(r.error, r.entities and r.entities[0].original) for r in got] == [("the reply is not JSON: no", None), ("the reply is not JSON: ", None), (None, "A")]
