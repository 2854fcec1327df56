import random

from pyspark.sql import functions as F

from veilspark.operators import entities as E, render as R, reply, spans as S
from veilspark.plans import pipeline


def docs(spark, rows):
    """rows: (text, [(original, category, enabled)])."""
    df = spark.createDataFrame([(i, t, [tuple(e) for e in es]) for i, (t, es) in enumerate(rows)], "id int, text string, es array<struct<o:string,c:string,on:boolean>>")
    return df.withColumn("entities", F.transform("es", lambda e: E.entity(e["o"], e["c"], enabled=e["on"]))).drop("es")


def twin(text, ents):
    spans = []
    for i, (o, _, on) in enumerate(ents):
        at = text.find(o) if o and on else -1
        while at >= 0:
            spans.append((at, at + len(o), i))
            at = text.find(o, at + len(o))
    kept, last = [], 0
    for s, e, i in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if s >= last:
            kept.append((s, e, i))
            last = e
    return spans, kept


def test_spans_against_a_twin(spark):
    r = random.Random(1)
    rows = [("aXbXXc", [("X", "name", True)]), ("a.*b\\Ec\\E", [("\\E", "id", True), (".*", "id", True)]), ("", [("a", "name", True)]), ("abc", [("", "name", True)]), ("ééaé", [("é", "name", True)]), ("x", [])]
    for _ in range(60):
        t = "".join(r.choice("ab[(é ") for _ in range(r.randint(0, 20)))
        rows.append((t, [("".join(r.choice("ab[(é") for _ in range(r.randint(1, 3))), "name", r.random() < 0.8) for _ in range(r.randint(0, 4))]))
    df = docs(spark, rows).withColumn("all", S.all_spans(F.col("text"), F.col("entities"))).withColumn("kept", S.kept_spans(F.col("all")))
    for x in df.orderBy("id").collect():
        spans, kept = twin(*rows[x.id])
        assert [tuple(s) for s in x["all"]] == spans
        assert [tuple(s) for s in x["kept"]] == kept


def test_numbers_and_replacement(spark):
    df = docs(spark, [("Ann 12 Ann", [("Ann", "name", True), ("1", "id", True), ("Ann", "name", True), ("zz", "email", False)])]).withColumn("entities", E.numbered(F.col("entities")))
    x = df.select("entities.placeholder", R.redacted_tagged(F.col("text"), F.col("entities")), R.redacted_plain(F.col("text"), F.col("entities")), R.redacted_spans(F.col("text"), F.col("entities"))).first()
    assert x[0] == ["[NAME_1]", "[ID_1]", "[NAME_2]", "[EMAIL_1]"]
    assert x[1] == "[NAME_[ID_1]] [ID_1]2 [NAME_[ID_1]]"  # what one puts in, a later one replaces
    assert x[2] == "███ ███2 ███"
    assert x[3] == "[NAME_1] [ID_1]2 [NAME_1]"


def test_national_ids(spark):
    t = "12345678901 02345678901 123456789012 12345678901 é98765432109"
    assert spark.createDataFrame([(t,)], "t string").select(E.national_ids(F.col("t"))).first()[0] == ["12345678901"]


def test_manual(spark):
    df = docs(spark, [("a b", [("a", "name", True)])]).withColumn("entities", E.with_manual(E.with_manual(F.col("entities"), F.lit("b")), F.lit("a")))
    assert df.select("entities.placeholder").first()[0] == ["", "[REDACTED_1]"]


def test_replies():
    obj = '{"original": "A", "category": "name"}'
    assert reply.parse(f'{{"entities": [{obj}], "x": 1}}') == [("A", "name", None)]
    assert reply.parse(f'{{"entities": [{obj}, ]}}') == [("A", "name", None)]
    assert reply.parse(f'{{"entities": [{obj}, {{"original": "B') == [("A", "name", None)]
    assert reply.parse('{"entities": [{"name": "A"}]}') == [(None, None, None)]
    assert reply.parse('[{"name": " A ", "confidence": "x", "age": 5, "z": [1]}]') == [("5", "age", 0.7), ("x", "confidence", 0.7), ("A", "name", 0.7)]
    assert reply.parse("no json") is None and reply.parse("[NaN]") is None and reply.parse("[" * 5000) is None


def test_scan_and_birth(spark):
    rows = [("Date of birth: 10.05.2010. Seen 10.06.2012.", [("10.05.2010", "date", True), ("10.06.2012", "date", True)]), ("12.01.2001 only", [("12.01.2001", "date", True)]), ("x", [])]
    df = docs(spark, rows).withColumn("lang", F.lit("en")).withColumn("entities", E.numbered(F.col("entities")))
    got = {r.id: ([e.placeholder for e in r.entities], r.detected_birth_date) for r in pipeline.recalc(df, True, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {0: (["[DATE_1]", "age 2 yr 1 mo"], "10.05.2010"), 1: (["[DATE_1]"], None), 2: ([], None)}
    off = pipeline.recalc(df, False, F.lit("2024-01-01").cast("date")).where("id = 0").first()
    assert [e.placeholder for e in off.entities] == ["[DATE_1]", "[DATE_2]"] and off.detected_birth_date == "10.05.2010" and off.summary == "2/2 entities enabled"
