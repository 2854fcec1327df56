"""The table function against the operators on columns."""

import pytest
from pyspark.sql import functions as F
from test_operators import docs

from veilspark.operators import detect, rowwise
from veilspark.operators.summary import rows


def test_table_function(spark):
    data = [
        ("ID 12345678901, é 98765432109 and 12345678901.", [("12345678901", "id", True), ("23.01.2023 11:55", "phone", True), ("555", "phone", False)]),
        ("٣12345678901 x12345678901 12345678901y 02345678901 12345678901٣ -12345678901-", []), ("", []), (None, [("1.2.2020", "phone", True)]), ("no ids", [("a", "name", True)]),
    ]
    df = docs(spark, data)
    rowwise.register(spark)
    got = spark.sql("SELECT t.id, e.* FROM {df} t, LATERAL entities_of(t.text, t.entities) e", df=df).collect()
    whole = detect.corrected(df.where("text IS NOT NULL"))
    expected = rows(whole, "id").select("id", "ord", *rowwise.FIELDS).collect()
    assert sorted(map(str, map(tuple, (r for r in got if r.id != 3)))) == sorted(map(str, map(tuple, expected)))
    assert [(r.original, r.category) for r in got if r.id == 3] == [("1.2.2020", "date")]
    assert [r.original for r in spark.sql("SELECT * FROM entities_of('a 12345678901')").collect()] == ["12345678901"]
    for bad in ("entities_of(1)", "entities_of('a', 5)", "entities_of('a', array(struct(1 AS x)))"):
        with pytest.raises(Exception, match="argument"):
            spark.sql(f"SELECT * FROM {bad}").collect()
