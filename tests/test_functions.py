from datetime import date

import pytest
from pyspark.sql import functions as F

from veilspark.functions import category as C, dates as D, text as T


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


CATEGORIES = {
    "name": "name", "address": "name", "adres": "name", "phone": "phone", "email": "email", "institution": "institution", "age": "age", "admission_date": "name", "discharge_date": "date", "date_of_birth": "date",
    "dob": "name", "patient": "name", "patient_id": "id", "national_id": "id", "location": "address", "city": "address", "şehir": "address", "street": "name", "hotel": "phone", "e-posta": "email",
    "hospital": "institution", "hospital_name": "name", "org": "institution", "age_at_visit": "date", "yaş": "age", "message": "age", "incident_date": "date", "tc": "id", "confidence": "id",
}
DATES = {
    "15.03.2020": date(2020, 3, 15), "15/03/20": date(2020, 3, 15), "1-2-49": date(2049, 2, 1), "1-2-50": date(1950, 2, 1), "31.02.2020": date(2020, 1, 1), "03/25/2020": date(2020, 1, 1), "2020-03-15": date(2020, 3, 15),
    "2020/3/5": date(2020, 3, 5), "15 Mart 2020": date(2020, 3, 15), "March 15, 2012": date(2012, 3, 15), "Mar 2012": date(2012, 3, 1), "2019 Ekim": date(2019, 10, 1), "KASIM 2019": date(2019, 11, 1), "HAZİRAN 2019": date(2019, 1, 1),
    "10/2019": date(2019, 10, 1), "13/2019": date(2019, 1, 1), "2022": date(2022, 1, 1), "1850": None, "menarş 2022": date(2022, 1, 1), "23.01.2023 11:55": date(2023, 1, 23), "Seen 2021-02-03 ok": date(2003, 2, 21),
    "2020.03.15": date(2015, 3, 20), "15 Sept 2020": date(2020, 1, 1), "Date: 5 May 2020": date(2020, 1, 1), "27.5.221.1": date(221, 5, 27), "abc": None, " 15.03.2020": date(2020, 3, 15), None: None,
}
AGES = [
    (date(2010, 5, 10), date(2020, 5, 10), 10, 0, "age 10"), (date(2010, 5, 10), date(2020, 5, 9), 9, 11, "age 9 yr 11 mo"), (date(2010, 5, 31), date(2020, 6, 30), 10, 0, "age 10"),
    (date(2012, 2, 29), date(2013, 2, 28), 0, 11, "age 0 yr 11 mo"), (date(2010, 5, 10), date(2010, 4, 1), 0, 10, "age 0 yr 10 mo"), (date(2010, 5, 10), date(2010, 6, 9), 0, 0, "at birth"),
]


def test_normalize_category(spark):
    got = dict(one(spark, [(k,) for k in CATEGORIES], "r string", "r", C.normalize_category(F.col("r"))))
    assert got == CATEGORIES
    assert one(spark, [("address",)], "r string", C.normalize_category(F.col("r"), strict=True)) == [("address",)]


def test_parse_date(spark):
    got = dict(one(spark, [(k,) for k in DATES], "t string", "t", D.parse_date(F.col("t"))))
    assert got == DATES


def test_ages(spark):
    y, m = D.age_diff(F.col("b"), F.col("e"))
    got = one(spark, [a[:2] for a in AGES], "b date, e date", "b", "e", y, m, D.age_phrase(y, m, F.lit("en")))
    assert got == AGES
    assert one(spark, [AGES[1][:2]], "b date, e date", D.age_phrase(y, m, F.lit("tr"))) == [("9 yıl 11 ay",)]


@pytest.mark.parametrize("xml, text", [
    ("<w:p>a<w:br/>b<w:tab/>c</w:p><w:p>d</w:p>", "a\nb\tc\nd"), ("a<w:br/></w:p>b", "a\nb"), ("<w:p/>x", "x"), ("a > b", "a  b"), ("a<b", "a"), ("&amp;lt;", "<"), ("a\n\n\n\n\nb", "a\n\nb"), ("<foo<w:br/>x", "x"), ("a</w:p></w:p></w:p>b", "a\nb"),
])
def test_strip_markup(spark, xml, text):
    assert one(spark, [(xml,)], "x string", T.strip_markup(F.col("x"))) == [(text,)]


def test_small_functions(spark):
    assert one(spark, [("<&>\"'",)], "x string", T.html_escape(F.col("x")), T.xml_escape(F.col("x"))) == [("&lt;&amp;&gt;&quot;'", "&lt;&amp;&gt;&quot;&apos;")]
    assert one(spark, [("m-q4_k_m.gguf", 1.0), ("m", 4.0), ("m", 40.0)], "n string, s double", T.quantisation(F.col("n"), F.col("s"))) == [("Q4_K_M",), ("Q4_K_M",), ("Q8_0",)]
    assert one(spark, [("ab\ncdé\nfgh",)], "x string", T.truncate_input(F.col("x"), 7), T.truncate_input(F.col("x"), 2), T.truncate_input(F.col("x"), 99)) == [("ab", "ab", "ab\ncdé\nfgh")]
    assert one(spark, [("é" * 5,)], "x string", T.truncate_input(F.col("x"), 5)) == [("éé",)]
    assert one(spark, [("a",), ("[X_1]",), ("",)], "x string", T.age_like(F.col("x"))) == [(True,), (False,), (False,)]
    assert one(spark, [(" a  b ", "x a b"), ("a", "a")], "c string, t string", T.selection(F.col("c"), F.col("t"))) == [("a b",), (None,)]


def test_names_for_sql(spark):
    from veilspark.functions import category, dates, names
    from veilspark.operators import render

    assert names.register(spark) == ["normalize_category", "parse_date", "redacted_tagged", "redacted_plain"]
    words = spark.createDataFrame([("Hasta Adı",), ("TEL",), (" e-posta ",), ("doctor",), (None,), ("x'y\\",)], "raw string")
    assert all(a == b for a, b in words.select(F.expr("normalize_category(raw)"), category.normalize_category(F.col("raw"))).collect())
    days = spark.createDataFrame([("12.03.2020",), ("2020-03-12",), ("12 Mart 2020",), ("March 12, 2020",), ("no",), (None,)], "input string")
    got = days.select(F.expr("parse_date(input)"), dates.parse_date(F.col("input"))).collect()
    assert all(a == b for a, b in got) and got[0][0] is not None
    text = spark.createDataFrame([("Ann Lee met Ann, 40", [("Ann", "name", "[NAME_2]", True), ("Ann Lee", "name", "[NAME_1]", True), ("40", "age", "forty", True), ("met", "name", "[NAME_3]", False)])], f"body string, entities {names.ENTITIES}")
    for f in ("redacted_tagged", "redacted_plain"):
        a, b = text.select(F.expr(f"{f}(body, entities)"), getattr(render, f)(F.col("body"), F.col("entities"))).first()
        assert a == b != "Ann Lee met Ann, 40"
