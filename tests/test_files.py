import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.operators import entities as E
from veilspark.sources import models, readers, writers
from veilspark.streaming import progress


def test_read_and_export(spark, tmp_path):
    (tmp_path / "note.txt").write_text("Ann\nline é")
    (tmp_path / "NOTE.MD").write_text("# x")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "scan.png").write_bytes(b"x")
    (tmp_path / "nozip.docx").write_bytes(b"x")
    df = spark.createDataFrame([(1, "Ann & (co)\n\nend")], "id long, text string").withColumn("entities", E.numbered(F.array(E.entity(F.lit("Ann"), "name"))))
    made = {f: bytes(writers.exported(df, "id", f).first().content) for f in writers.FORMATS}
    assert made["txt"].decode() == "███ & (co)\n\nend" and made["md"].decode().startswith("# Redacted Document\n\n███")
    with zipfile.ZipFile(io.BytesIO(made["docx"])) as z:
        assert len(z.namelist()) == 4
    for f in ("docx", "pdf"):
        (tmp_path / f"out.{f}").write_bytes(made[f])
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["note.txt"] == ("Ann\nline é", None) and got["NOTE.MD"] == ("# x", None) and got["bad.txt"] == (None, "not UTF-8")
    assert got["scan.png"][1] == "unsupported file format: .png" and got["nozip.docx"][0] is None and got["nozip.docx"][1]
    assert got["out.docx"] == ("[NAME_1] & (co)\nend", None)  # an empty paragraph tag ends no line
    assert got["out.pdf"][0].startswith("[NAME_1] & (co)")
    writers.save(df, "id", "md", str(tmp_path / "saved"))
    assert (tmp_path / "saved" / "1_redacted.md").read_bytes() == made["md"] and len(list((tmp_path / "saved").iterdir())) == 1
    with pytest.raises(ValueError):
        writers.exported(df, "id", "xls")


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    q = readers.read_folder_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("opened").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.text for r in spark.sql("SELECT text FROM opened").collect()] == ["hello"]


def test_settings_and_models(spark, tmp_path):
    p = tmp_path / "x" / "settings.json"
    assert models.Settings.load(p) == models.Settings()
    models.Settings(language="tr", age_conversion=True).save(p)
    assert models.Settings.load(p).language == "tr"
    p.write_text("{")
    assert models.Settings.load(p) == models.Settings()
    (tmp_path / "a-q8_0.gguf").write_bytes(b"x" * 10)
    assert [(r.name, r.quantisation) for r in models.find_models(spark, [str(tmp_path)]).collect()] == [("a-q8_0.gguf", "Q8_0")]


def test_progress(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t + timedelta(milliseconds=ms), 1 << 20, i) for i, ms in enumerate((0, 100, 250, 300, 600, 700))]
    df = spark.createDataFrame(rows, "download_id long, ts timestamp, bytes long, seq long")
    out = progress.progress(df).orderBy("seq").collect()
    assert out[-1].percent == 100.0 and out[2].downloaded == 3 << 20 and out[2].mib_per_s == 12.0
    assert [(r.downloaded >> 20, r.percent == 100) for r in progress.throttled(progress.progress(df)).orderBy("downloaded").collect()] == [(3, False), (5, False), (6, True)]


def test_queries_match_their_sql(spark):
    import duckdb

    from veilspark.plans.catalog import ORACLES, QUERIES

    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("customer", "orders", "events", "documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("redact_tagged", "spans_kept", "birth_cascade", "age_conversion", "export_docx_xml", "strip_markup", "truncate_input", "progress"):
        got = QUERIES[name](spark, d)
        cur = c.execute(ORACLES[name])
        names = [x[0] for x in cur.description]
        assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, cur.fetchall())), name


def test_pdf_characters_and_lines():
    made = writers.pdf_bytes("doğum Şİı\x0cx\u2028y\n\r\nlast\r")
    assert b"/Differences[208/Gbreve 221/Idotaccent 222/Scedilla 240/gbreve 253/dotlessi 254/scedilla]" in made  # what any viewer must know
    assert readers.pdf_text(made)[0].split("\n")[0] == "doğum Şİı\x0cx?y"
    assert made.count(b" Td (") == 3


def test_lines_and_blank_paragraphs(spark):
    from pyspark.sql import functions as F

    cases = {"": [], "a": ["a"], "a\n": ["a"], "a\r\nb\r": ["a", "b\r"], "\n\n": ["", ""], "a\x0cb\u2028c": ["a\x0cb\u2028c"], " \u00a0\t\nx": [" \u00a0\t", "x"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", writers.lines(F.col("t")).alias("l"), writers.docx_document(F.col("t")).alias("d")).collect()
    assert {r.t: r.l for r in df} == cases
    assert {r.t: r.d.count("<w:p/>") for r in df}[" \u00a0\t\nx"] == 1 and {r.t: r.d.count("<w:p/>") for r in df}["\n\n"] == 2


def test_models_in_nested_folders(spark, tmp_path):
    from veilspark.sources import models

    for p in ("a.gguf", "deep/b.gguf", "deep/er/c.gguf"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    where = f"file:{tmp_path}"
    assert [r.name for r in models.find_models(spark, [where]).collect()] == ["a.gguf"]
    assert {r.name for r in models.find_models(spark, [], (where,)).collect()} == {"a.gguf", "b.gguf"}


def test_streamed_progress_equals_batch(spark, tmp_path):
    import datetime as dt
    import random

    from veilspark.streaming import progress

    r = random.Random(0)
    t0, rows = dt.datetime(2024, 1, 1), []
    for d in range(3):
        ms, total, n = 0, 0, r.randint(20, 40)
        sizes = [r.randint(1, 10**6) for _ in range(n)]
        for i, x in enumerate(sizes):
            ms += r.randint(1, 200)
            rows.append((d, t0 + dt.timedelta(milliseconds=ms), i, x, sum(sizes) + (d == 2)))  # the last download is not complete
    schema = "download_id long, ts timestamp, seq long, bytes long, total long"
    df = spark.createDataFrame(rows, schema)
    for i, lo in enumerate((0, 1500, 3000)):
        at = [t0 + dt.timedelta(milliseconds=x) for x in (lo, lo + 1500 if i < 2 else 10**7)]
        df.where(df.ts.between(at[0], at[1] - dt.timedelta(milliseconds=1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = progress.progress_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = progress.throttled(progress.progress(df.drop("total"), df.select("download_id", "total").distinct()))
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, batch.collect())) and batch.where("percent = 100 AND mib_per_s = 0").count() == 2
