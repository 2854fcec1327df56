"""The sink of whole files: all four formats, failed and killed tasks, overwriting, streams that restart."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from veilspark.functions.text import safe_name
from veilspark.operators import entities as E
from veilspark.sources import readers, sink, writers

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def docs(spark, n=20):
    df = spark.range(n).select("id", F.concat(F.lit("Ann no. "), F.col("id").cast("string"), F.lit("\n\nend é")).alias("text"))
    return df.withColumn("entities", E.numbered(F.array(E.entity(F.lit("Ann"), "name"))))


def files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize("fmt", writers.FORMATS)
def test_formats(spark, tmp_path, fmt):
    df = docs(spark).repartition(3)
    sink.save(df, "id", fmt, str(tmp_path / "out"))
    made = {r.id: bytes(r.content) for r in writers.exported(df, "id", fmt).collect()}
    found = {os.path.basename(f): open(f, "rb").read() for f in files(tmp_path)}
    assert found == {f"{k}_redacted.{fmt}": v for k, v in made.items()}
    assert not os.path.exists(tmp_path / "out" / sink.STAGING)
    assert {bytes(r.content) for r in sink.load(spark, str(tmp_path / "out")).collect()} == set(made.values())


def test_names_and_modes(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("a/b", b"1"), ("..", b"2"), ("a", b"3"), ("a", b"4"), ("", b"5"), (None, b"6"), ("x" * 400, b"7"), ("gone", None), ("é b.c", b"8")]
    df = spark.createDataFrame(rows, "key string, content binary").coalesce(1)
    write = sink.register(spark) and (lambda d, mode: d.write.format(sink.NAME).option("format", "txt").mode(mode).save(out))
    write(df, "append")
    got = {os.path.relpath(f, out).split(os.sep, 1)[1]: open(f, "rb").read() for f in files(out)}
    assert {got[f"{n}_redacted.txt"] for n in ("a%2Fb", "%2E.", "a", "%", "null", "é b.c")} == {b"1", b"2", b"3", b"5", b"6", b"8"} and got["a_redacted-2.txt"] == b"4" and len(got) == 8
    write(df.limit(0), "append")
    assert len(files(out)) == 8
    write(df.where("key = 'a'"), "overwrite")
    assert sorted(open(f, "rb").read() for f in files(out)) == [b"3", b"4"]
    assert len({safe_name(x) for x in ("a/b", "a%2Fb", "a\\b", "A/b", "", "%", "x" * 400, "x" * 401)}) == 8 and len(safe_name("日" * 500)) < 255
    for bad in (df.select("content", "key"), df.select("key")):
        with pytest.raises(Exception, match="string key"):
            write(bad, "append")
    with pytest.raises(Exception, match="unsupported export format"):
        df.write.format(sink.NAME).option("format", "xls").mode("append").save(out)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    sink.save(docs(spark, 3), "id", "txt", out)
    before = {f: open(f, "rb").read() for f in files(out)}
    broken = docs(spark, 4000).repartition(4).withColumn("text", F.when(F.col("id") == 3999, F.raise_error(F.lit("on purpose"))).otherwise(F.col("text")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="on purpose"):
            sink.save(broken, "id", "txt", out, mode)
        assert {f: open(f, "rb").read() for f in files(out)} == before


def test_a_killed_task_leaves_nothing(tmp_path):
    """A worker dies after it has written some of its files; the attempt that follows writes them all, once."""
    code = f"""
        import os, signal, sys
        sys.path.insert(0, {ROOT!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession, functions as F
        from veilspark.plans.ship import ship
        from veilspark.sources import sink
        spark = ship(SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate())
        stage = sink.Job.stage
        def killed(self, batches):
            out = stage(self, batches)
            if TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() == 0:
                os.kill(os.getpid(), signal.SIGKILL)
            return out
        sink.BatchWriter.write = killed
        import pyspark.cloudpickle as cp
        cp.register_pickle_by_value(sink)
        df = spark.range(200).repartition(4).select(F.col("id").cast("string").alias("key"), F.encode(F.lit("x"), "UTF-8").alias("content"))
        sink.register(spark)
        df.write.format(sink.NAME).option("format", "txt").mode("append").save({str(tmp_path / "out")!r})
        print("done")
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=240)
    assert "done" in run.stdout, run.stderr[-2000:]
    assert "SIGKILL" in run.stderr or "crashed" in run.stderr or "Python worker exited" in run.stderr
    assert sorted(map(os.path.basename, files(tmp_path))) == sorted(f"{i}_redacted.txt" for i in range(200))


def test_stream_writes_each_document_once(spark, tmp_path):
    src, out, at = tmp_path / "in", tmp_path / "out", tmp_path / "c"
    src.mkdir()

    def run():
        df = spark.readStream.schema("id long, text string").json(str(src)).withColumn("entities", E.numbered(F.array(E.entity(F.lit("Ann"), "name"))))
        sink.save_stream(df, "id", "md", str(out), str(at)).trigger(availableNow=True).start().awaitTermination()

    docs(spark, 5).select("id", "text").coalesce(1).write.mode("append").json(str(src))
    run()
    run()
    first = files(out)
    assert len(first) == 5
    os.remove(at / "commits" / "0")  # as if the query had died between the sink's commit and Spark's own
    for f in (at / "commits").glob(".0*"):
        os.remove(f)
    docs(spark, 9).where("id >= 5").select("id", "text").coalesce(1).write.mode("append").json(str(src))
    run()
    assert sorted(os.path.basename(f) for f in files(out)) == [f"{i}_redacted.md" for i in range(9)]


def test_folder_to_folder(spark, tmp_path):
    """Files come twice, late and broken; the query is restarted between and in the middle of its batches."""
    from veilspark.plans import pipeline

    src, out, at = tmp_path / "in", tmp_path / "out", str(tmp_path / "c")
    src.mkdir()

    def run():
        pipeline.scan_folder(spark, str(src), str(out), "txt", at).trigger(availableNow=True).start().awaitTermination()

    (src / "a.txt").write_text("ID 12345678901 of Ann")
    (src / "b.md").write_text("nothing")
    (src / "bad.txt").write_bytes(b"\xff")
    (src / "x.png").write_bytes(b"x")
    (src / "c.docx").write_bytes(writers.docx_bytes(docs(spark, 1).select(writers.docx_document(F.lit("ID 12345678901"))).first()[0]))
    run()
    (src / "again").mkdir()
    now = os.stat(src / "a.txt").st_mtime
    os.utime(src / "a.txt", (now + 3600, now + 3600))  # listed anew
    (src / "d.txt").write_text("98765432109")
    os.utime(src / "d.txt", (now - 200_000, now - 200_000))  # old, and not lost
    run()
    newest = max(int(f) for f in os.listdir(tmp_path / "c" / "commits") if f.isdigit())
    for f in (f"{newest}", f".{newest}.crc"):
        if os.path.exists(tmp_path / "c" / "commits" / f):
            os.remove(tmp_path / "c" / "commits" / f)
    run()
    got = {os.path.basename(f): open(f, encoding="utf-8").read() for f in files(out)}
    block = "█" * 11
    assert len(files(out)) == len(got)
    assert got == {"a.txt_redacted.txt": f"ID {block} of Ann", "b.md_redacted.txt": "nothing", "c.docx_redacted.txt": f"ID {block}", "d.txt_redacted.txt": block}


def test_archives_hold_every_file(spark, tmp_path, monkeypatch):
    """All formats by one job, in few archives of a bounded size, with the bytes that one file each has."""
    df = docs(spark, 60).repartition(2)
    folder = str(tmp_path / "out")
    sink.save_archived(df, "id", writers.FORMATS, folder)
    assert len(files(folder)) == 2 and not os.path.exists(tmp_path / "out" / sink.STAGING)
    expected = {f"{r.id}_redacted.{f}": bytes(r.content) for f in writers.FORMATS for r in writers.exported(df, "id", f).collect()}
    got = [(os.path.basename(r.path), bytes(r.content), r.length) for r in sink.unpacked(spark, folder).collect()]
    assert len(got) == 240 and {n: c for n, c, _ in got} == expected and all(len(c) == n for _, c, n in got)
    assert sorted((r.id, r.format, bytes(r.content)) for r in writers.exported_all(df, "id").collect()) == sorted((int(n.split("_")[0]), n.rsplit(".")[1], c) for n, c in expected.items())
    monkeypatch.setattr(sink, "ARCHIVE", 1000)
    job = sink.Job(str(tmp_path / "small"), "txt", False, True).begin()
    rows = sink.pa.RecordBatch.from_pydict({"key": ["a", "a", "b", None], "content": [b"x" * 900, b"y" * 900, b"z", None]})
    assert (job.stage(iter([rows])).files, len(files(tmp_path / "small"))) == (3, 2)
    with pytest.raises(Exception, match="unsupported export format"):
        sink.save_archived(df, "id", ("xls",), folder)


def test_archives_are_compressed_as_a_whole(spark, tmp_path):
    """Small files of one form take a fraction of their bytes, and archives that were not compressed are still read."""
    df = docs(spark, 2000).coalesce(1)
    packed, plain = str(tmp_path / "packed"), str(tmp_path / "plain")
    sink.save_archived(df, "id", writers.FORMATS, packed)
    made = {f"{r.id}_redacted.{r.format}": bytes(r.content) for r in writers.exported_all(df, "id").collect()}
    assert {os.path.basename(r.path): bytes(r.content) for r in sink.unpacked(spark, packed).collect()} == made and len(made) == 8000
    assert sum(map(os.path.getsize, files(packed))) < sum(map(len, made.values())) / 10
    os.makedirs(plain)
    with sink.zipfile.ZipFile(f"{plain}/000000.zip", "w") as z:
        for name, content in made.items():
            z.writestr(name, content)
    assert {os.path.basename(r.path): bytes(r.content) for r in sink.unpacked(spark, plain).collect()} == made


def test_files_of_archives_are_opened_by_one_reading(spark, tmp_path):
    """The same texts and errors as by a reading for each kind, of archives that take a fraction of their files' bytes."""
    folder = str(tmp_path / "out")
    sink.save_archived(docs(spark, 500).coalesce(1), "id", writers.FORMATS, folder)
    found = sink.unpacked(spark, folder)
    assert sum(map(os.path.getsize, files(folder))) < found.agg(F.sum("length")).first()[0] / 10
    odd = [("/a/x.txt", b"\xff"), ("/a/x.md", b""), ("/a/x.docx", b"no"), ("/a/x.pdf", b"no"), ("/a/x.png", b"x"), ("/a/none", b"x"), ("/a/n.txt", None)]
    both = found.select("path", "content").union(spark.createDataFrame(odd, "path string, content binary"))
    got = readers.open_files(both, once=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, readers.open_files(both).collect()), key=str) and got.schema == readers.open_files(both).schema
    plan = readers.open_files(found, once=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
