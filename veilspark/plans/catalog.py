"""Every query over the driver tables by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import category as C, dates as D, text as T
from ..operators import birth as B, detect, entities as E, gazetteer as G, render as R, reply, rowwise, spans as S, summary as A
from ..sources import models, readers, sink, writers
from ..sources.tables import table
from ..streaming import edits as L, progress as P
from . import duck, pipeline
from .fixtures import edits, made, noted, notes, replies, unreadable

def as_of() -> Column:
    return F.lit("2024-01-01").cast("date")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with corrected, completed and numbered entities."""
    return detect.corrected(noted(spark, sf_dir)).withColumn("entities", E.numbered(F.col("entities")))


def rows(df: DataFrame, *names: str) -> DataFrame:
    return A.rows(df, "note_id").select("note_id", "ord", *names)


@query("notes", duck.NOTES + "SELECT note_id, patient, national_id, birth, visit, lang, text FROM notes")
def _(spark, d):
    return notes(spark, d).drop("variant")


@query("national_ids", duck.NOTES + r"SELECT note_id, 0 AS ord, unnest(list_distinct(regexp_extract_all(text, '\b[1-9]\d{10}\b'))) AS national_id FROM notes")
def _(spark, d):
    return A.exploded(notes(spark, d), E.national_ids(F.col("text")), "note_id").withColumnRenamed("e", "national_id")


@query("reclassify", duck.NOTED + "SELECT note_id, CAST(ord AS INTEGER) AS ord, original, category, subcategory FROM fixed")
def _(spark, d):
    return rows(noted(spark, d).withColumn("entities", E.reclassified(F.col("entities"))), "original", "category", "subcategory")


@query("normalize_category", duck.categories())
def _(spark, d):
    return made(spark, d, "labels").select("p_partkey", "raw", C.normalize_category(F.col("raw")).alias("category"), C.normalize_category(F.col("raw"), True).alias("strict"))


@query("parse_date", duck.date_cases())
def _(spark, d):
    return made(spark, d, "dates").select("o_orderkey", "input", D.parse_date(F.col("input")).alias("parsed"))


@query("parse_date_notes", duck.NOTED + f"SELECT note_id, CAST(ord AS INTEGER) AS ord, original, {duck.parse_date('original')} AS parsed FROM fixed")
def _(spark, d):
    return rows(noted(spark, d), "original").withColumn("parsed", D.parse_date(F.col("original")))


def _ages(spark: SparkSession, d: str) -> DataFrame:
    years, months = D.age_diff(F.col("birth"), F.col("visit"))
    return notes(spark, d).select("note_id", years.alias("years"), months.alias("months"))


AGES = duck.NOTES + f"SELECT note_id, {duck.years('birth', 'visit')} AS years, {duck.months('birth', 'visit')} AS months FROM notes"


@query("age_diff", AGES)
def _(spark, d):
    return _ages(spark, d)


def _phrase(lang: str) -> None:
    @query(f"age_phrase_{lang}", f"SELECT note_id, {duck.phrase('years', 'months', repr(lang))} AS phrase FROM ({AGES})")
    def _(spark, d):
        return _ages(spark, d).select("note_id", D.age_phrase(F.col("years"), F.col("months"), F.lit(lang)).alias("phrase"))


_phrase("en")
_phrase("tr")


def _birth(name: str, find: Callable[[Column, Column, Column], Column], oracle: str) -> None:
    @query(name, duck.BIRTH + oracle)
    def _(spark, d):
        df = merged(spark, d).withColumn("dates", B.dated(F.col("entities"))).withColumn("scan", B.scanned(F.col("text"), as_of()))
        return df.withColumn("found", find(F.col("dates"), F.col("text"), F.col("scan"))).select("note_id", F.col("found.birth").alias("birth"), F.col("found.ord").alias("ord"))


@query("birth_regex", duck.BIRTH + "SELECT note_id, scan AS birth FROM scans")
def _(spark, d):
    return notes(spark, d).select("note_id", B.scanned(F.col("text"), as_of()).alias("birth"))


_birth("birth_scan_entity", lambda dates, text, scan: B.by_scan(dates, scan), "SELECT note_id, birth, ord FROM s0")
_birth("birth_subcategory", lambda dates, text, scan: B.by_subcategory(dates), "SELECT note_id, birth, ord FROM s1")
_birth("birth_context", lambda dates, text, scan: B.by_context(dates, text), "SELECT note_id, birth, ord FROM s2")
_birth("birth_earliest", lambda dates, text, scan: B.earliest(dates), "SELECT note_id, birth, ord FROM s3")
_birth("birth_cascade", B.detected, "SELECT note_id, birth, ord FROM cascade")


@query("age_conversion", duck.BIRTH + "SELECT note_id, ord, original, placeholder, detected_birth_date FROM aged")
def _(spark, d):
    df = pipeline.with_ages(merged(spark, d), True, as_of())
    return A.exploded(df, F.col("entities"), "note_id", "detected_birth_date").select("note_id", "ord", "e.original", "e.placeholder", "detected_birth_date")


@query("age_override", duck.override("1980-05-17"))
def _(spark, d):
    df = pipeline.with_ages(merged(spark, d), True, as_of(), F.lit("17.05.1980"))
    return A.exploded(df, F.col("entities"), "note_id", "detected_birth_date").select("note_id", "ord", "e.placeholder", "detected_birth_date")


@query("merge_supplement", duck.NOTED + "SELECT note_id, ord, original, category, subcategory, CAST(confidence AS DOUBLE) AS confidence FROM merged")
def _(spark, d):
    return rows(detect.corrected(noted(spark, d)), "original", "category", "subcategory", "confidence")


@query("entities_lateral", duck.NOTED + "SELECT note_id, ord, original, category, subcategory, CAST(confidence AS DOUBLE) AS confidence FROM merged")
def _(spark, d):
    """merge_supplement once more, by a table function in SQL."""
    rowwise.register(spark)
    return spark.sql("SELECT n.note_id, e.ord, e.original, e.category, e.subcategory, e.confidence FROM {notes} n, LATERAL entities_of(n.text, n.entities) e", notes=noted(spark, d))


@query("placeholders", duck.NOTED + "SELECT note_id, ord, original, placeholder FROM numbered")
def _(spark, d):
    return rows(merged(spark, d), "original", "placeholder")


@query("manual_entity", duck.NOTED + "SELECT note_id, ord, original, placeholder FROM numbered UNION ALL SELECT note_id, CAST((SELECT count(*) FROM merged m WHERE m.note_id = n.note_id) AS INTEGER), 'is well', '[REDACTED_1]' FROM notes n")
def _(spark, d):
    twice = E.with_manual(E.with_manual(F.col("entities"), F.lit("is well")), F.lit("is well"))
    return rows(merged(spark, d).withColumn("entities", twice), "original", "placeholder")


@query("reassign_with_manual", duck.NOTED + "SELECT note_id, ord, original, placeholder FROM numbered UNION ALL SELECT note_id, CAST((SELECT count(*) FROM merged m WHERE m.note_id = n.note_id) AS INTEGER), 'is well', '[PII_1]' FROM notes n")
def _(spark, d):
    return rows(merged(spark, d).withColumn("entities", E.numbered(E.with_manual(F.col("entities"), F.lit("is well")))), "original", "placeholder")


@query("delete_manual", duck.NOTED + "SELECT note_id, ord, original FROM numbered")
def _(spark, d):
    df = merged(spark, d).withColumn("entities", E.with_manual(F.col("entities"), F.lit("is well")))
    return rows(df.withColumn("entities", E.without_manual(E.without_manual(F.col("entities"), F.size("entities") - 1), F.lit(0))), "original")


@query("toggle_entity", duck.NOTED + "SELECT note_id, ord, ord <> 1 AS enabled FROM merged")
def _(spark, d):
    return rows(merged(spark, d).withColumn("entities", E.toggled(F.col("entities"), F.lit(1), F.lit(False))), "enabled")


@query("toggle_category", duck.NOTED + "SELECT note_id, ord, category <> 'date' AS enabled FROM merged")
def _(spark, d):
    return rows(merged(spark, d).withColumn("entities", E.toggled_category(F.col("entities"), F.lit("date"), F.lit(False))), "enabled")


@query("select_none", duck.NOTED + "SELECT note_id, ord, false AS enabled FROM merged")
def _(spark, d):
    return rows(merged(spark, d).withColumn("entities", E.all_set(F.col("entities"), False)), "enabled")


@query("edits_folded", duck.EDITS_FOLDED)
def _(spark, d):
    return rows(L.folded(merged(spark, d), edits(spark, d), "note_id"), "original", "placeholder", "enabled")


@query("category_counts", duck.NOTED + "SELECT note_id, category, count(*) AS n FROM merged GROUP BY ALL")
def _(spark, d):
    return A.category_counts(merged(spark, d), "note_id")


def _summary(lang: str) -> None:
    @query(f"summary_{lang}", duck.summary(lang))
    def _(spark, d):
        return merged(spark, d).select("note_id", A.summary(F.col("entities"), F.lit(lang)).alias("summary"))


_summary("en")
_summary("tr")


@query("enabled_summary", duck.NOTED + "SELECT note_id, (count(*) FILTER (category <> 'date')) || '/' || count(*) || ' entities enabled' AS summary FROM merged GROUP BY note_id")
def _(spark, d):
    return merged(spark, d).select("note_id", A.enabled_summary(E.toggled_category(F.col("entities"), F.lit("date"), F.lit(False))).alias("summary"))


def _spanned(spark: SparkSession, d: str, age: bool = False) -> DataFrame:
    df = merged(spark, d)
    if age:
        df = pipeline.with_ages(df, True, as_of())
    return df.withColumn("spans", S.kept_spans(S.all_spans(F.col("text"), F.col("entities"))))


@query("spans_all", duck.SPANS + 'SELECT note_id, "start", "end", ord FROM spans')
def _(spark, d):
    return A.exploded(merged(spark, d), S.all_spans(F.col("text"), F.col("entities")), "note_id").select("note_id", "e.*")


@query("spans_automaton", duck.SPANS + 'SELECT note_id, "start", "end", ord FROM spans')
def _(spark, d):
    return A.exploded(merged(spark, d), G.all_spans(F.col("text"), F.col("entities")), "note_id").select("note_id", "e.*")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Every word of six letters and more that a conversation or a benchmark text has."""
    texts = table(spark, d, "conversations").select("text").union(table(spark, d, "benchmark").select("text"))
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0)).alias("name")).distinct()


@query("gazetteer", duck.gazetteer(False))
def _(spark, d):
    """Where the names stand in whole documents: how often each, and the first and last place."""
    docs = table(spark, d, "documents")
    unique = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return G.counted(docs, "doc_id", _names(spark, d), unique)


@query("gazetteer_resolved", duck.gazetteer(True))
def _(spark, d):
    return G.resolved(G.gazetteer(table(spark, d, "benchmark"), "item_id", _names(spark, d)), "item_id")


@query("spans_kept", duck.SPANS + 'SELECT note_id, k.s AS "start", k.e AS "end", k.o AS ord FROM (SELECT note_id, unnest(kept) AS k FROM kept)')
def _(spark, d):
    return A.exploded(_spanned(spark, d), F.col("spans"), "note_id").select("note_id", "e.*")


@query("highlight_html", duck.html(True))
def _(spark, d):
    return _spanned(spark, d).select("note_id", R.highlighted_html(F.col("text"), F.col("entities"), F.col("spans")).alias("html"))


@query("redact_html", duck.html(False))
def _(spark, d):
    return _spanned(spark, d, True).select("note_id", R.redacted_html(F.col("text"), F.col("entities"), F.col("spans")).alias("html"))


@query("redact_tagged", duck.redact("placeholder"))
def _(spark, d):
    return merged(spark, d).select("note_id", R.redacted_tagged(F.col("text"), F.col("entities")).alias("redacted"))


@query("redact_plain", duck.redact(duck.BLOCKS))
def _(spark, d):
    return merged(spark, d).select("note_id", R.redacted_plain(F.col("text"), F.col("entities")).alias("redacted"))


@query("redact_plain_ages", duck.redact(f"CASE WHEN placeholder NOT LIKE '[%' THEN placeholder ELSE {duck.BLOCKS} END", "aged"))
def _(spark, d):
    return pipeline.with_ages(merged(spark, d), True, as_of()).select("note_id", R.redacted_plain(F.col("text"), F.col("entities")).alias("redacted"))


@query("redact_spans", duck.span_tags())
def _(spark, d):
    return merged(spark, d).select("note_id", R.redacted_spans(F.col("text"), F.col("entities")).alias("redacted"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select("note_id", R.redacted_tagged(F.col("text"), F.col("entities")).alias("redacted"))


@query("export_md", f"SELECT note_id, '# Redacted Document' || chr(10) || chr(10) || redacted || chr(10) || chr(10) || '---' || chr(10) || '*De-identified by veilspark*' || chr(10) AS md FROM ({duck.redact(duck.BLOCKS)})")
def _(spark, d):
    return merged(spark, d).select("note_id", writers.markdown(R.redacted_plain(F.col("text"), F.col("entities"))).alias("md"))


@query("export_docx_xml", duck.docx())
def _(spark, d):
    return _tagged(spark, d).select("note_id", writers.docx_document(F.col("redacted")).alias("xml"))


@query("export_pdf_layout", duck.pdf())
def _(spark, d):
    return writers.pdf_layout(_tagged(spark, d), "note_id", F.col("redacted"))


@query("export_name", duck.EXPORT_NAME)
def _(spark, d):
    return made(spark, d, "paths").select("c_custkey", "path", T.export_name(F.col("path"), "docx").alias("name"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "html")


@query("strip_markup", duck.STRIP)
def _(spark, d):
    return _pages(spark, d).select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def _(spark, d):
    return _pages(spark, d).select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query("xml_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def _(spark, d):
    return _pages(spark, d).select("page_id", T.xml_escape(F.col("html")).alias("escaped"))


def _stripped(name: str, strip: Callable[[Column], Column]) -> None:
    @query(f"{name}_strip", duck.reply_texts(name))
    def _(spark, d):
        out = strip(F.col("raw"))
        return made(spark, d, "raws").select("conv_id", "turn", F.sha2(out, 256).alias("sha256"), F.length(out).alias("n"))


_stripped("think", T.think_strip)
_stripped("fence", T.fence_strip)


@query("reply_entities", duck.REPLY_ENTITIES)
def _(spark, d):
    return rows(reply.parsed(replies(spark, d)), "original", "category", "subcategory", "confidence")


@query("reply_errors", duck.REPLY_ERRORS)
def _(spark, d):
    return reply.parsed(replies(spark, d)).groupBy("form").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"), F.sum(F.size("entities")).alias("n_entities"))


@query("prompts", duck.prompts())
def _(spark, d):
    """What a model is asked about each note and each document, by its digest."""
    both = notes(spark, d).select("note_id", "lang", "text").union(table(spark, d, "documents").select("doc_id", "lang", "text"))
    return detect.prompts(both).select("note_id", "lang", F.octet_length("prompt").alias("n_bytes"), detect.digest().alias("digest"))


@query("reply_failures", duck.REPLY_FAILURES)
def _(spark, d):
    return reply.parsed(unreadable(spark, d)).select("note_id", F.col("entities").isNull().alias("failed"), "error")


@query("reply_well_typed", duck.REPLY_WELL_TYPED)
def _(spark, d):
    """Read in the JVM alone; the rest are errors."""
    return rows(reply.parsed(replies(spark, d), salvage=False).where("error IS NULL"), "original", "category", "subcategory", "confidence")


@query("entity_table", duck.NOTED + "SELECT note_id, CAST(ord + 1 AS INTEGER) AS row, original, category, placeholder, CAST(round(confidence * 100) AS INTEGER) AS percent FROM numbered")
def _(spark, d):
    return A.entity_table(merged(spark, d), "note_id")


@query("truncate_input", duck.TRUNCATE)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(T.truncate_input(F.col("text"), 2000)).alias("n"))


@query("truncate_long", duck.truncate(90_000, "repeat(text || chr(10), 60)"))
def _(spark, d):
    """What a model is given of texts longer than it takes."""
    cut = T.truncate_input(F.repeat(F.concat("text", F.lit("\n")), 60), 90_000)
    return table(spark, d, "documents").select("doc_id", F.length(cut).alias("n"), F.sha2(cut, 256).alias("sha256"))


@query("recalc_ages", duck.RECALC_AGES)
def _(spark, d):
    return pipeline.recalc(merged(spark, d), True, as_of()).select("note_id", "summary", "detected_birth_date", "redacted_html")


@query("toggle_refresh", duck.TOGGLE_REFRESH)
def _(spark, d):
    return pipeline.toggle(merged(spark, d), F.lit(1), F.lit(False)).select("note_id", "summary", "redacted_html")


@query("export_docx_documents", duck.docx_documents())
def _(spark, d):
    """Paragraphs of whole documents, with blank lines and line ends of both kinds among them."""
    text = F.concat("text", F.lit("\r\n \t\n\n"), "text", F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", F.sha2(writers.docx_document(text), 256).alias("sha256"))


@query("selection", duck.SELECTION)
def _(spark, d):
    found = T.selection(F.col("chosen"), F.col("text"))
    return made(spark, d, "chosen").select("doc_id", F.length(found).alias("n"), F.sha2(found, 256).alias("sha256"), F.contains("text", found).alias("found"))


@query("model_inventory", duck.inventory())
def _(spark, d):
    return models.inventory(made(spark, d, "files"))


@query("model_catalog", duck.MODEL_CATALOG)
def _(spark, d):
    return models.catalogue_status(made(spark, d, "offered"), made(spark, d, "fetched"), "m7")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return ev.select(F.col("user_id").alias("download_id"), "ts", (F.col("value") * 1000).cast("long").alias("bytes"), F.col("event_id").alias("seq"))


@query("progress", duck.PROGRESS)
def _(spark, d):
    return P.progress(_chunks(spark, d)).select("download_id", "seq", "downloaded", "total", P.rounded(F.col("percent"), 6).alias("percent"))


@query("progress_rates", duck.PROGRESS_RATES)
def _(spark, d):
    return P.progress(_chunks(spark, d)).select("download_id", "seq", "mib_per_s", "eta_secs")


def _throttled(name: str, download: str, slower: int) -> None:
    """slower: the events' times divided, so that many chunks come within an interval."""

    @query(name, duck.throttled(download, slower))
    def _(spark, d):
        ts = F.timestamp_micros(F.expr(f"unix_micros(CAST(ts AS timestamp)) div {slower}"))
        chunks = _chunks(spark, d).withColumns({"ts": ts, "download_id": F.expr(download.replace("user_id", "download_id")).cast("long")})
        return P.throttled(P.progress(chunks)).withColumn("percent", P.rounded(F.col("percent"), 6))


_throttled("progress_throttled", "user_id", 1)
_throttled("progress_dense", "user_id", 200_000)
_throttled("progress_one_download", "0 * user_id", 20_000)


@query("corpus_rollup", duck.NOTED + "SELECT lang, category, count(*) AS n, count(*) AS n_enabled FROM merged GROUP BY CUBE (lang, category)")
def _(spark, d):
    return A.corpus_rollup(merged(spark, d), "lang")


@query("scan_replies")
def _(spark, d):
    return pipeline.scan(replies(spark, d), detect.ReplyColumnDetector(), True, as_of()).select("note_id", "summary", "detected_birth_date", "redacted_html", "error")


@query("recalc", duck.NOTED + "SELECT note_id, count(*) || '/' || count(*) || ' entities enabled' AS summary FROM merged GROUP BY note_id")
def _(spark, d):
    return pipeline.recalc(merged(spark, d), False, as_of()).select("note_id", "summary")


@query("export_files")
def _(spark, d):
    files = writers.exported_all(merged(spark, d), "note_id")
    return files.select("note_id", "format", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("export_sink", duck.SINK)
def _(spark, d):
    """Every note's file in all four formats, written by the sink into archives and read back; of a DOCX file the digest is its document's."""
    folder = sink.scratch(spark, "export")
    sink.save_archived(merged(spark, d), "note_id", writers.FORMATS, folder)
    files, packed = (sink.unpacked(spark, folder, kinds).withColumn("kind", T.file_type(F.col("path"))) for kinds in (("txt", "md", "pdf"), ("docx",)))
    both = files.select("path", "kind", "content").union(readers.raw_texts(packed).select("path", "kind", F.encode("raw", "UTF-8").alias("content")))
    return both.select(F.regexp_extract("path", r"(\d+)_redacted\.\w+$", 1).cast("long").alias("note_id"), F.col("kind").alias("format"), F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("open_files", duck.OPEN_FILES)
def _(spark, d):
    """Exports of all notes, opened again: plain text as it was, and the lines of a PDF."""
    folder = sink.scratch(spark, "open")
    sink.save_archived(merged(spark, d), "note_id", ("txt", "pdf"), folder)
    found = readers.open_files(sink.unpacked(spark, folder), once=True)
    return found.select(F.regexp_extract("path", r"(\d+)_redacted\.\w+$", 1).cast("long").alias("note_id"), "kind", F.sha2("text", 256).alias("sha256"), "error")
