"""Exports: plain text, Markdown, PDF and DOCX."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import xml_escape
from ..operators.render import redacted_plain, redacted_tagged
from ..operators.summary import exploded

FORMATS = ("txt", "md", "pdf", "docx")
#: Page layout of the PDF export: A4 in millimetres, 10 point, lines 4.5 mm apart.
TOP, BOTTOM, LEFT, PITCH, POINTS = 272.0, 25.0, 25.0, 4.5, 10
LINES = int((TOP - BOTTOM) // PITCH)
WIDTH, HEIGHT, MM = 210.0, 297.0, 72 / 25.4
#: The six places where the Turkish code page departs from the font's base encoding.
TURKISH = "208/Gbreve 221/Idotaccent 222/Scedilla 240/gbreve 253/dotlessi 254/scedilla"
#: Fixed values of the DOCX format: namespace, content types, relationships, how a line and a page look.
RUN = '<w:p><w:r><w:rPr><w:rFonts w:ascii="Courier New" w:hAnsi="Courier New" w:cs="Courier New"/><w:sz w:val="20"/></w:rPr><w:t xml:space="preserve">'
SECTION = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr>'
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
TYPES = f'{DECLARATION}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELS = f'{DECLARATION}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
NO_RELS = f'{DECLARATION}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>'


def lines(text: Column) -> Column:
    """Lines without their ends; a last line end begins no line."""
    parts = F.split(text, "\n", -1)
    ended = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.concat(ended, F.filter(F.slice(parts, -1, 1), lambda x: x != ""))


def markdown(redacted: Column) -> Column:
    return F.concat(F.lit("# Redacted Document\n\n"), redacted, F.lit("\n\n---\n*De-identified by veilspark*\n"))


def docx_document(redacted: Column) -> Column:
    """document.xml: a paragraph for each line, an empty one for a line of white space alone."""
    parts = F.transform(lines(redacted), lambda x: F.when(x.rlike(r"(?U)^\s*\z"), F.lit("<w:p/>")).otherwise(F.concat(F.lit(RUN), xml_escape(x), F.lit("</w:t></w:r></w:p>"))))
    return F.concat(F.lit(f'{DECLARATION}<w:document xmlns:w="{W}"><w:body>'), F.array_join(parts, ""), F.lit(f"{SECTION}</w:body></w:document>"))


def pdf_layout(df: DataFrame, key: str, redacted: Column) -> DataFrame:
    """(key, ord, page, y, line): where each line goes, y in tenths of a millimetre."""
    out = exploded(df, lines(redacted), key).withColumnRenamed("e", "line")
    row = F.col("ord") % LINES
    return out.select(key, "ord", F.expr(f"ord div {LINES}").cast("int").alias("page"), (F.lit(int(10 * TOP)) - row * int(10 * PITCH)).cast("int").alias("y"), "line")


def docx_bytes(document: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELS), ("word/_rels/document.xml.rels", NO_RELS), ("word/document.xml", document)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def pdf_bytes(text: str) -> bytes:
    """A PDF of the text in Courier; characters outside the Turkish code page become question marks."""
    rows = text.split("\n")
    rows = [x.removesuffix("\r") for x in rows[:-1]] + rows[-1:] * (rows[-1] != "")
    pages = [rows[i : i + LINES] for i in range(0, len(rows), LINES)] or [[]]
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"", f"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding<</Type/Encoding/BaseEncoding/WinAnsiEncoding/Differences[{TURKISH}]>>>>".encode()]
    kids = []
    for page in pages:
        shown = []
        for i, line in enumerate(page):
            raw = line.encode("cp1254", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            shown.append(f"BT /F1 {POINTS} Tf {LEFT * MM:.2f} {(TOP - i * PITCH) * MM:.2f} Td (".encode() + raw + b") Tj ET")
        body = b"\n".join(shown)
        n = len(objects) + 1
        kids.append(f"{n} 0 R")
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {WIDTH * MM:.2f} {HEIGHT * MM:.2f}]/Resources<</Font<</F1 3 0 R>>>>/Contents {n + 1} 0 R>>".encode())
        objects.append(f"<</Length {len(body)}>>\nstream\n".encode() + body + b"\nendstream")
    objects[1] = f"<</Type/Pages/Count {len(kids)}/Kids[{' '.join(kids)}]>>".encode()
    out, at = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{x:010d} 00000 n \n".encode() for x in at)
    out += f"trailer<</Size {len(objects) + 1}/Root 1 0 R>>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def exported(df: DataFrame, key: str, fmt: str) -> DataFrame:
    """(key, content): the file of each document (text, entities); text formats take blocks, page formats placeholders."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format: {fmt}")
    plain, tagged = redacted_plain(F.col("text"), F.col("entities")), redacted_tagged(F.col("text"), F.col("entities"))
    if fmt in ("txt", "md"):
        return df.select(key, F.encode(plain if fmt == "txt" else markdown(plain), "UTF-8").alias("content"))
    made = df.select(key, (docx_document(tagged) if fmt == "docx" else tagged).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            make = docx_bytes if fmt == "docx" else pdf_bytes
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([None if b is None else make(b) for b in batch.column("body").to_pylist()], pa.binary())], [key, "content"])

    return made.mapInArrow(run, made.select(key).schema.add("content", "binary"))


def exported_all(df: DataFrame, key: str, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """(key, format, content): exported() in several formats, of documents that are read and redacted once."""
    if bad := [f for f in formats if f not in FORMATS]:
        raise ValueError(f"unsupported export format: {bad[0]}")
    texts = df.select(key, redacted_plain(F.col("text"), F.col("entities")).alias("plain"), redacted_tagged(F.col("text"), F.col("entities")).alias("tagged"))
    bodies = {"txt": F.col("plain"), "md": markdown(F.col("plain")), "pdf": F.col("tagged"), "docx": docx_document(F.col("tagged"))}
    makes = {"txt": str.encode, "md": str.encode, "pdf": pdf_bytes, "docx": docx_bytes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in formats:
                made = pa.array([None if b is None else makes[f](b) for b in batch.column(f).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([f] * batch.num_rows, pa.string()), made], [key, "format", "content"])

    made = texts.select(key, *[bodies[f].alias(f) for f in formats])
    return made.mapInArrow(run, made.select(key).schema.add("format", "string").add("content", "binary"))


def save(df: DataFrame, key: str, fmt: str, folder: str) -> None:
    """One file <key>_redacted.<fmt> for each document, in a folder that is mounted on all executors. A file appears whole or not at all, and a task that runs again writes the same."""

    def write(rows) -> None:
        for r in rows:
            name = os.path.join(folder, f"{str(r[key]).replace(os.sep, '_')}_redacted.{fmt}")
            part = f"{name}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, name)

    os.makedirs(folder, exist_ok=True)
    exported(df, key, fmt).foreachPartition(write)
