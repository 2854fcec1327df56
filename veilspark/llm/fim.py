"""Fill-in-the-middle transformation over an index of distinct texts.

Copies are cut at different places but have the same boundaries, so these are found once for
each distinct text: an aggregation whose key is the text itself groups what is equal byte for
byte (with a partial step, so copies of one task are one row before any shuffle), and each
group's token ends become an Elias-Fano list of about a tenth of the text's size. The lists
are written to the shared folder, addressed by the text's SHA-256 and length, and joined back
to the documents by an ordinary join, whose hot keys the skew rule splits. A document then asks
its list for two ends only; the list is never unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import written
from .textbytes import SPACE, buffer, slices, words

SEED, FIM, SPM = 42, 50, 80  #: seed of the cuts; per cent of the documents to transform, and of these in suffix-first form
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
HEAD = 8  #: bytes before a list's bits: its length and its universe


def token_ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends in code points of the tokens (white space and the word behind it, or white space at the text's end), the first of each text (n + 1 values), and the texts' lengths."""
    raw, offs = buffer(column)
    _, ends, first = words(raw, offs)
    a = np.frombuffer(raw, np.uint8)
    points = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
    chars = points[offs[1:]] - points[offs[:-1]]
    count = np.diff(first)
    at = points[ends] - np.repeat(points[offs[:-1]], count)
    full = np.flatnonzero(np.diff(offs))
    tail = full[SPACE[a[offs[1:][full] - 1]]]
    more = np.zeros(len(count), np.int64)
    more[tail] = 1
    return np.insert(at, first[1:][tail], chars[tail]), np.concatenate([[0], np.cumsum(count + more)]), chars


def _low(n: np.ndarray, universe: np.ndarray) -> np.ndarray:
    """Bits of a value that are stored as they are."""
    mean = np.maximum(universe // np.maximum(n, 1), 1)
    return np.floor(np.log2(mean)).astype(np.int64)


def encode(values: np.ndarray, first: np.ndarray, universe: np.ndarray) -> list[bytes]:
    """An Elias-Fano list for each run first[i]:first[i + 1] of rising values, none above universe[i]."""
    n = np.diff(first)
    low = _low(n, universe)
    high_bytes = (n + (universe >> low) + 8) // 8
    size = HEAD + high_bytes + (n * low + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(8 * int(start[-1]), np.uint8)
    of = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(values)) - first[of]
    bits[8 * (start[of] + HEAD) + (values >> low[of]) + i] = 1
    at = 8 * (start[of] + HEAD + high_bytes[of]) + i * low[of]
    for b in range(int(low.max(initial=0))):
        has = low[of] > b
        bits[at[has] + b] = (values[has] >> b) & 1
    out = np.packbits(bits, bitorder="little")
    head = np.stack([n, universe], 1).astype("<u4").view(np.uint8).reshape(-1, HEAD)
    out[(start[:-1, None] + np.arange(HEAD))] = head
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(start[:-1], start[1:])]


def select(lists: pa.Array, asked: np.ndarray) -> np.ndarray:
    """For each list the value at each asked place (one row of places for each list, counted from 0, all inside it)."""
    raw, offs = buffer(lists)
    a = np.frombuffer(raw, np.uint8)
    head = a[offs[:-1, None] + np.arange(HEAD)].copy().view("<u4").astype(np.int64)
    n, universe = head[:, :1], head[:, 1:]
    low = _low(n, universe)
    start = offs[:-1, None] + HEAD
    lows = 8 * (start + (n + (universe >> low) + 8) // 8) + asked * low
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(a).astype(np.int64))])
    rank = ones[start] + asked
    byte = np.searchsorted(ones, rank, side="right") - 1
    left, pos = rank - ones[byte], np.zeros_like(asked)
    for b in range(7, -1, -1):  # the set bit with `left` others before it
        here = a[byte] >> b & 1
        before = np.bitwise_count(a[byte] & ((1 << b) - 1)).astype(np.int64)
        pos = np.where((here == 1) & (before == left), b, pos)
    value = (8 * (byte - start) + pos - asked) << low
    for b in range(int(low.max(initial=0))):
        at = np.minimum(lows + b, 8 * len(a) - 1)
        value |= np.where(low > b, (a[at >> 3] >> (at & 7) & 1).astype(np.int64) << b, 0)
    return value


def size(lists: pa.Array) -> np.ndarray:
    """Lengths of the lists."""
    raw, offs = buffer(lists)
    return np.frombuffer(raw, np.uint8)[offs[:-1, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.int64)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("address"), part.column("bytes"), pa.array(encode(*token_ends(part.column("text"))), pa.binary())], ["address", "bytes", "ends"])


def address(text: Column) -> list[Column]:
    return [F.unhex(F.sha2(text, 256)).alias("address"), F.octet_length(text).alias("bytes")]


def index(texts: DataFrame) -> DataFrame:
    """(address, bytes, ends) for each distinct text of column text: the ends of its tokens as an Elias-Fano list."""
    return texts.select("text").distinct().select("text", *address(F.col("text"))).mapInArrow(_lists, "address binary, bytes int, ends binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            ends, forms = part.column("ends"), part.column("form").to_pylist()
            n = size(ends)
            h = np.stack([np.asarray(part.column(c)) for c in ("h1", "h2")], 1) % (n[:, None] + 1)
            h.sort(1)
            made = np.array([f != "plain" for f in forms], bool)
            at = np.zeros_like(h)
            rows = np.flatnonzero(made)
            if len(rows):
                got = select(ends.take(pa.array(rows)), np.maximum(h[rows] - 1, 0))
                at[rows] = np.where(h[rows] > 0, got, 0)
            out = []
            for t, f, (i, j) in zip(part.column("text").to_pylist(), forms, at.tolist(), strict=True):
                if f == "plain":
                    out.append(t)
                elif f == "psm":
                    out.append(f"{PREFIX}{t[:i]}{SUFFIX}{t[j:]}{MIDDLE}{t[i:j]}")
                else:
                    out.append(f"{SUFFIX}{t[j:]}{PREFIX}{t[:i]}{MIDDLE}{t[i:j]}")
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), part.column("form"), pa.array(at[:, 0], mask=~made), pa.array(at[:, 1] - at[:, 0], mask=~made), pa.array(out, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def transform(docs: DataFrame, seed: int = SEED, fim: int = FIM, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs; lengths are null where the form is plain.

    A null text counts as empty; a null doc_id draws its cut like an empty one. Texts that are
    empty or hold a mark stay plain. Rows that repeat come back as often, each the same; rows
    that share a text and not a doc_id share its list and are cut on their own. An empty table
    gives no rows; other columns of docs, whatever their names, are left alone.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lists = written(index(rows), "fim-index", freed=True)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= fim), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    keyed = rows.select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2"), *address(F.col("text")))
    found = keyed.join(lists, ["address", "bytes"]).select("doc_id", "text", "form", "h1", "h2", "ends")
    return found.mapInArrow(_cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of. A mark has no part that it begins and ends with, so none arises where pieces meet."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def result(docs: DataFrame) -> DataFrame:
    """The query's columns: digests of the outputs, and of the texts that come back from them."""
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS i, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS j,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(tokens[1:i], '') AS prefix, array_to_string(tokens[i + 1:j], '') AS middle, array_to_string(tokens[j + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
