"""Sampled SentencePiece segmentations.

A text is cut where no piece can reach across: before a space that follows another
character. The pieces that cover such a chunk, whatever its length, form a lattice. Filtering
forward gives the weight of all ways to reach each character boundary; sampling backward from
the end picks each piece in proportion to the ways through it, which draws a segmentation
exactly from the lattice's distribution. A file's merge ranks stand for frequencies: the
piece of rank r weighs (1 / (r + 2)) ** alpha. Characters without a piece become byte pieces.
Random numbers are a function of the row key, the chunk's place and the step, so a row gives
the same pieces on any executor. Filtering runs once for each different short chunk of a
batch, and for longer ones side by side; a chunk past BLOCK is filtered in blocks that hand
on the weights of their last boundaries, and sampled from its last block to its first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbytes import slices, xxh64

SHORT = 24  #: chunks up to here are filtered once for each different one
BLOCK = 2048
GROUP = 60_000  #: characters that are filtered side by side
SLOTS = 18
ALPHA = 1.0
MARK = 0x2581  #: stands for a space in pieces
LITERAL = 0x110000  #: that character itself in a text: it has no piece, so it comes back from bytes
BYTE_WEIGHT = 1e-4
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary: byte pieces, and a table from a piece's hash to its id and weight."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.bytes = np.zeros(256, np.int64)
        text: list[bytes] = [b""] * self.size
        found: dict[int, tuple[int, float, int]] = {}
        self.alpha = alpha
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.bytes[b], text[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text[i] = p.replace("▁", " ").encode()
                codes = [ord(c) for c in p]
                if any(a != MARK and b == MARK for a, b in zip(codes, codes[1:])):
                    raise ValueError("a piece that reaches from a word into the space behind it")
                found[self.hash(codes)] = (i, (1.0 / (2.0 - sp.get_score(i))) ** alpha, len(codes))
        self.text = text
        keys = np.array(sorted(found), np.uint64)
        self.keys = keys
        self.ids = np.array([found[int(k)][0] for k in keys], np.int64)
        self.weights = np.array([*[found[int(k)][1] for k in keys], 0.0])  # the last one, which index -1 reads, is no piece's
        slots, self.ways = self.slot(keys), []
        rest = np.arange(len(keys))
        while len(rest):  # keys of one slot go to tables of their own
            way = np.full(1 << SLOTS, -1, np.int32)
            way[slots[rest[::-1]]] = rest[::-1]
            self.ways.append(way)
            rest = rest[way[slots[rest]] != rest]
        self.longest = max(n for _, _, n in found.values())

    @staticmethod
    def hash(codes: list[int]) -> int:
        h = 0
        for c in codes:
            h = (h * int(BASE) + c + 1) & (1 << 64) - 1
        return h

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * BASE >> np.uint64(64 - SLOTS)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where there is no piece."""
        flat = h.ravel()
        slot = self.slot(flat)
        out = self.ways[0][slot]
        miss = np.flatnonzero((self.keys[out] != flat) & (out >= 0))
        out[miss] = -1
        for way in self.ways[1:]:
            at = way[slot[miss]]
            hit = (at >= 0) & (self.keys[at] == flat[miss])
            out[miss[hit]] = at[hit]
            miss = miss[(at >= 0) & ~hit]
        return out.reshape(h.shape)


def filtered(codes: np.ndarray, pieces: Pieces, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chunks side by side: (chunk, end, length - 1) cumulative chances that the piece that ends there has at most that length, its piece's index (-1: bytes), and the weights of the boundaries, each last few of which share a scale. begun: the weights of the first boundaries, where the codes go on from an earlier block."""
    m, n = codes.shape
    most = min(n, pieces.longest)
    at = np.full((m, n + 1, most), -1, np.int32)
    weight = np.zeros((m, n + 1, most))
    h = np.zeros((m, n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, most + 1):
            h = h[:, : n - k + 1] * BASE + codes[:, k - 1 :].astype(np.uint64) + np.uint64(1)
            found = pieces.find(h)
            at[:, k:, k - 1] = found
            w = pieces.weights[found]
            if k == 1:
                w[found < 0] = BYTE_WEIGHT
            weight[:, k:, k - 1] = w
    alpha = np.zeros((m, n + 1))
    if begun is None:
        begun = np.ones((m, 1))
    alpha[:, : begun.shape[1]] = begun
    for j in range(begun.shape[1], n + 1):
        k = min(j, most)
        weight[:, j, :k] *= alpha[:, j - k : j][:, ::-1]
        alpha[:, j] = weight[:, j, :k].sum(1)
        weight[:, j] = np.cumsum(weight[:, j], axis=1) / alpha[:, j, None]
        if j % 8 == 0:  # only ratios of the last boundaries count from here on
            alpha[:, max(0, j - most + 1) : j + 1] /= alpha[:, j, None].copy()
    return weight, at, alpha


def uniform(key: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys and a step."""
    with np.errstate(over="ignore"):
        x = key + np.asarray(step + 1).astype(np.uint64) * BASE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def chunks(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and texts of the chunks of texts that lie end to end."""
    n = len(codes)
    first = np.zeros(n + 1, bool)
    first[1:-1] = (codes[1:] == MARK) & (codes[:-1] != MARK)
    first[offs] = True
    begin = np.flatnonzero(first[:-1]) if n else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, n)), np.searchsorted(offs, begin, side="right") - 1


def sampled_in_blocks(codes: np.ndarray, key: np.uint64, pieces: Pieces, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """One chunk of any length: for each step from its end, where the piece begins and its index (-1: bytes)."""
    reach = pieces.longest
    starts = list(range(0, len(codes), block))
    begun: list[np.ndarray | None] = [None]  # weights of the boundaries up to each block's start

    def of(i: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        lo = max(0, starts[i] - reach)
        return lo, filtered(codes[None, lo : starts[i] + block], pieces, begun[i])

    for i in range(len(starts) - 1):
        lo, (_, _, alpha) = of(i)
        begun.append(alpha[:, max(0, starts[i + 1] - reach) - lo : starts[i + 1] - lo + 1])
    pos, step, froms, found, chance = len(codes), 0, [], [], []
    for i in range(len(starts) - 1, -1, -1):
        lo, (cum, at, _) = of(i)
        while pos > starts[i]:
            if step % 4096 == 0:
                chance = uniform(key, np.arange(step, step + 4096)).tolist()
            row = cum[0, pos - lo]
            k = min(int(np.searchsorted(row, chance[step % 4096], side="right")), min(pos - lo, len(row)) - 1)
            found.append(at[0, pos - lo, k])
            pos -= k + 1
            froms.append(pos)
            step += 1
    return np.array(froms, np.int64), np.array(found, np.int64)


def segment(texts: list[str], keys: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and n + 1 offsets; keys are the rows' 64-bit keys."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes[codes == MARK] = LITERAL
    codes[codes == 32] = MARK
    begin, size, doc = chunks(codes, offs)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    place = np.arange(len(begin)) - np.searchsorted(doc, doc)
    with np.errstate(over="ignore"):
        seed = keys.astype(np.uint64)[doc] * np.uint64(0xD6E8FEB86659FD93) ^ (place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    got = []  # (chunk, step from its end, piece or bytes of a character)
    count = np.zeros(len(begin), np.int64)

    def sample(cum: np.ndarray, at: np.ndarray, live: np.ndarray, row: np.ndarray) -> None:
        pos, step = size[live], 0
        while len(live):
            k = (cum[row, pos] <= uniform(seed[live], step)[:, None]).sum(1)
            k = np.minimum(k, np.minimum(pos, cum.shape[2]) - 1)
            found = at[row, pos, k]
            pos = pos - k - 1
            got.append((live, np.full(len(live), step), np.where(found >= 0, pieces.ids[found], -1 - (begin[live] + pos))))
            count[live] += 1
            step += 1
            more = pos > 0
            live, row, pos = live[more], row[more], pos[more]

    short = np.flatnonzero(size <= SHORT)
    h = np.zeros(len(begin), np.uint64)
    h[short] = xxh64(codes.tobytes(), 4 * begin[short], 4 * size[short])
    for n in np.unique(size[short]):
        group = short[size[short] == n]
        _, one, of = np.unique(h[group], return_index=True, return_inverse=True)
        step_of = max(1, 2_000_000 // (int(n) + 1) // min(int(n), pieces.longest))
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(0, len(one) + step_of, step_of))
        for b, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            some = one[b * step_of : (b + 1) * step_of]
            cum, at, _ = filtered(codes[begin[group[some]][:, None] + np.arange(n)], pieces)
            sample(cum, at, group[order[lo:hi]], of[order[lo:hi]] - b * step_of)
    longer = np.flatnonzero((size > SHORT) & (size <= BLOCK))
    longer = longer[np.argsort(size[longer], kind="stable")]
    while len(longer):
        fit = np.flatnonzero(size[longer] * (np.arange(len(longer)) + 1) <= GROUP)
        live, longer = longer[: len(fit) or 1], longer[len(fit) or 1 :]
        n = int(size[live].max())
        side = np.minimum(begin[live][:, None] + np.arange(n), len(codes) - 1)  # what lies behind a chunk is not looked at
        cum, at, _ = filtered(codes[side], pieces)
        sample(cum, at, live, np.arange(len(live)))
    for c in np.flatnonzero(size > BLOCK).tolist():
        froms, found = sampled_in_blocks(codes[begin[c] : begin[c] + size[c]], seed[c], pieces)
        got.append((np.full(len(froms), c), np.arange(len(froms)), np.where(found >= 0, pieces.ids[found], -1 - (begin[c] + froms))))
        count[c] = len(froms)
    upto = np.cumsum(count)
    flat = np.empty(int(upto[-1]), np.int64)
    for live, step, piece in got:
        flat[upto[live] - 1 - step] = piece
    ends = np.concatenate([[0], upto])[np.searchsorted(begin, offs)]
    alone = np.flatnonzero(flat < 0)
    if len(alone):
        raw = [("▁" if c == LITERAL else " " if c == MARK else chr(c)).encode("utf-8", "surrogatepass") for c in codes[-1 - flat[alone]].tolist()]
        n = np.ones(len(flat), np.int64)
        n[alone] = [len(x) for x in raw]
        at = np.cumsum(n) - n
        wide = np.repeat(flat, n)
        into = np.repeat(at[alone], n[alone]) + np.arange(n[alone].sum()) - np.repeat(np.cumsum(n[alone]) - n[alone], n[alone])
        wide[into] = pieces.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.append(at, len(wide))[ends]
        flat = wide
    return flat, ends


def text_of(ids: list[int], pieces: Pieces) -> str:
    """The text that ids stand for, byte for byte."""
    return b"".join(map(pieces.text.__getitem__, ids)).decode("utf-8", "surrogatepass")


_loaded: dict[int, Pieces] = {}


def loaded(file: tuple[bytes, float]) -> Pieces:
    """One vocabulary for each Python worker and file."""
    key = hash(file)
    if key not in _loaded:
        _loaded[key] = Pieces(*file)
    return _loaded[key]


def _file(docs: DataFrame, path: str | None, alpha: float):
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((f.read(), alpha))


def _rows(batches: Iterator[pa.RecordBatch], file) -> Iterator[tuple]:
    pieces = loaded(file.value)
    for batch in batches:
        for rows in slices(batch, "text", 4 << 20):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            keys = np.asarray(rows.column("key")).astype(np.int64).view(np.uint64)
            yield rows, texts, *segment(texts, keys, pieces), pieces


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(seed).cast("long"), doc_id).alias("key"))


def encode(docs: DataFrame, seed: int = 0, alpha: float = ALPHA, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of docs: a segmentation drawn under the row's doc_id and `seed`.

    A null or empty text has no ids, a null doc_id draws like a row of its own key, rows that
    repeat a doc_id draw under the same key, an empty table gives no rows, extra columns are
    left alone. A run without spaces is one lattice, however long. decode() gives each text
    back exactly.
    """
    file = _file(docs, path, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, ids, ends, _ in _rows(batches, file):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return _keyed(docs, seed).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    file = _file(ids, path, ALPHA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(file.value)
        for batch in batches:
            texts = [None if x is None else text_of(x, pieces) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def result(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The query's columns: the number of pieces, digests of their ids and whether they give the whole text back."""
    file = _file(docs, None, ALPHA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, ids, ends, pieces in _rows(batches, file):
            all_ids, cut, raw = ids.tolist(), ends.tolist(), ids.astype("<i4").tobytes()
            parts = [(all_ids[a:b], raw[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            back = [text_of(x, pieces) for x, _ in parts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "n_pieces": pa.array(np.diff(ends)),
                "ids_crc32": pa.array([zlib.crc32(x) for _, x in parts], pa.int64()),
                "text_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                "lossless": pa.array([a == b for a, b in zip(texts, back, strict=True)]),
            })

    return _keyed(docs, seed).mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_crc32 long, text_sha256 string, lossless boolean")
