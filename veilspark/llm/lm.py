"""Language-model scores by a weighted backoff automaton over words.

Every n-gram of order 2 and 3 that occurs at least LEAST times in the training texts is an
arc, at any corpus size. Smoothing is absolute discounting interpolated with the lower order
down to the add-half unigrams, so each state's probabilities sum to one. A state is the
longest context that has arcs; an arc that is missing is replaced by the state's failure
arc, whose weight is its backoff.

Nothing is gathered or broadcast: the automaton lies in shards by key, and texts in chunks
of tokens. A chunk sends each shard its distinct words and pairs with their counts, once, and
gets the counts over all chunks back in the same order; in a round for each higher order those
n-grams alone whose two parts occur often enough for an arc, as no other can; and in a last
one the backoffs of the contexts that can have arcs. A text's walk is then a few vector operations over its
chunk: the weight of a word is that of the longest arc, or of the backoffs passed.

`Automaton` is the same model in one piece, for tables that fit the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import written
from .textbytes import LOWER, P1, P2, buffer, slices, words, xxh64

ORDER = 3
LEAST = 2
UNITS = 2  #: a discount is one of so many units of a count
DISCOUNT = 1 / UNITS
CHUNK = 1_000_000
SHARD = 2_000_000
BLOCK = 2_000_000
END = np.uint64(0x9E6C63D0876A9A47)  #: stands for the end of a text; any value that is no word's hash

HELD_OUT = "coalesce(pmod(crc32(CAST(doc_id AS STRING)), 5) = 1, false)"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, one after the other, and each text's number of tokens."""
    raw, offs = buffer(column)
    raw = raw.translate(LOWER)
    s, e, f = words(raw, offs)
    n = np.diff(f)
    out = np.full(len(s) + len(n), END, np.uint64)
    out[np.arange(len(s)) + np.repeat(np.arange(len(n)), n)] = xxh64(raw, s, e - s)
    return out, n + 1


def ngrams(t: np.ndarray, n: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For order 1, 2, ...: the n-gram that ends at each token, as a hash, and whether it lies in the text (whose start is an end token)."""
    place = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
    keys = [(t, np.ones(len(t), bool))]
    with np.errstate(over="ignore"):
        for k in range(2, order + 1):
            before = np.empty_like(t)
            before[:1], before[1:] = END, keys[-1][0][:-1]
            if k == 2:
                before[place == 0] = END
            x = before * P2
            keys.append((((x << np.uint64(31)) | (x >> np.uint64(33))) * P1 ^ t, place >= k - 2))
    return keys


def _columns(order: int, key, ctx, word, suffix, n) -> pa.RecordBatch:
    as_long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), order, np.int32)), as_long(key), as_long(ctx), as_long(word), as_long(suffix), pa.array(n.astype(np.int64))], ["ord", "key", "ctx", "word", "suffix", "n"])


GRAMS = "ord int, key long, ctx long, word long, suffix long, n long"


def _gather(batches: Iterator[pa.RecordBatch], order: int, share: float) -> Iterator[pa.RecordBatch]:
    """Word counts, and candidates of the higher orders, of each chunk of tokens."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        t, n = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        grams = ngrams(t, n, order)
        key, count = np.unique(t, return_counts=True)
        zero = np.zeros_like(key)
        for i in range(0, len(key), 1 << 18):
            j = slice(i, i + (1 << 18))
            yield _columns(1, key[j], zero[j], key[j], zero[j], count[j])
        least = math.ceil(share * len(t))
        for k in range(2, order + 1):
            at = np.flatnonzero(grams[k - 1][1])
            key, first, count = np.unique(grams[k - 1][0][at], return_index=True, return_counts=True)
            ok = count >= least
            i = at[first[ok]]
            before = grams[k - 2][0][np.maximum(i - 1, 0)]
            ctx = np.where((i == 0) | (t[np.maximum(i - 1, 0)] == END), END, before)
            yield _columns(k, key[ok], ctx, t[i], grams[k - 2][0][i], count[ok])

    held, size = [], 0
    for batch in batches:
        for rows in slices(batch, "text"):
            held.append(tokens(rows.column("text")))
            size += len(held[-1][0])
            if size >= CHUNK:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


def _count(batches: Iterator[pa.RecordBatch], order: int, known) -> Iterator[pa.RecordBatch]:
    """How often each candidate of a sorted block occurs."""
    keys = known.value
    total = np.zeros(len(keys), np.int64)
    for batch in batches:
        for rows in slices(batch, "text"):
            t, n = tokens(rows.column("text"))
            for key, valid in ngrams(t, n, order)[1:]:
                key = key[valid]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                total += np.bincount(at[keys[at] == key], minlength=len(keys))
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), pa.array(total[hit])], ["key", "n"])


class Automaton:
    """States are contexts with arcs, 0 the root. words: sorted hashes; counts: theirs; grams: rows (ord, key, ctx, word, suffix, n) with exact n."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, grams: list[tuple]):
        self.words, self.total = words, total
        self.log_total = math.log10(total + 0.5 * (distinct + 1))
        self.log_count = np.log10(counts + 0.5)
        self.p1 = (self.log_count - self.log_total).tolist()
        self.size = len(words) + 1
        index = {int(w): i for i, w in enumerate(words)}
        seen = {int(w): int(c) for w, c in zip(words, counts, strict=True)} | {g[1]: g[5] for g in grams}
        last = {g[1]: g[4] for g in grams}
        ids = {c: i + 1 for i, c in enumerate(dict.fromkeys(g[2] for g in sorted(grams)))}
        mass = [0.0] * (len(ids) + 1)
        for g in grams:
            mass[ids[g[2]]] += (g[5] - DISCOUNT) / seen[g[2]]
        self.backoff = [0.0, *[math.log10(max(1.0 - m, 1e-12)) for m in mass[1:]]]
        self.fail = [0] * len(mass)
        for c, i in ids.items():
            if c in last:
                self.fail[i] = ids.get(last[c], 0)
        self.start = [ids.get(int(w), 0) for w in words]
        self.end = ids.get(int(END), 0)
        self.arcs: dict[int, tuple[float, int]] = {}
        for _, key, ctx, word, suffix, n in sorted(grams):
            s, w = ids[ctx], index[word]
            lower, _ = self.step(self.fail[s], w)
            p = (n - DISCOUNT) / seen[ctx] + 10.0 ** (self.backoff[s] + lower)
            to = next((ids[k] for k in (key, suffix, word) if k in ids), 0)
            self.arcs[s * self.size + w] = (math.log10(p), to)

    def step(self, state: int, w: int) -> tuple[float, int]:
        """Weight and next state for a word of the automaton (its index)."""
        weight = 0.0
        while True:
            arc = self.arcs.get(state * self.size + w)
            if arc:
                return weight + arc[0], arc[1]
            if not state:
                return weight + self.p1[w], self.start[w]
            weight += self.backoff[state]
            state = self.fail[state]

    def walk(self, text: list[int]) -> float:
        """Log10 weight of a text given as indices of words, -1 for words outside, without these words' unigram weights."""
        arcs, size, p1, start, backoff, fail = self.arcs.get, self.size, self.p1, self.start, self.backoff, self.fail
        weight, state = 0.0, self.end
        for w in text:
            if w < 0:
                while state:
                    weight += backoff[state]
                    state = fail[state]
                continue
            while True:
                arc = arcs(state * size + w)
                if arc:
                    weight += arc[0]
                    state = arc[1]
                    break
                if not state:
                    weight += p1[w]
                    state = start[w]
                    break
                weight += backoff[state]
                state = fail[state]
        return weight


CHUNKS = "chunk long, ids array<long>, held array<boolean>, n array<int>, vocab binary, at binary, tokens long, train long"
ASKED = "chunk long, ord int, shard int, keys binary, vals binary"
TOLD = "chunk long, ord int, shard int, vals binary, distinct long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as tokens, CHUNK and a little more to a row: the distinct tokens, and each token's place among them."""
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
    chunk = TaskContext.get().partitionId() << 33

    def flush(rows: list) -> pa.RecordBatch:
        t, n = np.concatenate([x[0] for x in rows]), np.concatenate([x[1] for x in rows])
        ids, held = pa.concat_arrays([x[2] for x in rows]), pa.concat_arrays([x[3] for x in rows])
        vocab, at, count = np.unique(t, return_inverse=True, return_counts=True)
        often = np.argsort(-count, kind="stable")  # small numbers for frequent tokens: bytes that compress
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), one(ids, pa.int64()), one(held, pa.bool_()), one(pa.array(n), pa.int32()), pa.array([vocab[often].tobytes()], pa.binary()), pa.array([_planes(rank[at], 4)], pa.binary()), pa.array([len(t)]), pa.array([int(n[~held.to_numpy(zero_copy_only=False)].sum())])],
            ["chunk", "ids", "held", "n", "vocab", "at", "tokens", "train"],
        )

    rows, size = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            rows.append((*tokens(part.column("text")), part.column("doc_id"), part.column("held_out")))
            size += len(rows[-1][0])
            if size >= CHUNK:
                yield flush(rows)
                chunk, rows, size = chunk + 1, [], 0
    if rows:
        yield flush(rows)


class Chunk:
    """A row of the table of chunks. keys: for each order the sorted distinct n-grams and the place of each token's among them; valid: whether the n-gram lies in the text; ctx: from order 2 on, the place of each token's context among the keys one order lower."""

    def __init__(self, row: dict, order: int):
        self.chunk, self.ids = row["chunk"], row["ids"]
        self.held, self.n = np.array(row["held"], bool), np.array(row["n"], np.int64)
        vocab, at = np.unique(np.frombuffer(row["vocab"], np.uint64), return_inverse=True)
        at = at.astype(np.uint32)[_unplaned(row["at"], 4)]
        self.train = np.repeat(~self.held, self.n)
        self.keys, self.valid, self.ctx = [(vocab, at)], [np.ones(len(at), bool)], []
        first = np.cumsum(self.n) - self.n
        for key, valid in ngrams(vocab[at], self.n, order)[1:]:
            before = np.roll(self.keys[-1][1], 1)
            if not self.ctx:
                before[first] = np.searchsorted(vocab, END)
            self.ctx.append(before)
            key[~valid] = 0
            u, i = np.unique(key, return_inverse=True)
            self.keys.append((u, i.astype(np.uint32)))
            self.valid.append(valid)

    def told(self, rows: pa.Table) -> dict[int, np.ndarray]:
        """What the shards said, by order, in the order of the keys that were asked: twice the sum, and one where this chunk is the first to ask."""
        of: dict[int, list] = {}
        for k, shard, vals, n in sorted(zip(rows["ord"].to_pylist(), rows["shard"].to_pylist(), rows["vals"].to_pylist(), rows["distinct"].to_pylist(), strict=True)):
            of.setdefault(k, []).append(_array(vals))
        return {k: np.concatenate(x) for k, x in of.items()}

    def open(self, n: list[np.ndarray]) -> np.ndarray:
        """Which keys of the order behind those of n can occur LEAST times: both parts do."""
        k = len(n)
        often, (u, at) = n[-1] >= LEAST, self.keys[k]
        return np.bincount(at, weights=self.valid[k] & often[self.ctx[k - 1]] & often[self.keys[k - 1][1]], minlength=len(u)) > 0

    def counts(self, rows: pa.Table, order: int) -> list[np.ndarray]:
        """Counts of all keys up to an order; those that were not asked are under LEAST and stand as 0. first: the keys that this chunk is the first to ask."""
        of = self.told(rows)
        out, self.first = [of[1] >> 1, of[2] >> 1], [of[1] & 1, of[2] & 1]
        for k in range(3, order + 1):
            can = self.open(out)
            n = np.zeros(len(can), np.uint64)
            n[can] = of.get(k, np.zeros(0, np.uint64))
            out.append(n >> np.uint64(1))
            self.first.append(n & np.uint64(1))
        return out

    def counted(self, k: int, weights: np.ndarray) -> np.ndarray:
        u, at = self.keys[k]
        return np.bincount(at, weights=weights, minlength=len(u))


def _blob(x: np.ndarray) -> bytes:
    """Width and values, in as few bytes as hold the largest."""
    x = x.astype(np.min_scalar_type(x.max(initial=0)))
    return bytes([x.itemsize]) + x.tobytes()


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all numbers, then the next ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T).tobytes()


def _unplaned(blob: bytes, width: int, kind: type = np.uint32) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, len(blob) // width)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.view(kind)[:, 0]


def _sorted_blob(u: np.ndarray) -> bytes:
    """Sorted keys, one at least, as the first and the steps to the next in as few bytes as hold the largest."""
    step = np.diff(u)
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + u[:1].tobytes() + _planes(step, width)


def _sorted_array(blob: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.uint64, 1, 1), _unplaned(blob[9:], blob[0], np.uint64)]), dtype=np.uint64)


def _array(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[1:], f"u{blob[0]}")


def _asked(chunk: int, asked: list[tuple[np.ndarray, np.ndarray]], shards: int, first: int = 1) -> pa.Table:
    """Rows of ASKED: for each order from `first` on the sorted keys and their values, cut by shard. A shard is a range of keys."""
    edges = np.array([(i << 64) // shards for i in range(shards)], np.uint64)
    rows = []
    for k, (u, vals) in enumerate(asked):
        cut = [*np.searchsorted(u, edges).tolist(), len(u)]
        rows += [(k + first, i, _sorted_blob(u[a:b]), _blob(vals[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
    column = lambda j, kind: pa.array([r[j] for r in rows], kind)
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "ord": column(0, pa.int32()), "shard": column(1, pa.int32()), "keys": column(2, pa.binary()), "vals": column(3, pa.binary())})


def _totals(rows: pa.Table) -> pa.Table:
    """For a shard: twice the sums over all chunks, plus one for the first chunk to ask, in each chunk's own order of keys; distinct, on one row: keys with a sum."""
    rows = rows.take(np.argsort(rows["chunk"].to_numpy()))
    keys = [_sorted_array(x) for x in rows["keys"].to_pylist()]
    vals = np.concatenate([_array(x) for x in rows["vals"].to_pylist()])
    _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(at, weights=vals).astype(np.uint64)
    told = total[at] << np.uint64(1)
    told[first] |= np.uint64(1)
    out = np.split(told, np.cumsum([len(x) for x in keys])[:-1])
    distinct = np.zeros(len(keys), np.int64)
    distinct[0] = np.count_nonzero(total)
    return pa.table({"chunk": rows["chunk"], "ord": rows["ord"], "shard": rows["shard"], "vals": pa.array([_blob(x) for x in out], pa.binary()), "distinct": pa.array(distinct)})


def _ask_counts(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Words and pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            c = Chunk(batch.slice(i, 1).to_pylist()[0], 2)
            yield from _asked(c.chunk, [(u, c.counted(k, c.train & c.valid[k]).astype(np.uint64)) for k, (u, _) in enumerate(c.keys)], shards).to_batches()


def _ask_more(left: pa.Table, right: pa.Table, order: int, shards: int) -> pa.Table:
    """The keys of one higher order that can have arcs."""
    c = Chunk(left.to_pylist()[0], order)
    can, k = c.open(c.counts(right, order - 1)), order - 1
    return _asked(c.chunk, [(c.keys[k][0][can], c.counted(k, c.train & c.valid[k]).astype(np.uint64)[can])], shards, order)


def _ask_backoffs(left: pa.Table, right: pa.Table, order: int, shards: int) -> pa.Table:
    """What the discount takes from a context, in units of the discount: one for each of its arcs, named by the first chunk that asked for it, and all of each training occurrence that is no arc's."""
    c = Chunk(left.to_pylist()[0], order)
    n = c.counts(right, order)
    asked = []
    for k in range(1, order):
        (u, at), ctx = c.keys[k], c.ctx[k - 1]
        none = np.bincount(ctx, weights=(n[k] < LEAST)[at] & c.train & c.valid[k], minlength=len(n[k - 1]))
        of = np.zeros(len(u), np.int64)
        of[at[c.valid[k]]] = ctx[c.valid[k]]
        arcs = np.bincount(of[(n[k] >= LEAST) & (c.first[k] == 1)], minlength=len(n[k - 1]))
        can = n[k - 1] >= LEAST  # a rarer context has no arcs
        asked.append((c.keys[k - 1][0][can], (UNITS * none + arcs).astype(np.uint64)[can]))
    return _asked(c.chunk, asked, shards)


def _score(left: pa.Table, right: pa.Table, order: int, log_total: float) -> pa.Table:
    c = Chunk(left.to_pylist()[0], order)
    first = right["first"].to_numpy(zero_copy_only=False)
    n = c.counts(right.filter(pa.array(first)), order)
    masses = c.told(right.filter(pa.array(~first)))
    log_p = np.log10(n[0] + 0.5)[c.keys[0][1]] - log_total
    p, base = 10.0**log_p, log_p
    for k in range(1, order):
        ctx, seen = c.ctx[k - 1], n[k][c.keys[k][1]]
        can = n[k - 1] >= LEAST
        backoff = np.ones(len(can))
        backoff[can] = (masses.get(k, np.zeros(0, np.uint64)) >> 1) / UNITS / n[k - 1][can]
        arc = np.where(seen >= LEAST, (seen - DISCOUNT) / np.maximum(n[k - 1], 1)[ctx], 0.0)
        p = np.where(c.valid[k], arc + backoff[ctx] * p, p)
    begin = np.cumsum(c.n) - c.n
    whole = lambda x: pa.array(np.add.reduceat(x, begin))
    known = whole((n[0] > 0)[c.keys[0][1]].astype(np.int64))
    return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "held_out": pa.array(c.held), "n_tokens": pa.array(c.n), "n_known": known, "base_score": whole(base), "score": whole(np.log10(p))})


def train(docs: DataFrame, order: int = ORDER, share: float = 0.0, gram_share: float = 0.0) -> tuple[Automaton, DataFrame]:
    """The automaton in one piece, and the counts (key, n) of all words of docs (text string).

    For tables that fit the driver. Words below `share` of all tokens, and n-grams below
    `gram_share`, are left out; by default none is that occurs LEAST times.
    """
    if gram_share < share:
        raise ValueError("an n-gram's words must be in the automaton")
    docs = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = docs.coalesce(max(1, size // (4 * CHUNK)))  # no shuffle; small partitions would name every n-gram a candidate
    gathered = few.mapInArrow(lambda it: _gather(it, order, gram_share), GRAMS).groupBy("ord", "key").agg(F.sum("n").alias("n"), F.min("ctx").alias("ctx"), F.min("word").alias("word"), F.min("suffix").alias("suffix"))
    gathered = written(gathered, "lm-grams")
    one = gathered.where("ord = 1").select("key", "n")
    total, distinct = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = one.where(F.col("n") >= max(1, math.ceil(share * total))).toArrow()
    keys, counts = often["key"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order_by = np.argsort(keys)
    keys, counts = keys[order_by], counts[order_by]
    candidates = gathered.where("ord > 1")
    n = candidates.count()
    grams: list[tuple] = []
    for i in range(-(-n // BLOCK)):
        part = candidates.where(F.pmod(F.xxhash64("key"), F.lit(-(-n // BLOCK))) == i)
        block = np.unique(part.select("key").toArrow()["key"].to_numpy().view(np.uint64))
        known = docs.sparkSession.sparkContext.broadcast(block)
        exact = docs.mapInArrow(lambda it, known=known: _count(it, order, known), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(LEAST, math.ceil(gram_share * total)))
        found = part.drop("n").join(exact, "key").select("ord", "key", "ctx", "word", "suffix", "n").toArrow()
        whole = [found[c].to_numpy().view(np.uint64).tolist() for c in ("key", "ctx", "word", "suffix")]
        grams += zip(found["ord"].to_pylist(), *whole, found["n"].to_pylist(), strict=True)
    return Automaton(keys, counts, total, distinct, grams), one


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Learns from the rows that are not held out (crc32 of doc_id as text, modulo 5, is not 1;
    a null doc_id is not held out). A null or empty text is one token, its end. Rows that
    repeat a doc_id are scored each; an empty table gives no rows; with no training rows
    every token is unknown and has probability one half over one half. Extra columns are
    left alone. Words are told apart by 64-bit hashes.
    """
    if order < 2:
        raise ValueError("order 1 has no arcs")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.expr(HELD_OUT))
    chunks = written(docs.mapInArrow(_chunks, CHUNKS), "lm-chunks")
    size, total = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    shards = max(1, size // SHARD)
    asked = chunks.mapInArrow(lambda it: _ask_counts(it, shards), ASKED)
    counts = written(asked.groupBy("ord", "shard").applyInArrow(_totals, TOLD), "lm-counts", freed=True)

    def more(k: int):
        return lambda x, y: _ask_more(x, y, k, shards)

    for k in range(3, order + 1):
        asked = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(more(k), ASKED)
        counts = counts.union(written(asked.groupBy("ord", "shard").applyInArrow(_totals, TOLD), f"lm-counts-{k}", freed=True))
    distinct = counts.where("ord = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    log_total = math.log10(total + 0.5 * (distinct + 1))
    asked = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(lambda x, y: _ask_backoffs(x, y, order, shards), ASKED)
    masses = written(asked.groupBy("ord", "shard").applyInArrow(_totals, TOLD), "lm-backoffs", freed=True)
    told = counts.withColumn("first", F.lit(True)).union(masses.withColumn("first", F.lit(False)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda x, y: _score(x, y, order, log_total), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
