"""Jaccard self-join of shingle sets: a size-aware join of light and heavy sets.

Equal sets meet first, in one aggregation by digest; only one of each goes on. Two sets that
link share at least c of their n members, so in any order that all sets agree on they share k
of their first n - c + k. The order is rare members first, by a sketch of counts over all
sets: it decides how much work there is and never what is found.

Small sets are light: every pair of members of their prefix (k = 2) is a key, and two light
sets that link meet under one. Large sets are heavy: they scan the inverted lists of the
members of their prefix (k = 1), in which light sets stand too as far down as a heavy set
could link with one. The boundary between the two is where keys written and list places
scanned cost least together, from exact lengths of the lists.

Each set is first compared with the least one under each of its keys; a group of copies is
then one component, and a key whose sets are all connected is done. Under any other key with
few sets all pairs are compared that lengths and positions allow. Under a crowded one the sets
come in chunks, and two chunks that meet are compared in one task, from a product of their
incidence matrices: nothing is a row for each pair, and only a forest of the links goes on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import forget, written
from .simhash import components
from .textbytes import LOWER, buffer, joined, slices, xxh64

SHINGLE, PERCENT = 4, 85
LEAST = 6  #: smaller sets link with equal ones alone
LIGHT = 400  #: sets of this size and more are heavy, whatever the cost
SKETCH = (1 << 16, 1 << 25)  #: bounds on the sketch's counters, one for 16 members between them
CELLS = 1 << 16  #: counters in a message
RANDOM = np.uint64(0x9E3779B97F4A7C15)
BINS = 128  #: of a histogram of a set's members
CROWD = 64  #: sets under a key up to which their pairs are rows
CHUNK, MEMBERS = 256, 1 << 18  #: sets of a chunk, and members of them, on average at most
WORDS = 1 << 15  #: members that an incidence matrix has columns for at once


def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts of a column, one text after the other, and the first of each (n + 1 values)."""
    raw, offs = buffer(column)
    raw, s, e, f = joined(raw.translate(LOWER), offs)
    count = np.diff(f)
    k = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(len(count)), k)
    first = f[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    last = np.where(count[of] >= SHINGLE, first + SHINGLE - 1, f[1:][of] - 1)
    h = xxh64(raw, s[first], e[last] - s[first]) if len(of) else np.zeros(0, np.uint64)
    ends = np.cumsum(k)
    for a, b in zip((ends - k).tolist(), ends.tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(count)))]).astype(np.int64)


def overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Members that a set of n shares at least with any set that links."""
    return (PERCENT * n + 99) // 100


def _digests(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[pa.RecordBatch]:
    """Digest and size of each text's set, with the columns `more`; bins: how many members fall into each of BINS, 255 standing for as many or more."""
    for batch in batches:
        for part in slices(batch, "text"):
            h, first = sets_of(part.column("text"))
            sid = [hashlib.md5(h[a:b]).digest() for a, b in zip(first.tolist(), first[1:].tolist())]
            out = {"sid": pa.array(sid, pa.binary()), "n": pa.array(np.diff(first).astype(np.int32))}
            if "bins" in more:
                of = np.repeat(np.arange(part.num_rows), np.diff(first))
                bins = np.bincount(of * BINS + (h % np.uint64(BINS)).astype(np.int64), minlength=BINS * part.num_rows).reshape(-1, BINS)
                out["bins"] = pa.array([r.tobytes() for r in np.minimum(bins, 255).astype(np.uint8)], pa.binary())
            names = ["sid", "n", *more]
            yield pa.RecordBatch.from_arrays([out[c] if c in out else part.column(c) for c in names], names)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose histograms leave room for a link: sets share no more than the smaller count of each bin."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bins_a", "bins_b"))
        most = np.minimum(x, y).sum(1, dtype=np.int64)
        total = np.asarray(batch.column("total"))
        ok = ((x == 255) & (y == 255)).any(1) | ((100 + PERCENT) * most >= PERCENT * total)
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """This task's counters, as compressed messages of CELLS each."""
    total, some = np.zeros(1 << bits, np.uint32), False
    for batch in batches:
        for part in slices(batch, "text"):
            h, _ = sets_of(part.column("text"))
            np.add.at(total, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
            some = True
    if some:
        for i in range(0, len(total), CELLS):
            cells = zlib.compress(np.minimum(total[i : i + CELLS], 65535).astype(np.uint16).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i // CELLS], pa.int32()), pa.array([cells], pa.binary())], ["cell", "counts"])


def _classes(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """Of each run of counters the classes: 0 up to four times what is expected, then one more for each doubling. Messages come sorted by cell."""

    def done(cell: int, total: np.ndarray) -> pa.RecordBatch:
        out = np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / (2 * mean + 2)))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], ["cell", "classes"])

    cell, total = None, np.zeros(0)
    for batch in batches:
        for c, raw in zip(batch.column("cell").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(raw), np.uint16).astype(np.int64)
            if c != cell:
                if cell is not None:
                    yield done(cell, total)
                cell, total = c, counts
            else:
                total += counts
    if cell is not None:
        yield done(cell, total)


def sketch(one: DataFrame, members: int) -> np.ndarray:
    """Frequency classes by the top bits of a member's hash, from all sets; at most SKETCH[1] bytes."""
    bits = min(max(members // 16, SKETCH[0]), SKETCH[1]).bit_length() - 1
    cells = one.select("text").mapInArrow(lambda it: _count(it, bits), "cell int, counts binary")
    mean = members / (1 << bits)
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _classes(it, mean), "cell int, classes binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in found:
        part = np.frombuffer(zlib.decompress(r.classes), np.uint8)
        out[r.cell * CELLS : r.cell * CELLS + len(part)] = part
    return out


def ordered(column: pa.Array, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, set, place, size) of the members of each set's prefix that shares k members with whatever links: rare members first."""
    h, first = sets_of(column)
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    bits = len(classes).bit_length() - 1
    order = np.argsort(of * 64 + classes[(h >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
    place = np.arange(len(h)) - first[of]
    keep = place < (n - overlap(n) + k)[of]
    of = of[keep]
    return h[order][keep], of, place[keep], n[of]


def _keys(batches: Iterator[pa.RecordBatch], classes: Callable[[], np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", (4 << 20) // (1 if k == 1 else 8)):
            h, of, place, n = ordered(part.column("text"), classes(), k)
            if k == 2:  # each member with each one behind it in the prefix
                start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
                behind = np.repeat(np.diff(np.append(start, len(of))), np.diff(np.append(start, len(of)))) - place - 1
                a = np.repeat(np.arange(len(of)), behind)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(behind) - behind, behind)
                with np.errstate(over="ignore"):
                    h = (h[a] * RANDOM ^ h[a] >> np.uint64(29)) + h[b]
                of, place, n = of[b], place[b], n[b]
            ids = np.asarray(part.column("id"))[of]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids), pa.array(n.astype(np.int32)), pa.array((k + n - 1 - place).astype(np.int32))], ["key", "id", "n", "reach"])


def keys(one: DataFrame, classes: object, k: int) -> DataFrame:
    """(key, id, n, reach) of each set of `one` under each of its keys of k members; reach: how many members it could share with a set that it shares these k first with."""
    return one.select("id", "text").mapInArrow(lambda it: _keys(it, lambda: classes.value, k), "key long, id long, n int, reach int")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Rows whose key another has too, with the number of rows under it."""
    held = written(rows, "jaccard-keys")
    many = held.groupBy("key").agg(F.count("*").alias("len")).where("len > 1")
    out = written(held.join(many, "key"), "jaccard-shared", freed=True)
    forget(held)
    return out


def boundary(one: DataFrame, lists: DataFrame) -> int:
    """Sets below this size are light. A light set costs its keys, a heavy one its keys and the places it scans."""
    n = F.least("n", F.lit(LIGHT))
    c = F.floor((F.col("n") * PERCENT + 99) / 100)
    p, q = F.col("n") - c + 1, F.col("n") - c + 2
    sized = {r.n: r for r in one.groupBy(n.alias("n")).agg(F.sum(p).alias("own"), F.sum(q * (q - 1) / 2).alias("pairs")).collect()}
    scans = {r.n: r.scans for r in lists.groupBy(n.alias("n")).agg(F.sum(F.col("len") - 1).alias("scans")).collect()}
    best, at, saved = 0.0, LEAST, 0.0
    for size in sorted(x for x in sized if x < LIGHT):
        saved += sized[size].own + scans.get(size, 0) - sized[size].pairs
        if saved >= best:
            best, at = saved, size + 1
    return at


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for half in slices(batch, "text_a", 2 << 20):
            for part in slices(half, "text_b", 2 << 20):
                (x, fx), (y, fy) = sets_of(part.column("text_a")), sets_of(part.column("text_b"))
                ok = []
                for i in range(part.num_rows):
                    p, q = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    both = int((q[at] == p).sum())
                    ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def screened(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that may link by their histograms."""
    small = one.select("id", "n", "bins")
    pairs = pairs.join(small.toDF("a", "n_a", "bins_a"), "a").join(small.toDF("b", "n_b", "bins_b"), "b")
    pairs = pairs.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), "bins_a", "bins_b").mapInArrow(_screen, "a long, b long")
    return written(pairs, "jaccard-screened", freed=True)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def texts_of(one: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of some sets, written: what follows joins these few and not all texts."""
    return written(one.select("id", "text").join(ids.distinct(), "id", "left_semi"), "jaccard-texts", freed=True)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def possible(x: str, y: str) -> Column:
    """Two places under a key, of sets that may link by their sizes and by what is left behind the key."""
    n, m = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (F.least(f"{x}.reach", f"{y}.reach") * (100 + PERCENT) >= (n + m) * PERCENT)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")]


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (lo, hi, side), with histograms: those sets of a cell go on that one on the other side leaves room for a link with."""

    def done(cell: tuple[int, int], rows: list[tuple[int, bool, int, bytes]]) -> pa.RecordBatch:
        ids, side = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        n, bins = np.array([r[2] for r in rows]), np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, BINS)
        keep = np.zeros(len(rows), bool)
        right = np.flatnonzero(side) if side.any() else np.arange(len(rows))
        for i in np.flatnonzero(~side):
            most = np.minimum(bins[i], bins[right]).sum(1, dtype=np.int64)
            ok = ((100 + PERCENT) * most >= PERCENT * (n[i] + n[right])) | ((bins[i] == 255) & (bins[right] == 255)).any(1)
            ok &= ids[right] != ids[i]
            keep[i] |= ok.any()
            keep[right[ok]] = True
        kept = np.flatnonzero(keep)
        lo, hi = (pa.array(np.full(len(kept), x), pa.int64()) for x in cell)
        return pa.RecordBatch.from_arrays([lo, hi, pa.array(side[kept]), pa.array(ids[kept])], ["lo", "hi", "side", "id"])

    cell, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("lo", "hi", "id", "side", "n", "bins")]
        for lo, hi, *row in zip(*columns, strict=True):
            if (lo, hi) != cell:
                if len(held) > 1:
                    yield done(cell, held)
                cell, held = (lo, hi), []
            held.append(tuple(row))
    if len(held) > 1:
        yield done(cell, held)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (lo, hi, side): the sets of two chunks (of one, where lo = hi). Of the links between them a spanning forest goes on."""

    def done(rows: list[tuple[int, bool, np.ndarray]]) -> pa.RecordBatch:
        left = [r for r in rows if not r[1]]
        right = [r for r in rows if r[1]] or left
        both, n, m = shared_members([r[2] for r in left], [r[2] for r in right])
        i, j = np.nonzero(100 * both >= PERCENT * (n[:, None] + m - both))
        a, b = np.array([r[0] for r in left])[i], np.array([r[0] for r in right])[j]
        known, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.arange(len(known))
        x, y = at[: len(a)], at[len(a) :]
        while (apart := root[x] != root[y]).any():
            np.minimum.at(root, np.maximum(root[x], root[y])[apart], np.minimum(root[x], root[y])[apart])
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
        out = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(known[out], pa.int64()), pa.array(known[root[out]], pa.int64())], ["a", "b"])

    cell, held = None, []
    for batch in batches:
        for part in slices(batch, "text"):
            h, first = sets_of(part.column("text"))
            cells = zip(part.column("lo").to_pylist(), part.column("hi").to_pylist(), strict=True)
            for k, (now, i, side) in enumerate(zip(cells, part.column("id").to_pylist(), part.column("side").to_pylist(), strict=True)):
                if now != cell:
                    if len(held) > 1:
                        yield done(held)
                    cell, held = now, []
                held.append((i, side, h[first[k] : first[k + 1]]))
    if len(held) > 1:
        yield done(held)


def shared_members(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many members each set of the one list shares with each of the other, and the sizes of both."""
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    h, g = np.concatenate(left), np.concatenate(right)
    words = np.intersect1d(h, g)
    out = np.zeros((len(n), len(m)), np.float32)  # whole numbers far below 2^24

    def rows(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of, at = np.repeat(np.arange(len(n)), n), np.searchsorted(words, h)
        has = words[np.minimum(at, len(words) - 1)] == h
        return of[has], at[has]

    (i, x), (j, y) = (rows(h, n), rows(g, m)) if len(words) else ((words, words), (words, words))
    for start in range(0, len(words), WORDS):
        part = []
        for of, at, k in ((i, x, len(n)), (j, y, len(m))):
            here = (at >= start) & (at < start + WORDS)
            bits = np.zeros((k, min(WORDS, len(words) - start)), np.float32)
            bits[of[here], at[here] - start] = 1
            part.append(bits)
        out += part[0] @ part[1].T
    return out.astype(np.int64), n, m


def crowded(rest: DataFrame, homes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks (id, chunk) of the sets under crowded keys, and the cells (lo, hi) of chunks to compare: rest (key, p) holds all places under these keys.

    A set's chunk is its home (the least set it has met under any key), its size class and, of
    homes of more than CHUNK sets or so many members, a part by hash. Chunks that meet under a
    key, of size classes that may link, are a cell: what is written grows with chunks times
    chunks, and pairs of sets are never rows.
    """
    at = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int").alias("size")
    sets = rest.select("p.id", "p.n").distinct().join(homes, "id").select("id", "n", "home", at)
    parts = sets.groupBy("home", "size").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.col("n").cast("long")) / MEMBERS)).alias("parts"))
    chunk = F.xxhash64("home", "size", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("chunk")
    chunks = written(sets.join(parts, ["home", "size"]).select("id", "size", chunk), "jaccard-chunks", freed=True)
    met = rest.select("key", "p.*").join(chunks, "id").groupBy("key", "chunk", "size").agg(F.max("reach").alias("reach"), F.min("n").cast("long").alias("n"), F.count("*").alias("sets"))
    met = written(met, "jaccard-met", freed=True)
    other = met.toDF("key", "hi", "size_hi", "reach_hi", "n_hi", "sets_hi")
    near = (F.abs(F.col("size") - F.col("size_hi")) <= 1) & (F.least("reach", "reach_hi") * (100 + PERCENT) >= (F.col("n") + F.col("n_hi")) * PERCENT)
    some = (F.col("chunk") < F.col("hi")) | (F.col("chunk") == F.col("hi")) & (F.col("sets") > 1)
    cells = written(met.join(other, "key").where(near & some).select(F.col("chunk").alias("lo"), "hi").distinct(), "jaccard-cells", freed=True)
    forget(met)
    return chunks.select("id", "chunk"), cells


def candidates(cells: DataFrame, chunks: DataFrame, one: DataFrame) -> DataFrame:
    """(lo, hi, side, id): the sets of each cell that may link with one on its other side, by their histograms; no text is sent for the others."""
    sides = cells.select("lo", "hi", F.lit(False).alias("side"), F.col("lo").alias("chunk")).union(cells.where("lo <> hi").select("lo", "hi", F.lit(True), "hi"))
    rows = sides.join(chunks, "chunk").join(one.select("id", "n", "bins"), "id").select("lo", "hi", "side", "id", "n", "bins")
    rows = rows.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "side").mapInArrow(_possible, "lo long, hi long, side boolean, id long")
    return written(rows, "jaccard-candidates", freed=True)


def compared(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect what all links within cells connect."""
    rows = rows.join(texts, "id").select("lo", "hi", "side", "id", "text")
    return rows.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "side").mapInArrow(_linked, "a long, b long")


def connected(places: DataFrame, one: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(id, root) of the sets that links connect, from a table of places (key, id, n, reach) under shared keys."""
    place = F.struct("id", "n", "reach").alias("p")
    rows = places.select("key", place)
    met = rows.join(rows.groupBy("key").agg(F.min("p").alias("q")), "key")
    homes = written(met.groupBy(F.col("p.id").alias("id")).agg(F.min("q.id").alias("home")), "jaccard-homes", freed=True)
    first = written(met.where((F.col("p.id") != F.col("q.id")) & possible("p", "q")).select(*_pair("p", "q")).distinct(), "jaccard-pairs", freed=True)
    pairs = screened(first, one)
    texts = texts_of(one, ends(pairs))
    links = written(verified(pairs, texts), "jaccard-links", freed=True)
    forget(texts)
    roots = components(links).withColumnRenamed("fp", "id")
    known = written(places.join(roots, "id", "left").select("key", place, F.coalesce("root", "id").alias("root")), "jaccard-known", freed=True)
    sizes = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("all")).where("low <> high")
    rest = written(known.join(sizes.select("key", "all"), "key"), "jaccard-rest", freed=True)
    forget(known)
    few = rest.where(F.col("all") <= crowd).select("key", "p", "root")
    pairs = few.join(few.select("key", F.col("p").alias("q"), F.col("root").alias("other")), "key").where((F.col("p.id") < F.col("q.id")) & (F.col("root") != F.col("other")) & possible("p", "q"))
    pairs = screened(pairs.select(*_pair("p", "q")).distinct().join(first, ["a", "b"], "left_anti"), one)
    chunks, cells = crowded(rest.where(F.col("all") > crowd), homes)
    forget(rest)
    rows = candidates(cells, chunks, one)
    texts = texts_of(one, ends(pairs).union(rows.select("id")))
    more = written(verified(pairs, texts).union(compared(rows, texts)), "jaccard-links", freed=True)
    forget(texts)
    return components(links.union(more)).withColumnRenamed("fp", "id")


def join(docs: DataFrame, light: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: the size of its shingle set, and the smallest doc_id that links of at least PERCENT per cent lead to.

    A null text counts as empty; rows without words link with nothing and are components of
    their own. Rows that repeat come back as often, linked with each other by their equal
    sets. A null doc_id takes part in links but is a component_id only where no other is
    there. Shingles are told apart by 64-bit hashes, equal sets by 128-bit digests. An empty
    table gives no rows; other columns of docs, whatever their names, are left alone. light:
    a boundary to use in place of the one by cost.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(lambda it: _digests(it, "doc_id"), "sid binary, n int, doc_id long")
    rows = written(rows, "jaccard-rows")
    one = docs.select(text).mapInArrow(lambda it: _digests(it, "text", "bins"), "sid binary, n int, text string, bins binary").where(F.col("n") >= LEAST)
    one = one.groupBy("sid", "n").agg(F.any_value("text").alias("text"), F.any_value("bins").alias("bins")).withColumn("id", F.monotonically_increasing_id())
    one = written(one, "jaccard-sets", freed=True)
    members = one.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    classes = spark.sparkContext.broadcast(sketch(one, members))
    places = shared_keys(keys(one, classes, 1))
    at = boundary(one, places) if light is None else light
    heavy = places.where(F.col("n") * 100 >= PERCENT * at).drop("len")
    places = written(heavy.union(shared_keys(keys(one.where(F.col("n") < at), classes, 2)).drop("len")), "jaccard-places")
    roots = connected(places, one, crowd)
    forget(places)
    of = one.select("sid", "id").join(roots, "id").select("sid", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    least = rows.where("n > 0").groupBy("sid").agg(F.min(order).alias("least")).join(of, "sid", "left")
    least = written(least, "jaccard-classes", freed=True)
    top = least.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("top"))
    known = least.join(top, "root", "left").select("sid", F.coalesce("top.doc_id", "least.doc_id").alias("component_id"))
    linked = rows.join(known, "sid", "left")
    return linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (SELECT a, b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS shared, any_value(l.n + r.n) AS total FROM flat l JOIN flat r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL) WHERE 100 * shared >= 85 * (total - shared)),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.c = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
