"""SimHash near-duplicates found with BK-trees.

Equal fingerprints meet first, in one aggregation with a partial sum. Different ones that
link differ in at most `radius` bits, so of radius + k blocks of the 64 bits at least k
agree: each fingerprint goes to one shard for every choice of k blocks, the shard being
these blocks' bits. k is the least number that keeps a shard at about SHARD / 4 fingerprints
on average, whatever the size of the corpus; the links are the same under each. A shard's
BK-tree (children keyed by their integer Hamming distance to the parent) answers all its
fingerprints at once and follows only edges within the radius. Trees are built where their
shard is, not broadcast: a tree over all fingerprints grows with the corpus, and with random
64-bit keys a radius of 4 still follows most edges of it. A shard past SHARD fingerprints is
cut into chunks, and each pair of chunks becomes a task of its own, so no link is lost and
no task is unbounded. A shard passes on a spanning forest of its links, never all its pairs;
components over these edges come from min-label propagation on tables in the shared folder,
each freed once the next is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import forget, written
from .textbytes import LOWER, buffer, joined, slices, xxh64

RADIUS = 4
SHARD = 4096
TOGETHER = 10_000
PAIRS = 250_000  #: a block of queries has trees of about so many nodes in all


def fingerprints_of(column: pa.Array, n: int = 4) -> np.ndarray:
    """Signed 64-bit fingerprints of the texts of a column."""
    raw, offs = buffer(column)
    raw, s, e, f = joined(raw.translate(LOWER), offs)
    count = np.diff(f)
    out = np.zeros(len(count), np.uint64)
    shingles = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    if not shingles.sum():
        return out.view(np.int64)
    has = np.flatnonzero(shingles)
    k = shingles[has]
    at = np.cumsum(k) - k
    first = np.repeat(f[:-1][has], k) + (np.arange(k.sum()) - np.repeat(at, k))
    last = np.where(np.repeat(count[has], k) >= n, first + n - 1, np.repeat(f[1:][has] - 1, k))
    h = xxh64(raw, s[first], e[last] - s[first])
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    out[has] = np.packbits(2 * sums > k[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(fingerprints_of(part.column("text")))], ["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp): a null text counts as empty; no words give 0; the mark is a hash of the whole text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")).mapInArrow(_fingerprint, "doc_id long, mark long, fp long")


class BKTrees:
    """BK-trees over 64-bit values, built and searched level by level with numpy, many trees at once: values of one tree lie together, `of` is the tree of each."""

    def __init__(self, values: np.ndarray, of: np.ndarray):
        self.values = values
        m = len(values)
        new = np.ones(m, bool)
        new[1:] = of[1:] != of[:-1]
        self.roots, self.trees = np.flatnonzero(new), of[new]
        self.first, self.n = np.zeros(m, np.int64), np.zeros(m, np.int64)  # a node's children lie in `child` from first, n of them
        kids, edges, filled = [], [], 0
        rest = np.flatnonzero(~new)
        parent = self.roots[np.cumsum(new) - 1][rest]
        while len(rest):
            d = np.bitwise_count(values[rest] ^ values[parent]).astype(np.int64)
            order = np.lexsort((rest, d, parent))
            rest, parent, d = rest[order], parent[order], d[order]
            new = np.ones(len(rest), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (d[1:] != d[:-1])
            nodes = rest[new]
            p, start, count = np.unique(parent[new], return_index=True, return_counts=True)
            self.first[p], self.n[p] = filled + start, count
            kids.append(nodes)
            edges.append(d[new])
            filled += len(nodes)
            under = nodes[np.cumsum(new) - 1]
            rest, parent = rest[~new], under[~new]
        self.child = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        self.edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)

    def within(self, queries: np.ndarray, of: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) at a distance of at most radius; of: the tree that each query asks."""
        at = np.minimum(np.searchsorted(self.trees, of), len(self.trees) - 1)
        q = np.flatnonzero(self.trees[at] == of)
        node = self.roots[at[q]]
        found_q, found_n = [], []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            k = self.n[node]
            at = np.repeat(self.first[node] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            ok = np.abs(self.edge[at] - np.repeat(d, k)) <= radius
            q, node = np.repeat(q, k)[ok], self.child[at[ok]]
        return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (q, node)


def forest(values: np.ndarray, of: np.ndarray, queries: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect what the links between queries and the values of the trees they ask connect; of and asked are sorted."""
    if not len(values) or not len(queries):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    trees = BKTrees(values, of)
    known = np.unique(np.concatenate([values, queries]))
    root, tree_at, query_at = np.arange(len(known)), np.searchsorted(known, values), np.searchsorted(known, queries)
    size = np.searchsorted(of, asked, side="right") - np.searchsorted(of, asked, side="left")
    block = np.cumsum(size) // PAIRS
    for at in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(block)) + 1):
        q, node = trees.within(queries[at], asked[at], radius)
        a, b = query_at[at[q]], tree_at[node]
        while True:  # the larger root goes under the smaller, until both ends of every link have one root
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    out = np.flatnonzero(root != np.arange(len(root)))
    return known[out], known[root[out]]


def _shards(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (pair, shard, l, r); side 0 is the tree's, side 1 asks, side 2 does both. Whole shards are searched together, about TOGETHER rows at a time."""

    def done(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        fp, side, of = (np.concatenate(x) for x in zip(*parts, strict=True))
        fp, tree, ask = fp.view(np.uint64), side != 1, side != 0
        a, b = forest(fp[tree], of[tree], fp[ask], of[ask], radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    last, number, rows = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(c)) for c in ("pair", "shard", "l", "r")], 1)
        fp, side = np.asarray(batch.column("fp")), np.asarray(batch.column("side"))
        new = np.ones(len(fp), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        new[0] = last is None or tuple(key[0].tolist()) != last
        last = tuple(key[-1].tolist())
        of = number + np.cumsum(new)
        number = int(of[-1])
        if rows >= TOGETHER and new.any():  # all shards but the batch's last one are whole
            cut = int(np.flatnonzero(new)[-1])
            yield done([*held, (fp[:cut], side[:cut], of[:cut])])
            held, rows, fp, side, of = [], 0, fp[cut:], side[cut:], of[cut:]
        held.append((fp, side, of))
        rows += len(fp)
    if held:
        yield done(held)


def agreeing(n: int, radius: int, mean: int = SHARD // 4) -> int:
    """How many of radius + k blocks must agree so that shards of n random fingerprints hold about `mean` at most."""
    k = 1
    while k < 64 - radius and n >> (64 * k // (radius + k)) > mean:
        k += 1
    return k


def shard_keys(k: int, radius: int, fp: str = "fp") -> F.Column:
    """An array of (pair, shard) for a fingerprint: one for each choice of k of radius + k blocks."""
    n = radius + k
    ends = [64 * i // n for i in range(n + 1)]
    blocks = [(F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << b - a) - 1).cast("long")), b - a) for a, b in zip(ends, ends[1:])]
    keys = []
    for i, some in enumerate(combinations(blocks, k)):
        shard = F.lit(0).cast("long")
        for x, width in some:
            shard = F.shiftleft(shard, width).bitwiseOR(x)
        keys.append(F.struct(F.lit(i).alias("pair"), shard.alias("shard")))
    return F.array(*keys)


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints in column fp; together they connect exactly what links of at most `radius` bits connect."""
    keyed = fps.select("fp", F.explode(shard_keys(agreeing(fps.count(), radius), radius)).alias("k")).select("fp", "k.pair", "k.shard")
    large = written(keyed.groupBy("pair", "shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows), "simhash-large")
    keyed = keyed.join(large, ["pair", "shard"], "left")
    chunks = F.coalesce(F.ceil(F.col("n") / F.lit(shard_rows)), F.lit(1)).cast("int")
    keyed = keyed.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    each = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda o: F.struct(F.least(o, F.col("c")).alias("l"), F.greatest(o, F.col("c")).alias("r"), F.when(o == F.col("c"), 2).when(o > F.col("c"), 0).otherwise(1).alias("side")),
    )
    tasks = keyed.select("pair", "shard", "fp", F.explode(each).alias("x")).select("pair", "shard", "x.l", "x.r", "x.side", "fp")
    n = max(12, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = tasks.repartition(n, "pair", "shard", "l", "r").sortWithinPartitions("pair", "shard", "l", "r")
    return tasks.mapInArrow(lambda it: _shards(it, radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): min-label propagation with pointer jumping over edges (a, b); nodes without edges do not appear."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "simhash-edges")
    both = edges.union(edges.select("b", "a"))
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("fp"), "root"), "simhash-labels")
    held = labels
    while True:
        near = both.join(labels.select(F.col("fp").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.fp == near.a).select("fp", "root", F.least("root", "near").alias("to"))
        jump = labels.select(F.col("fp").alias("to"), F.col("root").alias("far"))
        new = written(step.join(jump, "to", "left").select("fp", F.least("to", F.coalesce("far", "to")).alias("root"), (F.least("to", F.coalesce("far", "to")) != F.col("root")).alias("moved")), "simhash-labels")
        forget(held)
        held, labels = new, new.select("fp", "root")
        if new.where("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, mark, fp, component_id, keeper) for every row of docs.

    component_id is the smallest doc_id reachable over links of at most `radius` bits, the
    document itself included; keeper is the (doc_id, mark) of the row that stands for the
    component. Null texts count as empty, documents without words have fingerprint 0 and
    link like any other; rows that repeat a doc_id come back as often. A null doc_id takes
    part in links but is never a component_id unless no other is there. An empty table gives
    no rows. Extra columns are left alone.
    """
    fps = written(fingerprints(docs), "simhash-fps")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    groups = written(fps.groupBy("fp").agg(F.min(row).alias("least"), F.count("*").alias("n")), "simhash-groups")
    roots = components(links(groups.select("fp"), radius))
    full = written(groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")), "simhash-roots")
    of = full.where("linked").groupBy("root").agg(F.min("least").alias("of"))
    many = full.join(of, "root", "left").select("fp", F.coalesce("of", "least").alias("of"))
    return fps.join(many, "fp", "left").select("doc_id", "mark", "fp", F.col("of.doc_id").alias("component_id"), F.struct("of.doc_id", "of.mark").alias("keeper"))


def result(docs: DataFrame) -> DataFrame:
    """The query's columns: the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id, with its columns; of rows equal in doc_id and text one stays."""
    found = written(near_duplicates(docs, radius).select("doc_id", "mark", "keeper"), "simhash-rows")
    gone = written(found.where(~F.struct("doc_id", "mark").eqNullSafe(F.col("keeper"))).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "simhash-gone")
    again = written(found.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")), "simhash-again")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_mark"))
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & F.col("own_mark").eqNullSafe(F.col("gone_mark"))
    rows = rows.join(gone, same, "left_anti")
    if not again.isEmpty():
        one = rows.join(again, same, "left_semi").groupBy("own_id", "own_mark").agg(F.any_value("row").alias("row"))
        rows = rows.join(again, same, "left_anti").select("row").union(one.select("row"))
    return rows.select("row.*")
