"""Hard negatives by bit-sliced integer products.

Rows are dealt to blocks, anchors (a stated query set, a fiftieth of the rows) are sent to
every block and stream past its rows, so a task holds one block and a few hundred anchors
whatever the size of the table. A block's components lie as bit-planes of two's complement.
A score grows plane by plane from the most significant one: after some planes the rest of it
lies between what the anchor's negative and its positive components could still add if every
remaining bit were set. Candidates whose interval cannot qualify any more are dropped, and
once few are left the remaining planes are read for these pairs alone.

Two passes: the first finds each anchor's positives, the second the negatives within the
score ranges that the positives ask for. Each block gives its best few for each anchor (and
positive), and a ranking with a partial limit keeps the best of all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .shared import written

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
LEAST, MOST = 50, 95  #: a negative's score is between these per cents of the positive's
COMPONENTS = 1 << 20  #: components of a block's rows, on average at most
BLOCKS = 24
PIECE = 1 << 21  #: components of pairs that are looked at together
ANCHORS = 128  #: anchors that look at a block together
LARGEST = 1 << 27  #: a component at or past it could take a score out of 64 bits
SPARSE = 0.05  #: share of pairs left from which on pairs are looked at one by one

Tighten = Callable[[np.ndarray, np.ndarray, "Pairs"], np.ndarray]


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bits) of the bit-planes of integer rows in two's complement, the most significant first: their weighted sum is x."""
    width = int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length()
    weights = np.array([-(1 << width), *(1 << k for k in range(width - 1, -1, -1))], np.int64)
    return weights, np.stack([(x >> k & 1).astype(np.uint8) for k in range(width, -1, -1)])


class Pairs:
    """The pairs under consideration: a whole matrix (anchors x rows) with a mask, or a list of the pairs left in the order of anchors."""

    def __init__(self, alive: np.ndarray | None = None, of: np.ndarray | None = None):
        self.alive, self.of = alive, of

    def each(self, x: np.ndarray) -> np.ndarray:
        """A value of each anchor, at its pairs."""
        return x[:, None] if self.of is None else x[self.of]

    def nth(self, x: np.ndarray, where: np.ndarray, n: int, anchors: int) -> np.ndarray:
        """Of each anchor the n-th largest x among its pairs in `where`; -inf where there are fewer."""
        if self.of is None:
            where = where & self.alive
            out, rows = np.full(anchors, -np.inf), np.flatnonzero(where.sum(1) >= n)
            if len(rows):
                out[rows] = np.partition(np.where(where[rows], x[rows], -np.inf), -n, 1)[:, -n]
            return out
        of, x = self.of[where], x[where]
        x = x[np.lexsort((-x, of))]  # `of` rises already
        start, end = np.searchsorted(of, np.arange(anchors)), np.searchsorted(of, np.arange(anchors), side="right")
        return np.where(end - start >= n, np.append(x, -np.inf)[np.minimum(start + n - 1, len(x))], -np.inf)


def scores(anchors: np.ndarray, weights: np.ndarray, bits: np.ndarray, alive: np.ndarray, tighten: Tighten) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of alive (anchors x rows) that survive. tighten says which pairs may stay while their scores are known to lie in lo..hi; in its last call lo = hi."""
    a = anchors.astype(np.float64)
    below, above = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
    acc, k = np.zeros(alive.shape), 0
    while k < len(weights) and alive.mean() > SPARSE:
        acc += weights[k] * (a @ bits[k].T.astype(np.float64))
        rest = int(weights[k + 1 :].sum())
        alive = alive & tighten(acc + rest * below[:, None], acc + rest * above[:, None], Pairs(alive=alive))
        k += 1
    ai, ri = np.nonzero(alive)
    got, piece = acc[ai, ri], max(1, PIECE // max(1, a.shape[1]))
    for k in range(k, len(weights)):
        for i in range(0, len(ai), piece):
            got[i : i + piece] += weights[k] * np.einsum("ij,ij->i", a[ai[i : i + piece]], bits[k][ri[i : i + piece]])
        rest = int(weights[k + 1 :].sum())
        stay = tighten(got + rest * below[ai], got + rest * above[ai], Pairs(of=ai))
        ai, ri, got = ai[stay], ri[stay], got[stay]
    return ai, ri, got.astype(np.int64)


def best(n: int, anchors: int) -> Tighten:
    """Pairs that may be among the n highest of their anchor."""
    return lambda lo, hi, pairs: hi >= pairs.each(pairs.nth(lo, np.ones(lo.shape, bool), n, anchors))


def within(low: np.ndarray, high: np.ndarray, n: int) -> Tighten:
    """Pairs that may be among the n highest of one of their anchor's score ranges (anchors x ranges; empty ones have low > high)."""

    def tighten(lo: np.ndarray, hi: np.ndarray, pairs: Pairs) -> np.ndarray:
        out = np.zeros(lo.shape, bool)
        for l, h in zip(low.T, high.T):
            sure = (lo >= pairs.each(l)) & (hi <= pairs.each(h))
            least = np.maximum(l, pairs.nth(lo, sure, n, len(l)))
            out |= (lo <= pairs.each(h)) & (hi >= pairs.each(least))
        return out

    return tighten


def _first(of: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each group: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, of))
    new = np.ones(len(order), bool)
    new[1:] = of[order][1:] != of[order][:-1]
    start = np.flatnonzero(new)
    rank = np.arange(len(order)) - start[np.cumsum(new) - 1] if len(order) else order
    return order[rank < n]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Block:
    """Rows of a block while its anchors pass."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.ids, self.labels = np.asarray(rows["vec_id"]), np.asarray(rows["label"])
        self.weights, self.bits = planes(_matrix(rows["q"].combine_chunks()))

    def positives(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        ids, labels = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label"))
        alive = (labels[:, None] == self.labels) & (ids[:, None] != self.ids)
        ai, ri, got = scores(_matrix(batch.column("q")), self.weights, self.bits, alive, best(POSITIVES, len(ids)))
        at = _first(ai, got, self.ids[ri], POSITIVES)
        return [np.asarray(batch.column("anchor"))[ai[at]], ids[ai[at]], self.ids[ri[at]], got[at]]

    def negatives(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        ids, labels = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label"))
        goal = batch.column("goals")
        n = np.asarray(pc.list_value_length(goal))
        goals = np.zeros((len(n), POSITIVES))
        has = np.arange(POSITIVES) < n[:, None]
        goals[has] = np.asarray(goal.flatten())
        low, high = -(-LEAST * goals // 100), MOST * goals // 100
        low[~has], high[~has] = 1, 0
        ai, ri, got = scores(_matrix(batch.column("q")), self.weights, self.bits, labels[:, None] != self.labels, within(low, high, NEGATIVES))
        fits = (got[:, None] >= low[ai]) & (got[:, None] <= high[ai])
        p, j = np.nonzero(fits)
        at = _first(ai[p] * POSITIVES + j, got[p], self.ids[ri[p]], NEGATIVES)
        p, j = p[at], j[at]
        return [np.asarray(batch.column("anchor"))[ai[p]], ids[ai[p]], goals[ai[p], j].astype(np.int64), self.ids[ri[p]], got[p]]


def _pass(names: list[str], of: Callable[[Block, pa.RecordBatch], list[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches come sorted by (dims, block, is_anchor): a block's rows, then the anchors that look at them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, key = None, None
        for batch in batches:
            kinds = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("dims", "block", "is_anchor")], 1)
            cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(1)) + 1).tolist(), len(kinds)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *now, anchor = kinds[a].tolist()
                if now != key:
                    held, block, key = [], None, now
                if not anchor:
                    held.append(batch.slice(a, b - a))
                    continue
                if held and block is None:
                    block, held = Block(held), []
                for c in range(a, b, ANCHORS) if block else ():
                    out = of(block, batch.slice(c, min(ANCHORS, b - c)))
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return run


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dims, q, anchor): components as floor(256 x), labels of every seventh row moved on by one; anchor is a key of the row's content where it is an anchor, else null."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * 256))
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST / 256))
    raw = raw.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    q = raw.select("vec_id", label.alias("label"), F.size("embedding").alias("dims"), x.cast("array<long>").alias("q"))
    return q.withColumn("anchor", F.when(F.col("vec_id") % EVERY == 0, F.xxhash64("vec_id", "label", "q")))


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Blocks of rows, each followed by all anchors."""
    sent = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("is_anchor", F.lit(1))
    own = rows.withColumn("is_anchor", F.lit(0))
    both = own.unionByName(sent, allowMissingColumns=True)
    return both.repartition(blocks, "dims", "block").sortWithinPartitions("dims", "block", "is_anchor")


def ranked(df: DataFrame, by: list[str], score: str, row: str, n: int) -> DataFrame:
    """The first n rows of each group with their rank: higher scores first, then smaller ids."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), row)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mine(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): up to NEGATIVES for each of up to POSITIVES of every anchor.

    vectors: (vec_id, embedding, label). Rows with a null id, label or vector, or with a
    component that is null, not finite or at or past 2^19 take no part. Vectors of different
    lengths have no score. A row is not an anchor's positive if it has the anchor's vec_id;
    rows that repeat a vec_id count each, but an anchor repeated whole is one anchor. Equal
    scores go by the smaller vec_id. An empty table, or one without anchors, gives no rows;
    other columns, whatever their names, are left alone.
    """
    q = quantised(vectors)
    total = q.agg(F.sum(F.col("dims").cast("long"))).first()[0] or 0
    blocks = max(BLOCKS, -(-total // COMPONENTS))
    rows = written(q.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "negatives-rows")
    anchors = rows.where("anchor IS NOT NULL").select("anchor", "vec_id", "label", "dims", "q").dropDuplicates(["vec_id", "anchor"])
    rows = rows.select("dims", "block", "vec_id", "label", "q")
    found = _dealt(rows, anchors, blocks).mapInArrow(_pass(["anchor", "anchor_id", "positive_id", "score"], Block.positives), "anchor long, anchor_id long, positive_id long, score long")
    positives = written(ranked(found, ["anchor_id", "anchor"], "score", "positive_id", POSITIVES).drop("rank"), "negatives-positives")
    goals = positives.groupBy(F.col("anchor_id").alias("vec_id"), "anchor").agg(F.array_sort(F.collect_set("score")).alias("goals"))
    asked = anchors.join(goals, ["vec_id", "anchor"])
    names = ["anchor", "anchor_id", "goal", "negative_id", "score"]
    near = _dealt(rows, asked, blocks).mapInArrow(_pass(names, Block.negatives), ", ".join(f"{x} long" for x in names))
    first = ranked(near, ["anchor_id", "anchor", "goal"], "score", "negative_id", NEGATIVES).select("anchor_id", "anchor", F.col("goal").alias("positive_score"), "rank", "negative_id", F.col("score").alias("negative_score"))
    out = positives.select("anchor", "anchor_id", "positive_id", F.col("score").alias("positive_score")).join(first, ["anchor_id", "anchor", "positive_score"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3
"""
