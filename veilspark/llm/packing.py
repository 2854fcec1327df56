"""Packing into fixed windows under a source mixture, by deficit round-robin.

Each source is a queue of tokens (its documents end to end), dealt in slots of GRANULE
tokens. Queues are the leaves of a binary tree in which the lightest are paired first, and
each node deals its slots to its two sides by deficit round-robin: a side is owed its
weight's share of every slot that the node sends, and sends as soon as it is owed half a slot
or more. Deficits so carry over all windows and partitions, a side that has run out leaves
its share to the other, and the n-th slot of a node has a closed form in n. A queue's slots
climb the tree from its leaf to their place in the sequence, so every task places its own
documents from a queue total and a prefix sum for each input partition; the cost of a slot
is the depth of its leaf, whatever the number of queues. When queues of a sixteenth of the
weight have run out, the tree is made anew from those that last. Slots never straddle
windows. The parts of queues that are less than a slot (under GRANULE tokens each) follow
behind all slots, so only the last window is padded.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .shared import written
from .textbytes import slices

WINDOW = 2048
GRANULE = 256
END = 1
PLAN = 64 << 20  #: bytes of a plan that may be broadcast; a larger one is joined to the documents
ANEW = 16  #: the tree is made anew when queues of this part of its weight have run out
CACHED = 400_000
LONG = 1000  #: a run of so much white space is one piece without the pattern, whose engine gives up on very long ones
RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG},}}")
UNSAFE = re.compile(r"\s | \s")
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_of_char() -> dict[str, int]:
    """The byte that stands behind each character of a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Ids of a byte-level BPE file of the tokenizers library.

    A space between two non-space characters always begins a new pre-token, so texts fall
    into chunks there and a chunk's ids do not depend on its neighbours. They are looked up
    in a bounded cache; the vocabulary's merges run only for chunks that are not there.
    """

    def __init__(self, spec: str, pattern: str):
        import tiktoken

        spec_ = json.loads(spec)
        of = byte_of_char()
        special = {t["content"]: t["id"] for t in spec_["added_tokens"]}
        ranks = {bytes(of[c] for c in k): v for k, v in spec_["model"]["vocab"].items() if k not in special}
        self.core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        self.cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        out, at = [], 0
        for m in RUN.finditer(text) if len(text) >= LONG else ():
            s, e = m.span()
            # the pattern leaves a run's last character to what follows, if anything does
            e -= e < len(text) and not text.startswith(self.special, e)
            out += self.core.encode(text[at:s], allowed_special="all")
            out += self.core._encode_single_piece(text[s:e].encode())
            at = e
        out += self.core.encode(text[at:], allowed_special="all")
        return np.asarray(out, np.uint16).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids as 16-bit little-endian values."""
        chunks = SAFE_SPACE.split(text) if UNSAFE.search(text) else text.split(" ")
        cache = self.cache
        found = list(map(cache.get, chunks[1:]))
        if None in found:
            if len(cache) > CACHED:
                cache.clear()
            for i, x in enumerate(found):
                if x is None:
                    chunk = chunks[i + 1]
                    x = cache.get(chunk)
                    if x is None:
                        x = self._ids(" " + chunk)
                        if len(chunk) < 64:
                            cache[chunk] = x
                    found[i] = x
        return self._ids(chunks[0]) + b"".join(found)


_loaded: dict[int, Tokenizer] = {}


def tokenizer(spec: str, pattern: str) -> Tokenizer:
    """One tokenizer for each Python worker and file."""
    key = hash((spec, pattern))
    if key not in _loaded:
        _loaded[key] = Tokenizer(spec, pattern)
    return _loaded[key]


def _tokenize(batches: Iterator[pa.RecordBatch], file, end: int) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(*file.value)
    part, sent = TaskContext.get().partitionId(), {}
    tail = np.asarray([end], np.uint16).tobytes()
    for batch in batches:
        for rows in slices(batch, "text", 2 << 20):
            ids = [tok.ids(x or "") + tail for x in rows.column("text").to_pylist()]
            offs = []
            for q, x in zip(rows.column("queue").to_pylist(), ids, strict=True):
                offs.append(sent.get(q, 0))
                sent[q] = offs[-1] + len(x) // 2
            n = [len(x) // 2 for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), rows.column("doc_id"), rows.column("queue"), pa.array(offs, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "doc_id", "queue", "off", "n", "ids"],
            )


def _exact(most: int) -> type:
    """A type that holds numbers up to `most`."""
    return object if most >= 1 << 62 else np.int64


class Tree:
    """Deficit round-robin over queues 0, 1, ... of so many slots and positive weights. A node's levels: (on the right, left weight, weight, left slots, right slots) of each node above it, the nearest first."""

    def __init__(self, slots: list[int], weights: list[int]):
        if any(w <= 0 for w in weights):
            raise ValueError("weights are positive")
        heap = [(w, i, n) for i, (w, n) in enumerate(zip(weights, slots, strict=True))]
        heapq.heapify(heap)
        above: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.n, self.sides, at = len(slots), {}, len(slots)
        while len(heap) > 1:
            (a, x, n), (c, y, m) = heapq.heappop(heap), heapq.heappop(heap)
            above[x], above[y] = (at, (0, a, a + c, n, m)), (at, (1, a, a + c, n, m))
            self.sides[at] = x, y
            heapq.heappush(heap, (a + c, at, n + m))
            at += 1
        self.root = at - 1
        levels: dict[int, tuple[tuple[int, ...], ...]] = {self.root: ()}
        for i in range(at - 2, -1, -1):
            levels[i] = (above[i][1], *levels[above[i][0]])
        self.levels = [levels[i] for i in range(self.n)]
        self.above = above

    def sent(self, total: int) -> list[int]:
        """Slots that each queue has sent when all together have sent so many."""
        of = {self.root: total}
        for i in range(self.root, self.n - 1, -1):
            x, y = self.sides[i]
            _, a, b, n, m = self.above[x][1]
            of[x] = min(n, max(of[i] - m, (2 * of[i] * a + b) // (2 * b)))
            of[y] = of[i] - of[x]
        return [of[i] for i in range(self.n)]


def climb(j: np.ndarray, levels: list[tuple[tuple[int, ...], ...]], of: np.ndarray) -> np.ndarray:
    """The place among all slots of the slot that is number j of its queue; levels[of] is its queue's."""
    j = j.copy()
    depth = np.array([len(x) for x in levels], np.int64)[of]
    for d in range(int(depth.max(initial=0))):
        at = np.flatnonzero(depth > d)
        used, row = np.unique(of[at], return_inverse=True)
        table = [levels[i][d] for i in used]
        kind = _exact(max((2 * (int(j[at].max()) + 1)) * max(t[2] for t in table), 1))
        right, a, b, n, m = (np.array([t[i] for t in table], kind)[row] for i in range(5))
        x = j[at].astype(kind)
        left = np.minimum(-(-b * (2 * x + 1) // (2 * a)), x + 1 + m) - 1
        other = np.minimum(b * (2 * x + 1) // (2 * (b - a)) + 1, x + 1 + n) - 1
        j[at] = np.where(right == 1, other, left).astype(np.int64)
    return j


class Plan:
    """What a task must know of one queue: its full slots, the place of its left-over tokens, and for each tree from which slot on it holds, the slots before that tree, and the queue's levels."""

    def __init__(self, slots: int, tail_at: int):
        self.slots, self.tail_at = slots, tail_at
        self.begins: list[int] = []
        self.bases: list[int] = []
        self.levels: list[tuple[tuple[int, ...], ...]] = []

    def add(self, begin: int, base: int, levels: tuple[tuple[int, ...], ...]) -> None:
        self.begins.append(begin)
        self.bases.append(base)
        self.levels.append(levels)

    def size(self) -> int:
        return 64 + sum(24 + 40 * len(x) for x in self.levels)


def planned(slots: list[int], tails: list[int], weights: list[int] | None = None, granule: int = GRANULE) -> list[Plan]:
    """Plans of all queues. Without weights a queue's weight is its slots, under which all queues last to the end."""
    behind = sum(slots) * granule + np.cumsum([0, *tails])
    plans = [Plan(n, int(x)) for n, x in zip(slots, behind[:-1], strict=True)]
    left, base = list(slots), 0
    while live := [i for i, n in enumerate(left) if n]:
        w = [(weights or slots)[i] for i in live]
        tree = Tree([left[i] for i in live], w)
        for i, levels in zip(live, tree.levels, strict=True):
            plans[i].add(slots[i] - left[i], base, levels)
        if not weights:
            break
        last = climb(np.array([left[i] - 1 for i in live], np.int64), tree.levels, np.arange(len(live)))
        order = np.argsort(last, kind="stable")
        gone = np.cumsum(np.array(w, _exact(sum(w)))[order])
        end = int(last[order[int(np.argmax(ANEW * gone >= sum(w)))]]) + 1
        for i, n in zip(live, tree.sent(end), strict=True):
            left[i] -= n
        base += end
    return plans


def place(plans: list[Plan], queue: np.ndarray, at: np.ndarray, n: np.ndarray, window: int = WINDOW, granule: int = GRANULE) -> tuple[np.ndarray, ...]:
    """For documents at token `at` of their queues (indices of plans), n tokens long: row, start, length, sequence and offset of each piece."""
    g = granule
    j0, j1 = at // g, (at + n - 1) // g
    k = j1 - j0 + 1
    row = np.repeat(np.arange(len(n)), k)
    j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + j0[row]
    s, e = np.maximum(at[row], j * g), np.minimum(at[row] + n[row], (j + 1) * g)
    q = queue[row]
    full = np.flatnonzero(j < np.array([p.slots for p in plans], np.int64)[q])
    pos = np.array([p.tail_at for p in plans], np.int64)[q]
    # the tree that holds for a slot is the last one that begins at it or before
    first = np.cumsum([0, *[len(p.begins) for p in plans]])[:-1]
    tree = np.zeros(len(full), np.int64)
    for i in np.unique(q[full]):
        mine = q[full] == i
        tree[mine] = first[i] + np.searchsorted(np.array(plans[i].begins), j[full][mine], side="right") - 1
    begins, bases, levels = (np.array([x for p in plans for x in p.begins], np.int64), np.array([x for p in plans for x in p.bases], np.int64), [x for p in plans for x in p.levels])
    if len(full):
        pos[full] = (bases[tree] + climb(j[full] - begins[tree], levels, tree)) * g
    pos += s - j * g
    start, length = s - at[row], e - s
    over = np.flatnonzero(pos // window != (pos + length - 1) // window)
    if len(over):
        head = window - pos[over] % window
        row, start = np.insert(row, over + 1, row[over]), np.insert(start, over + 1, start[over] + head)
        pos = np.insert(pos, over + 1, pos[over] + head)
        length = np.insert(length, over + 1, length[over] - head)
        length[over + np.arange(len(over))] = head
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + length[:-1]) | (pos[1:] % window == 0)
    i = np.flatnonzero(new)
    return row[i], start[i], np.add.reduceat(length, i) if len(i) else length, pos[i] // window, pos[i] % window


PLANNED = "queue string, slots long, tail_at long, begins array<long>, bases array<long>, levels array<array<array<long>>>"


def _row_of(queue: str, p: Plan) -> tuple:
    return queue, p.slots, p.tail_at, p.begins, p.bases, [[list(y) for y in x] for x in p.levels]


def _plan_of(slots: int, tail_at: int, begins: list, bases: list, levels: list) -> Plan:
    out = Plan(slots, tail_at)
    for x in zip(begins, bases, levels, strict=True):
        out.add(*x)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], held, window: int, granule: int) -> Iterator[pa.RecordBatch]:
    """held: the broadcast plans by queue, or None where each row brings its own."""
    for batch in batches:
        for rows in slices(batch, "ids", 2 << 20):
            names = rows.column("queue").to_pylist()
            index: dict[str, int] = {}
            plans = []
            for i, x in enumerate(names):
                if x not in index:
                    index[x] = len(plans)
                    plans.append(held.value[x] if held else _plan_of(*[rows.column(c)[i].as_py() for c in ("slots", "tail_at", "begins", "bases", "levels")]))
            n, at = np.asarray(rows.column("n")), np.asarray(rows.column("off")) + np.asarray(rows.column("before"))
            row, start, length, seq, off = place(plans, np.array([index[x] for x in names], np.int64), at, n, window, granule)
            ids = [np.frombuffer(x, np.uint16).astype("<u4").tobytes() for x in rows.column("ids").to_pylist()]
            views = [memoryview(x) for x in ids]
            crc = [zlib.crc32(views[r][4 * s : 4 * (s + c)]) for r, s, c in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(off), rows.column("queue").take(pa.array(row))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )


def queues_of(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text, queue): a queue for each source, however many there are."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("queue"))


def pack(docs: DataFrame, weights: dict[str, int] | float | None = None, window: int = WINDOW, granule: int = GRANULE, path: str | None = None, pattern: str | None = None, end: int = END) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue).

    weights: target shares by source. None: the sources' own shares of tokens, which hold to
    the last window; a number t: the sources' slots to the power of t (under 1: small sources
    come more often while they last); a dictionary: positive integers by source, a source
    without one gets the smallest given. A source that runs out leaves its share to the
    others. Null texts are empty and give their end id alone, null sources share a queue, rows
    that repeat a doc_id are packed as documents of their own, an empty table gives no pieces.
    Very long texts and runs of white space are read whole. Extra columns are left alone.
    """
    import public_tokenizers

    if window % granule:
        raise ValueError("a window is a whole number of slots")
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast((open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), pattern or public_tokenizers.PATTERN))
    tokens = queues_of(docs).mapInArrow(lambda it: _tokenize(it, file, end), "part int, doc_id long, queue string, off long, n long, ids binary")
    tokens = written(tokens, "packing-tokens")
    sums = written(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")).withColumn("g", F.expr("part div 512")), "packing-sums")
    inside = Window.partitionBy("queue", "g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("queue").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("queue", "g").agg(F.sum("n").alias("n")).select("queue", "g", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("ahead"))
    before = sums.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, ["queue", "g"]).select("part", "queue", (F.col("ahead") + F.col("here")).alias("before"))
    before = written(before, "packing-before")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()  # a row for each source
    slots, tails = [r.n // granule for r in totals], [r.n % granule for r in totals]
    if isinstance(weights, dict):
        least = min(weights.values(), default=1)
        given = [weights.get(r.queue, least) for r in totals]
    else:
        given = None if weights is None else [max(1, round(1000 * n**weights)) for n in slots]
    plans = planned(slots, tails, given, granule)
    placed = tokens.join(before, ["part", "queue"]).select("doc_id", "queue", "off", "n", "before", "ids")
    if sum(p.size() for p in plans) <= PLAN:
        held = spark.sparkContext.broadcast({r.queue: p for r, p in zip(totals, plans, strict=True)})
    else:
        held, placed = None, placed.join(spark.createDataFrame([_row_of(r.queue, p) for r, p in zip(totals, plans, strict=True)], PLANNED), "queue")
    return placed.mapInArrow(lambda it: _pieces(it, held, window, granule), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
