"""Many names at once: one Aho-Corasick automaton over all entities of a row, an automaton or an index over a corpus-wide list of names.

spans.all_spans reads a text once for each entity; the automaton reads it once for all of
them. The results are the same: each name's occurrences from left to right, none of a name
overlapping another of the same name, in code points.

An automaton takes a hundred times its names' bytes and a random read of memory for each byte of a
text, so a list of more than FEW bytes becomes an Index instead: tables of the hashes of the names'
prefixes, one for each length that a name has. All places of a text are looked up in the first
table at once, those found there in the next, and what is found at a name's length is compared
byte by byte. Its cost hardly grows with the names.

A list of names of up to SMALL bytes is broadcast after its size was measured, as one Arrow
array. An index takes at most thirty times its names' bytes, and four to seven times for words, so
a task builds one over PIECE bytes of them at a time: it reads HELD bytes of texts, lets each piece
go over them and reads on. A longer list is dealt to shards of SMALL bytes, and each slice of the
documents meets each shard in a task of its own, so neither the driver nor a task ever holds the
whole list.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

SMALL = 32 << 20  #: bytes of names that are broadcast
FEW = 1 << 12  #: bytes of names for which an automaton is built
PIECE = 16 << 20  #: bytes of names that one automaton or index is built of
HELD = 64 << 20  #: bytes of texts that all pieces go over in turn
HITS = 100_000  #: places found that make a batch
GROUP = 1 << 20  #: bytes of whole texts whose places are found together
STEP = 1 << 18  #: places of a text that are looked up together
BASE, MIX = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93  #: odd numbers for hashes
FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ord", pa.int32())]))
PLACE = [("start", IntegerType()), ("end", IntegerType())]


def _type(name: str, kind: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(n, k) for n, k in [*PLACE, (name, kind)]]))


_kept: dict[str, object] = {}


def automaton(names: Iterable[tuple[str, object]]) -> ahocorasick.Automaton | None:
    """Of (name, value) pairs; empty names find nothing, and of equal ones the last counts."""
    out = ahocorasick.Automaton()
    for name, value in names:
        if name:
            out.add_word(name, (len(name), value))
    if not len(out):
        return None
    out.make_automaton()
    return out


def occurrences(found: ahocorasick.Automaton | None, text: str | None) -> Iterator[tuple[int, int, object]]:
    """(start, end, value) of each name's occurrences, in the order of their ends."""
    last: dict[object, int] = {}
    for at, (n, value) in found.iter(text) if found and text else ():
        if last.get(value, 0) <= at + 1 - n:
            last[value] = at + 1
            yield at + 1 - n, at + 1, value


@F.arrow_udf(_type("ord", IntegerType()))
def _spans(text: pa.Array, names: pa.Array) -> pa.Array:
    out = []
    for t, row in zip(text.to_pylist(), names.to_pylist(), strict=True):
        where: dict[str, list[int]] = {}
        for i, name in enumerate(row or ()):
            if name:
                where.setdefault(name, []).append(i)
        found = [(i, s, e) for s, e, name in occurrences(automaton((x, x) for x in where), t) for i in where[name]]
        out.append(None if t is None or row is None else [{"start": s, "end": e, "ord": i} for i, s, e in sorted(found)])
    return pa.array(out, FOUND)


def all_spans(text: Column, ents: Column) -> Column:
    """spans.all_spans in one pass over the text: for lists of dozens of entities, or long texts."""
    return _spans(text, F.transform(ents, lambda e: F.when(e["enabled"], e["original"])))


class Level:
    """A table of the prefixes of one length: their hashes by slot, the name that ends there (or -1), and whether longer ones begin so."""

    def __init__(self, length: int, keys: np.ndarray, ident: np.ndarray, longer: np.ndarray):
        bits = max(8, (2 * len(keys)).bit_length())
        self.length, self.shift = length, np.uint64(64 - bits)
        slot = self.slots(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.ident, self.longer = keys[order], ident[order], longer[order]
        self.starts = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=1 << bits), out=self.starts[1:])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(MIX)) >> self.shift).astype(np.int64)

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are there, their rows)."""
        slot = self.slots(keys)
        at, end = self.starts[slot], self.starts[1:][slot]
        live = np.flatnonzero(at < end)
        at, end, keys = at[live], end[live], keys[live]
        which, rows = [], []
        while len(live):
            same = self.keys[at] == keys
            which.append(live[same])
            rows.append(at[same])
            at = at + 1
            more = ~same & (at < end)
            live, at, end, keys = live[more], at[more], end[more], keys[more]
        if len(which) < 2:
            return (which[0], rows[0]) if which else (live, at)
        return np.concatenate(which), np.concatenate(rows)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, len + 1 offsets) of strings; a null is empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; data has eight more than are read."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


class Index:
    """Distinct names, none empty, by the hashes of their prefixes."""

    def __init__(self, names: pa.Array):
        self.names = names
        data, offsets = _bytes(names)
        self.lens = np.diff(offsets)
        self.first, self.most = offsets[:-1] - offsets[0], int(self.lens.max())
        self.data = np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)])
        self.chars = np.asarray(pc.utf8_length(names)).astype(np.int32)
        self.powers = np.full(STEP + self.most + 1, BASE, np.uint64)
        self.inverse = np.full(STEP, pow(BASE, -1, 1 << 64), np.uint64)
        for x in (self.powers, self.inverse):
            x[0] = 1
            np.cumprod(x, out=x)
        self.levels: list[Level] = []
        self.exact = self._build()

    def _build(self) -> bool:
        """False where two prefixes have one hash."""
        live, keys, node, before = np.arange(len(self.lens), dtype=np.int32), np.zeros(len(self.lens), np.uint64), np.zeros(len(self.lens), np.int32), 0
        for length in np.unique(self.lens).tolist():
            more = self.lens[live] >= length
            live, keys, node = live[more], keys[more], node[more]
            at = self.first[live]
            for j in range(before, length):
                keys = keys + self.data[at + j] * self.powers[j]
            order = np.argsort(keys)
            new = np.ones(len(order), bool)
            new[1:] = keys[order[1:]] != keys[order[:-1]]
            same, to = order[:-1][~new[1:]], order[1:][~new[1:]]
            if not (node[same] == node[to]).all() or not all((self.data[at[same] + j] == self.data[at[to] + j]).all() for j in range(before, length)):
                return False
            group = np.cumsum(new, dtype=np.int32) - 1
            node = np.empty(len(order), np.int32)
            node[order] = group
            ends = self.lens[live] == length
            ident, longer = np.full(group[-1] + 1, -1, np.int32), np.zeros(group[-1] + 1, bool)
            ident[node[ends]] = live[ends]
            longer[node[~ends]] = True
            self.levels.append(Level(length, keys[order[new]], ident, longer))
            before = length
        return True

    def _looked_up(self, text: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, names) in the n bytes of a text that has more behind it."""
        words, own = _words(text), _words(self.data)
        for a in range(0, n, STEP):
            m = min(STEP, n - a)
            part = text[a : a + m + self.most]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * self.powers[: len(part)], out=sums[1:])
            at = None
            for level in self.levels:
                p = level.length
                keys = (sums[p : p + m] - sums[:m]) * self.inverse[:m] if at is None else (sums[at + p] - sums[at]) * self.inverse[at]
                which, rows = level.found(keys)
                at = which if at is None else at[which]
                name = level.ident[rows]
                hit = name >= 0
                name, place = name[hit], at[hit] + a
                first = self.first[name]
                for j in [*range(0, p - 7, 8), *([p - 8] if p > 8 and p % 8 else [])] if p >= 8 else [0]:
                    differ = words[place + j] ^ own[first + j]
                    same = (differ if p >= 8 else differ << np.uint64(64 - 8 * p)) == 0
                    if not same.all():
                        name, place, first = name[same], place[same], first[same]
                yield place, name
                at = at[level.longer[rows]]
                if not len(at):
                    break

    def places(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, name, start, end) by name, then place; a row's are in one group."""
        data, offsets = _bytes(texts)
        cuts = [0]
        while cuts[-1] < len(texts):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + GROUP, "right")) - 1))
        for a, b in zip(cuts, cuts[1:]):
            own = offsets[a : b + 1] - offsets[a]
            n = int(own[-1])
            text = np.concatenate([data[offsets[a] : offsets[b]], np.zeros(self.most + 8, np.uint8)])
            found = list(self._looked_up(text, n))
            if not found:
                continue
            # sorted by name and place, so that each name's places in a text follow one another
            both = np.sort(np.concatenate([(name.astype(np.int64) << 36) | place for place, name in found]))
            name, place = (both >> 36).astype(np.int32), both & ((1 << 36) - 1)
            row = np.searchsorted(own, place, "right") - 1
            end = place + self.lens[name]
            within = end <= own[row + 1]
            if not within.all():
                name, place, row, end = name[within], place[within], row[within], end[within]
            keep = _apart(name, row, place, end)
            if keep is not None:
                name, place, row = name[keep], place[keep], row[keep]
            start = place - own[row]
            if n and text.max() > 127:
                before = np.zeros(n + 1, np.int32)
                np.cumsum((text[:n] & 0xC0) != 0x80, out=before[1:])
                start = before[place] - before[own[row]]
            start = start.astype(np.int32)
            yield row + a, name, start, start + self.chars[name]


def _apart(name: np.ndarray, row: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray | None:
    """Which places of a name, from left to right, do not overlap one that stays; None: all."""
    over = np.flatnonzero((name[1:] == name[:-1]) & (row[1:] == row[:-1]) & (place[1:] < end[:-1]))
    if not len(over):
        return None
    keep, last, before = np.ones(len(name), bool), 0, -2
    for i, p, e, e0 in zip(over.tolist(), place[over + 1].tolist(), end[over + 1].tolist(), end[over].tolist()):
        if i != before + 1:
            last = e0
        if p < last:
            keep[i + 1] = False
        else:
            last = e
        before = i
    return keep


def _rows(part: pa.RecordBatch, found: ahocorasick.Automaton | Index | None) -> Iterator[pa.RecordBatch]:
    """Places in batches of about HITS, however many a batch of texts has."""
    keys, at, starts, ends, names = part.column("key"), [], [], [], []
    columns = ["key", "start", "end", "name"]
    if isinstance(found, Index):
        for row, name, start, end in found.places(part.column("text")):
            for i in range(0, len(row), HITS):
                j = slice(i, i + HITS)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[j])), pa.array(start[j]), pa.array(end[j]), found.names.take(pa.array(name[j]))], columns)
        return

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(names, pa.string())], columns)
        for x in (at, starts, ends, names):
            x.clear()
        return out

    for i, t in enumerate(part.column("text")):
        for s, e, name in occurrences(found, t.as_py()):
            at.append(i)
            starts.append(s)
            ends.append(e)
            names.append(name)
            if len(at) >= HITS:
                yield made()
    yield made()


def _counts(part: pa.RecordBatch, found: ahocorasick.Automaton | Index | None) -> Iterator[pa.RecordBatch]:
    """(key, name, n, first, last) of each row and name, in batches of about HITS."""
    keys, columns = part.column("key"), ["key", "name", "n", "first", "last"]
    if isinstance(found, Index):
        for row, name, start, end in found.places(part.column("text")):
            cut = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (row[1:] != row[:-1])][: len(name)])
            n, last = np.diff(cut, append=len(name)), np.append(cut[1:], len(name)) - 1
            for i in range(0, len(cut), HITS):
                j = slice(i, i + HITS)
                c = cut[j]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[c])), found.names.take(pa.array(name[c])), pa.array(n[j]), pa.array(start[c]), pa.array(end[last[j]])], columns)
        return
    rows: list[tuple[int, str, list[int]]] = []

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([keys.take(pa.array([i for i, _, _ in rows], pa.int64())), pa.array([x for _, x, _ in rows], pa.string()), *(pa.array([c[k] for _, _, c in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32())))], columns)
        rows.clear()
        return out

    for i, t in enumerate(part.column("text")):
        own: dict[str, list[int]] = {}
        for s, e, name in occurrences(found, t.as_py()):
            c = own.setdefault(name, [0, s, e])
            c[0], c[2] = c[0] + 1, e
        rows += [(i, name, c) for name, c in own.items()]
        if len(rows) >= HITS:
            yield made()
    yield made()


def pieces(names: pa.Array, most: int) -> list[pa.Array]:
    """Names cut into runs of about `most` bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(names)), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // max(most, 1))) + 1).tolist(), len(names)]
    return [names.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


Give = Callable[[pa.RecordBatch, "ahocorasick.Automaton | Index | None"], Iterator[pa.RecordBatch]]


def _searched(texts: list[pa.RecordBatch], cut: list[pa.Array], give: Give) -> Iterator[pa.RecordBatch]:
    """What is found of each piece's names in all the texts; one automaton or index is there at a time."""
    for names in cut:
        found = _one(names)
        for batch in texts:
            yield from give(batch, found)
        found = None


def _one(names: pa.Array) -> ahocorasick.Automaton | Index | None:
    """An index where there are many names, unless their hashes are not enough to tell them apart."""
    if names.nbytes > FEW and (found := Index(names)).exact:
        return found
    return automaton((x, x) for x in names.to_pylist())


def _sharded(batches: Iterator[pa.RecordBatch], piece: int, held: int, give: Give) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, slice, is_text): a shard's names, then the texts of a slice."""
    now, names, texts, size = None, [], [], 0

    def found() -> Iterator[pa.RecordBatch]:
        if names and texts:
            yield from _searched(texts, pieces(pa.concat_arrays(names), piece), give)

    for batch in batches:
        if not batch.num_rows:
            continue
        cells = np.stack([np.asarray(batch.column(c)) for c in ("shard", "slice")], 1)
        is_text = np.asarray(batch.column("is_text").cast(pa.int8()))
        cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(1) | (is_text[1:] != is_text[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            cell, part = tuple(cells[a].tolist()), batch.slice(a, b - a)
            if cell != now:
                yield from found()
                now, names, texts, size = cell, [], [], 0
            if not is_text[a]:
                names.append(part.column("name"))
                continue
            texts.append(part)
            size += part.nbytes
            if size >= held:
                yield from found()
                texts, size = [], 0
    yield from found()


def gazetteer(docs: DataFrame, key: str, names: DataFrame, small: int = SMALL) -> DataFrame:
    """(key, start, end, name): every place of docs (key, text) at which a name stands. Null texts and empty names find nothing; names that repeat count once."""
    return _found(docs, key, names, small, _rows, [("start", "int"), ("end", "int"), ("name", "string")])


def counted(docs: DataFrame, key: str, names: DataFrame, unique: bool = False, small: int = SMALL) -> DataFrame:
    """(key, name, n, first, last): how often each name stands in each document, its first place's start and its last one's end, counted where the places are found. Rows of one key are added up, unless keys are said to be unique: then nothing is shuffled."""
    found = _found(docs, key, names, small, _counts, [("name", "string"), ("n", "bigint"), ("first", "int"), ("last", "int")])
    return found if unique else found.groupBy(key, "name").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def _found(docs: DataFrame, key: str, names: DataFrame, small: int, give: Give, columns: list[tuple[str, str]]) -> DataFrame:
    names = names.select(F.col("name").cast("string").alias("name")).where("name <> ''").distinct()
    size, n = names.agg(F.sum(F.octet_length("name")), F.count("*")).first()
    texts = docs.select(docs[key].alias("key"), F.col("text").cast("string").alias("text"))
    schema = texts.select("key", *[F.lit(None).cast(kind).alias(name) for name, kind in columns]).schema
    if (size or 0) <= small:
        sent, search, piece, held = docs.sparkSession.sparkContext.broadcast(names.toArrow().column(0).cast(pa.string()).combine_chunks()), uuid.uuid4().hex, PIECE, HELD

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut = pieces(sent.value, piece)
            if len(cut) > 1:
                for some in _held(batches, held):
                    yield from _searched(some, cut, give)
                return
            if search not in _kept:  # a worker that runs another task of this search has it already
                _kept.clear()
                _kept[search] = _one(sent.value)
            for batch in batches:
                yield from give(batch, _kept[search])

        found = texts.mapInArrow(run, schema)
    else:
        shards, slices = -(-size // max(small, 1)), max(2, texts.sparkSession.sparkContext.defaultParallelism)
        shards = min(shards, n)
        key_type = texts.schema["key"].dataType
        each = names.select(F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(False).alias("is_text"), F.lit(None).cast(key_type).alias("key"), F.lit(None).cast("string").alias("text"), "name")
        every = texts.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("key", "text"), F.lit(slices)).cast("int").alias("slice"), F.lit(True).alias("is_text"), "key", "text", F.lit(None).cast("string").alias("name"))
        dealt = each.union(every).repartition(shards * slices, "shard", "slice").sortWithinPartitions("shard", "slice", "is_text")
        piece, held = PIECE, HELD
        found = dealt.mapInArrow(lambda it: _sharded(it, piece, held, give), schema)
    return found.withColumnRenamed("key", key)


@F.arrow_udf(_type("name", StringType()))
def _first(spans: pa.Array) -> pa.Array:
    """Spans come in the order of (start, longest, name)."""
    out = []
    for row in spans.to_pylist():
        last, kept = 0, []
        for s in row:
            if s["start"] >= last:
                kept.append(s)
                last = s["end"]
        out.append(kept)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string())])))


def resolved(found: DataFrame, key: str) -> DataFrame:
    """Of places that overlap in a document the first to start, then the longest. A document's places meet in one row, which is no longer than its text."""
    place = F.struct("start", (-F.col("end")).alias("back"), "name")
    each = found.groupBy(key).agg(F.array_sort(F.collect_list(place)).alias("p"))
    spans = F.transform("p", lambda p: F.struct(p["start"].alias("start"), (-p["back"]).alias("end"), p["name"].alias("name")))
    return each.select(key, F.explode(_first(spans)).alias("s")).select(key, "s.*")
