"""Personal data: base patterns and bootstrapped contextual extraction.

Base entities, and digest-like keys as seeds of one more kind (secret), are the seeds. The
words around a seed make lexical patterns: two words, one word, either side, also with the
shape of what they surround. The same patterns around other identifier-like mentions make a
bipartite graph of patterns and instances, which Spark scores in rounds: a pattern is worth
the share of its instances that are known, over all kinds; an instance the chance that one
of its good patterns is right, and its kind is the one that these patterns have seen most
among those its surface can be. Rounds go on until no pattern becomes good; as scores only
grow, that is certain to come. Mentions in good patterns are added as spans. Texts are read
once; the graph holds only mentions, with equal edges summed up first, and is joined, never
gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .shared import written
from .textbytes import slices

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
MIN_SUPPORT, MIN_CONFIDENCE, SMOOTHING = 3.0, 0.75, 0.5
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"\+?\(?(?<![0-9])[0-9](?:[().\x20/:-]{0,2}[0-9]){3,}+")
#: Seeds of secrets: keys written as a digest is, of 32 hexadecimal digits or more in one case, letters and numbers mixed.
KEY = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])")
CODE = re.compile(r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{8,}+")
LETTERS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
MAYBE = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")
EDGE = ".,;:!?\"'()[]{}<>|"
REACH = 160  #: a context is looked for in so many characters on either side; words that reach farther are cut for it

Span = tuple[int, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, found from their @: the run before it is walked once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        nxt = at + 1
        if s < at and (m := DOMAIN.match(text, nxt)):
            out.append((0, s, m.end()))
            last = nxt = m.end()
        else:
            last = nxt
        at = text.find("@", nxt)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in the order of kind, then start; code points, end exclusive."""
    if not MAYBE.search(text):
        return []
    out = emails(text)
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 2 * 19 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """(kind or -1, start, end): base spans, seeds of secrets, and identifier-like runs that overlap none."""
    if not base and not MAYBE.search(text):
        return []
    out = list(base)
    taken = sorted((s, e) for _, s, e in base)
    found = [(0, m.start(), m.end()) for m in KEY.finditer(text)]
    found += [(1, m.start(), m.end()) for m in CODE.finditer(text)]
    found += [(1, m.start(), m.end()) for m in NUMBER.finditer(text)]
    at = text.find("@")
    while at >= 0:  # a run without white space that holds an @, however long; each is walked once
        s = e = at
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        end, core = e, text[s:e]
        e -= len(core) - len(core.rstrip(EDGE))
        s += len(core) - len(core.lstrip(EDGE))
        if s < at < e - 1:
            found.append((1, s, e))
        at = text.find("@", end)
    i, last = 0, 0
    for rank, s, e in sorted(found, key=lambda x: (x[1], x[0])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= last and not any(x < e for x, _ in taken[i : i + 1]):
            out.append((-1 if rank else SECRET, s, e))
            last = e
    return out


def shape(surface: str) -> str:
    """Runs of letters as a, digits by the number of them, other characters as they are; the first 24 of them."""
    return DIGITS.sub(lambda m: f"{len(m[0])}#", LETTERS.sub("a", surface[:REACH].lower()))[:24]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a mention: two words before it, one before and one behind it, each alone, and single words with the mention's shape."""
    left = [DIGIT.sub("0", w) for w in text[max(0, start - REACH) : start].lower().split()[-2:]]
    right = [DIGIT.sub("0", w) for w in text[end : end + REACH].lower().split()[:1]]
    left = ["^"] * (2 - len(left)) + left
    after, kind = right[0] if right else "$", shape(text[start:end])
    return [f"L2 {left[0]} {left[1]}", f"M {left[1]} _ {after}", f"L {left[1]}", f"R {after}", f"LS {left[1]} {kind}", f"RS {after} {kind}"]


def fits(surface: str) -> int:
    """The kinds that an unseen surface could be at all, as bits."""
    n = len(DIGIT.findall(surface))
    if "@" in surface:
        return 1 << 0
    plain = not any(c.isalpha() for c in surface)
    dots = surface.count(".")
    return (plain and dots == 3 and n <= 12) << 1 | (plain and not dots and 12 <= n <= 19) << 2 | (plain and 7 <= n <= 15) << 3 | (not plain and n > 0 and len(surface) >= 8) << SECRET


SCANNED = "row long, doc_id long, mark long, mentions array<struct<kind:int,start:int,end:int,fits:int,surface:string,patterns:array<string>>>"
_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("fits", pa.int32()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for rows in slices(batch, "text"):
            found = []
            for text in rows.column("text").to_pylist():
                found.append([(k, s, e, fits(text[s:e]), text[s:e].lower(), contexts(text, s, e)) for k, s, e in mentions(text, base_spans(text))] if text else [])
            n, flat = [len(x) for x in found], [m for x in found for m in x]
            cols = list(zip(*flat, strict=True)) or [()] * 6
            cells = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MENTION, strict=True)], fields=list(_MENTION))
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), rows.column("doc_id"), rows.column("mark"), pa.ListArray.from_arrays(ends, cells)], ["row", "doc_id", "mark", "mentions"])
            row += len(n)


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each of docs, numbered, with the mentions of its text: kind (-1: unknown), place, the kinds it fits, surface and patterns."""
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    return written(own.mapInArrow(_scan, SCANNED), "pii-mentions")


def learn(edges: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, smoothing: float = SMOOTHING) -> DataFrame:
    """Patterns worth following, (pattern, confidence, by: how much of each kind it has seen), from edges (pattern, surface, kind or -1, fits), distinct by pattern and surface."""
    seeds = written(edges.where("kind >= 0").groupBy("surface").agg(F.min("kind").alias("kind"), F.lit(1.0).alias("score")), "pii-seeds")
    unknown = edges.where("kind < 0").select("pattern", "surface", "fits").join(seeds.select("surface"), "surface", "left_anti")
    scores, before = seeds, -1
    while True:
        of_kind = [F.coalesce(F.sum(F.when(F.col("k") == i, F.col("score"))), F.lit(0.0)) for i in range(len(NAMES))]
        known = edges.select("pattern", "surface").join(scores.withColumnRenamed("kind", "k"), "surface", "left").groupBy("pattern").agg(F.count("*").alias("total"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("known"), F.array(*of_kind).alias("by"))
        good = known.where(F.col("known") >= support).select("pattern", (F.col("known") / (F.col("total") + smoothing)).alias("confidence"), "by")
        good = written(good.where(F.col("confidence") >= confidence), "pii-patterns")
        n = good.count()
        if n == before:
            return good
        before = n
        scores = seeds.union(judged(unknown, good, "surface").select("surface", "kind", "score"))


def judged(mentions: DataFrame, good: DataFrame, *key: str) -> DataFrame:
    """(key, kind, score) of mentions (key, pattern, fits) in good patterns: the chance that one of the patterns is right, and the kind that they have seen most among those that fit; ties go to the kind listed first. Mentions that fit none of the kinds seen do not appear."""
    seen = F.aggregate("by", F.lit(0.0), lambda a, x: a + x)
    votes = [F.sum(F.when(F.col("fits").bitwiseAND(F.lit(1 << i)) > 0, F.col("confidence") * F.col("by")[i] / seen).otherwise(0.0)) for i in range(len(NAMES))]
    out = mentions.join(good, "pattern").groupBy(*key).agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"), F.array(*votes).alias("votes"))
    return out.where(F.array_max("votes") > 0).select(*key, (F.array_position("votes", F.array_max("votes")) - 1).cast("int").alias("kind"), "score")


def added(found: DataFrame) -> DataFrame:
    """(row, spans) for the rows of scanned documents to which the method adds spans: seeds of secrets, and what the patterns found."""
    each = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "surface", "kind", "fits")
    edges = written(edges.groupBy("pattern", "surface").agg(F.max("kind").alias("kind"), F.max("fits").alias("fits")), "pii-edges")
    new = judged(each.where("kind < 0").select("row", "start", "end", "fits", F.explode("patterns").alias("pattern")), learn(edges), "row", "start", "end")
    new = new.select("row", "kind", "start", "end").union(each.where(F.col("kind") == SECRET).select("row", "kind", "start", "end"))
    return written(new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more")), "pii-added")  # a row's mentions are bounded by its text


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of docs: arrays of (kind, start, end) in the order of kind, then start.

    base holds the base spans of KINDS, spans these and what the method added, of NAMES. A
    null text is empty and has none; rows that repeat a doc_id are scanned each and keep
    their own spans, an empty table gives no rows, extra columns are left alone. Where
    patterns have seen two kinds of a mention equally often, the one listed first gets it.
    """
    found = scanned(docs)
    base = F.transform(F.filter("mentions", lambda m: (m["kind"] >= 0) & (m["kind"] < SECRET)), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    rows = found.select("row", "doc_id", base.alias("base")).join(added(found), "row", "left")
    return rows.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def result(docs: DataFrame) -> DataFrame:
    """The query's columns; spans of the kind that the method brings with it stand in a column of their own."""
    count = [F.expr(f"CAST(size(filter(base, x -> x.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    of_kind = lambda test: _joined(F.filter("spans", lambda x: test(x["kind"])))
    return extract(docs).select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), of_kind(lambda k: k < SECRET).alias("spans"), of_kind(lambda k: k == SECRET).alias("secret_spans"))


def cover(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind; of spans that overlap the first to begin names the kind, and all of them go."""
    out, at = [], 0
    for k, s, e in sorted(found, key=lambda x: (x[1], x[0])):
        if s >= at:
            out += [text[at:s], f"[{NAMES[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of each text replaced by their kind in capitals and brackets; n_chars, where there is one, follows the text.

    Null texts stay null, rows that repeat are redacted each, an empty table stays empty,
    other columns stay as they are whatever their names.
    """
    found = scanned(docs)
    more = found.select("row", "doc_id", "mark").join(added(found), "row").groupBy("doc_id", "mark").agg(F.any_value("more").alias("more"))
    more = written(more, "pii-redacted")  # only rows to which the method adds spans; broadcast or shuffled by its size
    names = []
    for n in ("own", "mark", "more"):
        while n in docs.columns or n in names:
            n += "_"
        names.append(n)
    own, mark, spans = names
    more = more.select(F.col("doc_id").alias(f"{own}_"), F.col("mark").alias(f"{mark}_"), F.col("more").alias(spans)) if docs.columns else more
    rows = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(more, rows[own].eqNullSafe(more[f"{own}_"]) & rows[mark].eqNullSafe(more[f"{mark}_"]), "left").select(*[rows[c] for c in docs.columns], more[spans])
    schema, at = docs.schema, docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = []
                for t, new in zip(part.column("text").to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    texts.append(t if t is None else cover(t, [*base_spans(t), *((x["kind"], x["start"], x["end"]) for x in new or ())]))
                cols = list(part.columns)[:-1]
                if size is not None:
                    changed = [None if t is None else len(t) for t in texts]
                    cols[size] = pa.array([n if n is not None else old for n, old in zip(changed, cols[size].to_pylist(), strict=True)], cols[size].type)
                cols[at] = pa.array(texts, cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(list(batch.schema)[:-1]))

    return rows.mapInArrow(clean, schema)
