"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Only the counts of vote
patterns (at most 3 ** labellers) reach the driver, where expectation-maximisation
estimates how each labeller votes on good and on bad texts, from all documents. The
posterior of a sample's patterns then trains a linear scorer on hashed token shapes, which
judges every document, also those on which no labeller votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbytes import LOWER, P1, P2, SPACE, buffer, slices, words, xxh64

DIM = 256
SAMPLE = 8192  #: rows that train the linear scorer, those of the smallest hashes
THRESHOLD = 0.5
SHRINK = 8  #: so many tokens weigh as much as the prior
BAD, GOOD, NONE = 0, 1, 2
LABELLERS = ("symbols", "capitals", "repeats", "runs", "prose", "separators", "variety", "topword", "sentences")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*|!<>=^~{}\\")] = True
SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))
PROSE = [x.encode() for x in ("a", "Aa", "A", "a.", "a,", "Aa.", "Aa,", "a?", "a;", "a:")]


def _hash(x: bytes) -> np.uint64:
    return xxh64(x, np.array([0]), np.array([len(x)]))[0]


PROSE_HASHES = np.sort(np.array([_hash(x) for x in PROSE], np.uint64))
SAME = np.uint64(0x5851F42D4C957F2D)


def _vote(value: np.ndarray, good_to: float, bad_from: float, enough: np.ndarray) -> np.ndarray:
    """Good up to good_to, bad from bad_from on, nothing between and where there is not enough text; the order of the bounds gives the direction."""
    if good_to < bad_from:
        v = np.where(value <= good_to, GOOD, np.where(value >= bad_from, BAD, NONE))
    else:
        v = np.where(value >= good_to, GOOD, np.where(value <= bad_from, BAD, NONE))
    return np.where(enough, v, NONE)


def look(column: pa.Array, want_features: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Votes (texts x labellers), hashed shape features (texts x DIM) and number of words of a column's texts; null texts are empty."""
    raw, offs = buffer(column)
    n = len(offs) - 1
    s, e, f = words(raw, offs)
    count = np.diff(f)
    h = xxh64(raw.translate(LOWER), s, e - s)
    doc = np.repeat(np.arange(n), count)
    per = lambda x: np.bincount(doc, weights=x, minlength=n)
    a = np.frombuffer(raw, np.uint8)
    upto = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[offs[1:]] - c[offs[:-1]]
    shape = np.frombuffer(raw.translate(SHAPE), np.uint8)
    letters, capitals, symbols = upto((shape == 97) | (shape == 65)), upto(shape == 65), upto(SYMBOLS[a])
    chars = np.maximum(upto(~SPACE[a]), 1)
    # runs of one class shrink to one character
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    first = offs[:-1][offs[:-1] < len(raw)]
    keep[first] = True
    short = shape[keep].tobytes()
    soffs = np.concatenate([[0], np.cumsum(keep)])[offs]
    s2, e2, f2 = words(short, soffs)
    hs = xxh64(short, s2, e2 - s2)
    prose = np.isin(hs, PROSE_HASHES)
    some = np.maximum(count, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    lettered = np.zeros(len(s2), bool)
    if len(s2):
        isl = np.concatenate([[0], np.cumsum(np.isin(np.frombuffer(short, np.uint8), (97, 65, 48)))])
        lettered = isl[e2] > isl[s2]
    ends = np.isin(a[e - 1], list(b".?!")) if len(e) else np.zeros(0, bool)
    runs = np.zeros(len(h), bool)
    runs[2:] = same[2:] & same[1:-1]
    top, distinct = np.zeros(n), np.zeros(n)
    if len(h):
        with np.errstate(over="ignore"):
            key = h ^ (doc.astype(np.uint64) * P1)
        _, at, c = np.unique(key, return_index=True, return_counts=True)
        np.maximum.at(top, doc[at], c)
        distinct = np.bincount(doc[at], minlength=n)
    enough = count >= 8
    votes = np.stack([
        _vote(symbols / chars, 0.005, 0.03, enough),
        _vote(capitals / np.maximum(letters, 1), 0.10, 0.30, enough),
        _vote(per(same) / some, 0.01, 0.10, enough),
        _vote(per(runs) / some, 0.002, 0.05, enough),
        _vote(per(prose) / some, 0.90, 0.60, enough),
        _vote(per(~lettered) / some, 0.02, 0.20, enough),
        _vote(distinct / some, 0.25, 0.12, count >= 40),
        _vote(top / some, 0.12, 0.25, count >= 40),
        _vote(count / np.maximum(per(ends), 1), 40, 80, count >= 40),
    ], 1)
    if not want_features:
        return votes, None, count
    buckets = [hs % np.uint64(DIM)]
    docs2 = np.repeat(np.arange(n), np.diff(f2))
    with np.errstate(over="ignore"):
        pair = ((hs[:-1] * P2) ^ hs[1:]) * P1 >> np.uint64(32)
    inner = docs2[1:] == docs2[:-1]
    x = np.bincount(docs2 * DIM + buckets[0].astype(np.int64), minlength=n * DIM)
    x = x + np.bincount(docs2[1:][inner] * DIM + (pair[inner] % np.uint64(DIM)).astype(np.int64), minlength=n * DIM)
    x = x + np.bincount(doc[same] * DIM + int(SAME % np.uint64(DIM)), minlength=n * DIM)
    x = np.sqrt(x.reshape(n, DIM) / some[:, None]).astype(np.float32)
    return votes, x, count


def code(votes: np.ndarray) -> np.ndarray:
    return (votes * 3 ** np.arange(votes.shape[1])).sum(1)


def decode(codes: np.ndarray, m: int = len(LABELLERS)) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(m) % 3


@dataclass
class WeakLabels:
    """prior: share of good texts; table[y, j, v]: chance that a vote of labeller j on a text of class y is v. No vote says nothing: its entry is 1."""

    prior: float
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        j = np.arange(votes.shape[1])
        good = np.log(self.prior) + np.log(self.table[GOOD][j, votes]).sum(1)
        bad = np.log(1 - self.prior) + np.log(self.table[BAD][j, votes]).sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Chance that a vote of each labeller, when it votes, is right."""
        return self.prior * self.table[GOOD][:, GOOD] + (1 - self.prior) * self.table[BAD][:, BAD]


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> WeakLabels:
    """Fit by vote patterns and how many texts have each, from the votes' majority on; add-one smoothing keeps every chance above 0."""
    weight = counts.astype(float)
    good = (votes == GOOD).sum(1) - (votes == BAD).sum(1)
    p = 1 / (1 + np.exp(-2.0 * good))
    out = WeakLabels(0.5, np.full((2, votes.shape[1], 3), 0.5))
    for _ in range(rounds):
        voted = weight * (votes != NONE).any(1)
        new = WeakLabels(float((p @ voted + 1) / (voted.sum() + 2)), np.zeros_like(out.table))
        for y, q in ((BAD, (1 - p) * weight), (GOOD, p * weight)):
            for v in (BAD, GOOD):
                new.table[y, :, v] = ((votes == v) * q[:, None]).sum(0) + 1
            new.table[y] /= new.table[y][:, :2].sum(1, keepdims=True)
            new.table[y, :, NONE] = 1
        done = np.abs(new.table - out.table).max(initial=0) < 1e-9
        out, p = new, new.posterior(votes)
        if done:
            break
    return out


def fit(x: np.ndarray, p: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic scorer (the last is the intercept) for soft labels p, by Newton's method."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    n = max(len(x), 1)
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (s - p) / n + ridge * w
        step = np.linalg.solve(x.T @ (x * (s * (1 - s))[:, None]) / n + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chance(w: np.ndarray, x: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    """The scorer's chance of good; texts of few words are drawn to the prior."""
    share = n / (n + SHRINK)
    logit = share * np.clip(x @ w[:-1] + w[-1], -30, 30) + (1 - share) * np.log(prior / (1 - prior))
    return 1 / (1 + np.exp(-logit))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text"):
            c, n = np.unique(code(look(rows.column("text"), False)[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64))], ["code", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text"):
            votes, x, _ = look(rows.column("text"))
            yield pa.RecordBatch.from_arrays([rows.column("h"), pa.array(code(votes).astype(np.int32)), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["h", "code", "x"])


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[WeakLabels, np.ndarray]:
    """The label model from all of docs, and the scorer from at most `sample` of its rows."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.octet_length("text")).alias("h"))
    patterns = docs.select("text").mapInArrow(_votes, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()  # at most 3 ** labellers rows
    total = sum(r.n for r in patterns)
    model = expectation_maximisation(decode(np.array([r.code for r in patterns], np.int64).reshape(-1)), np.array([r.n for r in patterns]))
    share = min(1.0, 1.5 * sample / max(total, 1))
    picked = docs.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else docs
    rows = picked.mapInArrow(_features, "h long, code int, x binary").orderBy("h", "code", "x").limit(sample).collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32).reshape(-1, DIM)
    p = model.posterior(decode(np.array([r.code for r in rows], np.int64).reshape(-1)))
    return model, fit(x, p)


def score(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, votes, weak_label, score, kept) for every row of docs.

    votes has a character for each labeller: 0 bad, 1 good, 2 no vote. weak_label is the
    label model's posterior for good, score the scorer's; kept is score >= threshold. Null
    texts are empty; a text of under 8 words has no votes and is judged by its shapes.
    Repeated rows get equal values; an empty table gives no rows; extra columns are left
    alone.
    """
    model, w = train(docs, sample)
    held = docs.sparkSession.sparkContext.broadcast((model, w))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = held.value
        for batch in batches:
            for rows in slices(batch, "text"):
                votes, x, n = look(rows.column("text"))
                s = chance(w, x, n, m.prior)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(["".join(map(str, v)) for v in votes.tolist()]), pa.array(m.posterior(votes)), pa.array(s), pa.array(s >= threshold)], ["doc_id", "votes", "weak_label", "score", "kept"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, "doc_id long, votes string, weak_label double, score double, kept boolean")


def keep(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the scorer keeps, with their columns."""
    model, w = train(docs, sample)
    held = docs.sparkSession.sparkContext.broadcast((model.prior, w))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, w = held.value
        for batch in batches:
            for rows in slices(batch, "text"):
                _, x, n = look(rows.column("text"))
                yield rows.filter(pa.array(chance(w, x, n, prior) >= threshold))

    return docs.mapInArrow(good, docs.schema)
