"""The Jaccard join against brute force, with nulls, empty and long texts, copies, shared passages, repeated rows, empty tables and clashing columns."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veilspark.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id long, n int, key string, root long, sid string"


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {" ".join(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {" ".join(w)} - {""}


def twin(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return sorted([(k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)], key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["é日", "\U0001f600"]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = [None, "", " \t\n", "one", "ONE", "a b c", "A  b\nc", "a b c d", "a b c d e", "x " * 5000, "日" * 3000]
    passage = make(60)
    for n in (5, 9, 10, 12, 20, 26, 40, 80, 200, 700):
        for _ in range(3):
            base = make(n)
            for _ in range(r.randint(2, 9)):  # near copies, about at the threshold
                copy = list(base)
                for _ in range(r.randint(0, max(1, n // 50))):
                    copy[r.randrange(len(copy))] = r.choice(vocabulary)
                rows.append(" ".join(copy + make(r.randint(0, max(1, n // 20)))))
    rows += [" ".join(passage + make(r.randint(0, 20))) for _ in range(60)]  # a passage is most of each
    chain = make(120)
    for _ in range(40):  # each links with its neighbours alone
        rows.append(" ".join(chain))
        chain = chain[4:] + make(4)
    rows += ["Exactly the same words in a third of all rows here"] * 150
    rows = [r.choice((str.upper, str.lower, str))(t) if t and t.isascii() else t for t in rows]
    out = list(enumerate(rows)) + [(None, rows[40]), (None, "nobody else has these words at all but me"), (7, rows[30]), (7, rows[30])]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,light,crowd", [(1, None, 16), (3, 10_000, 1), (4, 30, 10_000)])
def test_join(spark, monkeypatch, seed, light, crowd):
    monkeypatch.setattr(jaccard, "CHUNK", 256 if seed == 1 else 3)
    monkeypatch.setattr(jaccard, "WORDS", 1 << 15 if seed == 1 else 7)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, 2, "clash", 3, "clash") for i, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, jaccard.join(df, light, crowd).collect()), key=str)
    assert got == twin(rows)
    if seed == 1:
        assert jaccard.join(df.limit(0)).collect() == [] and jaccard.join(df.where("text IS NULL OR text = ''")).count() == 2


def test_sets():
    texts = [None, "", "A b C d b c D a b c d", "x", "one two three four five one two three four", "é É"]
    h, first = jaccard.sets_of(pa.array(texts))
    for t, a, b in zip(texts, first, first[1:]):
        assert sorted(xxhash.xxh64_intdigest(s, 42) for s in shingles(t)) == h[a:b].tolist()


def test_prefixes_meet():
    """Whatever the sketch says, two sets that link share a key of one member, and one of two."""
    r = random.Random(0)
    for _ in range(200):
        n = r.randint(6, 60)
        a = [str(r.random()) for _ in range(n)]
        b = a[: n - r.randint(0, n // 8)] + [str(r.random()) for _ in range(r.randint(0, n // 8))]
        texts = pa.array([" ".join(a), " ".join(b)])
        x, y = shingles(texts[0].as_py()), shingles(texts[1].as_py())
        if min(len(x), len(y)) < 6 or 100 * len(x & y) < 85 * len(x | y):
            continue
        classes = np.random.default_rng(n).integers(0, 5, 1 << 16).astype(np.uint8)
        for k in (1, 2):
            batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), texts], ["id", "text"])
            (out,) = jaccard._keys(iter([batch]), lambda: classes, k)
            places = [{k: (m, q) for k, i, m, q in zip(*(c.to_pylist() for c in out.columns)) if i == j} for j in (0, 1)]
            common = places[0].keys() & places[1].keys()
            assert any(min(places[0][c][1], places[1][c][1]) >= len(x & y) for c in common)
