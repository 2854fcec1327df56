"""Fill-in-the-middle against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, form string, address string, ends int, h1 string"


def twin(doc_id, text, fim_rate=50, spm=80):
    t = text or ""
    tokens = TOKEN.findall(t)
    n = len(tokens)
    hexes = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_rate:
        return n, "plain", None, None, t
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    if h[3] % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def rows():
    r = random.Random(3)
    texts = [None, "", " \t\n", "one", " lead", "trail  ", "a b c\x0bd", "é 日本 \U0001f600 ▁ x ", "with <P> inside", "x<M>", "ends with <", "<", "P> <S", "M>", "word " * 3000, "x" * 60_000, "日" * 999 + " y"]
    out = [(k, t) for k, t in enumerate(texts * 6)] + [(None, "no id here at all"), (7, "twice"), (7, "twice"), (7, "not twice")]
    out += [(1000 + k, "".join(r.choice("ab \n<é\U0001f600>PSM") for _ in range(r.randint(0, 60)))) for k in range(300)]
    return out + [(5000 + k, "a copy that a third of the rows hold") for k in range(200)]


def test_transform(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, 1, "clash", "clash", 2, "clash") for i, t in data], SCHEMA)
    got = sorted(map(tuple, fim.transform(df.repartition(5)).collect()), key=str)
    assert got == sorted([(i, *twin(i, t)) for i, t in data], key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    back = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).select("doc_id", "back").collect()
    assert sorted(map(tuple, back), key=str) == sorted([(i, t or "") for i, t in data], key=str)
    every = sorted(map(tuple, fim.transform(df, fim=100, spm=0).collect()), key=str)
    assert every == sorted([(i, *twin(i, t, 100, 0)) for i, t in data], key=str)
    assert fim.result(df.limit(0)).collect() == [] and fim.result(df.limit(0)).columns[:4] == ["doc_id", "n", "form", "prefix_chars"]
    assert fim.index(df.select(F.coalesce("text", F.lit("")).alias("text"))).count() == len({t or "" for _, t in data})


def test_lists():
    r = np.random.default_rng(0)
    runs = [np.sort(r.choice(u, n, replace=False)) + 1 for u, n in ((1, 1), (9, 9), (100, 3), (100_000, 2), (100_000, 60_000), (64, 0), (5000, 700))]
    first = np.concatenate([[0], np.cumsum([len(x) for x in runs])])
    lists = pa.array(fim.encode(np.concatenate(runs), first, np.array([1, 9, 100, 100_000, 100_000, 64, 5000])), pa.binary())
    assert fim.size(lists).tolist() == [len(x) for x in runs]
    full = [i for i, x in enumerate(runs) if len(x)]
    for _ in range(50):
        at = np.stack([r.integers(0, len(runs[i]), 2) for i in full])
        assert fim.select(lists.take(pa.array(full)), at).tolist() == [runs[i][a].tolist() for i, a in zip(full, at)]
    assert len(lists[4].as_py()) < 60_000 * 3 / 8 + 20  # two bits and a little for each value of a dense list
