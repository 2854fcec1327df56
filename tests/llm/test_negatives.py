"""Hard negatives against brute force, with nulls, ties, repeated rows, odd lengths, empty tables and clashing columns."""

import math
import random

import numpy as np
import pytest

from veilspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, q string, block int, anchor string, score double"


def twin(rows):
    v = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(c))) for c in x)))
    out, seen = [], set()
    for a in v:
        if a[0] % 50 or a in seen:
            continue
        seen.add(a)
        s = sorted((-sum(p * q for p, q in zip(a[2], b[2])), b[0], b[1] == a[1]) for b in v if b[0] != a[0] and len(b[2]) == len(a[2]))
        for p, j, _ in [x for x in s if x[2]][:5]:
            near = [(n, k) for n, k, same in s if not same and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a[0], j, r, k, -p, -n) for r, (n, k) in enumerate(near, 1)]
    return sorted(out)


def vectors(seed, n=400, dims=12):
    r = random.Random(seed)
    base = [[r.gauss(0.3, 0.4) for _ in range(dims)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.15) for x in r.choice(base)], r.randrange(4)) for i in range(n)]
    rows += [(n + k, base[0], k % 2) for k in range(60)]  # ties
    rows += [rows[50], rows[50], rows[3], (50, base[1], 1), (50, base[1], 2)]  # an anchor repeated whole, one with another vector, a row twice
    rows += [(None, base[0], 1), (7000, None, 1), (7050, base[0], None), (7100, [None] + base[0][1:], 1), (7150, [math.nan] + base[0][1:], 1), (7200, [math.inf] * dims, 1)]
    rows += [(7250, base[0][:5], 1), (7251, base[1][:5], 1), (7252, base[0][:5], 2), (7300, [], 1), (7301, [], 1), (7302, [], 2), (7350, [0.0] * dims, 3), (7351, [-1.0] * dims, 3), (7400, [900.0, -700.0] * (dims // 2), 0), (7401, [800.0, -900.0] * (dims // 2), 0), (7402, [700.0, -700.0] * (dims // 2), 2)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mine(spark, seed):
    rows = vectors(seed)
    df = spark.createDataFrame([(i, x, y, "clash", "clash", 1, "clash", 0.5) for i, x, y in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, negatives.mine(df).collect()))
    assert got == twin(rows) and len(got) > 50
    assert negatives.mine(df.limit(0)).collect() == [] and negatives.mine(df.where("vec_id % 50 <> 0")).collect() == []


@pytest.mark.parametrize("sparse", [0.0, 0.3, 2.0])
def test_intervals_never_drop_what_qualifies(monkeypatch, sparse):
    monkeypatch.setattr(negatives, "SPARSE", sparse)
    monkeypatch.setattr(negatives, "PIECE", 64)
    r = np.random.default_rng(5)
    for _ in range(40):
        a, x = r.integers(-300, 300, (5, 7)), r.integers(-300, 300, (int(r.integers(1, 40)), 7))
        w, bits = negatives.planes(x)
        assert (np.tensordot(w, bits.astype(np.int64), 1) == x).all()
        alive, full = r.random((5, len(x))) < 0.7, a @ x.T
        kept = negatives.scores(a, w, bits, alive, negatives.best(5, 5))
        assert (full[kept[0], kept[1]] == kept[2]).all()
        for i in range(5):
            best = sorted(full[i][alive[i]], reverse=True)[:5]
            assert sorted(kept[2][kept[0] == i], reverse=True)[: len(best)] == best
        low = r.integers(-90_000, 90_000, (5, 2)).astype(float)
        high = low + r.integers(-10, 60_000, (5, 2))
        kept = negatives.scores(a, w, bits, alive, negatives.within(low, high, 3))
        for i in range(5):
            for l, h in zip(low[i], high[i]):
                mine = [s for s in kept[2][kept[0] == i] if l <= s <= h]
                assert sorted(mine, reverse=True)[:3] == sorted([s for s in full[i][alive[i]] if l <= s <= h], reverse=True)[:3]
