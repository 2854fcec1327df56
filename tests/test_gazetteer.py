"""The automaton against one search for each name; the list of names broadcast and dealt to shards."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import docs, twin

from veilspark.operators import gazetteer as G, spans as S


def test_spans_equal_one_search_for_each_entity(spark):
    r = random.Random(8)
    rows = [("", [("a", "name", True)]), ("abc", [("", "name", True)]), ("aaa", [("aa", "name", True), ("a", "id", True), ("aa", "name", True)]), ("é\U0001f600aé", [("é", "name", True), ("\U0001f600", "id", False)]), ("x", [])]
    for _ in range(80):
        rows.append(("".join(r.choice("abé\U0001f600") for _ in range(r.randint(0, 40))), [("".join(r.choice("abé") for _ in range(r.randint(1, 3))), "name", r.random() < 0.8) for _ in range(r.randint(0, 12))]))
    df = docs(spark, rows).withColumn("new", G.all_spans(F.col("text"), F.col("entities"))).withColumn("old", S.all_spans(F.col("text"), F.col("entities")))
    for x in df.collect():
        assert [tuple(s) for s in x["new"]] == [tuple(s) for s in x["old"]] == twin(*rows[x.id])[0]
    none = docs(spark, rows[:1]).withColumn("text", F.lit(None).cast("string")).select(G.all_spans(F.col("text"), F.col("entities")).alias("s")).first()
    assert none.s is None


@pytest.mark.parametrize("small", [1 << 20, 40, 1])
def test_gazetteer(spark, small):
    r = random.Random(small)
    names = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 4))) for _ in range(60)})
    texts = [(i, "".join(r.choice("abcé \n") for _ in range(r.randint(0, 80)))) for i in range(40)] + [(40, None), (41, ""), (None, "abc"), (3, "ab ab"), (3, "ab ab")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    got = G.gazetteer(df, "id", spark.createDataFrame([(n,) for n in [*names, "", "a", None]], "name string"), small)
    expected, kept = [], {}
    for i, t in texts:
        for n in {*names, "a"}:
            at = (t or "").find(n)
            while at >= 0:
                expected.append((i, at, at + len(n), n))
                at = t.find(n, at + len(n))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    last = 0
    one = sorted([x for x in expected if x[0] == 0], key=lambda x: (x[1], -x[2]))
    for _, s, e, n in one:
        if s >= last:
            kept[s] = (e, n)
            last = e
    assert {x.start: (x.end, x.name) for x in G.resolved(got.where("id = 0"), "id").collect()} == kept
    assert G.gazetteer(df, "id", spark.createDataFrame([], "name string"), small).collect() == []


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_pieces_of_names_and_batches_of_places(spark, monkeypatch, held):
    """A list over many automata gives what one gives, and no automaton has more than its share."""
    names = [a + b for a in "abcé" for b in "abcdefé"] + ["aa", "a", "é"]
    df = spark.createDataFrame([(i, "abcdé aaé" * i) for i in range(30)], "id long, text string").repartition(2)
    one = sorted(map(tuple, G.gazetteer(df, "id", spark.createDataFrame([(n,) for n in names], "name string")).collect()))
    monkeypatch.setattr(G, "PIECE", 10)
    monkeypatch.setattr(G, "HELD", held)
    assert sorted(map(tuple, G.gazetteer(df, "id", spark.createDataFrame([(n,) for n in names], "name string")).collect())) == one and len(one) > 1000
    assert sorted(map(tuple, G.gazetteer(df, "id", spark.createDataFrame([(n,) for n in names], "name string"), 40).collect())) == one
    cut = G.pieces(G.pa.array(names), 10)
    assert len(cut) > 3 and [n for p in cut for n in p.to_pylist()] == names and max(sum(len(n.encode()) for n in p.to_pylist()) for p in cut) <= 13
    assert G.pieces(G.pa.array([], G.pa.string()), 10)[0].to_pylist() == []
    monkeypatch.setattr(G, "HITS", 7)
    part = G.pa.RecordBatch.from_pydict({"key": [1, 2], "text": ["aaaa" * 10, "a"]})
    assert [b.num_rows for b in G._rows(part, G.automaton([("a", "a")]))] == [7, 7, 7, 7, 7, 6]


def test_cost_follows_the_text():
    """A thousand names more cost a reading of the text no more."""
    import time

    text = "the quick brown fox jumps over the lazy dog " * 50_000
    took = []
    for n in (10, 10_000):
        found = G.automaton((f"name{i}", i) for i in range(n))
        start = time.perf_counter()
        assert list(G.occurrences(found, text)) == []
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 0.1


def brute(texts, names):
    out = []
    for i, t in enumerate(texts):
        for n in names:
            at = (t or "").find(n)
            while at >= 0:
                out.append((i, at, at + len(n), n))
                at = t.find(n, at + len(n))
    return sorted(out)


@pytest.mark.parametrize("seed,step,group", [(1, 7, 50), (2, 1 << 18, 1 << 20), (3, 64, 1), (4, 1, 1000)])
def test_index_equals_one_search_for_each_name(monkeypatch, seed, step, group):
    """Names of one to thirty characters, of several bytes each, that overlap themselves and begin alike; texts cut anywhere."""
    monkeypatch.setattr(G, "STEP", step)
    monkeypatch.setattr(G, "GROUP", group)
    monkeypatch.setattr(G, "HITS", 11)
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("aabé\U0001f600\0") for _ in range(n))
    names = sorted({word(r.randint(1, 30 if i % 5 == 0 else 9)) for i in range(300)} | {"a" * n for n in (1, 7, 8, 9, 16, 17)} | {"ab" * 20})
    texts = [word(r.randint(0, 60)) for _ in range(60)] + [None, "", "a" * 200, "ab" * 90, *names[:50]]
    found = G.Index(G.pa.array(names))
    part = G.pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    expected = brute(texts, names)
    got = [x for b in G._rows(part, found) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert found.exact and sorted(got) == expected
    assert sorted(x for b in G._rows(part.slice(40), found) for x in zip(*(c.to_pylist() for c in b.columns))) == [x for x in expected if x[0] >= 40]
    n, first, last = Counter((i, x) for i, _, _, x in expected), {}, {}
    for i, s, e, x in expected:
        first[i, x], last[i, x] = min(s, first.get((i, x), s)), max(e, last.get((i, x), e))
    counts = sorted((*k, c, first[k], last[k]) for k, c in n.items())
    for by in (found, G.automaton((x, x) for x in names)):
        assert sorted(x for b in G._counts(part, by) for x in zip(*(c.to_pylist() for c in b.columns))) == counts


def test_many_names_are_one_reading_of_the_texts(spark, monkeypatch):
    """Three megabytes of names are no more automata, or readings of the texts, than one name is; documents of one key are added up."""
    names = [f"name{i:06d}" for i in range(320_000)]
    assert len(G.pieces(G.pa.array(names), G.PIECE)) == 1
    texts = [(i % 50, f"name{i:06d}name{i + 1:06d} é name{i:06d}") for i in range(100)]
    df, listed = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(n,) for n in names], "name string")
    assert isinstance(G._one(G.pa.array(names[:1000])), G.Index)
    expected = sorted((texts[i][0], s, e, n) for i, s, e, n in brute([t for _, t in texts], names[:102]))
    assert sorted(map(tuple, G.gazetteer(df, "id", listed).collect())) == expected
    counts = {}
    for i, s, e, n in expected:
        c = counts.setdefault((i, n), [0, s, e])
        counts[i, n] = [c[0] + 1, min(c[1], s), max(c[2], e)]
    assert sorted(map(tuple, G.counted(df, "id", listed).collect())) == sorted((*k, *c) for k, c in counts.items())
    once = df.groupBy("id").agg(F.min("text").alias("text"))
    assert sorted(map(tuple, G.counted(once, "id", listed, True, 1 << 20).collect())) == sorted(map(tuple, G.counted(once, "id", listed).collect()))
    monkeypatch.setattr(G, "BASE", 1)  # sums of bytes: "ab" and "ba" are one
    assert not G.Index(G.pa.array(["ab", "ba"])).exact
    mixed = G._one(G.pa.array([f"{i:04d}" for i in range(2000)]))
    assert not isinstance(mixed, G.Index) and [n for _, _, n in G.occurrences(mixed, "0110 1010")] == ["0110", "1010"]
