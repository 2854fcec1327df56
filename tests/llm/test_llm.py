"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veilspark.llm import audio, htmlx, lm, packing, pii, quality, rules, simhash, spm, textbytes, urlfilter

TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "A b\tC  d\r\ne"), (6, "A b C d e"), (7, "mail a.b@c.org or +1 (555) 010-2234 at 10.0.0.1, card 4111 1111 1111 1111."), (8, "é ü 日本 \U0001f600 ▁ x"),
    (9, "word " * 3000), (10, "x" * 5000), (10, "x" * 5000), (None, "no id here at all"), (11, "the quick brown fox jumps over the lazy dog " * 20), (12, "the quick brown fox jumps over the lazy dog " * 19 + "the quick brown fox jumps over the lazy cat"),
]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], k, "clash") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_xxh64():
    r = np.random.default_rng(0)
    raw = bytes(r.integers(0, 255, 60_000).astype(np.uint8))
    s, n = r.integers(0, 50_000, 3000), r.integers(0, 90, 3000)
    n[0] = 3000
    assert [xxhash.xxh64_intdigest(raw[a : a + k], 42) for a, k in zip(s, n)] == textbytes.xxh64(raw, s, n).tolist()


# 1


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_pii_base_spans():
    r = random.Random(0)
    for alphabet in ("a.@-1 ", "ab@._c-+ ", "0123456789.- +()", "4 -1", "12345. @x+"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(t) == base(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert len(pii.base_spans("a" * 200_000 + "1" * 200_000)) == 0


def test_pii_query(docs, none):
    rows = pii.result(docs).collect()
    want = collections.Counter((i, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base(t or "")).encode()).hexdigest()) for i, t in TEXTS)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in rows) == want
    assert next(r for r in rows if r.doc_id == 7)[1:5] == (1, 1, 1, 1)
    assert pii.result(none).collect() == []


def test_pii_patterns_find_what_the_base_misses(spark):
    seen = [(i, f"Please call support hotline x number +1 (555) 010-22{i:02d} today") for i in range(8)]
    df = spark.createDataFrame([*seen, (100, "Please call support hotline x number 555-0199-777 today"), (101, "room 555-0199-777 is free")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.result(df).collect()}
    assert found[100] == "phone:37:49" and found[101] == ""
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[100] == "Please call support hotline x number [PHONE] today"


def test_pii_follows_patterns_over_rounds(spark):
    """Seeds make a pattern; its instance makes another; what that one finds is two steps from any seed."""
    near = [(i, f"aa bb +1 (555) 010-22{i:02d} cc") for i in range(40)]
    step = [(120 + i, f"aa bb 555-0{i}99-777 cc") for i in range(8)] + [(140 + i, f"dd ee 555-0{i}99-777 ff") for i in range(8)]
    far = [(60, "dd ee 555-1234-999 ff"), (61, "gg hh 555-1234-998 ii")]
    found = {r.doc_id: r.spans for r in pii.result(spark.createDataFrame([*near, *far, *step], "doc_id long, text string")).collect()}
    assert all(found[i] for i in range(120, 128)) and all(found[i] for i in range(140, 148)) and found[60] == "phone:6:18" and found[61] == ""


def brute_patterns(edges):
    seeds = {}
    for _, x, k, _ in edges:
        if k >= 0:
            seeds[x] = min(k, seeds.get(x, 9))
    score, kind, before = dict.fromkeys(seeds, 1.0), dict(seeds), -1
    while True:
        good = {}
        for p in {e[0] for e in edges}:
            of = [e[1] for e in edges if e[0] == p]
            known = sum(score.get(x, 0) for x in of)
            by = [sum(score[x] for x in of if kind.get(x) == i) for i in range(5)]
            if known >= 3 and known / (len(of) + 0.5) >= 0.75:
                good[p] = (known / (len(of) + 0.5), by)
        if len(good) == before:
            return good
        before, score, kind = len(good), dict.fromkeys(seeds, 1.0), dict(seeds)
        for x in {e[1] for e in edges} - set(seeds):
            mine = [(good[p], f) for p, y, k, f in edges if y == x and k < 0 and p in good]
            votes = [sum(c * by[i] / sum(by) for (c, by), f in mine if f >> i & 1) for i in range(5)]
            if mine and max(votes) > 0:
                score[x], kind[x] = 1 - math.prod(1 - c for (c, _), _ in mine), votes.index(max(votes))


def test_pii_graph_scores(spark):
    r = random.Random(3)
    for _ in range(3):
        kinds = {f"x{i}": r.choice([-1, -1, 0, 2, 3]) for i in range(30)}
        edges = sorted({(f"p{r.randrange(8)}", x, k, r.choice([4, 8, 12])) for x, k in kinds.items() for _ in range(4)})
        edges = list({(p, x): (p, x, k, f) for p, x, k, f in edges}.values())
        got = {x.pattern: (x.confidence, list(x.by)) for x in pii.learn(spark.createDataFrame(edges, "pattern string, surface string, kind int, fits int")).collect()}
        want = brute_patterns(edges)
        assert set(got) == set(want) and all(got[p][0] == pytest.approx(want[p][0]) and got[p][1] == pytest.approx(want[p][1]) for p in want)


def test_pii_long_runs_and_secrets(spark):
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    text = f'token = "{key}" ' + "x" * 400 + "@" + "y" * 400
    row = pii.result(spark.createDataFrame([(1, text), (2, "a1@" * 100_000)], "doc_id long, text string")).where("doc_id = 1").first()
    assert row.secret_spans == "secret:9:49" and row.spans == ""
    assert pii.mentions(text, [])[-1] == (-1, 51, len(text))
    assert pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text.startswith('token = "[SECRET]" x')


def test_pii_redacts_whole_rows(docs):
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[7].text == "mail [EMAIL] or [PHONE] at [IP], card [CARD]." and out[7].n_chars == len(out[7].text) and out[7].fp == "clash"
    assert out[1].text is None and out[2].text == ""


# 2


def fingerprint(t):
    w = WORD.findall((t or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in (zip(w, w[1:], w[2:], w[3:]) if len(w) >= 4 else [w])]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_simhash(docs, none):
    fps = [fingerprint(t) for _, t in TEXTS]
    of = groups(fps, 4)
    want = []
    for k, (i, _) in enumerate(TEXTS):
        ids = [TEXTS[j][0] for j in range(len(TEXTS)) if of[j] == of[k] and TEXTS[j][0] is not None]
        want.append((i, f"{fps[k]:016x}", min(ids, default=None)))
    assert collections.Counter(map(tuple, simhash.result(docs).collect())) == collections.Counter(want)
    assert simhash.result(none).collect() == []
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert len(kept) == len(set(of)) and kept.count(10) == 1 and None in kept
    assert simhash.deduplicated(docs).columns == docs.columns


def test_bk_trees_and_split_shards(spark):
    r = np.random.default_rng(0)
    centre = int(r.integers(0, 2**63))
    near = {centre ^ int(sum(1 << int(b) for b in set(r.integers(0, 64, 3)))) for _ in range(300)}
    values = np.array(sorted(near | {int(x) for x in r.integers(0, 2**63, 300)}), np.uint64)
    tree = np.repeat([3, 7], [200, len(values) - 200])  # two trees at once
    q, n = simhash.BKTrees(values, tree).within(values[180:230], tree[180:230], 4)
    want = {(i, j) for i in range(50) for j in range(len(values)) if tree[180 + i] == tree[j] and int(values[180 + i] ^ values[j]).bit_count() <= 4}
    assert set(zip(q.tolist(), n.tolist())) == want
    assert [simhash.agreeing(n, 4) for n in (0, 10**6, 10**8, 10**12)] == [1, 1, 2, 4]
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    got = {r.fp: r.root for r in simhash.components(simhash.links(df, 4, 32)).collect()}  # shards of over 32 are cut
    parts = collections.defaultdict(set)
    for v, g in zip(values.view(np.int64).tolist(), groups([int(x) for x in values], 4)):
        parts[g].add(v)
    assert {frozenset(p) for p in parts.values() if len(p) > 1} == {frozenset(k for k, v in got.items() if v == x) for x in set(got.values())}


# 3


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::7]
    made = urlfilter.cascade(spark.createDataFrame([(k,) for k in keys], "key string"), listed)
    assert len(made.levels) > 1
    assert [k for k in keys if k in made] == listed
    empty = urlfilter.cascade(spark.createDataFrame([(k,) for k in keys], "key string"), [])
    assert not any(k in empty for k in keys)


def test_urls(spark):
    urls = [None, "", "nothing", "http://A.COM", "http://a.com/", "x://www.example.com/en/1?q=/x", "http://example.com/en/", "http://b.example.com/en", "http://notexample.com/en/", "http://x.net/es/?", "http://x.net/fr", "http://u@h.net:80/fr/#a", "a://ads-track.example.org/x", "a://m.free-bets.example.net/y", "http://com/", "http://é.ÄÖ.org/é", "http://" + "a." * 3000 + "com/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host int")
    rows = urlfilter.judge(df).collect()
    for r in rows:
        u = (urls + urls[:3])[r.page_id]
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOW)
        fit = [x for x in urlfilter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.key), default=None)
        blocked = any(host == h or host.endswith("." + h) for h in urlfilter.BLOCKED_HOSTS)
        assert tuple(r) == (r.page_id, host, path, best.key if best else None, best.verdict if best else "block" if blocked else "allow")
    assert len(rows) == len(urls) + 3 and urlfilter.judge(df.limit(0)).collect() == []
    table = spark.createDataFrame([("COM.",), ("H.net",), (None,), ("",), ("h.net",)], "host string")
    assert urlfilter.listed_hosts(table) == ("com.", "h.net") and urlfilter.listed_hosts(table.limit(0)) == ()
    hosts = spark.createDataFrame([(0, "a://q.new.test/"), (1, "a://renew.test/"), (2, "a://new.test?x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(hosts, blocked=spark.createDataFrame([("new.test",)], "host string")).collect()} == {0: "block", 1: "allow", 2: "block"}


# 4


def test_tokenizer_ids():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    ref, mine = Tokenizer.from_file(path), packing.tokenizer(open(path, encoding="utf-8").read(), P.PATTERN)
    r = random.Random(0)
    pool = [*"ab Z'\n\t.,1é#  \x85\x1c", "'s", " ", " ", "<|endoftext|>"]
    for t in ["", " ", "it's we'll\n\n x", "日本 \U0001f600", *["".join(r.choice(pool) for _ in range(r.randint(1, 30))) for _ in range(1500)]]:
        assert np.frombuffer(mine.ids(t), np.uint16).tolist() == ref.encode(t, add_special_tokens=False).ids, t


def order(slots, weights):
    """The sequence of queues, from the place of each slot."""
    plans, seen = packing.planned(slots, [0] * len(slots), weights), {}
    for i, p in enumerate(plans):
        for j in range(slots[i]):
            t = max(k for k in range(len(p.begins)) if p.begins[k] <= j)
            seen[p.bases[t] + int(packing.climb(np.array([j - p.begins[t]]), [p.levels[t]], np.array([0]))[0])] = (i, j)
    assert sorted(seen) == list(range(sum(slots)))
    assert all([j for q, j in map(seen.get, range(len(seen))) if q == i] == list(range(slots[i])) for i in range(len(slots)))
    return [seen[k][0] for k in range(len(seen))]


def test_deficit_round_robin():
    r = random.Random(0)
    for _ in range(40):
        n = r.randint(1, 6)
        slots, weights = [r.randint(0, 40) for _ in range(n)], [r.randint(1, 50) for _ in range(n)]
        order(slots, None)
        got = order(slots, weights)
        live, left = [q for q in range(n) if slots[q]], slots[:]  # while none has run out, every prefix is within a slot and a half of the target
        sent = [0] * n
        for k, q in enumerate(got):
            if not all(left[x] for x in live):
                break
            sent[q] += 1
            left[q] -= 1
            assert all(abs(sent[x] - (k + 1) * weights[x] / sum(weights[y] for y in live)) < 1.5 for x in live)
    big = packing.planned([10**13, 10**13], [0, 0], [10**13, 3 * 10**13])
    x = packing.climb(np.array([10**13 - 1]), [big[1].levels[0]], np.array([0]))[0]
    assert x == pytest.approx(1.3333e13, rel=1e-3)


@pytest.mark.parametrize("weights", [[9, *[1] * 9], [50, 25, 15, 5, 5], [1] * 20, [1, 2, 4, 8, 16, 32, 64], [100, *range(1, 40)]])
def test_every_window_holds_the_mixture(weights):
    total, windows = sum(weights), 300
    tree = packing.Tree([8 * windows * w // total + 9 for w in weights], weights)
    sent = np.array([tree.sent(8 * k) for k in range(windows + 1)])
    target = np.array(weights) * 8 / total
    assert (np.abs(np.diff(sent, axis=0) - target) < 2).all() and (np.abs(sent - np.arange(windows + 1)[:, None] * target) < 1.5).all()
    heavy = target >= 2
    assert (np.abs(np.diff(sent, axis=0) - target)[:, heavy] <= 1).all()


def test_each_of_many_sources_has_a_queue(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i} " * (150 if i else 2000), f"s{i % 300}") for i in range(600)], "doc_id long, text string, source string")
    rows = packing.pack(df, {"s0": 1000, "s1": 2, "s2": 1}).collect()
    assert {(x.doc_id, x.queue) for x in rows} == {(i, f"s{i % 300}") for i in range(600)}
    first = collections.Counter()
    for x in rows:
        if x.sequence_id == 0:
            first[x.queue] += x.length
    assert first["s0"] >= 1024 and sum(first.values()) == 2048  # given weights hold
    monkeypatch.setattr(packing, "PLAN", 0)  # a plan that is too large to broadcast is joined
    assert collections.Counter(packing.pack(df, {"s0": 1000, "s1": 2, "s2": 1}).collect()) == collections.Counter(rows)


@pytest.mark.parametrize("c", [" ", "\n", "\t", "\u3000", "a", "1", "#", "é", " \n"])
def test_very_long_runs_are_tokens(c):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    ref, mine = Tokenizer.from_file(path), packing.tokenizer(open(path, encoding="utf-8").read(), P.PATTERN)
    for t in (c * 3000, f"x{c * 3000}y", f"{c * 2500}<|endoftext|>{c * 2500} z", f"a {c * 1000}'s {c * 1001}"):
        assert np.frombuffer(mine.ids(t), np.uint16).tolist() == ref.encode(t, add_special_tokens=False).ids
    assert len(mine.ids(c * (2_000_000 // len(c)))) > 0


def test_packing(docs, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).toPandas()
    full = collections.Counter()
    for i, t in TEXTS:
        full[i, tuple(ref.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    for (i, ids), copies in full.items():
        x = np.array(ids, "<u4")
        part = rows[(rows.doc_id == i) if i is not None else rows.doc_id.isna()]
        covered = collections.Counter()
        for p in part.itertuples():
            assert p.doc_tokens == len(x) and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32
            covered.update(range(p.start, p.start + p.length))
        assert set(covered) == set(range(len(x))) and set(covered.values()) == {copies}
    short = 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).tolist()
        assert g.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
        short += ends[-1] < 2048
    assert short <= 1 and packing.pack(none).collect() == []


# 5


def test_language_model(docs, none):
    rows = lm.score(docs).collect()
    tokens = lambda t: WORD.findall((t or "").translate(LOW)) + ["\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, t in TEXTS if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in TEXTS:
        w = tokens(t)
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    assert collections.Counter((*r[:5], round(r.base_score, 4)) for r in rows) == want
    assert all(r.score <= 0 for r in rows) and lm.score(none).collect() == []


def test_automaton_is_a_distribution(spark):
    r = random.Random(0)
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(r.choice(words[: r.randint(2, 30)]) for _ in range(60))) for i in range(60)], "doc_id long, text string")
    auto, _ = lm.train(df.select("text"), 3, 1e-3, 1e-3)
    assert len(auto.fail) > 10 and any(auto.fail)
    outside = 1 - sum(10**p for p in auto.p1)
    for s in range(len(auto.fail)):
        back, q = 0.0, s
        while q:
            back += auto.backoff[q]
            q = auto.fail[q]
        assert sum(10 ** auto.step(s, w)[0] for w in range(len(auto.words))) + 10**back * outside == pytest.approx(1, abs=1e-9)
    text = [r.randrange(len(auto.words)) for _ in range(50)]
    state, total = auto.end, 0.0
    for w in text:
        x, state = auto.step(state, w)
        total += x
    assert auto.walk(text) == pytest.approx(total)


def test_scores_are_those_of_all_ngrams_seen_twice(spark):
    """Two copies of a passage among 800,000 other tokens: its n-grams are arcs, whatever their share of the corpus."""
    r = random.Random(0)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    pair = [i for i in range(1000) if not held(i)][:2]
    rare = " ".join(f"rare{i}" for i in range(40))
    rows = [(i, " ".join(f"w{int(r.random() ** 3 * 3000)}" for _ in range(1000)) + (f" {rare}" if i in pair else "")) for i in range(1000)] + [(5000, rare), (5001, None), (5002, "w1 w2 never")]
    got = {x.doc_id: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    grams, after = collections.Counter(), collections.defaultdict(dict)
    of = lambda t: ["\n", *WORD.findall((t or "").translate(LOW)), "\n"]
    for i, t in rows:
        w = of(t)
        if not held(i):
            grams.update((x,) for x in w[1:])
            grams.update(zip(w, w[1:]))
            grams.update(zip(w, w[1:], w[2:]))
    for g, n in grams.items():
        if len(g) > 1 and n >= 2:
            after[g[:-1]][g[-1]] = n
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def p(ctx, w):
        if not ctx:
            return (grams[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        arcs, lower = after.get(ctx, {}), p(ctx[1:], w)
        of_ctx = grams[ctx]
        return (arcs[w] - 0.5 if w in arcs else 0) / max(of_ctx, 1) + (1 - sum(c - 0.5 for c in arcs.values()) / max(of_ctx, 1)) * lower

    for i in (1, 2, *pair, 5000, 5001, 5002):
        w = of(dict(rows)[i])
        want = sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w)))
        assert got[i].score == pytest.approx(want, abs=1e-6), i


# 6


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(0)
    y = (r.random(20_000) < 0.8).astype(int)
    truth = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    votes = np.where(r.random((len(y), 5)) < truth, y[:, None], 1 - y[:, None])
    votes[r.random(votes.shape) < 0.3] = quality.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts)
    assert abs(model.prior - 0.8) < 0.03 and np.abs(model.accuracies() - truth).max() < 0.03


def test_quality(spark, docs, none):
    rows = {r.doc_id: r for r in quality.score(docs).collect()}
    assert rows[1].votes == "2" * len(quality.LABELLERS) and 0 <= rows[9].score <= 1
    assert quality.score(none).collect() == [] and quality.keep(docs).columns == docs.columns
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = quality.score(big).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in found) / len(found) > 0.98
    assert all(r.kept for r in found if r.quality == 1)


# 7


def test_main_text(spark):
    r = random.Random(123)
    make, good, n = htmlx.Maker(r), 0, 60
    from veilspark.llm.htmltree import parse, text_of

    forest = htmlx.trained()
    for _ in range(n):
        page = make.page()
        t = parse(page)
        want = " ".join(w for w in text_of(t, [True] * len(t.tag)).split() if htmlx.MARK in w).replace(htmlx.MARK, "")
        good += htmlx.main_text([page.replace(htmlx.MARK, "")], forest)[0] == want
    assert good / n > 0.85
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {x.page_id: x for x in htmlx.extract(pages).collect()}
    import html

    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(/?)(p|h1|br)>", " ", body))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)
    import time

    start = time.time()
    parse("<div><p>a" * 30_000 + "<p><button>" + "<div>x" * 30_000)
    assert time.time() - start < 20  # in proportion to the page, however deep
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<div>" * 5000 + "x"), (4, "u", "<article><p>a<b>b</b>c &amp; d<p>e<script>'</p>'</script></article><!-- x"), (4, "u", "<<<>>&")], "page_id long, url string, html string")
    out = sorted(((x.page_id, x.text) for x in htmlx.extract(odd).collect()))
    assert out[:2] == [(1, ""), (2, "")] and len(out) == 5 and (4, "abc & d e") in out
    assert htmlx.extract(odd.limit(0)).collect() == []


# 8


def test_codec_tables():
    assert audio.MULAW[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.ALAW[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for b in block[4:]:
        for c in (b & 15, b >> 4):
            step = int(audio.STEPS[index])
            diff = (step >> 3) + (step >> 2 if c & 1 else 0) + (step >> 1 if c & 2 else 0) + (step if c & 4 else 0)
            value = max(-32768, min(32767, value - diff if c & 8 else value + diff))
            index = max(0, min(88, index + int(audio.INDEX_STEP[c & 7])))
            out.append(value)
    return out


def test_adpcm_and_wave():
    data = bytes(np.random.default_rng(0).integers(0, 256, 192 * 5).astype(np.uint8))
    assert audio.decode_adpcm(data).tolist() == [slow_adpcm(data[i : i + 192]) for i in range(0, len(data), 192)]
    for codec in (*audio.CODECS, "pcm"):
        name, rate, back, _ = audio.decode([audio.wave(codec, data)])[0]
        assert (name, rate, back) == (codec, 8000, data)
    assert audio.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    with pytest.raises(ValueError):
        audio.read_wave(b"RIFF")


def test_audio_query(docs, none):
    rows = audio.result(docs).collect()
    want = collections.Counter()
    for i, t in TEXTS:
        n, p = audio.payload_of(t)
        want[i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
        assert len(p) % 192 == 0 and p
    assert collections.Counter(tuple(r[:5]) for r in rows) == want and audio.result(none).collect() == []
    assert len({tuple(r) for r in rows if r.doc_id == 10}) == 1
    stored = {bytes(r.payload): r for r in audio.decoded(audio.encode(docs)).collect()}
    assert {r.doc_id: bytes(r.payload).rstrip() for r in stored.values()}[4] == b"one"
    features, codecs = {r.payload_sha256: r.feature for r in rows}, set()
    for p, r in stored.items():
        codec = audio.codec_of(p)
        x = [v for i in range(0, len(p), 192) for v in slow_adpcm(p[i : i + 192])] if codec == "adpcm" else [int((audio.MULAW if codec == "mulaw" else audio.ALAW)[b]) for b in p]
        twice = [v for a, b in zip(x, x[1:] + x[-1:]) for v in (a, (a + b) // 2)]
        pcm = np.array(twice, "<i2").tobytes()
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert bytes(r.pcm) == pcm and r.feature == features[hashlib.sha256(p).hexdigest()]
        assert r.feature == f"codec={codec};samples={len(x)};peak={max(map(abs, x))};energy={sum(v * v for v in x)};dc={sum(x)};crossings={crossings};rate=16000;pcm_bytes={len(pcm)};pcm_crc32={zlib.crc32(pcm)}"
        codecs.add(codec)
    assert len(codecs) > 1


# 9


def counts(t):
    w = WORD.findall(t or "")
    three = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_rules(spark, docs, none):
    r = random.Random(0)
    more = [(100 + i, "".join(r.choice(["a", "b", "c", " ", " ", "\n", "#", "\x0b", "é"]) for _ in range(r.randint(0, 400)))) for i in range(60)]
    df = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, "en") for i, t in more], "doc_id long, text string, lang string"))
    assert collections.Counter(tuple(x[:7]) for x in rules.result(df).collect()) == collections.Counter((i, *counts(t)) for i, t in [*TEXTS, *more])
    assert rules.result(none).collect() == [] and rules.keep(docs).columns == docs.columns
    clash = docs.withColumnRenamed("fp", "words").withColumn("row", docs.source).withColumn("rules", docs.lang)
    assert [x[:6] for x in rules.keep(clash).collect()] == [tuple(x) for x in rules.keep(docs).collect()]
    clash = docs.withColumnRenamed("fp", "_words")
    assert [tuple(x) for x in rules.keep(clash).collect()] == [tuple(x) for x in rules.keep(docs).collect()]


def brute_rules(text, lang):
    """Both distances, from Python's own regular expressions and logarithms."""
    import regex

    t, lang = text or "", (lang or "").lower()
    lower, upper, digit, space, punct, symbol = (len(regex.findall(x, t)) for x in (r"\p{Ll}", r"\p{Lu}", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()\[\]{}/\\_-]", "[#*$%&|<>=+@^~`]"))
    known = [lower, upper, digit, space, punct, symbol]
    p = [x / max(len(t), 1) for x in [*known, max(len(t) - sum(known), 0)]]
    a = rules.distance(p, list(rules.REFERENCE_CLASSES.get(lang, rules.REFERENCE_CLASSES[""]))) if len(t) >= 200 else None
    w, refs = WORD.findall(t), rules.REFERENCE_WORDS.get(lang)
    if len(w) < 200 or not refs:
        return a, None
    plain = collections.Counter(x.rstrip(".,;:!?").lower() for x in w)
    shares = [plain[x] / len(w) for x in refs]
    return a, rules.distance([*shares, max(1 - sum(shares), 0)], [*refs.values(), 1 - sum(refs.values())])


def test_rules_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["the", "The.", "of?!", "and,", "that!!;", "de", "la", "que", "sich", "W", "#x", "3.5", "é", "ÉÜ", "zz=", "a", "A."]
    rows = [(i, r.choice(["", " ", "\n"]) + "".join(r.choice(vocab) + r.choice([" ", "  ", "\n"]) for _ in range(r.choice([3, 60, 199, 200, 201, 400]))), r.choice(["en", "de", "FR", "es", "it", None])) for i in range(120)]
    got = {x.doc_id: x for x in rules.result(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, lang in rows:
        a, b = brute_rules(t, lang)
        x = got[i]
        assert x.class_distance == (None if a is None else pytest.approx(a, abs=1e-6)) and x.word_distance == (None if b is None else pytest.approx(b, abs=1e-6)), (t, lang)
        assert x.kept == (not x.base_failed and (a or 0) <= rules.MAX_CLASS_DISTANCE and (b or 0) <= (rules.max_word_distance(lang.lower()) if b is not None else 1))


def test_distances(spark):
    p, q = [0.5, 0.5, 0.0], [0.0, 0.5, 0.5]
    from pyspark.sql import functions as F

    got = spark.range(1).select(rules.js_distance([F.lit(x) for x in p], [F.lit(x) for x in q]), rules.js_distance([F.lit(x) for x in p], [F.lit(x) for x in p])).first()
    assert got[0] == pytest.approx(math.sqrt(0.5)) and got[1] == 0
    plan = rules.result(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    prose = " ".join("the" if i % 16 == 0 else "of" if i % 31 == 0 else f"{chr(97 + i % 26)}{chr(97 + i // 26)}word," for i in range(400))
    shout = spark.createDataFrame([(1, "THE WORDS! " * 3 + " ".join(f"WORD{i}" for i in range(300)), "en"), (2, prose, "en")], "doc_id long, text string, lang string")
    assert {x.doc_id: (x.base_failed, x.kept) for x in rules.result(shout).collect()} == {1: (False, False), 2: (False, True)}


# 10


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers as P

    return spm.Pieces(open(P.path("piece_bpe_32k.model"), "rb").read())


def ways(w, pc):
    codes = [spm.MARK if x == " " else spm.LITERAL if x == "▁" else ord(x) for x in w]
    out = []

    def go(i, ids, p):
        if i == len(codes):
            out.append((tuple(ids), p))
        for k in range(1, len(codes) - i + 1):
            f = pc.find(np.array([pc.hash(codes[i : i + k])], np.uint64))[0]
            if f >= 0:
                go(i + k, [*ids, int(pc.ids[f])], p * pc.weights[f])
            elif k == 1:
                go(i + 1, [*ids, *[int(pc.bytes[b]) for b in w[i].encode()]], p * spm.BYTE_WEIGHT)

    go(0, [], 1.0)
    total = sum(p for _, p in out)
    return {a: p / total for a, p in out}


def test_samples_follow_the_lattice(pieces):
    for w in (" hello", " thé", "ab", " ▁"):
        want, n = ways(w, pieces), 20_000
        ids, ends = spm.segment([w] * n, np.arange(n), pieces)
        got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:]))
        assert set(got) <= set(want) and sum(abs(got[k] / n - want[k]) for k in want) / 2 < 0.02


def test_long_runs_are_one_lattice(pieces):
    """Chances of each piece of a run of 60 letters, and of Chinese, equal forward times backward weights over the whole run."""
    for w in ("internationalizationofthedistributedcomputingenvironmentalist", "日本語の文章日本語中国人民大学生活水準高度経済成長時代"):
        codes = np.array([ord(c) for c in w], np.uint32)
        n, found = len(w), {}
        for i in range(n):
            for k in range(1, min(pieces.longest, n - i) + 1):
                f = pieces.find(np.array([pieces.hash(codes[i : i + k].tolist())], np.uint64))[0]
                if f >= 0 or k == 1:
                    found[i, i + k] = pieces.weights[f] if f >= 0 else spm.BYTE_WEIGHT
        ahead, behind = [1.0, *[0.0] * n], [*[0.0] * n, 1.0]
        for j in range(1, n + 1):
            ahead[j] = sum(ahead[i] * p for (i, e), p in found.items() if e == j)
        for i in range(n - 1, -1, -1):
            behind[i] = sum(behind[e] * p for (s, e), p in found.items() if s == i)
        want = {k: ahead[k[0]] * p * behind[k[1]] / ahead[n] for k, p in found.items()}
        draws = 4000
        side, blocks = collections.Counter(), collections.Counter()
        ids, ends = spm.segment([w] * draws, np.arange(draws), pieces)
        raw = {}
        for i, c in enumerate(w):
            raw.setdefault(len(w[:i].encode()), i)
        raw[len(w.encode())] = n
        for a, b in zip(ends[:-1], ends[1:]):
            at = 0
            for i in ids[a:b].tolist():
                to = at + len(pieces.text[i])
                if at in raw and to in raw:
                    side[raw[at], raw[to]] += 1
                at = to
        for k in range(draws):
            froms, _ = spm.sampled_in_blocks(codes, np.uint64(k * 7919 + 13), pieces, 16)  # blocks of 16 hand their weights on
            for a, b in zip(froms.tolist(), [n, *froms.tolist()]):
                blocks[a, b] += 1
        for k, v in want.items():
            assert abs(blocks[k] / draws - v) < 0.045
            assert abs(side[k] / draws - v) < 0.045 or len(w[k[0] : k[1]].encode()) > 1 and k[1] - k[0] == 1  # byte pieces
    spaces, _ = spm.segment([" " * 40], np.array([1]), pieces)
    assert len(spaces) < 40  # runs of spaces are pieces too


def test_segments_are_lossless_and_stable(pieces, docs, none):
    r = random.Random(0)
    texts = ["".join(r.choice([*"abc  \n\t▁é日\U0001f600", "the", " of"]) for _ in range(r.randint(0, 60))) for _ in range(500)] + ["", "a" * 500, " " * 70]
    ids, ends = spm.segment(texts, np.arange(len(texts)), pieces)
    assert [spm.text_of(ids[a:b].tolist(), pieces) for a, b in zip(ends[:-1], ends[1:])] == texts
    alone, _ = spm.segment(texts[7:8], np.array([7]), pieces)
    assert alone.tolist() == ids[ends[7] : ends[8]].tolist()
    rows = spm.result(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.lossless for r in rows) and spm.result(none).collect() == []
    back = {r.doc_id: r.text for r in spm.decode(spm.encode(docs)).collect()}
    assert back[8] == TEXTS[7][1] and back[1] == ""
    assert spm.result(docs, seed=1).where("doc_id = 11").first().ids_crc32 != spm.result(docs).where("doc_id = 11").first().ids_crc32


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in state.collect()}
        state = stage(spark, state, d)
        after = {r.doc_id: r for r in state.collect()}
        assert state.columns == docs.columns and set(after) <= set(before)
        if name == "quality_rules":
            assert not any(counts(before[i].text)[5] for i in after)
        if name == "near_dedup":
            ids = sorted(before)
            of = groups([fingerprint(before[i].text) for i in ids], 4)
            assert sorted(after) == sorted({ids[g] for g in of})
        if name == "pii":
            assert set(after) == set(before) and not any(base(after[i].text) for i in after)
    assert corpus_pipeline.run(spark, d).select("doc_id").distinct().count() == state.count()


def test_arrow_columns():
    raw, offs = textbytes.buffer(pa.array(["ab", None, "c"]).slice(1))
    assert raw == b"c" and offs.tolist() == [0, 0, 1]
