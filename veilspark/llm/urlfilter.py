"""URL filters on a Bloom filter cascade.

A rule is a host and the start of a path. All host suffixes and path starts of a URL that
could be a rule's key are looked up, the longest first, in a cascade of Bloom filters over
the corpus's complete key universe: level 0 encodes the listed keys, level 1 the universe's
other keys that level 0 lets through, level 2 the listed keys that level 1 lets through,
and so on until a level lets nothing through. Membership is then exact for every key of
the universe, and no join is needed. Level 0 is made so large that about as many foreign
keys pass as there are listed ones, so what the driver gathers follows the list, not the
corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import written

SPACE = 1 << 22  #: keys that a level may hold on the driver
FAR = 32  #: levels past this one are made larger


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Hosts that the method blocks where no rule fits: the sites of advertising and spam that the pages' tables name, under each ending.
BLOCKED_SITES = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{site}.example.{end}" for site in BLOCKED_SITES for end in ("com", "net", "org"))


class Bloom:
    def __init__(self, n: int, rate: float, level: int):
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2)) if n else 64
        self.hashes = max(1, round(-math.log2(rate)))
        self.level = level
        self.data = np.zeros(-(-self.bits // 8), np.uint8)

    def _at(self, key: str) -> list[int]:
        d = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.level)
        a, b = d >> 64, (d & (1 << 64) - 1) | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def add(self, key: str) -> None:
        for i in self._at(key):
            self.data[i >> 3] |= 1 << (i & 7)

    def __contains__(self, key: str) -> bool:
        return all(self.data[i >> 3] >> (i & 7) & 1 for i in self._at(key))


def _level(keys: Iterable[str], rate: float, level: int) -> Bloom:
    keys = list(keys)
    out = Bloom(len(keys), rate, level)
    for k in keys:
        out.add(k)
    return out


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def _passing(universe: DataFrame, listed: frozenset, cascade: Cascade) -> DataFrame:
    """Keys of the universe that are not listed and that all levels so far let through."""
    spark = universe.sparkSession
    held = spark.sparkContext.broadcast((listed, cascade.levels))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = held.value
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k in batch.column("key").to_pylist() if all(k in x for x in levels) and k not in keys], pa.string())})

    return universe.mapInArrow(scan, "key string")


def cascade(universe: DataFrame, keys: Iterable[str], rate: float = 0.5) -> Cascade:
    """A cascade that answers exactly for each key of `universe` (key string, distinct); `keys` is the list, which the driver holds anyway."""
    listed = frozenset(keys)
    if len(listed) > SPACE:
        raise ValueError(f"a list of over {SPACE} keys")
    n = universe.count()
    first = min(0.5, max(len(listed), 1) * math.sqrt(0.5) / max(n, 1))
    while True:
        out = Cascade([_level(listed, first, 0)])
        through = {r.key for r in _passing(universe, listed, out).limit(SPACE + 1).collect()}
        if len(through) <= SPACE:
            break
        first /= 16  # nothing is cut: level 0 is made anew, larger
    others, inside = set(listed), through
    while inside:
        level = _level(inside, rate if len(out.levels) < FAR else rate**4, len(out.levels))
        out.levels.append(level)
        others, inside = inside, {k for k in others if k in level}
    return out


def split(url: str | None) -> tuple[str, str]:
    """Host and path: from the first :// to the next of / ? #, A-Z lower-cased; then to the next of ? #."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    end = min(ends, default=len(rest))
    path = rest[end:]
    stop = min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def candidates(host: str, path: str, labels: tuple[int, ...], lengths: tuple[int, ...]) -> list[str]:
    """Keys that a rule which fits could have, given the rules' numbers of host labels and lengths of path; the longest first."""
    parts = host.split(".") if host else []
    hosts = {".".join(parts[-n:]) for n in labels if 0 < n <= len(parts)}
    return sorted((h + path[:n] for h in hosts for n in lengths if n <= len(path)), key=lambda k: (-len(k), k))


def listed_hosts(table: DataFrame) -> tuple[str, ...]:
    """The hosts of a table (host string) as a list for judge(): A-Z lower-cased, nulls and empty ones left out; over SPACE of them are an error."""
    host = F.translate(F.col("host").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host")
    rows = table.select(host).where("host <> ''").distinct().limit(SPACE + 1).collect()
    if len(rows) > SPACE:
        raise ValueError(f"a list of over {SPACE} keys")
    return tuple(sorted(r.host for r in rows))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] | DataFrame = BLOCKED_HOSTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    wins. Where none fits, the method's verdict is block for the hosts in `blocked`, a list
    or a table (host), and their subdomains, else allow. A null URL or one without :// has an empty host and path
    and no rule. Repeated rows are judged each, an empty table gives no rows, extra columns
    are left alone.
    """
    spark = pages.sparkSession
    blocked = listed_hosts(blocked) if isinstance(blocked, DataFrame) else blocked
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    labels = tuple(sorted({r.host.count(".") + 1 for r in rules} | {h.count(".") + 1 for h in blocked}))
    lengths = tuple(sorted({len(r.path) for r in rules} | {0}))
    if len({r.key for r in rules}) < len(rules):
        raise ValueError("two rules have the same key")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for u in batch.column("url").to_pylist() for k in candidates(*split(u), labels, lengths)}
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted(found), pa.string())})

    universe = written(urls.select("url").mapInArrow(keys, "key string").distinct(), "url-keys")
    made = [cascade(universe, [r.key for r in rules if r.verdict == v]) for v in ("allow", "block")]
    hosts = cascade(universe, blocked)
    held = spark.sparkContext.broadcast((made[0], made[1], hosts))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow, block, bad = held.value
        known: dict[str, int] = {}

        def kind(key: str) -> int:
            if key not in known:
                if len(known) > 100_000:
                    known.clear()
                known[key] = 1 if key in allow else 2 if key in block else 0
            return known[key]

        for batch in batches:
            out: list[tuple] = []
            for url in batch.column("url").to_pylist():
                host, path = split(url)
                rule = next((k for k in candidates(host, path, labels, lengths) if kind(k)), None)
                if rule is not None:
                    verdict = "allow" if kind(rule) == 1 else "block"
                else:
                    verdict = "block" if any(h in bad for h in candidates(host, "", labels, (0,))) else "allow"
                out.append((host, path, rule, verdict))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array(c, pa.string()) for c in cols]], ["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(verdicts, "page_id long, host string, path string, rule string, verdict string")


ORACLE = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u
), r AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, p, v)
), b AS (
  SELECT * FROM (VALUES {", ".join(f"('{h}')" for h in BLOCKED_HOSTS)}) t(h)
), f AS (
  SELECT s.page_id, s.host, s.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM s LEFT JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)
  GROUP BY s.page_id, s.host, s.path
)
SELECT page_id, host, path, rule,
  CASE WHEN v IS NOT NULL THEN v WHEN EXISTS (SELECT 1 FROM b WHERE f.host = b.h OR ends_with(f.host, '.' || b.h)) THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
