"""Quality rules in DataFrame functions alone.

Base counts, then the divergence rules: a document's histogram of character classes and its
histogram of common words are compared with its language's references by Jensen-Shannon
distance (the square root of the divergence in bits, 0 to 1), each only from a minimum
length on, below which a histogram says little.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Shares of lower case, upper case, digits, white space, punctuation, symbols and other
#: characters in running text: reference parameters, by language; "" is for any other.
CLASSES = ("lower", "upper", "digit", "space", "punct", "symbol", "other")
LOWER_OR_SPACE = r"[\p{Ll}\x20\x09-\x0D]+"
CLASS_PATTERN = {
    "upper": r"[^\p{Lu}]+",
    "digit": r"[^0-9]+",
    "punct": r"[^.,;:!?'\"()\[\]{}/\\_-]+",
    "symbol": r"[^#*$%&|<>=+@^~`]+",
}
REFERENCE_CLASSES = {
    "en": (0.775, 0.020, 0.005, 0.170, 0.025, 0.001, 0.004),
    "de": (0.770, 0.050, 0.005, 0.145, 0.025, 0.001, 0.004),
    "fr": (0.775, 0.020, 0.005, 0.165, 0.030, 0.001, 0.004),
    "es": (0.780, 0.020, 0.005, 0.165, 0.025, 0.001, 0.004),
    "": (0.770, 0.030, 0.005, 0.165, 0.025, 0.001, 0.004),
}
#: Common words and their shares of running text: reference parameters, by language.
REFERENCE_WORDS = {
    "en": {"the": 0.060, "of": 0.032, "and": 0.028, "to": 0.026, "in": 0.021, "a": 0.022, "is": 0.011, "that": 0.011, "for": 0.009, "it": 0.009},
    "de": {"der": 0.033, "die": 0.034, "und": 0.027, "in": 0.018, "den": 0.011, "von": 0.011, "zu": 0.011, "das": 0.010, "mit": 0.009, "sich": 0.008},
    "fr": {"de": 0.050, "la": 0.030, "le": 0.026, "et": 0.025, "les": 0.021, "des": 0.019, "en": 0.015, "un": 0.012, "du": 0.012, "une": 0.010},
    "es": {"de": 0.060, "la": 0.038, "que": 0.030, "el": 0.029, "en": 0.027, "y": 0.026, "a": 0.021, "los": 0.017, "se": 0.013, "del": 0.012},
}
MARKS = ".,;:!?"  #: stripped from the end of a word before it is looked up
MIN_CHARS, MAX_CLASS_DISTANCE = 200, 0.28
MIN_WORDS, MAX_WORD_SHARE = 200, 0.8  #: the share of the distance at which a text without any common word lies
GAP = r"\x20\x09-\x0D"
WORD = rf"[{GAP}]+"


def js_distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance of two histograms of shares, in [0, 1]."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    total = F.lit(0.0)
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total = total + part(a, m) + part(b, m)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def distance(p: list[float], q: list[float]) -> float:
    """The same of plain numbers."""
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2, 0.0))


def max_word_distance(lang: str) -> float:
    shares = list(REFERENCE_WORDS[lang].values())
    return MAX_WORD_SHARE * distance([*[0.0] * len(shares), 1.0], [*shares, 1 - sum(shares)])


def _by_language(lang: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def _measured(own: DataFrame) -> DataFrame:
    """own (row, text, lang) with the base counts and the histograms' numerators of its texts."""
    df = own.withColumn("words", F.array_remove(F.split("text", WORD), "")).withColumn("n_words", F.size("words").cast("long"))
    # lower case and white space are nearly all of a text; the other classes are counted in what is left
    df = df.withColumns({"chars": F.length("text").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"), "rest": F.regexp_replace("text", LOWER_OR_SPACE, "")})
    df = df.withColumns({c: F.length(F.regexp_replace("rest", pattern, "")).cast("long") for c, pattern in CLASS_PATTERN.items()})
    df = df.withColumns({"space": F.col("chars") - F.col("word_chars"), "n_symbols": F.length(F.regexp_replace("rest", r"[^#*$%&|<>]+", "")).cast("long")})
    df = df.withColumn("lower", F.col("chars") - F.col("space") - F.length("rest")).drop("rest")
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # A text whose windows have as many hashes has no window twice. In others a long of a hash's upper bits and the
    # window's place brings windows that may be equal together; these are sorted by their words, and equal neighbours count.
    df = df.withColumn("hashes", F.expr("CASE WHEN n_words < 4 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"))
    df = df.withColumn("repeats", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    df = df.withColumn("bits", F.expr("CASE WHEN repeats THEN CAST(ceil(log2(size(words))) AS INT) + 1 END"))
    df = df.withColumn("packed", F.expr("CASE WHEN repeats THEN sort_array(transform(hashes, (h, i) -> shiftleft(shiftright(h, bits), bits) | CAST(i AS BIGINT))) END"))
    df = df.withColumn("maybe", F.expr("CASE WHEN repeats THEN filter(packed, (x, k) -> coalesce(shiftright(x, bits) = shiftright(get(packed, k + 1), bits), false) OR coalesce(shiftright(x, bits) = shiftright(get(packed, k - 1), bits), false)) END"))
    df = df.withColumn("windows", F.expr("CASE WHEN repeats THEN sort_array(transform(transform(maybe, x -> CAST(x & (shiftleft(1L, bits) - 1) AS INT)), i -> struct(words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, i))) END"))
    same = lambda k: f"(coalesce(w.a = get(windows, {k}).a, false) AND w.b = get(windows, {k}).b AND w.c = get(windows, {k}).c)"
    df = df.withColumn("places", F.expr(f"CASE WHEN repeats THEN sort_array(transform(filter(windows, (w, k) -> {same('k - 1')} OR {same('k + 1')}), w -> w.i)) END"))
    df = df.withColumn("n_repeat_words", F.expr("CAST(CASE WHEN coalesce(size(places), 0) < 1 THEN 0 ELSE 3 + aggregate(slice(places, 2, size(places) - 1), struct(places[0] AS last, 0 AS n), (s, x) -> struct(x AS last, s.n + least(x - s.last, 3) AS n), s -> s.n) END AS BIGINT)"))
    found = "CASE lang " + " ".join(f"WHEN '{k}' THEN regexp_extract_all(text, r'(?i)(?:^|[{GAP}])({'|'.join(ws)})[{MARKS}]*(?=[{GAP}]|\\z)', 1)" for k, ws in REFERENCE_WORDS.items()) + " END"
    df = df.withColumn("common", F.expr(f"CASE WHEN n_words >= {MIN_WORDS} THEN concat(' ', lower(array_join({found}, '  ')), ' ') END"))
    return df.drop("words", "hashes", "bits", "packed", "maybe", "windows", "places", "repeats")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def judged(docs: DataFrame) -> DataFrame:
    """(row, rules) for every row of docs: its columns, and MEASURES.

    Null texts have no words. Words are separated by ASCII white space, so a text of other
    white space is one word. Documents under MIN_CHARS characters or MIN_WORDS words have no
    class or word distance (null), nor has a language without word references (null
    languages included), and the rule then lets them pass. base_failed: under 50 words, or
    over half the words in 3-word windows that repeat. Texts are read whole, whatever their
    length. Rows are judged each by itself: repeated rows get equal verdicts, an empty table
    gives no rows, columns of any name stay.
    """
    lang = F.coalesce(F.lower(F.col("lang").cast("string")), F.lit("")) if "lang" in docs.columns else F.lit("")
    df = _measured(docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang")))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    known = [F.col(c) for c in CLASSES[:-1]]
    total = F.greatest(F.col("chars"), F.lit(1))
    p = [c / total for c in known]
    p.append(F.greatest(F.col("chars") - sum(known[1:], known[0]), F.lit(0)) / total)
    q = [_by_language(F.col("lang"), {k: v[i] for k, v in REFERENCE_CLASSES.items() if k}, REFERENCE_CLASSES[""][i]) for i in range(len(CLASSES))]
    df = df.withColumn("class_distance", F.when(F.col("chars") >= MIN_CHARS, js_distance(p, q)))
    count = max(map(len, REFERENCE_WORDS.values()))
    spaced = {k: [f" {w} " for w in ws] for k, ws in REFERENCE_WORDS.items()}
    # a language's words stand in `common` between two spaces each; what goes with one of them says how often it is there
    for i in range(count):
        word = F.lit(None).cast("string")
        for k, ws in spaced.items():
            word = F.when(F.col("lang") == k, F.lit(ws[i])).otherwise(word)
        df = df.withColumn(f"share{i}", (F.length("common") - F.length(F.replace("common", word))) / F.length(word) / F.greatest(F.col("n_words"), F.lit(1)))
    shares = [F.col(f"share{i}") for i in range(count)]
    refs = [_by_language(F.col("lang"), {k: list(v.values())[i] for k, v in REFERENCE_WORDS.items()}, 0.0) for i in range(count)]
    shares.append(F.greatest(1 - sum(shares[1:], shares[0]), F.lit(0.0)))
    refs.append(1 - sum(refs[1:], refs[0]))
    df = df.withColumn("word_distance", F.when(F.col("common").isNotNull(), js_distance(shares, refs)))
    most = _by_language(F.col("lang"), {k: max_word_distance(k) for k in REFERENCE_WORDS}, 1.0)
    fine = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= most)
    return df.withColumn("kept", ~F.col("base_failed") & fine).select("row", F.struct(*MEASURES).alias("rules"))


def result(docs: DataFrame) -> DataFrame:
    """The query's columns, distances to six places."""
    rounded = lambda n: F.round(F.col(f"rules.{n}"), 6).alias(n) if n.endswith("distance") else F.col(f"rules.{n}")
    return judged(docs.select("doc_id", "text", "lang")).select("row.doc_id", *map(rounded, MEASURES))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns; what judged() says of odd rows holds."""
    # a filter on a row number stays above the measures; pushed below, it would compute them again for each use
    return judged(docs).withColumn("n", F.monotonically_increasing_id()).where("rules.kept AND n >= 0").select("row.*")


def _oracle() -> str:
    """SQL for DuckDB: base counts over exploded words, windows and lines, and both distances."""

    def js(p: list[str], q: list[str]) -> str:
        part = lambda x, a, b: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
        return "sqrt(greatest((" + " + ".join(f"{part(a, a, b)} + {part(b, a, b)}" for a, b in zip(p, q, strict=True)) + ") / 2, 0))"

    def of_lang(values: dict[str, float], other: float) -> str:
        return "CASE lang " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {other!r} END"

    quoted = lambda pattern: pattern.replace("'", "''")
    of_class = lambda pattern: f"length(regexp_replace(t, '{quoted(pattern)}', '', 'g'))"
    n = len(next(iter(REFERENCE_WORDS.values())))
    word_of = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(repr, ws))}]" for k, ws in REFERENCE_WORDS.items()) + " END"
    classes = [f"{c}" for c in CLASSES]
    p, q = [f"p_{c}" for c in classes], [f"q_{c}" for c in classes]
    sh, rf = [f"s_{i}" for i in range(n + 1)], [f"r_{i}" for i in range(n + 1)]
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, coalesce(lower(lang), '') AS lang FROM documents),
w AS (SELECT k, lang, w, i FROM (SELECT k, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT k, lang, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d))),
g AS (SELECT k, i, a, b, c FROM (SELECT k, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE c IS NOT NULL),
m AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g) WHERE n > 1),
r AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM m, (VALUES (0), (1), (2)) v(j) GROUP BY k),
l AS (SELECT k, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY k),
c AS (SELECT k, count(*) AS n_words, {", ".join(f"count(*) FILTER (list_position({word_of}, lower(rtrim(w, '{MARKS}'))) = {i + 1}) AS c_{i}" for i in range(n))} FROM w GROUP BY k),
x AS (
  SELECT d.k, doc_id, lang, t, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_dup_lines, 0) AS n_dup_lines, {", ".join(f"coalesce(c_{i}, 0) AS c_{i}" for i in range(n))},
    length(t) AS chars, {of_class(r"[^\x20\x09-\x0D]+")} AS space, {of_class("[^#*$%&|<>]+")} AS n_symbols, {of_class(r"[^\p{Ll}]+")} AS lower, {", ".join(f"{of_class(v)} AS {k}" for k, v in CLASS_PATTERN.items())}
  FROM d LEFT JOIN c USING (k) LEFT JOIN r USING (k) LEFT JOIN l USING (k)
),
h AS (SELECT *, {", ".join(f"{c}::DOUBLE / greatest(chars, 1) AS p_{c}" for c in classes[:-1])}, greatest(chars - ({" + ".join(classes[:-1])}), 0)::DOUBLE / greatest(chars, 1) AS p_other,
    {", ".join(f"{of_lang({k: v[i] for k, v in REFERENCE_CLASSES.items() if k}, REFERENCE_CLASSES[''][i])}::DOUBLE AS q_{c}" for i, c in enumerate(classes))},
    {", ".join(f"c_{i}::DOUBLE / greatest(n_words, 1) AS s_{i}" for i in range(n))}, {", ".join(f"{of_lang({k: list(v.values())[i] for k, v in REFERENCE_WORDS.items()}, 0.0)}::DOUBLE AS r_{i}" for i in range(n))} FROM x),
y AS (SELECT *, greatest(1 - ({" + ".join(sh[:-1])}), 0) AS s_{n}, 1 - ({" + ".join(rf[:-1])}) AS r_{n}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h),
z AS (SELECT *, CASE WHEN chars >= {MIN_CHARS} THEN {js(p, q)} END AS cd, CASE WHEN n_words >= {MIN_WORDS} AND lang IN ({", ".join(map(repr, REFERENCE_WORDS))}) THEN {js(sh, rf)} END AS wd FROM y)
SELECT doc_id, n_words, chars - space AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(wd, 0) <= {of_lang({k: max_word_distance(k) for k in REFERENCE_WORDS}, 1.0)} AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM z
"""


ORACLE = _oracle()
