"""The catalogue's queries once more, as SQL for DuckDB."""

from __future__ import annotations

from ..functions.category import CONTAINS, EQUALS, TURKISH
from ..functions.dates import MONTHS, RULES
from ..functions.text import BY_SIZE, QUANTISATIONS
from ..operators.birth import AFTER, BEFORE, SCANS, SUBCATEGORIES
from ..operators.render import BLOCKED, HIGHLIGHT
from ..functions.category import COLOURS
from .fixtures import EDITS, FENCE, NOTED_SQL, NOTES_SQL, ROWS

NOTES = f"WITH {NOTES_SQL} "
NOTED = f"WITH {NOTED_SQL} "
BLOCKS = "repeat('█', greatest(strlen(original), 3))"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(f"({q(x)})" for x in items)


def category(low: str) -> str:
    whens = []
    for cat, cues in CONTAINS.items():
        tests = [f"contains({low}, {q(c)})" for c in cues] + [f"{low} = {q(c)}" for c in EQUALS.get(cat, ())]
        whens.append(f"WHEN {' OR '.join(tests)} THEN {q(cat)}")
    return f"CASE {' '.join(whens)} ELSE 'name' END"


def categories() -> str:
    names = ", ".join(map(q, CONTAINS))
    return f"SELECT p_partkey, raw, {category('low')} AS category, CASE WHEN low IN ({names}) THEN low ELSE {category('low')} END AS strict FROM (SELECT p_partkey, raw, trim(lower(raw)) AS low FROM ({ROWS['labels'][1]}))"


def _ymd(y: str, m: str, d: str) -> str:
    return f"TRY_CAST(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0') AS DATE)"


def parse_date(x: str) -> str:
    t = f"trim({x})"
    months = "CASE lower({}) " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in MONTHS.items()) + " END"
    out = []
    for pattern, kind, y, m, d in RULES:
        part = lambda i, p=pattern: f"regexp_extract({t}, {q(p)}, {i})"
        year = f"TRY_CAST({part(y)} AS INTEGER)"
        if kind == "short":
            year = f"(CASE WHEN {year} < 50 THEN {year} + 2000 WHEN {year} < 100 THEN {year} + 1900 ELSE {year} END)"
        month = "1" if m is None else months.format(part(m)) if kind == "named" else f"TRY_CAST({part(m)} AS INTEGER)"
        day = "1" if d is None else f"TRY_CAST({part(d)} AS INTEGER)"
        made = _ymd(year, month, day)
        out.append(f"CASE WHEN {year} BETWEEN 1900 AND 2100 THEN {made} END" if kind == "year" else made)
    return f"coalesce({', '.join(out)})"


def date_cases() -> str:
    return f"SELECT o_orderkey, input, {parse_date('input')} AS parsed FROM ({ROWS['dates'][1]})"


def _months(b: str, e: str) -> str:
    return f"(month({e}) - month({b}) - CASE WHEN day({e}) < day({b}) THEN 1 ELSE 0 END)"


def years(b: str, e: str) -> str:
    return f"CAST(greatest(year({e}) - year({b}) - CASE WHEN {_months(b, e)} < 0 THEN 1 ELSE 0 END, 0) AS INTEGER)"


def months(b: str, e: str) -> str:
    m = _months(b, e)
    return f"CAST(greatest(CASE WHEN {m} < 0 THEN {m} + 12 ELSE {m} END, 0) AS INTEGER)"


def phrase(y: str, m: str, lang: str) -> str:
    return f"CASE WHEN {lang} = 'tr' THEN CASE WHEN {y} = 0 AND {m} = 0 THEN 'doğduğu gün' WHEN {m} = 0 THEN {y} || ' yaşında' ELSE {y} || ' yıl ' || {m} || ' ay' END ELSE CASE WHEN {y} = 0 AND {m} = 0 THEN 'at birth' WHEN {m} = 0 THEN 'age ' || {y} ELSE 'age ' || {y} || ' yr ' || {m} || ' mo' END END"


def _scan() -> str:
    out = []
    for p in SCANS:
        d = parse_date(f"regexp_extract(text, {q('(?i)' + p)}, 1)")
        out.append(f"(SELECT CASE WHEN x BETWEEN DATE '1903-01-02' AND DATE '2024-01-01' THEN x END FROM (SELECT {d} AS x))")
    return f"coalesce({', '.join(out)})"


_AT = "strpos(lower(text), lower(original))"
_CUES = " OR ".join([f"contains(substr(lower(text), greatest({_AT} - 120, 1), least({_AT} - 1, 120)), {q(c)})" for c in BEFORE] + [f"contains(substr(lower(text), {_AT} + length(original), 40), {q(c)})" for c in AFTER])
BIRTH_BODY = f"""{NOTED_SQL},
scans AS (SELECT note_id, {_scan()} AS scan FROM notes),
dates AS (SELECT n.*, {parse_date('original')} AS d FROM numbered n),
s0 AS (SELECT n.note_id, d AS birth, ord FROM notes n LEFT JOIN (SELECT note_id, arg_min(d, ord) AS d, min(ord) AS ord FROM dates JOIN scans USING (note_id) WHERE category = 'date' AND d = scan GROUP BY note_id) USING (note_id)),
s1 AS (SELECT n.note_id, d AS birth, ord FROM notes n LEFT JOIN (SELECT note_id, arg_min(d, ord) AS d, min(ord) AS ord FROM dates WHERE d IS NOT NULL AND lower(subcategory) IN ({', '.join(map(q, SUBCATEGORIES))}) GROUP BY note_id) USING (note_id)),
s2 AS (SELECT n.note_id, d AS birth, ord FROM notes n LEFT JOIN (SELECT note_id, arg_min(d, ord) AS d, min(ord) AS ord FROM dates WHERE category = 'date' AND d IS NOT NULL AND {_AT} > 0 AND ({_CUES}) GROUP BY note_id) USING (note_id)),
s3 AS (SELECT n.note_id, d AS birth, ord FROM notes n LEFT JOIN (SELECT note_id, min(d) AS d, arg_min(ord, d::VARCHAR || lpad(ord::VARCHAR, 4, '0')) AS ord FROM dates WHERE category = 'date' AND d IS NOT NULL GROUP BY note_id HAVING count(*) >= 2) USING (note_id)),
cascade AS (SELECT note_id, coalesce(s0.birth, s1.birth, s2.birth, s3.birth) AS birth, coalesce(s0.ord, s1.ord, s2.ord, s3.ord) AS ord FROM s0 JOIN s1 USING (note_id) JOIN s2 USING (note_id) JOIN s3 USING (note_id)),
aged AS (SELECT d.note_id, d.text, d.variant, d.ord, d.original, d.category, strftime(c.birth, '%d.%m.%Y') AS detected_birth_date,
  CASE WHEN c.birth IS NOT NULL AND d.category = 'date' AND d.d IS NOT NULL AND d.ord <> c.ord THEN {phrase(years('c.birth', 'd.d'), months('c.birth', 'd.d'), 'd.lang')} ELSE d.placeholder END AS placeholder
  FROM dates d JOIN cascade c USING (note_id))"""
BIRTH = f"WITH {BIRTH_BODY} "


def override(day: str) -> str:
    b = f"DATE '{day}'"
    return BIRTH + f"""SELECT note_id, ord, strftime({b}, '%d.%m.%Y') AS detected_birth_date,
      CASE WHEN category = 'date' AND d IS NOT NULL AND ord <> coalesce((SELECT min(x.ord) FROM dates x WHERE x.note_id = dates.note_id AND x.category = 'date' AND x.d = {b}), -1)
        THEN {phrase(years(b, 'd'), months(b, 'd'), 'lang')} ELSE placeholder END AS placeholder FROM dates"""


def summary(lang: str) -> str:
    name = "category" if lang == "en" else "CASE category " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TURKISH.items()) + " ELSE 'diğer' END"
    head = " PII entities found: " if lang == "en" else " KV tespit edildi: "
    return NOTED + f"SELECT note_id, sum(n) || {q(head)} || string_agg(n || ' ' || {name}, ', ' ORDER BY o) AS summary FROM (SELECT note_id, category, count(*) AS n, min(ord) AS o FROM merged GROUP BY ALL) GROUP BY note_id"


def _spans(base: str) -> str:
    return f"""parts AS (SELECT note_id, ord, original, unnest(string_split(text, original)) AS p, unnest(generate_series(1, len(string_split(text, original)))) AS k FROM {base}),
spans AS (SELECT note_id, ord, CAST(s AS INTEGER) AS "start", CAST(s + length(original) AS INTEGER) AS "end" FROM (
  SELECT note_id, ord, original, k, sum(length(p)) OVER (PARTITION BY note_id, ord ORDER BY k) + (k - 1) * length(original) AS s, count(*) OVER (PARTITION BY note_id, ord) AS n FROM parts) WHERE k < n),
kept AS (SELECT note_id, list_reduce(list({{'last': "end", 'kept': [{{'s': "start", 'e': "end", 'o': ord}}]}} ORDER BY "start", "end" DESC, ord), lambda a, x: CASE WHEN x.kept[1].s >= a.last THEN {{'last': x.last, 'kept': list_concat(a.kept, x.kept)}} ELSE a END).kept AS kept FROM spans GROUP BY note_id)"""


SPANS = f"WITH {NOTED_SQL}, {_spans('numbered')} "


def gazetteer(resolved: bool) -> str:
    docs, key = ("benchmark", "item_id") if resolved else ("documents", "doc_id")
    head = f"""WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) AS name FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)),
    hits AS (SELECT {key}, text, name FROM {docs} JOIN names ON contains(text, name)),
    parts AS (SELECT {key}, name, unnest(string_split(text, name)) AS p, unnest(generate_series(1, len(string_split(text, name)))) AS k, len(string_split(text, name)) AS parts FROM hits),
    places AS (SELECT {key}, name, CAST(s AS INTEGER) AS "start", CAST(s + length(name) AS INTEGER) AS "end" FROM (SELECT {key}, name, k, parts, sum(length(p)) OVER (PARTITION BY {key}, name ORDER BY k) + (k - 1) * length(name) AS s FROM parts) WHERE k < parts)"""
    if not resolved:
        return head + ' SELECT doc_id, name, count(*) AS n, min("start") AS first, max("end") AS last FROM places GROUP BY ALL'
    return head + """, kept AS (SELECT item_id, list_reduce(list({'last': "end", 'kept': [{'s': "start", 'e': "end", 'name': name}]} ORDER BY "start", "end" DESC, name), lambda a, x: CASE WHEN x.kept[1].s >= a.last THEN {'last': x.last, 'kept': list_concat(a.kept, x.kept)} ELSE a END).kept AS kept FROM places GROUP BY item_id)
    SELECT item_id, k.s AS "start", k.e AS "end", k.name AS name FROM (SELECT item_id, unnest(kept) AS k FROM kept)"""


def _folded(body: str, base: str, inner: str, outside) -> str:
    return f"""WITH {body}, {_spans(base)},
flat AS (SELECT note_id, unnest(kept) AS k FROM kept),
marks AS (SELECT f.note_id, n.text, list({{'s': k.s, 'at': k.e, 'html': {inner}}} ORDER BY k.s) AS m FROM flat f JOIN {base} n ON n.note_id = f.note_id AND n.ord = k.o GROUP BY f.note_id, n.text),
done AS (SELECT note_id, text, list_reduce(m, lambda a, x: {{'s': x.s, 'at': x.at, 'html': a.html || {outside('substr(text, a.at + 1, x.s - a.at)')} || x.html}}, {{'s': 0, 'at': 0, 'html': ''}}) AS r FROM marks)
SELECT note_id, r.html || {outside('substr(text, r.at + 1)')} AS """


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def html(highlight: bool) -> str:
    if highlight:
        c = "CASE n.category " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in COLOURS.items()) + " ELSE '#808080' END"
        style = " || ".join(q(p) + (f" || ({c})" if i < 3 else "") for i, p in enumerate(HIGHLIGHT.split("{c}")))
        inner = f"'<span class=\"pii highlight ' || n.category || '\" style=\"' || {style} || '\" title=\"' || upper(n.category) || ': ' || n.placeholder || '\">' || {_esc('substr(n.text, k.s + 1, k.e - k.s)')} || '</span>'"
        body, base = NOTED_SQL, "numbered"
    else:
        age = HIGHLIGHT.replace("{c}", COLOURS["age"])
        inner = f"CASE WHEN n.placeholder NOT LIKE '[%' THEN '<span class=\"pii highlight age\" style=\"{age}\">' || {_esc('n.placeholder')} || '</span>' ELSE '<span class=\"pii redacted\" style=\"{BLOCKED}\">' || {BLOCKS.replace('original', 'n.original')} || '</span>' END"
        body, base = BIRTH_BODY, "aged"
    return _folded(body, base, inner, lambda x: f"replace({_esc(x)}, chr(10), '<br>')") + "html FROM done"


def span_tags() -> str:
    return _folded(NOTED_SQL, "numbered", "n.placeholder", lambda x: x) + "redacted FROM done"


def redact(by: str, base: str = "numbered") -> str:
    return f"""WITH {BIRTH_BODY if base == 'aged' else NOTED_SQL},
todo AS (SELECT note_id, text, list({{'o': original, 'by': {by}, 't': ''}} ORDER BY strlen(original) DESC, ord) AS l FROM {base} GROUP BY note_id, text)
SELECT note_id, list_reduce(l, lambda a, x: {{'o': x.o, 'by': x.by, 't': replace(a.t, x.o, x.by)}}, {{'o': '', 'by': '', 't': text}}).t AS redacted FROM todo"""


def _document(lines: str) -> str:
    """document.xml of a list of lines: those of white space alone are empty paragraphs."""
    from ..sources.writers import DECLARATION, W

    run = '<w:p><w:r><w:rPr><w:rFonts w:ascii="Courier New" w:hAnsi="Courier New" w:cs="Courier New"/><w:sz w:val="20"/></w:rPr><w:t xml:space="preserve">'
    end = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr></w:body></w:document>'
    esc = f"replace({_esc('x')}, '''', '&apos;')"
    blank = r"regexp_matches(x, '^[\s\x0B\x85\p{Z}]*$')"
    return f"{q(DECLARATION)} || '<w:document xmlns:w=\"{W}\"><w:body>' || array_to_string(list_transform({lines}, lambda x: CASE WHEN {blank} THEN '<w:p/>' ELSE {q(run)} || {esc} || '</w:t></w:r></w:p>' END), '') || {q(end)}"


def docx() -> str:
    return f"SELECT note_id, {_document('string_split(redacted, chr(10))')} AS xml FROM ({redact('placeholder')})"


def docx_documents() -> str:
    parts = "string_split(text || chr(13) || chr(10) || ' ' || chr(9) || chr(10) || chr(10) || text, chr(10))"
    ended = f"list_transform({parts}, lambda x: CASE WHEN right(x, 1) = chr(13) THEN left(x, length(x) - 1) ELSE x END)"
    return f"SELECT doc_id, sha256({_document(ended)}) AS sha256 FROM documents"


def pdf() -> str:
    return f"SELECT note_id, CAST(ord AS INTEGER) AS ord, CAST(ord // 54 AS INTEGER) AS page, CAST(2720 - (ord % 54) * 45 AS INTEGER) AS y, line FROM (SELECT note_id, unnest(string_split(redacted, chr(10))) AS line, unnest(generate_series(0, len(string_split(redacted, chr(10))) - 1)) AS ord FROM ({redact('placeholder')}))"


def _pdf_bytes() -> str:
    """A file of one page, as every note's is: the objects one after the other, and where each begins."""
    from ..sources.writers import TURKISH

    esc = "replace(replace(replace(line, '\\', '\\\\'), '(', '\\('), ')', '\\)')"
    shown = f"string_agg('BT /F1 10 Tf 70.87 ' || printf('%.2f', (272.0 - ord * 4.5) * (72 / 25.4)) || ' Td (' || {esc} || ') Tj ET', chr(10) ORDER BY ord)"
    objects = [
        "'<</Type/Catalog/Pages 2 0 R>>'", "'<</Type/Pages/Count 1/Kids[4 0 R]>>'", q(f"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding<</Type/Encoding/BaseEncoding/WinAnsiEncoding/Differences[{TURKISH}]>>>>"),
        "'<</Type/Page/Parent 2 0 R/MediaBox[0 0 595.28 841.89]/Resources<</Font<</F1 3 0 R>>>>/Contents 5 0 R>>'", "'<</Length ' || length(body) || '>>' || chr(10) || 'stream' || chr(10) || body || chr(10) || 'endstream'",
    ]
    made = ", ".join(f"'{i} 0 obj' || chr(10) || {o} || chr(10) || 'endobj' || chr(10)" for i, o in enumerate(objects, 1))
    starts = " || ".join(f"printf('%010d 00000 n ', CAST(9 + {' + '.join(['0', *[f'length(o[{j}])' for j in range(1, i)]])} AS INTEGER)) || chr(10)" for i in range(1, 6))
    return f"""SELECT note_id, '%PDF-1.4' || chr(10) || all_o || 'xref' || chr(10) || '0 6' || chr(10) || '0000000000 65535 f ' || chr(10) || {starts} || 'trailer<</Size 6/Root 1 0 R>>' || chr(10) || 'startxref' || chr(10) || (9 + length(all_o)) || chr(10) || '%%EOF' || chr(10) AS file
      FROM (SELECT *, array_to_string(o, '') AS all_o FROM (SELECT note_id, [{made}] AS o FROM (SELECT note_id, {shown} AS body FROM ({pdf()}) GROUP BY note_id)))"""


def _sink() -> str:
    plain = redact(BLOCKS)
    md = f"SELECT note_id, '# Redacted Document' || chr(10) || chr(10) || redacted || chr(10) || chr(10) || '---' || chr(10) || '*De-identified by veilspark*' || chr(10) AS file FROM ({plain})"
    parts = {"txt": f"SELECT note_id, redacted AS file FROM ({plain})", "md": md, "pdf": _pdf_bytes(), "docx": f"SELECT note_id, xml AS file FROM ({docx()})"}
    return " UNION ALL ".join(f"SELECT note_id, '{f}' AS format, CAST(strlen(file) AS INTEGER) AS n_bytes, sha256(file) AS sha256 FROM ({x})" for f, x in parts.items())


STRIP = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^<>]*<', '<', 'g'), '<[^>]*(>|$)', '', 'g'), '>', ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''),
  '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM pages
"""


def reply_texts(kind: str) -> str:
    f = FENCE
    trimmed = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    out = "regexp_replace(regexp_replace(raw, '<think>.*?</think>', '', 'gs'), '<think>.*$', '', 's')" if kind == "think" else trimmed(f"regexp_replace(regexp_replace(regexp_replace({trimmed('raw')}, '^({f}json)+', ''), '^({f})+', ''), '({f})+$', '')")
    return f"SELECT conv_id, turn, sha256({out}) AS sha256, CAST(length({out}) AS INTEGER) AS n FROM ({ROWS['raws'][1]})"


EXPORT_NAME = f"""SELECT c_custkey, path, left(path, length(path) - length(base)) || CASE WHEN contains(base, '.') THEN left(base, length(base) - strpos(reverse(base), '.')) ELSE base END || '_redacted.docx' AS name
FROM (SELECT c_custkey, path, list_last(string_split(path, '/')) AS base FROM ({ROWS['paths'][1]}))"""
MODEL_CATALOG = f"SELECT id, name, filename, size_gb, EXISTS (SELECT 1 FROM ({ROWS['fetched'][1]}) f WHERE length > 1000000 AND list_last(string_split(path, '/')) = filename) AS downloaded, id = 'm7' AS active FROM ({ROWS['offered'][1]})"


def truncate(limit: int, text: str) -> str:
    """Whole lines of fewer than `limit` bytes in all, or of a longer first line what fits."""
    return f"""
WITH d AS (SELECT doc_id, {text} AS text FROM documents),
c AS (SELECT doc_id, text, list_reduce(list_transform(string_split(text, chr(10)), lambda x: {{'n': CAST(strlen(x) AS BIGINT), 'c': CAST(length(x) AS BIGINT)}}),
    lambda a, x: CASE WHEN a.n + 1 + x.n < {limit} AND a.c >= 0 THEN {{'n': a.n + 1 + x.n, 'c': a.c + 1 + x.c}} ELSE {{'n': CAST(1000000000 AS BIGINT) , 'c': a.c}} END) AS r,
    strlen(string_split(text, chr(10))[1]) AS head FROM d),
b AS (SELECT doc_id, list_max(list_filter(range(1, length(text) + 1), lambda i: strlen(left(text, i)) <= {limit})) AS cut FROM d WHERE strlen(text) > {limit} AND strlen(string_split(text, chr(10))[1]) >= {limit}),
n AS (SELECT doc_id, text, CAST(CASE WHEN strlen(text) <= {limit} THEN length(text) WHEN head < {limit} THEN r.c ELSE cut END AS INTEGER) AS n FROM c LEFT JOIN b USING (doc_id))
SELECT doc_id, n, sha256(left(text, n)) AS sha256 FROM n
"""


TRUNCATE = f"SELECT doc_id, n FROM ({truncate(2000, 'text')})"


def inventory() -> str:
    whens = " ".join(f"WHEN contains(upper(name), '{x}') THEN '{x}'" for x in QUANTISATIONS) + " " + " ".join(f"WHEN size_gb < {s} THEN '{x}'" for s, x in BY_SIZE)
    return f"SELECT name, path, size_gb, CASE {whens} ELSE 'Q8_0' END AS quantisation FROM (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS name, CAST(round(length / 1073741824.0, 2) AS DOUBLE) AS size_gb FROM ({ROWS['files'][1]})) WHERE lower(path) LIKE '%.gguf'"


PROGRESS = """
WITH c AS (SELECT user_id AS download_id, event_id AS seq, ts, CAST(trunc(value * 1000) AS BIGINT) AS bytes FROM events),
t AS (SELECT download_id, CAST(sum(bytes) AS BIGINT) AS total FROM c GROUP BY download_id)
SELECT download_id, seq, downloaded, total, round(CASE WHEN total > 0 THEN least(downloaded / total * 100, 100.0) ELSE 0.0 END, 6) AS percent
FROM (SELECT download_id, seq, CAST(sum(bytes) OVER (PARTITION BY download_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS downloaded FROM c) JOIN t USING (download_id)
"""


SINK = _sink()

#: Rates and times left as they are shown, and the records let through, one after the other.
def _rates(download: str = "user_id", slower: int = 1) -> str:
    return f"""
WITH RECURSIVE c AS (SELECT {download} AS download_id, event_id AS seq, epoch_us(ts) // {slower} AS us, epoch_us(ts) // {slower} // 1000 AS ms, CAST(trunc(value * 1000) AS BIGINT) AS bytes FROM events),
r AS (SELECT download_id, seq, us, ms, CAST(sum(bytes) OVER w AS BIGINT) AS downloaded, CAST(sum(bytes) OVER (PARTITION BY download_id) AS BIGINT) AS total, (us - min(us) OVER (PARTITION BY download_id)) / 1e6 AS secs FROM c WINDOW w AS (PARTITION BY download_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
p AS (SELECT download_id, seq, us, ms, downloaded, total, CASE WHEN total > 0 THEN least(downloaded / total * 100, 100.0) ELSE 0.0 END AS percent,
  round(CASE WHEN secs > 0 THEN downloaded / secs ELSE 0 END / 1048576, 2) AS mib_per_s, CAST(CASE WHEN secs > 0 AND downloaded > 0 AND total > downloaded THEN floor((total - downloaded) / (downloaded / secs)) ELSE 0 END AS BIGINT) AS eta_secs FROM r)"""


def throttled(download: str = "user_id", slower: int = 1) -> str:
    return f"""{_rates(download, slower)},
m AS (SELECT DISTINCT download_id, ms FROM p),
n AS (SELECT download_id, ms, min(ms) OVER (PARTITION BY download_id ORDER BY ms RANGE BETWEEN 250 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM m),
k AS (SELECT download_id, min(ms) AS ms FROM m GROUP BY download_id UNION ALL SELECT n.download_id, n.after FROM k JOIN n ON k.download_id = n.download_id AND k.ms = n.ms WHERE n.after IS NOT NULL)
SELECT download_id, downloaded, total, round(percent, 6) AS percent, mib_per_s, eta_secs FROM (SELECT *, row_number() OVER (PARTITION BY download_id, ms ORDER BY us, seq) AS nth FROM p) JOIN k USING (download_id, ms)
WHERE nth = 1 AND ms > (SELECT min(ms) FROM m WHERE m.download_id = k.download_id)
UNION ALL SELECT DISTINCT download_id, total, total, 100.0, 0.0, 0 FROM p WHERE downloaded = total"""


PROGRESS_RATES = _rates() + " SELECT download_id, seq, mib_per_s, eta_secs FROM p"

#: What each form of made-up reply must give, from the rules for replies: well-formed ones (0-3) all three entities, one with a
#: trailing comma (4) or cut off in its last object (5) the two before, a flat one (6) and one with words around it (8) an entity
#: for each key in the keys' order, and objects without known keys (7) an empty list.
REPLY_ENTITIES = f"""WITH {NOTES_SQL}, f AS (SELECT *, CAST(note_id % 9 AS INTEGER) AS form FROM notes),
e(form_from, form_to, ord, kind, category, subcategory, confidence) AS (VALUES
  (0, 5, 0, 'patient', 'name', 'patient', 0.95), (0, 5, 1, 'birth', 'date', 'date_of_birth', 0.95), (0, 3, 2, 'id', 'id', 'national_id', 0.95),
  (6, 6, 0, 'high', 'id', 'confidence', 0.7), (6, 6, 1, 'patient', 'name', NULL, 0.7), (6, 6, 2, 'visit', 'date', 'visit', 0.7))
SELECT note_id, CAST(ord AS INTEGER) AS ord, CASE kind WHEN 'patient' THEN patient WHEN 'birth' THEN strftime(birth, '%d.%m.%Y') WHEN 'id' THEN national_id WHEN 'visit' THEN strftime(visit, '%d.%m.%Y') ELSE kind END AS original,
  category, subcategory, CAST(confidence AS DOUBLE) AS confidence
FROM f JOIN e ON CASE form WHEN 8 THEN 6 ELSE form END BETWEEN form_from AND form_to"""
REPLY_ERRORS = f"""WITH {NOTES_SQL} SELECT form, count(*) AS n, CAST(0 AS BIGINT) AS n_errors, CAST(sum(CASE WHEN form < 4 OR form IN (6, 8) THEN 3 WHEN form < 6 THEN 2 ELSE 0 END) AS BIGINT) AS n_entities
FROM (SELECT CAST(note_id % 9 AS INTEGER) AS form FROM notes) GROUP BY form"""


def _recalc_ages() -> str:
    found = f"{BIRTH}SELECT note_id, any_value(detected_birth_date) AS detected_birth_date, count(*) || '/' || count(*) || ' entities enabled' AS summary FROM aged GROUP BY note_id"
    return f"SELECT f.note_id, summary, detected_birth_date, html AS redacted_html FROM ({found}) f JOIN ({html(False)}) h USING (note_id)"


def _toggle_refresh() -> str:
    on = "on_list AS (SELECT * FROM numbered WHERE ord <> 1)"
    inner = f"'<span class=\"pii redacted\" style=\"{BLOCKED}\">' || {BLOCKS.replace('original', 'n.original')} || '</span>'"
    shown = _folded(f"{NOTED_SQL}, {on}", "on_list", inner, lambda x: f"replace({_esc(x)}, chr(10), '<br>')") + "html FROM done"
    return f"SELECT note_id, (count(*) - 1) || '/' || count(*) || ' entities enabled' AS summary, any_value(html) AS redacted_html FROM ({NOTED}SELECT note_id FROM merged) JOIN ({shown}) USING (note_id) GROUP BY note_id"


RECALC_AGES, TOGGLE_REFRESH = _recalc_ages(), _toggle_refresh()
REPLY_WELL_TYPED = REPLY_ENTITIES.replace("FROM f JOIN e", "FROM (SELECT * FROM f WHERE form < 4) f JOIN e")


def _failures() -> str:
    from .fixtures import UNREADABLE

    whens = " ".join(f"WHEN {i} THEN {x.replace('STRING', 'VARCHAR')}" for i, x in enumerate(UNREADABLE))
    return f"WITH {NOTES_SQL} SELECT note_id, true AS failed, 'the reply is not JSON: ' || left(coalesce(CASE CAST(note_id % {len(UNREADABLE)} AS INTEGER) {whens} END, ''), 300) AS error FROM notes"


REPLY_FAILURES = _failures()


def prompts() -> str:
    from ..operators.detect import SYSTEM

    made = f"CASE WHEN lang = 'tr' THEN 'Belge:' ELSE 'Document:' END || chr(10) || '---' || chr(10) || left(text, n) || chr(10) || '---'"
    cut = truncate(90_000, "text").strip()
    both = f"{NOTES}SELECT note_id AS doc_id, lang, text FROM notes UNION ALL SELECT doc_id, lang, text FROM documents"
    texts = f"SELECT row_number() OVER () AS doc_id, doc_id AS note_id, lang, text FROM ({both})"
    limited = cut.replace("SELECT doc_id, text AS text FROM documents", f"SELECT * FROM ({texts})").replace("SELECT doc_id, n, sha256(left(text, n)) AS sha256 FROM n", "SELECT note_id, lang, n, n.text FROM n JOIN d USING (doc_id)")
    return f"SELECT note_id, lang, CAST(strlen(prompt) AS INTEGER) AS n_bytes, sha256(CASE WHEN lang = 'tr' THEN {q(SYSTEM['tr'])} ELSE {q(SYSTEM['en'])} END || chr(10) || chr(10) || prompt) AS digest FROM (SELECT note_id, lang, {made} AS prompt FROM ({limited}))"


#: A row of an order's lines edits a list, one edit after the other.
EDITS_FOLDED = f"""WITH RECURSIVE {NOTED_SQL},
log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY seq) AS k FROM (SELECT DISTINCT ON (note_id, seq) * FROM ({EDITS}) ORDER BY note_id, seq, op, index, category, value, original)),
s AS (SELECT note_id, CAST(0 AS BIGINT) AS k, list({{'o': original, 'c': category, 'p': placeholder, 'v': true}} ORDER BY ord) AS l FROM numbered GROUP BY note_id
  UNION ALL SELECT s.note_id, log.k, CASE op
    WHEN 'toggle' THEN list_transform(l, lambda x, i: {{'o': x.o, 'c': x.c, 'p': x.p, 'v': CASE WHEN i - 1 = log.index THEN log.value ELSE x.v END}})
    WHEN 'category' THEN list_transform(l, lambda x: {{'o': x.o, 'c': x.c, 'p': x.p, 'v': CASE WHEN x.c = log.category THEN log.value ELSE x.v END}})
    WHEN 'all' THEN list_transform(l, lambda x: {{'o': x.o, 'c': x.c, 'p': x.p, 'v': log.value}})
    WHEN 'add' THEN CASE WHEN len(list_filter(l, lambda x: x.o = log.original)) > 0 THEN l ELSE list_append(l, {{'o': log.original, 'c': 'manual', 'p': '[REDACTED_' || (len(list_filter(l, lambda x: x.c = 'manual')) + 1) || ']', 'v': true}}) END
    ELSE list_filter(l, lambda x, i: i - 1 <> log.index OR x.c <> 'manual') END
  FROM s JOIN log ON log.note_id = s.note_id AND log.k = s.k + 1),
done AS (SELECT note_id, arg_max(l, k) AS l FROM s GROUP BY note_id)
SELECT note_id, CAST(i - 1 AS INTEGER) AS ord, x.o AS original, x.p AS placeholder, x.v AS enabled FROM (SELECT note_id, unnest(l) AS x, unnest(generate_series(1, len(l))) AS i FROM done)"""

OPEN_FILES = f"""SELECT note_id, 'txt' AS kind, sha256(redacted) AS sha256, CAST(NULL AS VARCHAR) AS error FROM ({redact(BLOCKS)})
UNION ALL SELECT note_id, 'pdf', sha256(trim(redacted, chr(10))), NULL FROM ({redact('placeholder')})"""

_WHITE = r"[\s\x0B\x85\p{Z}]+"
SELECTION = f"""SELECT doc_id, CAST(length(f) AS INTEGER) AS n, sha256(f) AS sha256, contains(text, f) AS found FROM (SELECT doc_id, text, CASE WHEN length(t) < 2 THEN NULL WHEN contains(text, t) THEN t
  WHEN contains(text, regexp_replace(t, '{_WHITE}', ' ', 'g')) THEN regexp_replace(t, '{_WHITE}', ' ', 'g') WHEN contains(text, replace(t, chr(13) || chr(10), chr(10))) THEN replace(t, chr(13) || chr(10), chr(10)) ELSE t END AS f
  FROM (SELECT *, regexp_replace(chosen, '^{_WHITE}|{_WHITE}$', '', 'g') AS t FROM ({ROWS['chosen'][1]})))"""
