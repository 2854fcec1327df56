"""Clinical notes, entity lists and model replies derived from orders and customers, for both engines.

The tables hold no clinical text, so each order and its customer give one note. A note
is written as a list of literals and names of values; both engines' SQL comes from that list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.entities import ENTITIES
from ..sources.tables import dealt, table

SPARK = {
    "P": "patient", "N": "national_id", "B": "date_format(birth, 'dd.MM.yyyy')", "V": "date_format(visit, 'dd.MM.yyyy')", "V30": "date_format(date_sub(visit, 30), 'dd.MM.yyyy')",
    "V400": "date_format(date_sub(visit, 400), 'dd.MM.yyyy')", "L9": "right(patient, 9)", "Z": "concat('0', left(national_id, 10))", "T": "concat('9', national_id)",
    "MY": "date_format(visit, 'MM/yyyy')", "Y": "date_format(visit, 'yyyy')", "ISO": "date_format(visit, 'yyyy-MM-dd')",
}
DUCK = {
    "P": "patient", "N": "national_id", "B": "strftime(birth, '%d.%m.%Y')", "V": "strftime(visit, '%d.%m.%Y')", "V30": "strftime(visit - 30, '%d.%m.%Y')",
    "V400": "strftime(visit - 400, '%d.%m.%Y')", "L9": "right(patient, 9)", "Z": "'0' || left(national_id, 10)", "T": "'9' || national_id",
    "MY": "strftime(visit, '%m/%Y')", "Y": "strftime(visit, '%Y')", "ISO": "strftime(visit, '%Y-%m-%d')",
}
#: {X} is a value of the tables above.
TEXTS = (
    "Patient: {P}, ID {N}.\nDate of birth: {B}\nSeen {V}. {P} is well.",
    "Patient {P} (ID {N}), {B} born. Control on {V}.",
    "{P} {N}: {V}; earlier {V30}; first {V400}.",
    "{P} {N}. Given {B} and {V}.",
    "{P} {N}. Seen {V} <b>& \"well\"</b>.",
    "{P} / {P} / {N} / {N}.\n\nDate of birth: {B}. Seen {V}. Ref {L9}.",
    "{P} {N}. Tel 23.01.2023 11:55. Codes {Z} {T}. Seen {V}.",
    "{P} {N}. Date of birth: {B}. At birth {B}; {MY}; {Y}; {ISO}; 31.02.2020. Seen {V}.",
)
#: (variants, value or literal, category, subcategory) in list order.
FOUND = (
    (range(8), "{P}", "name", None), ((5,), "{P}", "name", None), ((5,), "{L9}", "id", None), ((6,), "23.01.2023 11:55", "phone", None), ((0, 1, 5, 7), "{B}", "date", None),
    ((3,), "{B}", "date", "date_of_birth"), ((2,), "{V30}", "date", None), ((2,), "{V400}", "date", None), ((7,), "{MY}", "date", None), ((7,), "{Y}", "date", None),
    ((7,), "{ISO}", "date", None), ((7,), "31.02.2020", "date", None), (range(8), "{V}", "date", None),
)


def sql_text(template: str, values: dict[str, str], glue: str) -> str:
    parts = []
    for i, x in enumerate(template.replace("{", "}").split("}")):
        if i % 2:
            parts.append(values[x])
        elif x:
            parts.append("'" + x.replace("'", "''") + "'")
    return f"concat({', '.join(parts)})" if glue == "," else " || ".join(f"({p})" for p in parts)


def _case(values: dict[str, str], glue: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {sql_text(t, values, glue)}" for i, t in enumerate(TEXTS))
    return f"CASE variant {whens} END"


#: Notes that a task works on: dates and forms of one take up to half a millisecond.
NOTES_A_TASK = 25_000


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, patient, national_id, birth, visit, lang, variant, text)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    df = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS note_id", "c_name AS patient", "CAST(10000000000 + o_custkey * 7919 AS STRING) AS national_id",
        "date_add(DATE'1950-01-01', CAST(o_custkey % 16000 AS INT)) AS birth", "CAST(o_orderdate AS DATE) AS visit",
        "CASE WHEN (o_orderkey div 8) % 4 = 3 THEN 'tr' ELSE 'en' END AS lang", "CAST(o_orderkey % 8 AS INT) AS variant",
    )
    df = dealt(df, orders.count(), NOTES_A_TASK)
    return df.withColumn("text", F.expr(_case(SPARK, ",").replace("\n", "\\n")))


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes with entities: what a model would have found, before any correction."""
    lists = []
    for variants, value, category, sub in FOUND:
        e = f"array(named_struct('original', {sql_text(value, SPARK, ',')}, 'category', '{category}', 'subcategory', CAST({repr(sub) if sub else 'NULL'} AS STRING), 'placeholder', '', 'confidence', 0.9D, 'enabled', true, 'start', CAST(NULL AS BIGINT), 'end', CAST(NULL AS BIGINT), 'manual', CAST(NULL AS BOOLEAN)))"
        lists.append(F.when(F.col("variant").isin(*variants), F.expr(e)).otherwise(F.array().cast(ENTITIES)))
    return notes(spark, sf_dir).withColumn("entities", F.concat(*lists).cast(ENTITIES))


NOTES_SQL = f"""notes AS (
  SELECT *, {_case(DUCK, "|")} AS text FROM (
    SELECT o_orderkey AS note_id, c_name AS patient, CAST(10000000000 + o_custkey * 7919 AS VARCHAR) AS national_id,
      DATE '1950-01-01' + CAST(o_custkey % 16000 AS INTEGER) AS birth, CAST(o_orderdate AS DATE) AS visit,
      CASE WHEN (o_orderkey // 8) % 4 = 3 THEN 'tr' ELSE 'en' END AS lang, CAST(o_orderkey % 8 AS INTEGER) AS variant
    FROM orders JOIN customer ON o_custkey = c_custkey))"""


def _found_sql() -> str:
    lists = []
    for variants, value, category, sub in FOUND:
        s = f"{{'original': {sql_text(value, DUCK, '|')}, 'category': '{category}', 'subcategory': CAST({repr(sub) if sub else 'NULL'} AS VARCHAR)}}"
        lists.append(f"CASE WHEN variant IN ({', '.join(map(str, variants))}) THEN [{s}] ELSE [] END")
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


NOTED_SQL = f"""{NOTES_SQL},
noted AS (SELECT *, {_found_sql()} AS es FROM notes),
raw AS (SELECT note_id, variant, lang, text, unnest(generate_series(0, len(es) - 1)) AS ord, unnest(es) AS e FROM noted),
fixed AS (SELECT note_id, variant, lang, text, ord, e.original AS original,
  CASE WHEN hit THEN 'date' ELSE e.category END AS category, CASE WHEN hit THEN 'date' ELSE e.subcategory END AS subcategory
  FROM (SELECT *, e.category = 'phone' AND regexp_matches(e.original, '\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{2,4}}|\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}|\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') AS hit FROM raw)),
ids AS (SELECT note_id, variant, lang, text, id FROM (SELECT *, unnest(list_distinct(regexp_extract_all(text, '\\b[1-9]\\d{{10}}\\b'))) AS id FROM notes)),
merged AS (
  SELECT note_id, variant, lang, text, CAST(ord AS INTEGER) AS ord, original, category, subcategory, 0.9 AS confidence FROM fixed
  UNION ALL
  SELECT note_id, variant, lang, text, CAST((SELECT count(*) FROM fixed f WHERE f.note_id = ids.note_id) + row_number() OVER (PARTITION BY note_id ORDER BY strpos(text, id)) - 1 AS INTEGER), id, 'id', 'national_id', 0.85
  FROM ids WHERE NOT EXISTS (SELECT 1 FROM fixed f WHERE f.note_id = ids.note_id AND f.original = ids.id)),
numbered AS (SELECT *, '[' || CASE category WHEN 'name' THEN 'NAME' WHEN 'date' THEN 'DATE' WHEN 'id' THEN 'ID' WHEN 'phone' THEN 'PHONE' ELSE 'PII' END || '_' || row_number() OVER (PARTITION BY note_id, category ORDER BY ord) || ']' AS placeholder FROM merged)"""

def pick(cases, by: str) -> str:
    """A case for each row, by a number that its columns give; SQL of both engines."""
    return f"CASE {by} % {len(cases)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(cases)) + " END"


def literals(*cases: str) -> list[str]:
    return ["'" + x + "'" for x in cases]


#: Labels, dates, raw replies, file names and model files made of rows of the given tables: name -> (table, SQL of both engines).
LABELS = (
    "name", "date", "id", "address", "adres", "phone", "email", "institution", "age", "admission_date", "discharge_date", "date_of_birth", "dob", "patient", "patient_id", "national_id", "location",
    "city", "street", "zip", "hotel", "e-posta", "hospital", "hospital_name", "org", "facility", "summary", "radiology", "age_at_visit", "message", "incident_date", "tc", "confidence", " Phone ", "DOCTOR",
)
ODD_DATES = (
    "15.03.2020", "15/03/20", "1-2-49", "1-2-50", "31.02.2020", "03/25/2020", "2020-03-15", "2020/3/5", "15 Mart 2020", "March 15, 2012", "Mar 2012", "2019 Ekim", "KASIM 2019", "10/2019", "13/2019", "2022",
    "1850", "23.01.2023 11:55", "Seen 2021-02-03 ok", "2020.03.15", "15 Sept 2020", "Date: 5 May 2020", "15.03.20201", "27.5.221.1", "abc", "", " 1.1.2001 ",
)
_NAMED = "CASE CAST(m AS INT) " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(("ocak", "Feb", "Mart", "April", "mayis", "JUNE", "temmuz", "aug", "Eylul", "october", "Kasim", "Dec"), 1)) + " END"
_DATES = [
    "d || '.' || m || '.' || y", "d || '/' || m || '/' || substr(y, 3, 2)", "'Seen ' || y || '-' || m || '-' || d || ' ok'", f"d || ' ' || {_NAMED} || ' ' || y", f"{_NAMED} || ' ' || y", "y || '/' || m || '/' || d", "m || '/' || y", "y",
    f"y || ' ' || {_NAMED}", "d || '-' || m || '-' || y || ' 10:30'", "'order of ' || y", f"{_NAMED} || ' ' || d || ', ' || y", "m || '.' || d || '.' || y",
]
FENCE = chr(96) * 3
_RAW = (
    "'<think>' || text || '</think>{}'", "text || '<think>' || text", "'<think>a</think>' || text || '<think>b</think>y'", f"'{FENCE}json ' || text || ' {FENCE}'", f"'{FENCE} [' || text || '] {FENCE}{FENCE}'", "'  ' || text || '  '", f"'{FENCE}json{FENCE}json' || text",
    "text",
)
_PATHS = ("c_name || '.txt'", "c_name || '.tar.gz'", "c_name", "'a.b/' || c_name", "'.hidden' || c_name", "c_name || '.'")
_QUANTS = ("-Q4_K_M", "-q8_0", "-f16", "", "_Q5_K_S", "-Q2_K", "-Q3_K_L")
_FAMILY = ("Qwen3", "other", "qwen-big", "mid", "Llama")
_CHOSEN = (
    "substr(text, 1 + CAST(doc_id % 50 AS INT), 40)", "replace(substr(text, 10, 60), ' ', '  ')", "replace(substr(text, 10, 200), chr(10), chr(13) || chr(10))", "' x '", "'not in any text ' || CAST(doc_id AS STRING)",
    "'  ' || substr(text, 3, 30) || chr(10) || ' '", "replace(substr(text, 1, 300), ' ', chr(10))",
)
ROWS = {
    "chosen": ("documents", f"SELECT doc_id, text, {pick(_CHOSEN, 'doc_id')} AS chosen FROM documents"),
    "labels": ("part", f"SELECT p_partkey, {pick(literals(*LABELS), 'p_partkey')} || CASE WHEN p_size % 3 = 0 THEN ' ' || p_type ELSE '' END AS raw FROM part"),
    "dates": ("orders", f"SELECT o_orderkey, {pick([*literals(*ODD_DATES), *_DATES, *_DATES], 'o_orderkey')} AS input FROM (SELECT *, substr(t, 1, 4) AS y, substr(t, 6, 2) AS m, substr(t, 9, 2) AS d FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS t FROM orders) a) b"),
    "raws": ("conversations", f"SELECT conv_id, turn, {pick(_RAW, '(conv_id + turn)')} AS raw FROM conversations"),
    "paths": ("customer", f"SELECT c_custkey, '/' || c_mktsegment || '/' || {pick(_PATHS, 'c_custkey')} AS path FROM customer"),
    "files": ("part", f"SELECT '/m/' || p_type || '/' || {pick(literals(*_FAMILY), 'p_partkey')} || '-' || CAST(p_partkey AS STRING) || {pick(literals(*_QUANTS), 'p_size')} || CASE p_partkey % 9 WHEN 0 THEN '.txt' WHEN 1 THEN '.GGUF' ELSE '.gguf' END AS path, CAST(p_size AS BIGINT) * 300000000 + p_partkey AS length FROM part"),
    "offered": ("part", "SELECT 'm' || CAST(p_partkey AS STRING) AS id, p_name AS name, 'model-' || CAST(p_partkey AS STRING) || '.gguf' AS filename, CAST(p_size AS DOUBLE) AS size_gb FROM part"),
    "fetched": ("lineitem", "SELECT '/m/model-' || CAST(l_partkey AS STRING) || '.gguf' AS path, CAST(l_quantity * 50000 AS BIGINT) AS length FROM lineitem WHERE l_linenumber = 1"),
}


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, text = ROWS[name]
    text = text.replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", "FROM {source}")
    return spark.sql(text, source=table(spark, sf_dir, source))


FORMS = 9


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, form, lang, text, raw_response): what a model might have written about a note, well formed or not."""
    obj = "concat('{\"original\": \"', {o}, '\", \"category\": \"', '{c}', '\", \"confidence\": 0.95}')"
    one = lambda o, c: obj.replace("{o}", o).replace("{c}", c)
    three = [one("patient", "patient"), one(SPARK["B"], "date_of_birth"), one("national_id", "national_id")]
    clean = f"concat('{{\"entities\": [', {three[0]}, ', ', {three[1]}, ', ', {three[2]}, '], \"summary\": \"3\"}}')"
    comma = f"concat('{{\"entities\": [', {three[0]}, ', ', {three[1]}, ', ]}}')"
    flat = "concat('[{\"name\": \"', patient, '\", \"confidence\": \"high\", \"visit\": \"', {v}, '\"}}]')".replace("{v}", SPARK["V"]).replace("}}", "}")
    loose = "concat('{\"entities\": [{\"name\": \"', patient, '\"}]}')"
    forms = (
        clean, f"concat('```json\\n', {clean}, '\\n```')", f"concat('<think>who [is] {{this}}?</think>\\n', {clean})", f"concat({clean}, '<think>and')", comma,
        f"left({clean}, length({clean}) - 40)", flat, loose, f"concat('No JSON today: ', patient, ' ', {flat}, ' end')",
    )
    whens = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    df = notes(spark, sf_dir).withColumn("form", F.expr(f"CAST(note_id % {FORMS} AS INT)"))
    return df.select("note_id", "form", "lang", "text", F.expr(f"CASE form {whens} END").alias("raw_response"))


#: Replies that no step can read: no JSON, JSON with a constant it has not, brackets that nothing closes, nothing at all, none.
UNREADABLE = ("'No findings for ' || patient || repeat(' today', 60)", "'[NaN, \"' || patient || '\"]'", "'{\"entities\": [' || patient", "''", "CAST(NULL AS STRING)")


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    whens = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(UNREADABLE))
    return notes(spark, sf_dir).select("note_id", "lang", "text", F.expr(f"CASE CAST(note_id % {len(UNREADABLE)} AS INT) {whens} END").alias("raw_response"))


#: An edit for each line of an order: what it does follows from the line's part.
OPS = ("toggle", "category", "all", "add", "delete", "toggle")
_OP = "CASE l_partkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(OPS)) + " END"
EDITS = f"SELECT l_orderkey AS note_id, CAST(l_linenumber AS BIGINT) AS seq, {_OP} AS op, CAST(l_suppkey % 5 AS INT) AS index, CASE WHEN l_suppkey % 2 = 0 THEN 'date' ELSE 'name' END AS category, l_quantity > 25 AS value, CASE WHEN l_suppkey % 3 = 0 THEN 'is well' ELSE 'Seen' END AS original FROM lineitem"


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, seq, op, index, category, value, original)."""
    return spark.sql(EDITS.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
