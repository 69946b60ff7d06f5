"""Queries of what models answer, with the stand-in that needs no network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers
from ..operators.layout import dealt
from ..sources.providers import OfflineProvider
from . import process
from .queries import CONFIG, WORDS, _place, pages, query, read

RAW = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"tipo_documento": "' || event_type || '", "datos": {"k": "v' || CAST(event_id AS VARCHAR) || '", "n": 0, "b": false, "z": null, "m": 12}}' WHEN 1 THEN '```json' || chr(10) || '{"datos": {"k": "v", "t": true, "o": {"p": [1, 2]}}}' || chr(10) || '```'
    WHEN 2 THEN '{"tipo_documento": "broken' WHEN 3 THEN '[1]' WHEN 4 THEN '{"tipo_documento": "x", "datos": [1]}' ELSE '{"tipo_documento": null, "datos": {"e": "", "l": [], "d": 1.5}}' END AS raw FROM events"""


@query(f"""WITH b AS (SELECT event_id, regexp_replace(regexp_replace(raw, '^```[a-z]*\\s*', ''), '\\s*```$', '') AS bare FROM ({RAW})), j AS (SELECT event_id, CASE WHEN json_valid(bare) THEN bare::JSON END AS j FROM b),
    k AS (SELECT event_id, j, unnest(json_keys(j, '$.datos')) AS key FROM j WHERE json_type(j, '$.datos') = 'OBJECT'), v AS (SELECT event_id, key, json_extract(j, '$.datos.' || key) AS v, json_type(j, '$.datos.' || key) AS t FROM k),
    p AS (SELECT event_id, string_agg(key || '=' || CASE WHEN t = 'NULL' OR v::VARCHAR IN ('0', 'false', '[]', '""') THEN '' WHEN t = 'VARCHAR' THEN v ->> '$' ELSE v::VARCHAR END, '; ' ORDER BY key) AS data FROM v GROUP BY 1)
    SELECT event_id, coalesce(json_extract_string(j, '$.tipo_documento'), 'desconocido') AS kind, coalesce(data, '') AS data FROM j LEFT JOIN p USING (event_id)""")
def free_answers(spark, sf):
    raw = F.expr(RAW.split("SELECT event_id, ")[1].split(" AS raw")[0].replace("CAST(event_id AS VARCHAR)", "string(event_id)"))
    f = read(spark, sf, "events").select("event_id", answers.free_answer(raw).alias("f"))
    return f.select("event_id", "f.kind", F.array_join(F.transform(F.array_sort(F.map_entries("f.data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ").alias("data"))


LISTED = """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '{"fields": [{"label": "A ", "value": "' || o_orderstatus || '", "data_type": "date"}, {"label": "", "value": "x"}]}' WHEN 1 THEN '{"fields": [], "campos": [{"label": "B", "value": 7, "data_type": "odd"}, 5, {"value": "v"}]}'
    WHEN 2 THEN '```' || chr(10) || '[{"label": "C", "value": "' || o_orderpriority || '"}, {"label": "D", "value": "d", "data_type": "dni"}]' || chr(10) || '```' WHEN 3 THEN '{"fields": {"label": "E"}}' ELSE 'no JSON' END AS raw FROM orders"""


@query(f"""WITH b AS (SELECT k, regexp_replace(regexp_replace(raw, '^```[a-z]*\\s*', ''), '\\s*```$', '') AS bare FROM ({LISTED})), j AS (SELECT k, CASE WHEN json_valid(bare) THEN bare::JSON END AS j FROM b),
    l AS (SELECT k, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_array_length(j, '$.fields') > 0 THEN json_extract(j, '$.fields') WHEN json_array_length(j, '$.campos') > 0 THEN json_extract(j, '$.campos') ELSE '[]'::JSON END AS l FROM j),
    i AS (SELECT k, unnest(CAST(l AS JSON[])) AS i FROM l), s AS (SELECT k, trim(coalesce(json_extract_string(i, '$.label'), '')) AS label, trim(coalesce(json_extract_string(i, '$.value'), '')) AS value, coalesce(json_extract_string(i, '$.data_type'), 'text') AS t FROM i)
    SELECT k, label, value, CASE WHEN t IN ('text', 'date', 'number', 'currency', 'dni', 'email', 'phone') THEN t ELSE 'text' END AS data_type FROM s WHERE label <> '' AND value <> ''""")
def suggested_answers(spark, sf):
    raw = F.expr(LISTED.split("SELECT o_orderkey AS k, ")[1].split(" AS raw")[0])
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(answers.suggested(raw)).alias("s")).select("k", "s.*")


NORM = "regexp_replace(strip_accents(lower({0})), '[^\\pL\\pN]', '', 'g')"


@query(f"""{WORDS}, v AS (SELECT doc_id, page, string_agg('«' || text || '»', ' ' ORDER BY word_no) AS value FROM words WHERE word_no % 40 IN (3, 4) GROUP BY doc_id, page, word_no // 40),
    t AS (SELECT DISTINCT doc_id, page, value, unnest(list_filter(list_transform(string_split(value, ' '), lambda w: {NORM.format('w')}), lambda w: w <> '')) AS t FROM v), n AS (SELECT *, {NORM.format('text')} AS n FROM words),
    h AS (SELECT DISTINCT t.doc_id, t.page, value, word_no, x, y, w, h FROM t JOIN n ON n.doc_id = t.doc_id AND n.page = t.page AND n.n <> '' AND (n = t OR length(t) >= 3 AND (contains(n, t) OR contains(t, n)))),
    b AS (SELECT doc_id, page, value, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM h GROUP BY doc_id, page, value)
    SELECT DISTINCT v.doc_id, v.page, v.value, x, y, w, h FROM v LEFT JOIN b USING (doc_id, page, value)""")
def scattered_values(spark, sf):
    """Where the words of values stand that a model has put in quotation marks: two words of every forty."""
    w = pages(spark, sf)
    some = w.select("doc_id", "page", F.inline(F.filter("ws", lambda x: (x["word_no"] % 40).isin(3, 4)))).groupBy("doc_id", "page", F.floor(F.col("word_no") / 40).alias("g")).agg(F.array_sort(F.collect_list(F.struct("word_no", F.concat(F.lit("«"), "text", F.lit("»")).alias("t")))).alias("ts"))
    values = some.select("doc_id", "page", F.array_join(F.transform("ts", lambda s: s["t"]), " ").alias("value")).distinct()
    return answers.scattered_regions(w, values).select("doc_id", "page", "value", "box.x", "box.y", "box.w", "box.h")


# Customers as forms: a line for the name, one for the segment, one for the balance.

LINES_SQL = """lines AS (SELECT c_custkey AS doc_id, unnest([0, 1, 2]) AS line, unnest(['Nombre', 'Segmento', 'Saldo']) AS label, unnest([c_name, c_mktsegment, CAST(CAST(floor(c_acctbal * 100) AS BIGINT) AS VARCHAR)]) AS value FROM customer)"""
FORM_WORDS_SQL = f"""{LINES_SQL}, ws AS (SELECT doc_id, line * 100 + c AS word_no, CASE c WHEN 0 THEN label || ':' ELSE value END AS text, 2000 + 8000 * c AS x, 3000 + 3000 * line AS y, 600 * length(CASE c WHEN 0 THEN label || ':' ELSE value END) AS w, 1500 AS h FROM lines, (VALUES (0), (1)) v(c))"""


def _customers(spark, sf, colon: str = "':'", *more):
    """Words of the forms; more: columns that each add a line of two words."""
    c = read(spark, sf, "customer")
    balance = F.floor(F.col("c_acctbal") * 100).cast("string")
    line = lambda label, value: F.array(F.concat(F.lit(label), F.expr(colon)), value)
    ws = F.array(line("Nombre", F.col("c_name")), line("Segmento", F.col("c_mktsegment")), line("Saldo", balance), *more)
    ws = F.filter(ws, lambda l: F.size(l) > 0)
    return _place(c.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "c_custkey", ws)


def _texts(spark, sf):
    balance = F.floor(F.col("c_acctbal") * 100).cast("string")
    text = F.concat(F.lit("Nombre: "), "c_name", F.lit("\nSegmento: "), "c_mktsegment", F.lit("\nSaldo: "), balance)
    return dealt(read(spark, sf, "customer"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.lit(0).cast("long").alias("page"), F.col("c_nationkey").cast("long").alias("template"), text.alias("text"), "c_name", "c_mktsegment", balance.alias("balance"))


@query(f"""WITH {FORM_WORDS_SQL}, f AS (SELECT doc_id, lower(label) AS key, value FROM lines JOIN customer ON c_custkey = doc_id WHERE c_nationkey % 3 = 0 OR line = c_nationkey % 3),
    u AS (SELECT c_nationkey, least(3, count(*) FILTER (c_custkey % 10 = 0)) AS used FROM customer GROUP BY 1), n AS (SELECT *, {NORM.format('text')} AS n FROM ws), t AS (SELECT *, {NORM.format('value')} AS t FROM f),
    b AS (SELECT t.doc_id, key, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM t JOIN n ON n.doc_id = t.doc_id AND n <> '' AND t <> '' AND (n = t OR length(t) >= 3 AND (contains(n, t) OR contains(t, n))) GROUP BY ALL)
    SELECT f.doc_id, f.key, f.value, b.x, b.y, b.w, b.h, coalesce(used, 0) AS used FROM f JOIN customer ON c_custkey = f.doc_id LEFT JOIN u USING (c_nationkey) LEFT JOIN b ON b.doc_id = f.doc_id AND b.key = f.key""")
def model_extraction(spark, sf):
    """Every customer's form is read with the help of confirmed ones of its nation."""
    texts = _texts(spark, sf)
    keys = [(t, n, k, k.title()) for t in range(25) for n, k in enumerate(("nombre", "segmento", "saldo")) if t % 3 == 0 or n == t % 3]
    fields = spark.createDataFrame(keys, "template long, ord int, key string, name string")
    examples = texts.where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), "template", "text", F.create_map(F.lit("nombre"), F.col("c_name"), F.lit("segmento"), F.col("c_mktsegment")).alias("values"))
    out = answers.extract_with_examples(texts.drop("c_name", "c_mktsegment", "balance"), _customers(spark, sf), fields, examples, OfflineProvider(), CONFIG)
    return out.select("doc_id", "key", "value", "box.x", "box.y", "box.w", "box.h", "used")


@query(f"""WITH {LINES_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'detectado' ELSE 'desconocido' END AS kind, CASE WHEN doc_id % 4 > 0 THEN lower(label) WHEN label = 'Saldo' THEN 'importe' ELSE 'nombre' END AS key, value FROM lines WHERE doc_id % 4 > 0 OR label <> 'Segmento'""")
def free_extraction(spark, sf):
    """Forms without a template; every fourth has a text in which the stand-in finds nothing, so that rules read the words."""
    texts = _texts(spark, sf).withColumn("text", F.when(F.col("doc_id") % 4 == 0, "nothing here").otherwise(F.col("text")))
    return answers.extract_free(texts, _customers(spark, sf, "''"), OfflineProvider()).select("doc_id", "kind", "key", "value")


@query(f"""WITH {FORM_WORDS_SQL} SELECT l.doc_id, CAST(line AS BIGINT) AS ordinal, lower(label) AS key, label AS name, 'text' AS data_type, value AS sample_text, x, y, w, h FROM lines l JOIN ws ON ws.doc_id = l.doc_id AND ws.word_no = l.line * 100 + 1""")
def model_suggestions(spark, sf):
    return answers.model_suggestions(_customers(spark, sf), OfflineProvider()).select("doc_id", "ordinal", "key", "name", "data_type", "sample_text", "box.x", "box.y", "box.w", "box.h")


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'model' ELSE 'rules' END || CASE WHEN c_custkey % 3 = 0 THEN '+table' ELSE '' END AS source, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n FROM customer""")
def suggest_sources(spark, sf):
    """Where suggestions come from: the model where lines have colons, else rules, and rows of codes."""
    c = F.col("c_custkey")
    more = F.when(c % 3 == 0, F.array(F.lit("F.1"), c.cast("string"))).otherwise(F.array().cast("array<string>"))
    s = process.suggest_fields(_customers(spark, sf, "if(c_custkey % 2 = 0, ':', '')", more), OfflineProvider())
    return s.groupBy("doc_id", "source").agg(F.count("*").alias("n")).select("doc_id", "source", "n")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 THEN 'hosted' WHEN s_suppkey % 5 > 0 THEN 'remote' ELSE 'local' END AS backend FROM supplier""")
def generation_backends(spark, sf):
    """Which back-end answers under settings kept in a table: the hosted one if enabled and with a key, else the remote one if it has an address."""
    from ..sources.providers import backend_of

    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select("s_suppkey", backend_of(k % 2 == 0, F.when(k % 3 > 0, "key"), F.when(k % 5 > 0, "url").otherwise("")).alias("backend"))
