"""Queries of stored tables: sources, look-ups, templates, records and their display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change_feed, layout, records
from ..sources import files, image_sink
from ..storage import scratch
from .queries import CONFIG, WORDS, query, read, words

# Sources


@query("""SELECT doc_id AS path, 'neither image nor PDF' AS reason FROM documents WHERE doc_id % 3 = 2 AND NOT (starts_with(coalesce(text, ''), 'BM') OR starts_with(coalesce(text, ''), '%PDF'))""")
def rejected_files(spark, sf):
    """Texts as files, some behind the first bytes of a PDF or an image."""
    head = F.when(F.col("doc_id") % 3 == 0, F.lit(b"%PDF")).when(F.col("doc_id") % 3 == 1, F.lit(b"\x89PNG")).otherwise(F.lit(b""))
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.concat(head, F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("content"))
    return files.rejected(d)


@query("SELECT doc_id, base64(encode(text)) AS content_base64 FROM documents")
def base64_content(spark, sf):
    return files.base64_content(read(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))).select("doc_id", F.regexp_replace("content_base64", "[\r\n]", "").alias("content_base64"))


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS border, NULL::BIGINT AS sample_id FROM nation")
def add_missing(spark, sf):
    return files.add_missing(read(spark, sf, "nation").select("n_nationkey", "n_name"), {"n_name": "string", "border": "string", "sample_id": "long"})


@query("""SELECT s_suppkey AS k, v AS name, list_contains(['png', 'jpg', 'jpeg', 'webp', 'tif', 'tiff', 'bmp', 'pdf'], lower(split_part(v, '.', -1))) AS accepted
    FROM (SELECT s_suppkey, replace(s_name, '#', '.') || '.' || ['png', 'TXT', 'Pdf', 'webp', 'doc', 'TIFF'][s_suppkey % 6 + 1] AS v FROM supplier)""")
def accepted_types(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("png", "TXT", "Pdf", "webp", "doc", "TIFF")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.replace("s_name", F.lit("#"), F.lit(".")), F.lit("."), suffix).alias("name"))
    return s.withColumn("accepted", files.is_accepted(F.col("name")))


@query(f"""{WORDS}, raw AS (SELECT doc_id, page, word_no, '  ' || text AS text, CASE WHEN word_no % 17 = 0 THEN 'n/a' WHEN word_no % 19 = 0 THEN '-1' ELSE CAST(conf AS VARCHAR) END AS conf, x, y, w, h FROM words)
    SELECT doc_id, page, word_no, trim(text) AS text, CAST(conf AS DOUBLE) AS conf, CAST(floor(x / 1000.0::DOUBLE / 100 * 100000 + 0.5) AS BIGINT) AS x, CAST(floor(y / 1000.0::DOUBLE / 200 * 100000 + 0.5) AS BIGINT) AS y,
        CAST(floor(w / 1000.0::DOUBLE / 100 * 100000 + 0.5) AS BIGINT) AS w, CAST(floor(h / 1000.0::DOUBLE / 200 * 100000 + 0.5) AS BIGINT) AS h FROM raw WHERE conf NOT IN ('n/a', '-1') AND trim(text) <> ''""")
def recognised_words(spark, sf):
    """Words as a recogniser gives them: pixels, confidences as text that can't always be read."""
    conf = F.when(F.col("word_no") % 17 == 0, "n/a").when(F.col("word_no") % 19 == 0, "-1").otherwise(F.col("conf").cast("string"))
    raw = words(spark, sf).select("doc_id", "page", "word_no", F.concat(F.lit("  "), "text").alias("text"), conf.alias("conf"), *[(F.col(c) / 1000.0).alias(f"px_{c}") for c in "xywh"], F.lit(100).alias("width"), F.lit(200).alias("height"))
    return layout.normalise_words(raw)


# Look-ups


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def by_key(spark, sf):
    return read(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_match(spark, sf):
    return records.first_matching(read(spark, sf, "orders"), "o_orderstatus = 'F'", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT s_suppkey AS id, 'images/' || CAST(n_regionkey AS VARCHAR) || '/' || s_name || '.png' AS stored_path FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def image_paths(spark, sf):
    """Where a document's image is stored."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return read(spark, sf, "supplier").join(n, "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("images/"), F.col("n_regionkey").cast("string"), F.lit("/"), "s_name", F.lit(".png")).alias("stored_path"))


# Templates


def _nations(spark, sf, universal: str = "false"):
    border = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("xywh", (1000, 2000, 90_000, 80_000))])
    return read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.expr(universal).alias("is_universal"), border.alias("border"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, false AS is_universal, CAST(90000 AS BIGINT) AS width FROM nation UNION ALL SELECT max(n_nationkey) + 1, 'datos IA', true, 100000 FROM nation")
def seed_universal(spark, sf):
    return records.seeded(_nations(spark, sf)).select("id", "name", "is_universal", F.col("border.w").alias("width"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_nationkey = 3 AS is_universal FROM nation")
def seed_universal_once(spark, sf):
    return records.seeded(_nations(spark, sf, "n_nationkey = 3")).select("id", "name", "is_universal")


@query("SELECT 'templates' AS t, CAST(1 AS BIGINT) AS id, 'datos IA' AS name")
def reset_tables(spark, sf):
    t = records.reset({"templates": _nations(spark, sf), "documents": read(spark, sf, "documents"), "records": read(spark, sf, "orders")})
    left = t["templates"].select(F.lit("templates").alias("t"), "id", "name")
    for name, key in (("documents", "doc_id"), ("records", "o_orderkey")):
        left = left.unionByName(t[name].select(F.lit(name).alias("t"), F.col(key).alias("id"), F.lit("").alias("name")))
    return left


@query("SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey <> 3")
def deletable_templates(spark, sf):
    return records.deletable(_nations(spark, sf, "n_nationkey = 3")).select("id")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 'own' END, c_mktsegment) AS signature, c_name AS border FROM nation LEFT JOIN customer ON c_custkey = n_nationkey * 9""")
def template_samples(spark, sf):
    t = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 9).alias("sample_id"), F.when(F.col("n_nationkey") % 4 == 0, "own").alias("signature"), F.lit(None).cast("string").alias("border"))
    d = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("signature"), F.col("c_name").alias("border"))
    return records.with_samples(t, d, "signature", "border").select("id", "signature", "border")


# Records and what is shown of them


@query("""SELECT o_orderkey, coalesce(n_name, '—') AS template_name, CASE o_orderstatus WHEN 'F' THEN '✓ Listo' WHEN 'O' THEN 'Procesando (OCR + IA)…' ELSE 'P' END AS label FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 40""")
def listed_records(spark, sf):
    t = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("t"), "n_name")
    o = read(spark, sf, "orders").withColumn("t", F.col("o_orderkey") % 40).join(t, "t", "left")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "processing").otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", records.listed_name(F.col("n_name")).alias("template_name"), records.state_label(state).alias("label"))


@query("""WITH v AS (SELECT c_custkey AS k, c_nationkey AS t, ['_tipo_documento', '_inner', 'f1', 'f2', 'f3'][c_custkey % 5 + 1] AS key FROM customer),
    f AS (SELECT n_nationkey AS t, 'f1' AS key, n_name AS name FROM nation UNION ALL SELECT n_nationkey, 'f2', '' FROM nation)
    SELECT k, CASE WHEN v.key = '_tipo_documento' THEN '📋 Tipo de documento' WHEN v.key = '_inner' THEN 'inner' ELSE coalesce(nullif(name, ''), v.key) END AS name FROM v LEFT JOIN f ON f.t = v.t AND f.key = v.key""")
def field_display_names(spark, sf):
    key = F.element_at(F.array(*[F.lit(x) for x in ("_tipo_documento", "_inner", "f1", "f2", "f3")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    v = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("template_id"), key.alias("key"))
    n = read(spark, sf, "nation")
    f = n.select(F.col("n_nationkey").alias("template_id"), F.lit("f1").alias("key"), F.col("n_name").alias("name")).union(n.select("n_nationkey", F.lit("f2"), F.lit("")))
    return records.field_names(v, f).select("k", "name")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'saved' END AS a, o_orderstatus AS b, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '' END AS c FROM orders""")
def saved_overlay(spark, sf):
    saved = F.when(F.col("o_orderkey") % 3 != 0, F.create_map(F.lit("a"), F.lit("saved"), F.lit("c"), F.lit("")))
    m = records.overlaid(F.create_map(F.lit("a"), F.col("o_orderpriority"), F.lit("b"), F.col("o_orderstatus")), saved)
    return read(spark, sf, "orders").select("o_orderkey", *[m[k].alias(k) for k in "abc"])


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber % 5 > 0 AS aligned, l_suppkey % 7 > 0 AS required, ((l_partkey % 4) * 90 + l_suppkey % 11) % 360 AS t, CASE WHEN l_quantity % 3 > 0 THEN l_quantity / 10 END AS s FROM lineitem),
    u AS (SELECT *, CASE WHEN t > 180 THEN t - 360 ELSE t END AS turn FROM r)
    SELECT k, n, CASE WHEN NOT required THEN '⚠ Anclas obligatorias no localizadas' WHEN NOT aligned THEN '⚠ No se pudo alinear (geometría no plausible)'
        ELSE concat_ws('; ', CASE WHEN abs(turn) >= 1 THEN 'Girado/enderezado ' || CASE WHEN turn > 0 THEN '+' ELSE '' END || CAST(CAST(turn AS BIGINT) AS VARCHAR) || '°' END, CASE WHEN s > 0 THEN 'Escalado ×' || printf('%.2f', s) END, 'Alineado a la plantilla') END AS trace FROM u""")
def pipeline_trace(spark, sf):
    t = records.trace(F.col("l_linenumber") % 5 > 0, F.col("l_suppkey") % 7 > 0, (F.col("l_partkey") % 4 * 90).cast("double"), (F.col("l_suppkey") % 11).cast("double"), F.when(F.col("l_quantity") % 3 > 0, F.col("l_quantity").cast("double") / 10))
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.array_join(t, "; ").alias("trace"))


@query("SELECT doc_id, substr(text, 1, 300) AS error FROM documents")
def error_data(spark, sf):
    return read(spark, sf, "documents").select("doc_id", records.error_data(F.col("text"))["_error"].alias("error"))


@query("SELECT o_orderstatus AS status, count(*) FILTER (o_totalprice > 100000) AS high, count(*) AS n, bool_and(o_totalprice > 0) AS every FROM orders GROUP BY 1")
def conditional_counts(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(F.col("o_totalprice") > 100_000).alias("high"), F.count("*").alias("n"), F.bool_and(F.col("o_totalprice") > 0).alias("every"))


@query("""WITH s AS (SELECT count(*) AS docs, sum(length(text)) AS i, sum(turn) AS o FROM conversations GROUP BY conv_id % 3), c AS (SELECT *, i / 1e6::DOUBLE * 0.27::DOUBLE + o / 1e6::DOUBLE * 1.10::DOUBLE AS usd FROM s)
    SELECT docs, CASE WHEN usd < 0.01 THEN printf('~$%.5f  (~%.5f €)', usd, usd * 0.93) ELSE printf('~$%.4f  (~%.4f €)', usd, usd * 0.93) END AS cost FROM c""")
def token_costs(spark, sf):
    c = read(spark, sf, "conversations")
    parts = [records.token_stats(c.where(F.col("conv_id") % 3 == k).select(F.char_length("text").alias("tokens_in"), F.col("turn").alias("tokens_out")), CONFIG) for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2]).where("docs > 0").select("docs", "cost")


@query("""WITH c AS (SELECT c_nationkey AS template_id, c_custkey // 2 AS document_id, 'k' || CAST(c_custkey % 2 AS VARCHAR) AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS value, c_custkey % 100 AS x FROM customer),
    e AS (SELECT template_id, document_id, string_agg(key || '=' || coalesce(value, '') || '@' || CAST(x AS VARCHAR), '; ' ORDER BY key) AS fields FROM c GROUP BY ALL)
    SELECT e.*, coalesce(s_comment, '') AS text, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM e LEFT JOIN (SELECT s_suppkey, s_name AS s_comment FROM supplier) ON s_suppkey = document_id""")
def learned_example_rows(spark, sf):
    c = read(spark, sf, "customer").selectExpr("c_nationkey as template_id", "c_custkey div 2 as document_id", "concat('k', c_custkey % 2) as key", "if(c_custkey % 5 = 0, null, c_name) as value", "named_struct('x', c_custkey % 100) as region")
    d = read(spark, sf, "supplier").selectExpr("s_suppkey as document_id", "s_name as text", "if(s_suppkey % 2 = 0, array(1D), null) as embedding")
    shown = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"], F.lit("@"), e["value"]["region"]["x"].cast("string")))
    return records.example_rows(c, d).select("template_id", "document_id", F.array_join(shown, "; ").alias("fields"), "text", F.size("embedding").alias("n"))


@query("SELECT c_custkey, to_json({'name': c_name, 'segment': CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END})::VARCHAR AS target FROM customer")
def example_targets(spark, sf):
    f = F.create_map(F.lit("name"), F.struct(F.col("c_name").alias("value"), F.lit(1).alias("region")), F.lit("segment"), F.struct(F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("value"), F.lit(2).alias("region")))
    return read(spark, sf, "customer").select("c_custkey", F.to_json(records.example_targets(f)).alias("target"))


@query("""SELECT p_partkey, p_brand = 'Brand#11' OR split_part(p_type, ' ', 1) = 'LARGE' AS installed FROM part""")
def model_installed(spark, sf):
    """Names match whole or before the colon."""
    from ..sources.providers import installed

    p = read(spark, sf, "part")
    models = F.array(F.replace("p_brand", F.lit("Brand#11"), F.lit("m")), F.concat(F.replace(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("LARGE"), F.lit("m")), F.lit(":latest")))
    return p.select("p_partkey", installed(F.lit("m"), models).alias("installed"))


@query("SELECT 'doc ' || doc_id AS key, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha256, true AS same FROM documents WHERE text IS NOT NULL")
def stored_files(spark, sf):
    """Documents written as files, one each, and read back by the rows that refer to them."""
    base = scratch(spark, "files")
    d = read(spark, sf, "documents")
    image_sink.write_files(d.select(F.concat(F.lit("doc "), "doc_id").alias("key"), F.lit("txt").alias("suffix"), F.encode("text", "utf-8").alias("content")), base)
    return image_sink.read_files(spark, base).select("key", "n_bytes", "sha256", (F.sha2("content", 256) == F.col("sha256")).alias("same"))


@query("""WITH e AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE o_orderkey % 7 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'update' END AS op,
        CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS acct, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS segment FROM orders WHERE o_custkey % 5 < 2),
    l AS (SELECT k, max(seq) FILTER (op <> 'update') AS since, arg_max(op, seq) FILTER (op <> 'update') AS last FROM e GROUP BY k),
    n AS (SELECT e.k, any_value(last) AS last, arg_max(acct, seq) FILTER (acct IS NOT NULL AND op <> 'delete' AND seq >= coalesce(since, -1)) AS acct, arg_max(segment, seq) FILTER (segment IS NOT NULL AND op <> 'delete' AND seq >= coalesce(since, -1)) AS segment FROM e JOIN l USING (k) GROUP BY e.k)
    SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN last = 'insert' THEN acct ELSE coalesce(acct, c_acctbal) END AS c_acctbal, CASE WHEN last = 'insert' THEN segment ELSE coalesce(segment, c_mktsegment) END AS c_mktsegment
    FROM (SELECT * FROM customer WHERE c_custkey % 9 > 0) FULL JOIN n ON c_custkey = k WHERE CASE WHEN last = 'delete' THEN false WHEN last = 'insert' THEN true ELSE c_custkey IS NOT NULL END""")
def changed_table(spark, sf):
    """Customers as a stored table, orders as inserts, updates and deletes of two fifths of them; the table read back."""
    c = read(spark, sf, "customer").where("c_custkey % 9 > 0").select("c_custkey", "c_acctbal", "c_mktsegment")
    stored = change_feed.StoredTable(spark, scratch(spark, "customers"), c.schema, "c_custkey").create(c)
    o = F.col("o_orderkey")
    events = read(spark, sf, "orders").where("o_custkey % 5 < 2").select(
        F.col("o_custkey").alias("c_custkey"), o.alias("seq"), F.when(o % 7 == 0, "delete").when(o % 7 == 1, "insert").otherwise("update").alias("op"),
        F.when(o % 3 > 0, F.col("o_totalprice")).alias("c_acctbal"), F.when(o % 4 > 0, F.col("o_orderpriority")).alias("c_mktsegment"),
    )
    stored.apply(events)
    return stored.read()


@query("""SELECT 'templates' AS t, count(*) AS before, CAST(1 AS BIGINT) AS after, 'datos IA' AS names FROM nation UNION ALL SELECT 'documents', count(*), 0, '' FROM documents UNION ALL SELECT 'records', count(*), 0, '' FROM orders""")
def reset_stored_tables(spark, sf):
    """Three stored tables, how many rows each has, and what is left of them once all are emptied."""
    rows = {"templates": _nations(spark, sf).select("id", "name"), "documents": read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("name")), "records": read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("").alias("name"))}
    base = scratch(spark, "tables")
    stored = {t: change_feed.StoredTable(spark, f"{base}/{t}", r.schema, "id").create(r) for t, r in rows.items()}
    before = {t: s.read().count() for t, s in stored.items()}
    change_feed.reset_all(stored, "templates", records.seeded(_nations(spark, sf).limit(0)).select("id", "name"))
    parts = [s.read().agg(F.lit(t).alias("t"), F.lit(before[t]).alias("before"), F.count("*").alias("after"), F.concat_ws(", ", F.array_sort(F.collect_list("name"))).alias("names")) for t, s in stored.items()]
    return parts[0].union(parts[1]).union(parts[2])
