"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tool_calls import calls_in, link_tool_calls, tool_schemas

    calls, results = calls_in(table(spark, sf_dir, "conversations"))
    linked = link_tool_calls(calls, results, tool_schemas(spark))
    return linked.withColumn("errors", F.concat_ws(", ", "errors"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    made = warc.describe(warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "block_digest", "source_payload_digest", "content_length", F.sha2("content", 256).alias("content_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import round_trip_digests
    from .word_tokens import default_path

    return round_trip_digests(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, with_crc32, write_token_files
    from .word_tokens import default_path

    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, default_path("word_bpe_49k.json"))
    return with_crc32(read_token_files(spark, path))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces
    from .word_tokens import default_path

    return pack(pieces(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = table(spark, sf_dir, "documents")
    return language.identify_language(docs, language.fit(docs))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    pages = table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.fit(pages))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))[0]


def op13_kdtree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_tool_calls": op1_tool_calls, "op2_exact_dedup": op2_exact_dedup, "op3_embedding_dedup": op3_embedding_dedup, "op4_quality_classifier": op4_quality_classifier, "op5_warc_derivatives": op5_warc_derivatives, "op6_byte_bpe": op6_byte_bpe, "op7_token_files": op7_token_files, "op8_language_id": op8_language_id, "op9_pattern_packing": op9_pattern_packing, "op10_jaccard_join": op10_jaccard_join, "op11_html_text": op11_html_text, "op12_vector_codes": op12_vector_codes, "op13_kdtree_clusters": op13_kdtree_clusters}

_INTEGER = """SELECT *, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_FAR = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Each round as a table of its own: entries by part, and the nearest of each vector's parts."""
    ctes = [
        f"k AS ({_INTEGER})",
        f"p AS (SELECT vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(part))",
        f"b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < {entries})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS (SELECT a.vec_id, a.part, any_value(a.label) AS label, any_value(a.v) AS v, min({{'far': {_FAR}, 'entry': b.entry}}) AS near FROM p a JOIN b{r} b ON a.part = b.part GROUP BY a.vec_id, a.part)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT part, entry, list(mean ORDER BY place) AS v FROM (SELECT part, near.entry AS entry, place, CAST(floor(sum(v[place]) / count(*)) AS BIGINT) AS mean FROM a{r}, range(1, len(v) + 1) t(place) GROUP BY ALL) GROUP BY ALL)")
            ctes.append(f"b{r + 1} AS (SELECT b.part, b.entry, coalesce(m{r}.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} USING (part, entry))")
    ctes += [
        f"s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})",
        f"e AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', near.entry), '' ORDER BY part) AS code, CAST(sum(near.far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)",
    ]
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, s"


def _clusters_sql(centroids: int = 40, rounds: int = 5) -> str:
    ctes = [f"p AS (SELECT vec_id, v FROM ({_INTEGER}) WHERE len(v) = 64)", f"b0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM p QUALIFY c < {centroids})"]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS (SELECT a.vec_id, any_value(a.v) AS v, min({{'far': {_FAR}, 'c': b.c}}) AS near FROM p a, b{r} b GROUP BY a.vec_id)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT c, list(mean ORDER BY place) AS v FROM (SELECT near.c AS c, place, CAST(floor(sum(v[place]) / count(*)) AS BIGINT) AS mean FROM a{r}, range(1, 65) t(place) GROUP BY ALL) GROUP BY ALL)")
            ctes.append(f"b{r + 1} AS (SELECT b.c, coalesce(m{r}.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} USING (c))")
    return f"""WITH {', '.join(ctes)}
        SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, CAST(near.far AS BIGINT) AS distance, CAST(sum(near.far) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(near.far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(b.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN b{rounds} b ON b.c = a.near.c"""


#: The article that these pages mark, block by block.
_TEXT = """
        WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS raw FROM pages),
        b AS (SELECT page_id, url, unnest(raw) AS t, generate_subscripts(raw, 1) AS n FROM a),
        c AS (SELECT page_id, url, n, regexp_replace(replace(t, '<br>', ' '), '<[^>]*>', '', 'g') AS t FROM b),
        d AS (SELECT page_id, url, n, trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM c),
        e AS (SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY n) FILTER (WHERE t <> ''), '') AS text FROM d GROUP BY page_id, url)
        SELECT page_id, url, text, length(text) AS n_chars FROM e
    """

SQL = {
    "op11_html_text": _TEXT,
    "op12_vector_codes": _codes_sql(),
    "op13_kdtree_clusters": _clusters_sql(),
    "op1_tool_calls": """
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, min(text) AS text, min(length(coalesce(text, ''))) AS n, ['lookup', 'search', 'translate'][turn % 3 + 1] AS name
            FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
        d AS (SELECT conv_id, turn, turn - 2 AS used FROM c UNION ALL SELECT conv_id, turn, turn - 4 FROM c WHERE turn % 4 = 0),
        u AS (SELECT d.* FROM d SEMI JOIN c ON c.conv_id = d.conv_id AND c.turn = d.used),
        w AS (SELECT conv_id, turn, 0 AS level FROM c ANTI JOIN u USING (conv_id, turn)
              UNION SELECT u.conv_id, u.turn, w.level + 1 FROM w JOIN u ON u.conv_id = w.conv_id AND u.used = w.turn),
        l AS (SELECT conv_id, turn, max(level) AS level FROM w GROUP BY ALL),
        r AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
        e AS (SELECT c.*, l.level, r.turn AS result_turn, r.text AS content,
            list_concat(
              CASE WHEN c.text IS NULL THEN ['missing query'] ELSE [] END, CASE WHEN name = 'translate' THEN ['missing target'] ELSE [] END,
              CASE WHEN n % 7 = 0 OR name = 'lookup' AND (n % 60 < 1 OR n % 60 > 50) OR name = 'search' AND n % 60 > 40 THEN ['invalid limit'] ELSE [] END,
              CASE WHEN c.text IS NOT NULL AND (name <> 'search' AND n < 1 OR name = 'search' AND n > 400) THEN ['invalid query'] ELSE [] END,
              CASE WHEN name = 'translate' THEN ['unknown options'] WHEN n % 11 = 0 THEN ['invalid options'] ELSE [] END) AS errors,
            '{"limit":' || CASE WHEN n % 7 = 0 THEN to_json(CAST(n % 60 AS VARCHAR)) ELSE to_json(n % 60) END || ',"options":' || CASE WHEN n % 11 = 0 THEN 'true' ELSE to_json({'b': n % 2 = 0, 'z': n % 5}) END
                || CASE WHEN c.text IS NULL THEN '' ELSE ',"query":' || to_json(c.text) END || '}' AS arguments,
            CASE WHEN c.turn % 4 = 0 THEN list_sort(['call_' || conv_id || '_' || (turn - 2), 'call_' || conv_id || '_' || (turn - 4)]) ELSE ['call_' || conv_id || '_' || (turn - 2)] END AS depends_on
            FROM c JOIN l USING (conv_id, turn) LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1)
        SELECT conv_id, 'call_' || conv_id || '_' || turn AS call_id, turn, name, CAST(level AS BIGINT) AS level, result_turn, len(errors) = 0 AS valid, array_to_string(errors, ', ') AS errors,
            CAST(to_json({'arguments': CAST(arguments AS JSON),
                'depends_on': depends_on, 'errors': errors, 'id': 'call_' || conv_id || '_' || turn, 'name': name,
                'result': CASE WHEN result_turn IS NOT NULL THEN {'content': content, 'turn': result_turn} END, 'turn': turn, 'valid': len(errors) = 0}) AS VARCHAR) AS json
        FROM e
    """,
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n FROM documents),
        w AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
                     count(*) OVER (PARTITION BY n) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM w
    """,
    "op10_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.to_id)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(to_id) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
}
