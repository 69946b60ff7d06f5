"""Similar confirmed examples, and the prompts built from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship_package
from ..storage import small_enough
from .retrieval_index import top_examples_indexed

SHOT, QUESTION, HINTS = 800, 2000, 5
#: Most queries that are sent to every task, and queries and examples scored at a time.
MOST_QUERIES, AT_ONCE = 20_000, 1000


def top_examples(queries: DataFrame, examples: DataFrame, k: int, by_template: bool = True) -> DataFrame:
    """query_id, example_id, score, rank of the k examples nearest to each query.

    Both have an id, a template and a vector. Examples without vector are skipped; one of another length scores 0 but
    stays in the ranking; ties go to the smaller id. With ``by_template`` only examples of the
    query's template count. Up to MOST_QUERIES queries go to all tasks, which score batches of examples by products of matrices and keep
    the best k of every query, so that neither pairs nor examples are shuffled; more queries go through an index
    (:func:`foliospark.operators.retrieval_index.top_examples_indexed`), with the same result.
    """
    if not small_enough(queries, MOST_QUERIES):
        return top_examples_indexed(queries, examples, k, by_template)[0]
    e = examples.where("size(vector) > 0").select(F.col("id").alias("example_id"), F.col("template").alias("e_template"), F.col("vector").cast("array<double>").alias("ev"))
    q = queries.select(F.col("id").alias("query_id"), F.col("template").alias("q_template"), F.col("vector").cast("array<double>").alias("qv"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "example_id")
    return _best_in_tasks(q, e, k, by_template).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_in_tasks(q: DataFrame, e: DataFrame, k: int, by_template: bool) -> DataFrame:
    spark = q.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast([(r.query_id, r.q_template, r.qv or []) for r in q.orderBy("query_id").collect()])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        score, found = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                for lo in range(0, len(asked), AT_ONCE):
                    part = slice(lo, lo + AT_ONCE)
                    score[part], found[part] = _merged(asked[part], some, k, by_template, score[part], found[part])
        at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array([asked[i][0] for i in at[0]], pa.int64()), pa.array(found[at]), pa.array(score[at])], names=["query_id", "example_id", "score"])

    return e.select(F.col("example_id").cast("long"), "e_template", "ev").mapInArrow(best, "query_id long, example_id long, score double")


def _merged(asked: list[tuple], some: pa.RecordBatch, k: int, by_template: bool, score: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best k of those found so far and of a batch of examples; of equal scores the smaller identifier."""
    ids, templates, vectors = some.column(0).to_numpy(), some.column(1).to_pylist(), some.column(2).to_pylist()
    new = np.zeros((len(asked), len(ids)))
    for d in {len(v) for v in vectors} & {len(v) for _, _, v in asked}:
        rows, cols = [i for i, (_, _, v) in enumerate(asked) if len(v) == d], [j for j, v in enumerate(vectors) if len(v) == d]
        x, y = np.array([asked[i][2] for i in rows], float), np.array([vectors[j] for j in cols], float)
        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            new[np.ix_(rows, cols)] = np.where(norm > 0, np.round(x @ y.T / norm, 6), 0.0)
    if by_template:
        kinds = {t: n for n, t in enumerate({t for t in templates if t is not None})}
        own, other = np.array([kinds.get(t, -1) for _, t, _ in asked]), np.array([kinds.get(t, -2) for t in templates])
        new[own[:, None] != other] = -np.inf
    all_ids = np.concatenate([found, np.broadcast_to(ids, new.shape)], axis=1)
    all_scores = np.concatenate([score, new], axis=1)
    line, out_score, out_ids = np.arange(len(asked)), score.copy(), found.copy()
    for n in range(k):
        top = all_scores.max(1)
        at = np.where(all_scores == top[:, None], all_ids, np.iinfo(np.int64).max).argmin(1)
        out_score[:, n], out_ids[:, n] = top, all_ids[line, at]
        all_scores[line, at] = -np.inf
    return out_score, out_ids


def value_hints(examples: DataFrame) -> DataFrame:
    """template, key, hints: the first different values of each key that aren't empty, in order of examples (ord, key, value)."""
    first = examples.where("value <> ''").groupBy("template", "key", "value").agg(F.min("ord").alias("ord"))
    order = Window.partitionBy("template", "key").orderBy("ord", "value")
    return first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= HINTS).groupBy("template", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]), ", ").alias("hints"))


def prompts(questions: DataFrame, fields: DataFrame, hints: DataFrame, shots: DataFrame) -> DataFrame:
    """query_id, prompt: the task, the template's keys, hints, confirmed examples and the text.

    questions: query_id, template, text; fields: template, ord, key, name; hints as above; shots: query_id, rank, text, values (a map).
    """
    lines = lambda col: F.array_join(F.transform(F.array_sort(F.collect_list(col)), lambda s: s["line"]), "\n")
    keys = fields.groupBy("template").agg(lines(F.struct("ord", F.concat(F.lit('- "'), "key", F.lit('": '), "name").alias("line"))).alias("keys"))
    seen = hints.groupBy("template").agg(lines(F.struct("key", F.concat(F.lit('- "'), "key", F.lit('": '), "hints").alias("line"))).alias("seen"))
    told = shots.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("TEXT:\n"), F.left("text", F.lit(SHOT)), F.lit("\nJSON:\n"), F.to_json("values")).alias("line")))), lambda s: s["line"]), "\n\n").alias("told"))
    q = questions.join(keys, "template", "left").join(seen, "template", "left").join(told, "query_id", "left")
    return q.select("query_id", F.concat(
        F.lit("Read the values of these keys from the text and answer with one JSON object. A value that is missing is empty.\n\nKEYS:\n"), F.coalesce("keys", F.lit("")),
        F.lit("\n\nSEEN:\n"), F.coalesce("seen", F.lit("(none)")), F.lit("\n\nEXAMPLES:\n"), F.coalesce("told", F.lit("(none)")), F.lit("\n\nTEXT:\n"), F.left("text", F.lit(QUESTION)),
    ).alias("prompt"))


def bare_json(raw: F.Column) -> F.Column:
    """A model's answer without the fences of a code block."""
    return F.regexp_replace(F.regexp_replace(F.trim(raw), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", "")


def parse_answer(raw: F.Column) -> F.Column:
    """The values of a model's JSON answer as a map of strings: fences stripped, {"value": ...} unwrapped; null for anything but an object."""
    bare = bare_json(raw)
    flat = F.when(F.startswith(bare, F.lit("{")), F.from_json(bare, "map<string,string>"))
    return F.transform_values(flat, lambda _, v: F.coalesce(F.when(F.startswith(v, F.lit("{")), F.get_json_object(v, "$.value")), v, F.lit("")))
