"""Records of processed pages: review rules, listings, and changes as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..storage import materialize


def field_count(data: Column) -> Column:
    """Keys that don't begin with an underscore."""
    return F.size(F.filter(F.map_keys(data), lambda k: ~F.startswith(k, F.lit("_"))))


def needs_review(data: Column, has_template: Column, score: Column, confidence: Column, anchor_review: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Anchors say so, the match is weak, no field has a value, or the values were read with little confidence."""
    empty = ~F.exists(F.map_entries(data), lambda e: ~F.startswith(e["key"], F.lit("_")) & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))
    return anchor_review | (has_template & (score < config.match_threshold)) | empty | (has_template & (confidence < config.review_below))


def status(review: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(review, "review").otherwise("done")


def average_confidence(values: DataFrame) -> DataFrame:
    """doc_id, page, avg_confidence over values that aren't empty, 0 if all are."""
    return values.groupBy("doc_id", "page").agg(F.coalesce(F.avg(F.when(F.col("value") != "", F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"))


def merged_data(read: Column, answered: Column) -> Column:
    """Values read from the page, overridden by a model's where these aren't empty."""
    over = F.map_filter(answered, lambda _, v: v != "")
    return F.map_concat(F.map_filter(read, lambda k, _: ~F.map_contains_key(over, k)), over)


def list_jobs(records: DataFrame, templates: DataFrame, documents: DataFrame) -> DataFrame:
    """Records with their template's name (null if missing, a dash in a listing by :func:`listed_name`) and file name (a dash if missing)."""
    t = templates.select(F.col("id").alias("template_id"), F.col("name").alias("template_name"))
    d = documents.select(F.col("id").alias("document_id"), "filename")
    return records.join(t, "template_id", "left").join(d, "document_id", "left").withColumn("filename", F.coalesce("filename", F.lit("—")))


def listed_name(name: Column) -> Column:
    """A name in a listing, a dash if there is none."""
    return F.coalesce(name, F.lit("—"))


# What a state is called.
STATES = {
    "processing": "Procesando (OCR + IA)…",
    "review": "⚠ Revisar",
    "done": "✓ Listo",
    "confirmed": "✓ Confirmado",
    "error": "✗ Error",
}
# The universal template, and the name of the key that holds a document's kind.
UNIVERSAL = "datos IA"
KIND_NAME = "📋 Tipo de documento"


def state_label(state: Column) -> Column:
    """What a state is called; an unknown one is called by itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[state], state)


def first_matching(table: DataFrame, condition, *order) -> DataFrame:
    """The first row that meets a condition, in the order given, or none."""
    return table.where(condition).orderBy(*order).limit(1)


def seeded(templates: DataFrame) -> DataFrame:
    """Templates (id, name, is_universal, border) with the universal one, added behind the greatest id if there is none."""
    one = templates.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.coalesce(F.bool_or("is_universal"), F.lit(False)).alias("there"))
    border = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("xywh", (0, 0, 100_000, 100_000))])
    new = one.where("not there").select((F.col("top") + 1).cast("long").alias("id"), F.lit(UNIVERSAL).alias("name"), F.lit(True).alias("is_universal"), border.alias("border"))
    return templates.select("id", "name", "is_universal", "border").unionByName(new)


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables empty, but for the universal template."""
    empty = {name: table.limit(0) for name, table in tables.items()}
    return empty | {"templates": seeded(empty["templates"])}


def deletable(templates: DataFrame) -> DataFrame:
    """Templates that may be deleted: all but the universal one."""
    return templates.where(~F.coalesce("is_universal", F.lit(False)))


def with_samples(templates: DataFrame, documents: DataFrame, *columns: str) -> DataFrame:
    """Templates whose own values of some columns come before those of their sample document (sample_id to id); null without either."""
    d = documents.select(F.col("id").alias("_sample"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = templates.join(d, F.col("sample_id") == F.col("_sample"), "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in templates.columns])


def field_names(values: DataFrame, fields: DataFrame) -> DataFrame:
    """Values (template_id, key) with name: the field's own, the kind's for _tipo_documento, an inner key without its underscore, else the key."""
    f = fields.select("template_id", "key", F.col("name").alias("_name"))
    name = F.when(F.col("key") == "_tipo_documento", KIND_NAME).when(F.startswith("key", F.lit("_")), F.substr("key", F.lit(2))).otherwise(F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col("key")))
    return values.join(f, ["template_id", "key"], "left").withColumn("name", name).drop("_name")


def overlaid(read: Column, saved: Column) -> Column:
    """Values read (a map) under values saved, which come first, blank or not; null saves nothing."""
    return F.when(saved.isNull(), read).otherwise(F.map_concat(F.map_filter(read, lambda k, _: ~F.map_contains_key(saved, k)), saved))


def trace(aligned: Column, required: Column, prerotate: Column, rotation: Column, scale: Column) -> Column:
    """What was done to a page, as texts in order."""
    turn = F.pmod(prerotate + rotation, F.lit(360.0))
    turn = F.when(turn > 180, turn - 360).otherwise(turn)
    done = F.array(
        F.when(F.abs(turn) >= 1, F.concat(F.lit("Girado/enderezado "), F.format_string("%+.0f", turn), F.lit("°"))),
        F.when(F.coalesce(scale, F.lit(0.0)) != 0, F.concat(F.lit("Escalado ×"), F.format_string("%.2f", scale))),
        F.lit("Alineado a la plantilla"),
    )
    return F.when(~required, F.array(F.lit("⚠ Anclas obligatorias no localizadas"))).when(aligned, F.array_compact(done)).otherwise(F.array(F.lit("⚠ No se pudo alinear (geometría no plausible)")))


def error_data(error: Column) -> Column:
    """The data of a record whose job failed: the first 300 characters of the error."""
    return F.create_map(F.lit("_error"), F.left(error, F.lit(300)))


def example_rows(confirmed: DataFrame, documents: DataFrame) -> DataFrame:
    """Examples of confirmed records: template_id, document_id, fields (key to value and region), text, embedding.

    confirmed: template_id, document_id, key, value, region; documents: document_id, text, embedding (null if no model answered: an empty one is kept).
    """
    fields = confirmed.groupBy("template_id", "document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct(F.coalesce("value", F.lit("")).alias("value"), "region").alias("v"))))).alias("fields"))
    return fields.join(documents, "document_id", "left").select("template_id", "document_id", "fields", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"))


def example_targets(fields: Column) -> Column:
    """The values alone of an example's fields."""
    return F.transform_values(fields, lambda _, v: v["value"])


def with_counts(parents: DataFrame, children: DataFrame, fk: str, name: str) -> DataFrame:
    counts = children.groupBy(F.col(fk).alias("_fk")).agg(F.count("*").alias(name))
    return parents.join(counts, F.col("id") == F.col("_fk"), "left").drop("_fk").withColumn(name, F.coalesce(name, F.lit(0)))


def append_with_ids(table: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New rows behind the greatest id, in ``order``: dense within range partitions, whose offsets come from their counts.

    The ranked rows are written once, so that counts and ranks are of the same partitions.
    """
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    placed = new.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranked = materialize(placed.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "ranked")
    sizes = ranked.groupBy("_part").agg(F.max("_r").alias("n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return table.unionByName(ranked.join(F.broadcast(before), "_part").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("before") + F.col("_r")).select(table.columns))


def updated(table: DataFrame, changes: DataFrame, key: str, keep_zero: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the changes that aren't null; in ``keep_zero`` columns a 0 changes nothing either."""
    own = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in own])
    pick = lambda c: F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit(0)) if c in keep_zero else F.col(f"_new_{c}"), F.col(c)).alias(c) if c in own else F.col(c)
    return table.join(new, key, "left").select(*[pick(c) for c in table.columns])


def deleted(table: DataFrame, gone: DataFrame, key: str, fk: str | None = None) -> DataFrame:
    """Rows whose key (or foreign key) isn't among those deleted."""
    return table.join(gone.select(F.col(key).alias(fk or key)), fk or key, "left_anti")


def unlinked(table: DataFrame, gone: DataFrame, key: str, fk: str) -> DataFrame:
    """Rows with the foreign key set to null where it was deleted."""
    lost = gone.select(F.col(key).alias("_lost")).distinct()
    return table.join(lost, F.col(fk) == F.col("_lost"), "left").withColumn(fk, F.when(F.col("_lost").isNull(), F.col(fk))).drop("_lost")


def learned(fields: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Template fields after confirmed records (template_id, key, value, x, y, w, h, ord).

    A known key takes the last value that isn't empty as its sample and keeps its place; a
    new key becomes a field at the first place it was seen.
    """
    last = confirmed.groupBy("template_id", "key").agg(
        F.max_by("value", F.when(F.coalesce("value", F.lit("")) != "", F.col("ord"))).alias("value"),
        F.min_by(F.struct("x", "y", "w", "h"), "ord").alias("box"),
    )
    both = fields.withColumn("_known", F.lit(True)).join(last, ["template_id", "key"], "full")
    place = lambda c: F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"box.{c}")).alias(c)
    return both.select("template_id", "key", *[place(c) for c in ("x", "y", "w", "h")], F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("sample_text"), F.lit("")).alias("sample_text"))


def token_stats(usage: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """docs, tokens in and out, their rounded averages, and the cost as text."""
    return with_costs(usage.agg(F.count("*").alias("docs"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out")), config)


def with_costs(s: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Counters (docs, tokens_in, tokens_out) with averages and the cost as text, as :func:`token_stats` has them."""
    cost = F.col("tokens_in") * config.price_in / 1e6 + F.col("tokens_out") * config.price_out / 1e6
    shown = lambda c: F.when(cost < 0.01, F.format_string("%.5f", c)).otherwise(F.format_string("%.4f", c))
    avg = lambda c: F.when(F.col("docs") > 0, F.floor(F.col(c) / F.col("docs") + 0.5)).otherwise(0).cast("long")
    return s.select("*", avg("tokens_in").alias("avg_in"), avg("tokens_out").alias("avg_out"), F.when(F.col("docs") == 0, "—").otherwise(F.concat(F.lit("~$"), shown(cost), F.lit("  (~"), shown(cost * config.euro), F.lit(" €)"))).alias("cost"))
