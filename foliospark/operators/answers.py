"""What models answer: values by key, free values, suggested fields, and where they stand on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import bound, name_to_key, normal_value
from ..sources.providers import Provider, answer, embed
from .anchors import find_values
from .layout import gathered, met_by_page
from .lines import TABLE_TOLERANCE, group_lines, labelled_values, line_texts, unique_keys
from .retrieval import bare_json, parse_answer, prompts, top_examples, value_hints

#: Characters of a text that a free prompt holds, and of a label that names a field.
TEXT, NAME = 3000, 80
# Kinds of values, the kinds of a document that is not known or read by rules, the names in answers, and the confidence of a suggestion.
KINDS = ("text", "date", "number", "currency", "dni", "email", "phone")
UNKNOWN, DETECTED = "desconocido", "detectado"
KIND, DATA, FIELDS, CAMPOS = "tipo_documento", "datos", "fields", "campos"
CONFIDENCE = 85.0
KIND_KEY = "_" + KIND


def one_value(raw: Column) -> Column:
    """An answer without code fences if it is one JSON value, else null.

    Spark's readers stop behind the first value, so the text is read in brackets and in braces: if more follows, one of these breaks.
    """
    def checked(bare: Column) -> Column:
        listed = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>")
        named = F.from_json(F.concat(F.lit('{"v":'), bare, F.lit("}")), "map<string,string>")
        return F.when((F.size(listed) == 1) & (F.size(F.map_keys(named)) == 1), bare)

    return bound(bare_json(raw), checked)


def _last_of_each(entries: Column) -> Column:
    """A map of entries of which the last of each key counts."""
    last = lambda es, keys: F.map_from_entries(F.filter(es, lambda e, i: i == F.size(keys) - F.array_position(keys, e["key"])))
    return bound(entries, lambda es: bound(F.reverse(F.transform(es, lambda e: e["key"])), lambda keys: last(es, keys)))


def free_answer(raw: Column) -> Column:
    """kind and data (a map of strings) of a free answer; an answer that is no JSON object, or has text around it, has the unknown kind and no data. Of repeated keys the last counts."""
    def told(said: Column) -> Column:
        typed = F.transform(F.map_entries(F.from_json(said, "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), _as_text(e["value"]).alias("value")))
        plain = F.transform(F.map_entries(F.from_json(said, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("")).alias("value")))
        return F.coalesce(_last_of_each(F.coalesce(typed, plain)), F.create_map().cast("map<string,string>"))  # a value that repeats a key within itself is no variant

    def parts(top: Column) -> Column:
        data = bound(F.when(F.startswith(top[DATA], F.lit("{")), top[DATA]), told)
        return F.struct(F.coalesce(top[KIND], F.lit(UNKNOWN)).alias("kind"), data.alias("data"))

    return bound(_last_of_each(F.map_entries(F.from_json(one_value(raw), "map<string,string>"))), parts)


def _as_text(x: Column) -> Column:
    """A JSON value as text: nothing for null, false, zero and empty lists or objects; nested ones as JSON."""
    def told(s: Column) -> Column:
        kind, text = s["kind"], s["text"]
        number = kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
        empty = x.isNull() | (kind == "VOID") | text.isin("{}", "[]", "false") | (number & (x.try_cast("double") == 0))
        nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        return F.when(empty, "").when(nested, text).otherwise(F.coalesce(x.try_cast("string"), F.lit("")))

    return bound(F.struct(F.schema_of_variant(x).alias("kind"), F.to_json(x).alias("text")), told)


def suggested(raw: Column) -> Column:
    """Suggestions in an answer, as structs of label, value and data_type: a list, or that under the first of two keys which isn't empty. Those without label or value are dropped; an unknown type is text."""
    under = lambda v, key: F.try_variant_get(v, f"$.{key}", "array<variant>")
    some = lambda items: bound(items, lambda i: F.when(F.size(i) > 0, i))
    listed = lambda v: F.coalesce(some(under(v, FIELDS)), some(under(v, CAMPOS)), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    part = lambda x, key: F.trim(F.coalesce(F.try_variant_get(x, f"$.{key}", "string"), F.lit("")))
    kind = lambda x: bound(part(x, "data_type"), lambda t: F.when(t.isin(*KINDS), t).otherwise("text"))
    structs = F.transform(bound(F.try_parse_json(one_value(raw)), listed), lambda x: F.struct(part(x, "label").alias("label"), part(x, "value").alias("value"), kind(x).alias("data_type")))
    return F.filter(structs, lambda s: (s["label"] != "") & (s["value"] != ""))


def scattered_regions(words: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` (doc_id, page, value, ...) with box: around all words of the page that match one of the value's words; null where none does.

    Normalised words match if they are equal or, for a word of the value of three characters or more, one holds the other.
    """
    pages = gathered(words, lambda c: F.struct(normal_value(c("text")).alias("norm"), *[c(name) for name in "xywh"])).withColumn("ws", F.filter("ws", lambda w: w["norm"] != ""))
    targets = F.filter(F.transform(F.split("value", "[ \\t\\n\\r]+"), lambda t: normal_value(t)), lambda t: t != "")
    met = met_by_page(pages, values.withColumn("ts", targets).select("doc_id", "page", "value", "ts").distinct(), "vs").select("doc_id", "page", "ws", F.inline("vs"))
    near = lambda w, t: (w == t) | ((F.char_length(t) >= 3) & (F.contains(w, t) | F.contains(t, w)))
    met = met.withColumn("hit", F.filter("ws", lambda w: F.exists("ts", lambda t: near(w["norm"], t))))
    low = lambda c: F.array_min(F.transform("hit", lambda w: w[c]))
    high = lambda c, s: F.array_max(F.transform("hit", lambda w: w[c] + w[s]))
    box = F.struct(low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x")).alias("w"), (high("y", "h") - low("y")).alias("h"))
    boxes = met.select("doc_id", "page", "value", F.when(F.size("hit") > 0, box).alias("box"))
    return values.join(boxes, ["doc_id", "page", "value"], "left")


def extract_with_examples(texts: DataFrame, words: DataFrame, fields: DataFrame, examples: DataFrame, provider: Provider, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, page, key, value, box, used, error: values that a model reads with the help of similar confirmed examples.

    texts: doc_id, page (0), template, text; fields: template, ord, key, name; examples: id, template, text, values (a map). A page whose model
    call fails or answers no JSON object has empty values; one without an embedding uses no examples.
    """
    q, e = embed(texts, provider), embed(examples, provider)
    best = top_examples(q.select(F.col("doc_id").alias("id"), "template", F.col("embedding").alias("vector")), e.select("id", "template", F.col("embedding").alias("vector")), config.top_k)
    shots = best.join(examples.select(F.col("id").alias("example_id"), "text", "values"), "example_id").select("query_id", "rank", "text", "values")
    seen = examples.select("template", F.col("id").alias("ord"), F.explode("values").alias("key", "value"))
    said = answer(prompts(texts.select(F.col("doc_id").alias("query_id"), "template", "text"), fields, value_hints(seen), shots), provider)
    used = best.groupBy("query_id").agg(F.count("*").alias("used"))
    read = said.select("query_id", "error", parse_answer(F.col("answer")).alias("m")).join(used, "query_id", "left")
    rows = texts.select("doc_id", "page", "template").join(read, F.col("doc_id") == F.col("query_id")).join(fields.select("template", "key"), "template")
    values = rows.select("doc_id", "page", "key", F.coalesce(F.col("m")[F.col("key")], F.lit("")).alias("value"), F.coalesce("used", F.lit(0)).alias("used"), "error")
    return scattered_regions(words, values)


def extract_free(texts: DataFrame, words: DataFrame, provider: Provider) -> DataFrame:
    """doc_id, page, kind, key, value: what a model finds without a template; where it finds nothing, what the rules for labels find."""
    prompt = F.concat(F.lit(f'Tell the kind of this document and all its data, as one JSON object {{"{KIND}": "...", "{DATA}": {{"key": "value"}}}}.\n\nTEXT:\n'), F.left("text", F.lit(TEXT)))
    said = answer(texts.select("doc_id", "page", prompt.alias("prompt")), provider).select("doc_id", "page", free_answer(F.col("answer")).alias("f"))
    data = F.map_filter(F.col("f.data"), lambda _, v: v != "")
    said = said.select("doc_id", "page", F.col("f.kind").alias("kind"), data.alias("data"))
    told = said.select("doc_id", "page", "kind", F.explode("data").alias("key", "value"))
    silent = said.where(F.size("data") == 0).select("doc_id", "page")
    ruled = labelled_values(group_lines(words.join(silent, ["doc_id", "page"], "left_semi"))).where("sample_text <> ''")
    return told.unionByName(ruled.select("doc_id", "page", F.lit(DETECTED).alias("kind"), "key", F.col("sample_text").alias("value")))


def model_suggestions(words: DataFrame, provider: Provider) -> DataFrame:
    """Fields that a model suggests for pages, line by line, and that are found on them: doc_id, page, ordinal, key, name, data_type, sample_text, box, confidence."""
    across = line_texts(group_lines(words, TABLE_TOLERANCE))
    pages = across.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    prompt = F.concat(F.lit(f'List the fields of this document as {{"{FIELDS}": [{{"label": "...", "value": "...", "data_type": "..."}}]}}; copy values as they stand.\n\nTEXT:\n'), F.left("text", F.lit(TEXT)))
    said = answer(pages.select("doc_id", "page", prompt.alias("prompt")), provider)
    found = said.select("doc_id", "page", F.posexplode(suggested(F.col("answer"))).alias("nth", "s")).select("doc_id", "page", "nth", "s.*")
    placed = found.join(find_values(words, found.select("doc_id", "page", "value")), ["doc_id", "page", "value"])
    order = placed.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("nth", name_to_key(F.col("label")).alias("base"), "label", "data_type", "value", "box"))).alias("all"))
    order = order.withColumn("keys", unique_keys(F.transform("all", lambda s: s["base"])))
    out = order.select("doc_id", "page", "keys", F.posexplode("all").alias("ordinal", "s"))
    return out.select("doc_id", "page", F.col("ordinal").cast("long").alias("ordinal"), F.expr("keys[ordinal]").alias("key"), F.left("s.label", F.lit(NAME)).alias("name"), "s.data_type", F.col("s.value").alias("sample_text"), "s.box", F.lit(CONFIDENCE).alias("confidence"))
