"""Lines of words, and fields read from them: labels with values, codes with values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import div_round
from ..functions.text import KEYWORDS, bound, guess_type, is_code, is_decoration, is_label, is_prose, label_kind, label_to_name, name_to_key, normal_labels
from .layout import gathered, unfolded

WORD = "struct<y:bigint,x:bigint,w:bigint,h:bigint,conf:bigint,text:string>"
TOLERANCE, TABLE_TOLERANCE = 1000, 1200
#: A value in a table has at most so many words, and its sample so many characters.
VALUE_WORDS, SAMPLE = 8, 120


def group_lines(words: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """doc_id, page, line, ws: the words of each line.

    Words are taken by y, then x; a word starts a line when its y is ``tolerance`` or more away from
    the first y of the current line. That depends on where the line began, so a page's words,
    a bounded number, are folded; the fold keeps only the places where lines begin.
    """
    pages = gathered(words, lambda c: F.struct(*[c(name) for name in ("y", "x", "w", "h", "conf", "text")]))
    starts = F.expr(f"""aggregate(ws, named_struct('y0', cast(null as bigint), 'at', 1, 'starts', cast(array() as array<int>)),
        (s, v) -> if(s.y0 is not null and abs(v.y - s.y0) < {tolerance}, named_struct('y0', s.y0, 'at', s.at + 1, 'starts', s.starts),
            named_struct('y0', v.y, 'at', s.at + 1, 'starts', concat(s.starts, array(s.at)))), s -> s.starts)""")
    cut = unfolded(pages.select("doc_id", "page", "ws", starts.alias("starts")), "starts", "line", "start")
    return cut.select("doc_id", "page", "line", F.expr("slice(ws, start, coalesce(get(starts, line + 1), size(ws) + 1) - start)").alias("ws"))


def line_texts(lines: DataFrame) -> DataFrame:
    """doc_id, page, line, text: the words of each line from left to right."""
    across = F.expr("array_sort(transform(ws, v -> struct(v.x as x, v.y as y, v.text as text)))")
    return lines.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.array_join(F.transform(across, lambda v: v["text"]), " ").alias("text"))


def _box(ws: str) -> str:
    return f"""transform(array(struct(array_min(transform({ws}, v -> v.x)) as x, array_min(transform({ws}, v -> v.y)) as y, array_max(transform({ws}, v -> v.x + v.w)) as r, array_max(transform({ws}, v -> v.y + v.h)) as b)),
        e -> struct(e.x as x, e.y as y, e.r - e.x as w, e.b - e.y as h))[0]"""


def _joined(ws: str) -> str:
    return f"array_join(transform({ws}, v -> v.text), ' ')"


def _taken(bases: Column, used: Column) -> Column:
    """``used`` and behind it a key for each base: the base itself or with the first free of _2, _3, ...

    No more numbers are tried than keys so far begin with the base.
    """
    numbered = lambda base, i: F.when(i == 1, base).otherwise(F.concat(base, F.lit("_"), i.cast("string")))
    like = lambda used, base: F.size(F.filter(used, lambda u: F.startswith(u, base)))
    free = lambda used, base: F.element_at(F.filter(F.transform(F.sequence(F.lit(1), like(used, base) + 1), lambda i: numbered(base, i)), lambda k: ~F.array_contains(used, k)), 1)
    return F.aggregate(bases, used, lambda used, base: F.concat(used, F.array(F.when(F.array_contains(used, base), free(used, base)).otherwise(base))))


def unique_keys(bases: Column) -> Column:
    """The keys of one list in order: each the base itself or with the first free of _2, _3, ...

    Where numbering the repeats of each base already gives different keys, these are the ones; only where such a key stands as
    a base too are the keys folded one by one.
    """
    nth = lambda bs, b, i: i + 1 - F.size(F.array_remove(F.slice(bs, F.lit(1), i + 1), b))
    key = lambda b, n: F.when(n == 1, b).otherwise(F.concat(b, F.lit("_"), n.cast("string")))
    counted = lambda bs: F.transform(F.transform(bs, lambda b, i: F.struct(b.alias("b"), nth(bs, b, i).alias("n"))), lambda s: key(s["b"], s["n"]))
    none = F.array().cast("array<string>")
    return bound(bases, lambda bs: bound(counted(bs), lambda ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), ks).otherwise(_taken(bs, none))))


def labelled_values(lines: DataFrame) -> DataFrame:
    """Values behind labels: doc_id, page, ordinal, key, name, data_type, sample_text, confidence, label_text, box, label_box, rule.

    On a line of two words or more the first keyword makes what follows it a value; at its beginning the first
    two or three words can be one keyword. Otherwise, and unless the label found last begins this line, what follows
    the first word with a colon is a value.
    """
    w = lines.withColumn("n", F.size("ws")).withColumn("text", F.expr(_joined("ws"))).withColumn("whole", normal_labels(F.transform("ws", lambda v: v["text"])))
    w = w.withColumn("norms", F.transform("whole", lambda n: F.rtrim(n, F.lit(":"))))
    first = lambda k: F.when(F.greatest(*[F.col("ws")[i]["text"].isNull() for i in range(k)]), F.lit("")).otherwise(F.concat(*[F.col("whole")[i] for i in range(k)]))
    w = w.withColumn("phrase", F.when(F.col("n") >= 3, F.coalesce(label_kind(first(2)), label_kind(first(3)))))
    known = F.filter(F.transform("norms", lambda n, j: F.when((j + 1 < F.col("n")) & is_label(n), j)), lambda j: j.isNotNull())
    w = w.withColumn("j", F.when(F.col("n") >= 2, F.when(F.col("phrase").isNotNull(), 0).when(F.arrays_overlap("norms", F.array(*map(F.lit, KEYWORDS))), F.get(known, F.lit(0)))))
    w = w.withColumn("kind", F.coalesce(label_kind(F.expr("norms[j]")), F.when(F.col("j") == 0, F.col("phrase"))))
    label = "rtrim(':', " + _joined("slice(ws, 1, {0} + 1)") + ")"
    w = w.withColumn("c", F.expr("if(contains(text, ':'), get(filter(sequence(0, n - 1), j -> contains(ws[j].text, ':') and j + 1 < n and n >= 2 and char_length(trim(" + label.format("j") + ")) >= 2), 0), null)"))

    def found(at: str, base: str, name: str, rule: str) -> str:
        cut = f"array(struct(slice(ws, {at} + 2, n) as value, slice(ws, 1, {at} + 1) as head))"
        return f"""if({at} is null, null, transform({cut}, u -> struct({base} as base, {name} as name, trim({_joined('u.value')}) as sample_text, aggregate(u.value, 0L, (s, v) -> s + v.conf) as total, size(u.value) as k,
            trim(rtrim(':', {_joined('u.head')})) as label_text, {_box('u.value')} as box, {_box('u.head')} as label_box, '{rule}' as rule))[0])"""

    w = w.withColumn("colon_label", F.expr(f"trim({label.format('c')})")).withColumn("colon_key", name_to_key(F.col("colon_label"))).withColumn("word_name", label_to_name(F.expr("norms[j]")))
    w = w.withColumn("x5", F.expr(found("j", "kind", "word_name", "keyword"))).withColumn("x6", F.expr(found("c", "colon_key", "left(colon_label, 50)", "colon")))
    kind = "struct<base:string,name:string,sample_text:string,total:bigint,k:int,label_text:string,box:struct<x:bigint,y:bigint,w:bigint,h:bigint>,label_box:struct<x:bigint,y:bigint,w:bigint,h:bigint>,rule:string>"
    w = w.withColumn("x5", F.col("x5").cast(kind)).withColumn("x6", F.col("x6").cast(kind))
    some = F.when(F.col("x5").isNotNull() | F.col("x6").isNotNull(), F.struct("line", "text", "x5", "x6"))  # no filter: Spark would move it below, and compute what it asks for once more for each word
    pages = w.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(some)).alias("ls"))
    fold = F.expr(f"""aggregate(ls, cast(array() as array<{kind}>), (out, l) -> concat(out,
        if(l.x5 is not null, array(l.x5), cast(array() as array<{kind}>)),
        if(l.x6 is not null and not coalesce(startswith(l.text, nullif(if(l.x5 is not null, l.x5.label_text, if(size(out) > 0, try_element_at(out, -1).label_text, null)), '')), false), array(l.x6), cast(array() as array<{kind}>))))""")
    out = pages.select("doc_id", "page", fold.alias("found")).withColumn("keys", unique_keys(F.transform("found", lambda s: s["base"])))
    out = unfolded(out.select("doc_id", "page", "keys", "found"), "found", "ordinal", "s")
    return out.select(
        "doc_id", "page", F.col("ordinal").cast("long").alias("ordinal"), F.expr("keys[ordinal]").alias("key"), "s.name", guess_type(F.col("s.sample_text")).alias("data_type"), "s.sample_text",
        (div_round(10 * F.col("s.total"), F.col("s.k")) / 10).alias("confidence"), "s.label_text", "s.box", "s.label_box", "s.rule",
    )


def code_values(lines: DataFrame) -> DataFrame:
    """Codes of table rows with their values: doc_id, page, line, ordinal, key, name, data_type, sample_text, confidence, box, label_box.

    A value runs from its code to the next one, a decorative word, or VALUE_WORDS words. Values without a letter or digit and prose are dropped.
    """
    across = F.expr("array_sort(transform(ws, v -> struct(v.x as x, v.y as y, v.w as w, v.h as h, v.conf as conf, v.text as text)))")
    # a list that a lambda looks things up in would be made again for each of them, so that each word's test stands where the word is
    w = lines.select("doc_id", "page", "line", across.alias("ws")).withColumn("at", F.filter(F.transform("ws", lambda v, i: F.when(is_code(v["text"]), i)), lambda i: i.isNotNull()))
    w = unfolded(w, "at", "nth", "i")
    w = w.withColumn("stop", F.expr(f"least(coalesce(get(at, nth + 1), size(ws)), i + {VALUE_WORDS + 1})"))
    w = w.withColumn("stop", F.coalesce(F.get(F.filter(F.expr("sequence(i, stop - 1)"), lambda k: (k > F.col("i")) & is_decoration(F.col("ws")[k]["text"])), F.lit(0)), F.col("stop")))
    valued = F.transform(F.array(F.expr("slice(ws, i + 2, stop - i - 1)")), lambda vs: F.struct(vs.alias("vs"), F.trim(F.array_join(F.transform(vs, lambda v: v["text"]), " ")).alias("value")))
    kept = F.filter(valued, lambda u: u["value"].rlike("[\\p{L}\\p{N}]") & ~is_prose(u["value"]))  # as a list, for a filter of rows would make the value once more for each condition
    w = w.select("doc_id", "page", "line", "ws", "i", kept.alias("kept"))
    w = unfolded(w, "kept", "none", "u").select("doc_id", "page", "line", "ws", "i", "u.*").withColumn("name", F.expr("upper(trim(ws[i].text))"))
    w = w.select(
        "doc_id", "page", F.col("line").cast("long").alias("line"), F.col("i"), name_to_key(F.col("name")).alias("base"), "name", guess_type(F.col("value")).alias("data_type"), F.left("value", F.lit(SAMPLE)).alias("sample_text"),
        (div_round(10 * F.expr("aggregate(vs, 0L, (s, v) -> s + v.conf)"), F.size("vs")) / 10).alias("confidence"), F.expr(_box("vs")).alias("box"), F.expr("struct(ws[i].x as x, ws[i].y as y, ws[i].w as w, ws[i].h as h)").alias("label_box"),
    )
    fields = [c for c in w.columns if c not in ("doc_id", "page")]
    pages = w.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("found")).withColumn("keys", unique_keys(F.transform("found", lambda s: s["base"])))
    out = unfolded(pages, "found", "ordinal", "s")
    return out.select("doc_id", "page", "s.line", F.col("ordinal").cast("long").alias("ordinal"), F.expr("keys[ordinal]").alias("key"), "s.name", "s.data_type", "s.sample_text", "s.confidence", "s.box", "s.label_box")


def merge_suggestions(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """doc_id, page, place, key, box, origin: the primary suggestions, then of the secondary ones those that overlap none before, under free keys.

    Both have doc_id, page, ordinal, key, box. A secondary suggestion is also held against
    those accepted before it, so each page's suggestions, a bounded list, are folded.
    """
    kind = "struct<ordinal:bigint,key:string,box:struct<x:bigint,y:bigint,w:bigint,h:bigint>,origin:int>"
    both = primary.select("doc_id", "page", F.struct("ordinal", "key", "box", F.lit(0).alias("origin")).alias("s")).unionByName(secondary.select("doc_id", "page", F.struct("ordinal", "key", "box", F.lit(1).alias("origin")).alias("s")))
    pages = both.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("s.origin").alias("o"), F.col("s.ordinal").alias("n"), F.col("s").cast(kind).alias("s")))).alias("all"))
    inter = "greatest(0L, least(m.box.x + m.box.w, c.s.box.x + c.s.box.w) - greatest(m.box.x, c.s.box.x)) * greatest(0L, least(m.box.y + m.box.h, c.s.box.y + c.s.box.h) - greatest(m.box.y, c.s.box.y))"
    near = f"exists(out, m -> m.box.y < c.s.box.y + c.s.box.h and c.s.box.y < m.box.y + m.box.h and {inter} > 0 and 3 * {inter} >= m.box.w * m.box.h + c.s.box.w * c.s.box.h)"
    fold = F.expr(f"""aggregate(all, cast(array() as array<{kind}>), (out, c) -> if(c.o <> 0 and {near}, out, concat(out, array(c.s))))""")
    part = lambda out, origin: F.transform(F.filter(out, lambda m: m["origin"] == origin), lambda m: m["key"])
    several = lambda own, more: F.arrays_overlap(own, more) | (F.size(F.array_distinct(more)) < F.size(more))
    keys = lambda out: bound(F.struct(part(out, 0).alias("own"), part(out, 1).alias("more")), lambda k: F.when(several(k["own"], k["more"]), _taken(k["more"], k["own"])).otherwise(F.concat(k["own"], k["more"])))
    named = bound(fold, lambda out: F.zip_with(out, keys(out), lambda m, k: F.struct(k.alias("key"), m["box"].alias("box"), m["origin"].alias("origin"))))
    return unfolded(pages.select("doc_id", "page", named.alias("named")), "named", "place", "s").select("doc_id", "page", F.col("place").cast("long").alias("place"), "s.key", "s.box", "s.origin")
