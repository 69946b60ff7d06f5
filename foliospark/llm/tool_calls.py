"""Tool-call linking for chat data, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: A tool's arguments: field, kind (string, integer, number, boolean, object, array), required, least and greatest number or length.
SCHEMA = "name string, fields array<struct<field:string,kind:string,required:boolean,low:double,high:double>>"


#: Whether there are numbers that no JSON value of Spark holds: of more digits than a decimal, or beyond all doubles; strings are taken out first, escaped quotes before them.
_BARE = r"""regexp_replace(replace(replace(arguments, r'\\', ''), r'\"', ''), '"[^"]*"', '')"""
_BEYOND = rf"""(rlike(arguments, '[0-9]{{39}}|[eE][+]?[0-9]{{3}}|[0-9]{{30}}[0-9.]*[eE]') and exists(regexp_extract_all({_BARE}, '-?[0-9][-+.0-9eE]*', 0),
    t -> if(t rlike '[.eE]', abs(try_cast(t as double)) = double('Infinity'), char_length(replace(t, '-', '')) > 38)))"""
#: The arguments as one JSON value, or null. Spark's parser stops behind the first value, so the text is read in brackets and in braces: if more follows, one of these breaks.
SINGLE = f"""case when try_variant_get(try_parse_json('{{"v":' || arguments || '}}'), '$', 'map<string,variant>') is not null
    and size(try_variant_get(try_parse_json('[' || arguments || ']'), '$', 'array<variant>')) = 1 then try_variant_get(try_parse_json('[' || arguments || ']'), '$[0]', 'variant') end"""


def _problems() -> F.Column:
    """What is wrong with the arguments (a: a map of variants, null if they are no JSON object) of a tool with these fields."""
    kind, value = "schema_of_variant(element_at(a, f.field))", "element_at(a, f.field)"
    absent = f"({value} is null or {kind} = 'VOID')"
    number, within = f"try_cast({value} as double)", "(f.low is null or {0} >= f.low) and (f.high is null or {0} <= f.high)"
    length = {"string": f"char_length(try_cast({value} as string))", "array": f"size(try_cast({value} as array<variant>))", "object": f"size(try_cast({value} as map<string,variant>))"}
    fits = f"""case f.kind
        when 'string' then {kind} = 'STRING' and {within.format(length['string'])}
        when 'boolean' then {kind} = 'BOOLEAN'
        when 'object' then startswith({kind}, 'OBJECT<') and {within.format(length['object'])}
        when 'array' then startswith({kind}, 'ARRAY<') and {within.format(length['array'])}
        else ({kind} in ('BIGINT', 'DOUBLE') or startswith({kind}, 'DECIMAL')) and abs({number}) < double('Infinity') and (f.kind = 'number' or {number} = floor({number})) and {within.format(number)} end"""
    return F.expr(f"""case when fields is null then array('unknown tool') when a is null then array('no object') else concat(
        transform(filter(fields, f -> f.required and {absent}), f -> concat('missing ', f.field)),
        transform(filter(fields, f -> not {absent} and not ({fits})), f -> concat('invalid ', f.field)),
        transform(array_sort(filter(map_keys(a), k -> not exists(fields, f -> f.field = k))), k -> concat('unknown ', k))) end""")


def canonical_numbers(json: str) -> str:
    """JSON text in which equal numbers are written alike, as an expression over a column of JSON without white space.

    A number with a fraction or an exponent is read as a double: a whole one below 2^53 is written without either, any
    other in the shortest form of doubles. Numbers of digits only, of which there are 38 at most, stay. Strings are told apart
    by their quotes, once escaped ones are hidden behind control characters, which JSON text never holds.
    """
    backslash, quote = r"r'\\'", r"r'\"'"  # as they stand escaped in JSON text
    hidden = f"replace(replace({json}, {backslash}, '\\u0001'), {quote}, '\\u0002')"
    double = "cast(t as double)"
    token = f"if(t rlike '^-?[0-9]' and t rlike '[.eE]', if({double} = floor({double}) and abs({double}) < 9007199254740992, string(bigint({double})), string({double})), t)"
    outside = f"array_join(transform(regexp_extract_all(p, '[-+.0-9eE]+|[^-+.0-9eE]+', 0), t -> {token}), '')"
    fixed = f"array_join(transform(split({hidden}, '\"'), (p, i) -> if(i % 2 = 0 and p rlike '[.eE]', {outside}, p)), '\"')"
    return f"if({json} rlike '[0-9][.eE]', replace(replace({fixed}, '\\u0002', {quote}), '\\u0001', {backslash}), {json})"


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Join calls to their results, order calls after the calls that they use, validate their arguments, and serialise.

    calls: conv_id, call_id, turn, name, arguments (JSON text), depends_on (array of call_id of the
    same conversation). results: conv_id, call_id, turn, content. schemas: SCHEMA, one row
    per tool; a declared list, small enough to be sent everywhere.

    Returns one row per call: conv_id, call_id, turn, name, level (0 for a call that
    uses none, else one more than the greatest level it uses; null on a cycle), result_turn, valid, errors, and
    json, the call with its result as canonical JSON: keys sorted at every depth, no white space.
    Conversations sorted by (level, turn) are in topological order. No step gathers a conversation:
    levels are found by joining calls with the calls they use (see :func:`_levels`).

    Nulls and ties: a call without conv_id or call_id, and a result that answers no call,
    link with nothing and are left out. Of calls with one identifier the one of the
    earliest turn counts, then the smallest arguments; of its results likewise. Calls used that don't exist
    are ignored. Arguments are read as JSON values of their own types: "5" is no integer, 7 no string, and 5.0 an integer.
    A field that is null counts as absent. Arguments that are null, no JSON object or more than one value, or that repeat a key are invalid ("no object") and serialised as null. So are those with an
    integer of more than 38 digits or a number beyond all doubles, anywhere in them ("number out of range", if nothing else is wrong). An escape of half a surrogate pair is read as ``?``. Numbers are written as :func:`canonical_numbers` says, so 1, 1.0 and 1e0 all become 1. Other
    columns are not read; empty tables give an empty result.
    """
    key = ["conv_id", "call_id"]
    calls = calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "arguments", "name", F.array_sort(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("depends_on"))).alias("c")).select(*key, "c.*")
    calls = materialize(calls, "calls")
    answers = results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"))
    level = _levels(calls.select(*key, "turn", "depends_on"))
    linked = calls.join(answers.hint("shuffle_hash"), key, "left").join(level, key, "left").join(F.broadcast(schemas.select(F.col("name").alias("tool"), "fields")), F.col("name") == F.col("tool"), "left")
    checked = linked.withColumn("parsed", F.expr(SINGLE)).withColumn("a", F.expr("try_variant_get(parsed, '$', 'map<string,variant>')")).withColumn("errors", _problems()).withColumn("beyond", F.coalesce(F.expr(_BEYOND), F.lit(False)))
    checked = checked.withColumn("errors", F.when(F.col("beyond") & (F.size("errors") == 0), F.array(F.lit("number out of range"))).otherwise(F.col("errors")))
    checked = checked.withColumn("valid", F.size("errors") == 0)
    line = F.to_json(
        F.struct(
            F.when(F.col("a").isNotNull() & ~F.col("beyond"), F.expr("try_parse_json(" + canonical_numbers("to_json(parsed)") + ")")).alias("arguments"),
            "depends_on", "errors",
            F.col("call_id").alias("id"),
            "name",
            F.when(F.col("r").isNotNull(), F.struct(F.col("r.content").alias("content"), F.col("r.turn").alias("turn"))).alias("result"),
            "turn", "valid",
        ),
        {"ignoreNullFields": "false"},
    )
    return checked.select(*key, "turn", "name", F.col("level").cast("long").alias("level"), F.col("r.turn").alias("result_turn"), "valid", "errors", line.alias("json"))


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level; no row for calls on a cycle or behind one.

    Chains of calls that use one other each are followed by doubling: each round a call points
    as far again as it did, so a chain of n calls takes log2(n) rounds. Calls that
    use several others get their level once all of those have one, a round for each such call in a row; but what one of
    these uses itself counts for nothing beside it (see :func:`_needed`), so a call that uses the last few of a chain is one of the chain.
    """
    key = ["conv_id", "call_id"]
    known = calls.select(*key)
    turn = F.col("turn") if "turn" in calls.columns else F.lit(None).cast("long")
    of_used = calls.select("conv_id", F.col("call_id").alias("used"), F.struct(turn.alias("turn"), F.char_length("call_id").alias("n"), "call_id").alias("place"))
    uses = calls.select(*key, F.explode(F.array_distinct("depends_on")).alias("used")).join(of_used, ["conv_id", "used"])
    uses = materialize(_needed(materialize(uses.select(*key, "used", "place"), "uses")), "needed")
    users = materialize(uses.groupBy(*key).agg(F.min("used").alias("to"), F.count("*").alias("n")), "users")
    # n_to: how many calls the call pointed at uses itself; at 1 the way goes on
    way = users.where("n = 1").join(users.select("conv_id", F.col("call_id").alias("to"), F.col("n").alias("n_to")), ["conv_id", "to"], "left")
    way = materialize(way.select(*key, "to", F.lit(1).alias("steps"), F.coalesce("n_to", F.lit(0)).alias("n_to")), "way")
    before = None
    while (left := way.where("n_to = 1").count()) not in (0, before):  # on a cycle it stays the same
        before = left
        ahead = way.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("n_to").alias("n_next"))
        on = way.where("n_to = 1").join(ahead, ["conv_id", "to"]).select(*key, F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("n_next").alias("n_to"))
        way = materialize(way.where("n_to <> 1").union(on), "way")
    last = materialize(known.join(users, key, "left_anti").withColumn("level", F.lit(0)), "level")
    levels, rounds = last, 0
    reached = way.where("n_to <> 1").select("conv_id", F.col("call_id").alias("used"), "to", "steps")
    several = uses.join(users.where("n > 1"), key, "left_semi").join(reached, ["conv_id", "used"], "left")
    waiting = materialize(several.select(*key, F.coalesce("to", "used").alias("used"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.lit(None).cast("int").alias("at")), "waiting")
    while waiting.limit(1).count():
        met = waiting.join(last.select("conv_id", F.col("call_id").alias("used"), "level"), ["conv_id", "used"], "left").withColumn("at", F.coalesce("at", F.col("level") + F.col("steps")))
        met = materialize(met.select(*key, "used", "steps", "at"), "waiting")
        last = materialize(met.groupBy(*key).agg(F.max("at").alias("level"), F.count_if(F.col("at").isNull()).alias("open")).where("open = 0").drop("open"), "level")
        if not last.limit(1).count():
            break
        rounds += 1
        levels = levels.union(last) if rounds % 16 else materialize(levels.union(last), "level")
        waiting = met.join(last.select(*key), key, "left_anti")
    behind = way.where("n_to > 1").join(levels.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return levels.union(way.where("n_to = 0").select(*key, F.col("steps").alias("level"))).union(behind)


#: Calls that use at most so many others are freed of those that one of the others uses.
FEW = 16


def _needed(uses: DataFrame) -> DataFrame:
    """Uses (conv_id, call_id, used, place: of the call used) without those that change no level: of a call that uses a and b, where a uses b and stands behind it, b.

    What goes is implied by a call farther behind, that perhaps by another one, but places only rise on that way, so it ends at
    one that stays, on cycles too: who uses a cycle goes on using it.
    """
    key = ["conv_id", "call_id"]
    n = uses.groupBy(*key).agg(F.count("*").alias("n"))
    several = uses.join(n.where(f"n between 2 and {FEW}").select(*key), key, "left_semi")
    few = uses.join(n.where(f"n <= {FEW}"), key, "left_semi").select("conv_id", F.col("call_id").alias("used"), F.col("used").alias("further"), F.col("place").alias("further_place"))
    implied = several.join(few, ["conv_id", "used"]).where("place > further_place").select(*key, F.col("further").alias("used")).distinct()
    return uses.join(several.join(implied, [*key, "used"], "left_semi").select(*key, "used"), [*key, "used"], "left_anti").select(*key, "used")


#: Tools of the calls that :func:`calls_in` reads out of conversations.
TOOLS = [
    ("lookup", [("limit", "integer", False, 1.0, 50.0), ("query", "string", True, 1.0, None), ("options", "object", False, None, None)]),
    ("search", [("limit", "integer", True, 0.0, 40.0), ("query", "string", True, None, 400.0), ("options", "object", False, None, None)]),
    ("translate", [("limit", "number", False, None, None), ("query", "string", True, 1.0, None), ("target", "string", True, 2.0, 2.0)]),
]


def tool_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOOLS, SCHEMA)


def calls_in(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each user turn is a call, which uses the user turn before and every fourth turn the one before that, too; the reply is its result.

    Some limits are strings and some options no objects, as models write them.
    """
    name = F.element_at(F.array(*[F.lit(t) for t, _ in TOOLS]), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    size = F.char_length(F.coalesce("text", F.lit("")))
    options = F.when(size % 11 == 0, F.to_json(F.struct(F.lit(True).alias("options")))).otherwise(F.to_json(F.struct(F.struct((size % 5).alias("z"), (size % 2 == 0).alias("b")).alias("options"))))
    limit = F.when(size % 7 == 0, F.to_json(F.struct((size % 60).cast("string").alias("limit")))).otherwise(F.to_json(F.struct((size % 60).alias("limit"))))
    query = F.when(F.col("text").isNotNull(), F.to_json(F.struct(F.col("text").alias("query"))))
    inner = lambda j: F.substr(j, F.lit(2), F.char_length(j) - 2)
    arguments = F.concat(F.lit("{"), F.concat_ws(", ", inner(query), inner(options), inner(limit)), F.lit("}"))
    used = lambda back: F.concat(F.lit("call_"), "conv_id", F.lit("_"), F.col("turn") - back)
    calls = conversations.where("role = 'user'").select(
        "conv_id", used(0).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"),
        F.when(F.col("turn") % 4 == 0, F.array(used(2), used(4))).otherwise(F.array(used(2))).alias("depends_on"),
    )
    results = conversations.where("role = 'assistant'").select("conv_id", used(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
