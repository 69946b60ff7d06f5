"""Small fixtures: brute force, round trips, nulls, ties, empty tables and clashing names."""

import base64
import gzip
import hashlib
import html.parser
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import common, embedding_dedup, exact_dedup, jaccard_join, language, packing, quality, queries, token_files, tool_calls, warc, word_store
from foliospark.llm.byte_bpe import ByteBPE, codec, decode, encode, round_trip_digests
from foliospark.llm.common import connected_components, scratch
from foliospark.llm.shingles import _ascending, common as shared, numbered, shingle_sets
from foliospark.llm.word_tokens import WordEncoder, default_path, encoder

WORDS, BYTES = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, sha string, payload string, size long"


def docs(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", 7) for i, t in rows], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


ODD = [None, "", " \t\n", "a", "The The", "x" * 50_000, "word " * 20_000, "é ß Σ 한국어 \U0001f600", "a\x1cb c", "<|endoftext|> <|startoftext|>", "don't 's !'s 12½"]


def sql(name, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.execute(queries.SQL[name])


def same(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(c[0] for c in rel.description)
    at = [[c[0] for c in rel.description].index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), sql(name, sf))


@pytest.mark.parametrize("hub", [1000, 5])
def test_connected_components(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB_EDGES", hub)
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    want = components({x for p in pairs for x in p}, pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs + [(5, None), (7, 7)], "a long, b long")).collect()}
    alone = {i for i in want if all(i not in p or p[0] == p[1] for p in pairs)}
    assert got == {i: c for i, c in want.items() if i not in alone}
    assert not connected_components(spark.createDataFrame([], "a long, b long")).count()


# op1


def test_tool_calls_order_validate_and_link(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "t", '{"n": 3, "s": {"z": 1, "a": [2, 1]}}', None),
            (1, "b", 1, "t", '{"n": 99}', ["a", "gone"]),
            (1, "c", 2, "t", '{"n": 1.5, "extra": 0}', ["a", "b"]),
            (1, "d", 3, "none", "[1]", []),
            (1, "x", 4, "t", None, ["y"]),
            (1, "y", 5, "t", "broken", ["x"]),
            (2, "a", 0, "t", "{}", []),
            (2, "a", 7, "t", '{"n": 1}', []),
            (None, "q", 0, "t", "{}", []),
            (2, None, 0, "t", "{}", []),
        ],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>",
    ).withColumn("level", F.lit("clash")).withColumn("errors", F.lit("clash"))
    results = spark.createDataFrame([(1, "a", 9, "late"), (1, "a", 1, "first"), (3, "a", 1, "none"), (None, None, 1, "x")], "conv_id long, call_id string, turn long, content string")
    schemas = spark.createDataFrame([("t", [("n", "integer", True, 0.0, 10.0), ("s", "object", False, None, None)])], tool_calls.SCHEMA)
    got = {(r["conv_id"], r["call_id"]): r for r in rows(tool_calls.link_tool_calls(calls, results, schemas))}
    assert {k: r["level"] for k, r in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (1, "x"): None, (1, "y"): None, (2, "a"): 0}
    assert got[1, "a"]["valid"] and got[1, "a"]["result_turn"] == 1
    assert got[1, "b"]["errors"] == ["invalid n"] and got[1, "c"]["errors"] == ["invalid n", "unknown extra"]
    assert got[1, "d"]["errors"] == ["unknown tool"] and got[1, "x"]["errors"] == ["no object"] and got[2, "a"]["errors"] == ["missing n"]
    assert got[1, "a"]["json"].startswith('{"arguments":{"n":3,"s":{"a":[2,1],"z":1}},"depends_on":[],')
    parsed = json.loads(got[1, "a"]["json"])
    assert parsed["result"] == {"content": "first", "turn": 1} and json.dumps(parsed, sort_keys=True, separators=(",", ":")) == got[1, "a"]["json"]
    assert json.loads(got[1, "y"]["json"])["arguments"] is None
    assert not tool_calls.link_tool_calls(calls.limit(0), results.limit(0), schemas).count()


def test_arguments_by_json_type_and_canonical_numbers(spark):
    fields = [("n", "integer", False, 0.0, 10.0), ("s", "string", False, None, 3.0), ("b", "boolean", False, None, None), ("x", "number", False, None, None), ("o", "object", False, None, None), ("l", "array", False, 1.0, 2.0), ("r", "boolean", True, None, None)]
    cases = [
        ('{"r": true, "n": "5", "s": 7}', ["invalid n", "invalid s"], '{"n":"5","r":true,"s":7}'),
        ('{"r": "true", "s": {"x": 1}, "b": 1}', ["invalid s", "invalid b", "invalid r"], '{"b":1,"r":"true","s":{"x":1}}'),
        ('{"r": false, "n": 5, "n": 6}', ["no object"], "null"),
        ('{"r": true, "n": 5.0, "x": 1e0, "o": {}, "l": [1]}', [], '{"l":[1],"n":5,"o":{},"r":true,"x":1}'),
        ('{"r": true, "n": 1.5, "x": "1", "o": [], "l": {"a": 1}}', ["invalid n", "invalid x", "invalid o", "invalid l"], '{"l":{"a":1},"n":1.5,"o":[],"r":true,"x":"1"}'),
        ('{"r": null, "n": null, "l": [1, 2, 3], "s": "four"}', ["missing r", "invalid s", "invalid l"], '{"l":[1,2,3],"n":null,"r":null,"s":"four"}'),
        ('{"r": true, "x": 1e400}', ["invalid x"], None),
        (r'{"r": true, "o": {"z": [2e3, -0.0, 1.50, 1.5e-7, 12345678901234567890123], "a": "1e0 \" 2.0 \\"}}', [], r'{"o":{"a":"1e0 \" 2.0 \\","z":[2000,0,1.5,1.5E-7,12345678901234567890123]},"r":true}'),
        ("[1]", ["no object"], "null"), ("5", ["no object"], "null"), ("", ["no object"], "null"), ('{"r": tru', ["no object"], "null"),
        ('{"r": true, "s": "' + 'long \\\\ \\" ' * 30_000 + '", "x": 1.0}', ["invalid s"], None),
    ]
    calls = spark.createDataFrame([(1, str(i), i, "t", a, None) for i, (a, _, _) in enumerate(cases)], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {int(r["call_id"]): r for r in rows(tool_calls.link_tool_calls(calls, results, spark.createDataFrame([("t", fields)], tool_calls.SCHEMA)))}
    for i, (arguments, errors, json_) in enumerate(cases):
        assert sorted(got[i]["errors"]) == sorted(errors) and got[i]["valid"] == (not errors), arguments[:80]
        if json_ is not None:
            assert got[i]["json"].startswith('{"arguments":' + json_ + ',"depends_on"'), (got[i]["json"][:200], json_)
    assert json.loads(got[12]["json"])["arguments"] == json.loads(cases[12][0])


def test_levels_of_chains_branches_and_cycles(spark):
    rng, uses = np.random.default_rng(1), {}
    for conv in range(8):
        for i in range(40):
            several = rng.integers(0, i, 2).tolist() if i and rng.random() < 0.15 else [i - 1] if i and rng.random() < 0.95 else []
            uses[conv, f"c{i}"] = {f"c{j}" for j in several}
    uses[0, "c3"] = {"c5"}  # c3 to c5 are a cycle or hang on one where they use each other
    uses[1, "c7"] = {"c7"}
    uses[2, "c9"] = {"c9", "c1", "gone"}
    for i in range(4, 40):  # the last few of a chain
        uses[3, f"c{i}"] = {f"c{i - 1}", f"c{i - 2}", f"c{i - 4}"}
    uses[4, "c20"], uses[4, "c21"], uses[4, "c22"], uses[4, "c30"] = {"c21"}, {"c22"}, {"c20"}, {"c20", "c21", "c22"}  # behind a cycle
    want: dict = {}
    for _ in range(200):
        for (conv, call), used in uses.items():
            used = [u for u in used if (conv, u) in uses]
            if all((conv, u) in want for u in used):
                want[conv, call] = max((want[conv, u] + 1 for u in used), default=0)
    calls = spark.createDataFrame([(conv, call, sorted(used)) for (conv, call), used in uses.items()], "conv_id long, call_id string, depends_on array<string>")
    got = [(r["conv_id"], r["call_id"], r["level"]) for r in rows(tool_calls._levels(calls))]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_levels_beside_and_behind_cycles(spark):
    rng, uses, rows_ = random.Random(4), {}, []
    for conv in range(500):
        n = rng.randrange(2, 30)
        for i in range(n):
            used = set(rng.sample(range(n), rng.choice((0, 1, 1, 2, 3, 4)) if n > 4 else rng.randrange(2)))
            if rng.random() < 0.8:  # mostly earlier ones
                used = {u for u in used if u < i}
            uses[conv, f"c{i}"] = {f"c{u}" for u in used} | ({"gone"} if rng.random() < 0.05 else set())
            rows_.append((conv, f"c{i}", i // 2 if conv % 2 else None, sorted(uses[conv, f"c{i}"])))
    for conv, graph in ((1000, {"a": "bcd", "b": "c", "c": "b", "d": ""}), (1001, {"a": "bcde", "b": "c", "c": "d", "d": "b", "e": ""}), (1002, {"a": "ab", "b": ""})):
        for call, used in graph.items():
            uses[conv, call] = set(used)
            rows_.append((conv, call, 1, list(used)))
    want: dict = {}
    waiting = dict(uses)
    while waiting:
        ready = {k: max((want[k[0], u] + 1 for u in used if (k[0], u) in uses), default=0) for k, used in waiting.items() if all((k[0], u) in want or (k[0], u) not in uses for u in used)}
        if not ready:
            break
        want |= ready
        waiting = {k: u for k, u in waiting.items() if k not in ready}
    assert len(rows_) > 5000 and waiting and len(want) > 1000
    got = rows(tool_calls._levels(spark.createDataFrame(rows_, "conv_id long, call_id string, turn int, depends_on array<string>")))
    assert len(got) == len(want) and {(r["conv_id"], r["call_id"]): r["level"] for r in got} == want


def test_arguments_are_one_value(spark):
    big = "1" * 39
    beyond = [f'{{"n":{big}}}', f'{{"n":[-{big}]}}', '{"n":1e400}', '{"n":-1E+309}', '{"n":' + "9" * 310 + ".0}", f'{{"v":{{"x":{big}}}}}', f'{{"o":{{"x":{big}}}}}']
    none = ['{"n":3}{"n":4}', '{"n":3} x', '{"n":3}]', '{"n":3}}', '{"n":3},{"n":4}', '{"n":3}],[{"n":4}', '{"n":3},"w":{"n":4}', '{"n":3', "", " ", ",", ']"', '{"v":1},"v":{"n":3}']
    some = {' {"n":3} \n': '{"n":3}', '{"s":"1e400 ' + big + '"}': '{"s":"1e400 ' + big + '"}', '{"s":"}{]["}': '{"s":"}{]["}', r'{"s":"\\\" 1e999"}': r'{"s":"\\\" 1e999"}', '{"n":' + "1" * 38 + "}": '{"n":' + "1" * 38 + "}", '{"n":1e308,"s":"e100"}': '{"n":1.0E308,"s":"e100"}', '{"v":1}': '{"v":1}'}
    cases = none + beyond + list(some)
    calls = spark.createDataFrame([(1, str(i), i, "t", a, None) for i, a in enumerate(cases)], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    schema = spark.createDataFrame([("t", [(f, k, False, None, None) for f, k in (("n", "number"), ("s", "string"), ("v", "number"), ("o", "object"))])], tool_calls.SCHEMA)
    got = {int(r["call_id"]): r for r in rows(tool_calls.link_tool_calls(calls, results, schema))}
    assert got[cases.index(beyond[-1])]["errors"] == ["number out of range"]
    for i, a in enumerate(cases):
        assert (got[i]["errors"] == ["no object"]) == (a in none) and (got[i]["errors"] == []) == (a in some), (a, got[i]["errors"])
        assert got[i]["json"].startswith('{"arguments":' + some.get(a, "null") + ',"depends_on"'), (a, got[i]["json"][:100])


# op2


def test_exact_dedup_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    data = list(enumerate(ODD)) + [(100 + i, "hot text") for i in range(40)] + [(200, "ho t\ntext"), (201, "hottext"), (None, "a"), (3, "a"), (300, "A")]
    got = rows(exact_dedup.exact_dedup(docs(spark, data)))
    groups = defaultdict(list)
    for i, t in data:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(data)
    for r in got:
        norm = next(n for n in groups if hashlib.sha256(n.encode()).hexdigest() == r["text_sha256"])
        best = min(groups[norm])
        assert r["group_size"] == len(groups[norm]) and r["keep_id"] == (None if best[1] else best[2])
    assert sum(r["kept"] for r in got) == len(groups)
    same_id = docs(spark, [(7, "hot text")] * 60 + [(None, "other hot")] * 60)  # rows that repeat identifier and text are spread as well
    got = rows(exact_dedup.exact_dedup(same_id))
    assert [(r["group_size"], r["kept"]) for r in got].count((60, True)) == 2 and len(got) == 120
    kept = exact_dedup.drop_copies(docs(spark, data))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == len(groups)
    assert not exact_dedup.exact_dedup(docs(spark, [])).count()


# op3


def brute_vectors(data):
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in data}
    near = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    return Counter(x for p in near for x in p), components(list(unit), near)


def test_embedding_dedup_brute_force(spark):
    rng = np.random.default_rng(5)
    data, i = [], 0
    for dim in (64, 24):
        for _ in range(60):
            centre = rng.standard_normal(dim)
            for _ in range(rng.integers(1, 9)):
                data.append((i, (centre + rng.uniform(0.05, 0.35) * rng.standard_normal(dim)).astype("f4").tolist()))
                i += 1
    hot = rng.standard_normal(64).astype("f4")
    data += [(i + k, (hot * (1 + k % 2)).tolist()) for k in range(70)] + [(i + 100 + k, (hot + 0.1 * rng.standard_normal(64)).astype("f4").tolist()) for k in range(90)]
    links, component = brute_vectors(data)
    bad = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [float("inf")] + [1.0] * 63), (9006, [None] + [1.0] * 63), (None, hot.tolist())]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in data + bad], "vec_id long, embedding array<float>, label int, sig string")
    got = {r["vec_id"]: r for r in rows(embedding_dedup.near_duplicate_vectors(df))}
    assert len(got) == len(data) + len(bad)
    for i, _ in data:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], component[i], component[i] == i)
    for i, _ in bad:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, i is not None)
    assert not embedding_dedup.near_duplicate_vectors(df.limit(0)).count()


@pytest.mark.parametrize("bits", [512, 1024, 4096])
def test_chains_of_codes_stay_connected(spark, monkeypatch, bits):
    """Codes that wander off from one another in long runs: every pair within the bound ends in one component."""
    monkeypatch.setattr(embedding_dedup, "RUN", 8)
    rng, bound = np.random.default_rng(bits), embedding_dedup.near_codes(bits)
    rows_, code = [], rng.integers(0, 256, bits // 8, dtype=np.uint8)
    for i in range(90):
        code = code ^ np.packbits(rng.random(bits) < (0.4 if i % 9 else 1.7) * bound / bits)
        rows_.append((1000 - i, bytearray(code.tobytes()), i // 45 if i % 2 else 10 + i // 6))
    edges = [(r["a"], r["b"]) for r in embedding_dedup._candidates(spark.createDataFrame(rows_, "rep long, code binary, key long")).collect()]
    component = components([r for r, _, _ in rows_], edges)
    bit = {r: np.unpackbits(np.frombuffer(bytes(c), np.uint8)) for r, c, _ in rows_}
    pairs = [(a, b) for a, _, ka in rows_ for b, _, kb in rows_ if a < b and ka == kb and (bit[a] != bit[b]).sum() <= bound]
    assert len(pairs) > 20 and all(component[a] == component[b] for a, b in pairs)


def test_vectors_of_doubles(spark):
    """Doubles are not rounded to floats: these differ beyond a float's digits, or overflow one."""
    side = float(np.sqrt(1 - 0.95**2))
    data = [(1, [1.0, 0.0]), (2, [0.95, side * (1 + 1e-9)]), (3, [0.95, side * (1 - 1e-9)]), (4, [1e300, 0.0]), (5, [1e-300, 0.0])]
    got = {r["vec_id"]: r["n_links"] for r in rows(embedding_dedup.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")))}
    assert got == {1: 3, 2: 1, 3: 4, 4: 3, 5: 3}


def test_long_runs_are_tied_by_a_join(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(embedding_dedup, "RUN", 8)
    keyed = spark.createDataFrame([(i, bytearray(rng.bytes(64)), 7 if i < 40 else 1000 + i // 4) for i in range(3, 80)], "rep long, code binary, key long")
    assert sorted((r["a"], r["b"]) for r in embedding_dedup._candidates(keyed).collect()) == [(3, i) for i in range(4, 40)]
    for most in (0, 100):
        monkeypatch.setattr(embedding_dedup, "BROADCAST_KEYS", most)
        near = keyed.select("rep", F.lit(bytearray(64)).alias("code"), "key")
        edges = [(r["a"], r["b"]) for r in embedding_dedup._candidates(near).collect()]
        assert components(range(3, 80), edges) == {i: 3 if i < 40 else i // 4 * 4 for i in range(3, 80)}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x.astype("f4") @ embedding_dedup.rotation(64, 512).T
    f = embedding_dedup._factor(y)
    assert np.allclose(np.linalg.norm(y, axis=1), 1, atol=1e-4)
    estimate = (np.where(y > 0, 1, -1) @ y.T) / (np.sqrt(512) * f[:, None])
    error = embedding_dedup.SIGMAS * np.sqrt((1 - f**2) / f**2 / 511)
    off = estimate - x @ x.T
    assert abs(off.mean()) < 0.002 and (np.abs(off) <= error[:, None]).all()


# op4, op8


def labelled(spark, n=240):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the river", "house of", "green hill", "and then", "walked", "slowly"]) for _ in range(rng.randint(5, 60)))
    bad = lambda: " ".join(rng.choice(["BUY!! NOW!!", "CLICK***", "%%%", "$$$ FREE", "WIN!!"]) for _ in range(rng.randint(5, 60)))
    data = [(i, (good if i % 3 else bad)()) for i in range(n)]
    return data, spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in data] + [(None, 1, 0), (1, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")


def test_isotonic_curve():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, share = quality._isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all() and 0 < share[0] and share[-1] < 1
    order = np.argsort(x)
    low = [max(min(y[order][i : j + 1].mean() for j in range(k, 300)) for i in range(k + 1)) for k in range(300)]  # the least-squares rising fit, by its definition
    own = np.interp(x[order], at, share)
    assert np.abs(own - np.array(low)).max() < 0.5 and np.abs(own - np.array(low)).mean() < 0.06
    assert [a.tolist() for a in quality._isotonic(np.array([1.0]), np.array([1.0]))] == [[1.0], [0.75]]


def test_quality_held_out(spark):
    data, labels = labelled(spark)
    df = docs(spark, data)
    model = quality.fit(df, labels)
    got = {r["doc_id"]: r for r in rows(quality.score_quality(df, model))}
    held = [i for i, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held == [i for i in sorted(got) if got[i]["held_out"]] and len(got) == len(data)
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in held)
    odd = rows(quality.score_quality(docs(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "x")]), model))
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in odd)
    kept = quality.drop_low_quality(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got.values())
    nothing = quality.fit(df, labels.limit(0))
    assert {r["score"] for r in rows(quality.score_quality(df, nothing))} == {quality.UNKNOWN}
    assert not quality.score_quality(df.limit(0), model).count()


def test_labels_of_held_out_rows_are_not_learned(spark):
    data, labels = labelled(spark, 60)
    df = docs(spark, data)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in rows(quality.score_quality(df, quality.fit(df, x)))) for x in (labels, flipped))
    assert a == b


def test_quality_scores_by_a_plain_loop(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(df, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in rows(quality.score_quality(df, model))}
    seen = []
    for r in df.collect():
        raw = (r.text or "").encode()
        saved = [0, 0]
        for half in (0, 1):
            for sign, d in zip((-1, 1), model.dictionaries[half]):
                for i in range(0, len(raw), 512):
                    one = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
                    saved[half] += sign * len(one.compress(raw[i : i + 512]))
        d = sum(x / max(1, len(raw)) for x in saved) / 2
        right = next((k for k, at in enumerate(model.at) if at >= d), len(model.at))
        if d == 0:
            score = model.even
        elif right in (0, len(model.at)):
            score = model.share[min(right, len(model.at) - 1)]
        else:
            (x0, x1), (y0, y1) = model.at[right - 1 : right + 1], model.share[right - 1 : right + 1]
            score = y0 + (y1 - y0) * (d - x0) / (x1 - x0)
        assert abs(got[r.doc_id]["score"] - score) < 1e-12 and got[r.doc_id]["predicted"] == (score >= 0.3)
        seen.append((d, score))
    seen = sorted(x for x in seen if x[0])
    assert len(seen) > 100 and all(a[1] <= b[1] for a, b in zip(seen, seen[1:]))  # the score rises with the difference alone


def test_language_by_dense_kernels():
    rng = np.random.default_rng(3)
    parts = {"a": ["the ", "and ", "ing "], "b": ["der ", "und ", "sch"], "c": ["el ", "que ", "ñ "]}
    pick = lambda k: "".join(rng.choice(parts[k], rng.integers(3, 30)).tolist()).encode()
    langs = [str(x) for x in rng.choice(list(parts), 90)]
    texts = [pick(k) for k in langs]
    model = language.KernelLanguages(texts, langs)
    grams = lambda t: {(n, t.lower()[i : i + n]) for n in language.LENGTHS for i in range(len(t) - n + 1)}
    marks = [i for k in sorted(parts) for i in [j for j, x in enumerate(langs) if x == k][: language.LANDMARKS]]
    counted = Counter(g for i in marks for g in grams(texts[i]))
    known = {g for g, n in counted.items() if n >= 2}
    kernel = lambda x, y: len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y)))
    own = [grams(t) & known for t in texts]
    knm = np.array([[kernel(x, own[i]) for i in marks] for x in own])
    kmm = knm[marks]
    y = np.where(np.array(langs)[:, None] == np.array(sorted(parts))[None], 1.0, -1.0)
    w = np.diag([1 / langs.count(k) for k in langs])
    # ridge in the landmarks' space: alpha minimises |W(Knm a - y)|^2 + ridge a' Kmm a
    alpha = np.linalg.lstsq(knm.T @ w @ knm + language.RIDGE * kmm, knm.T @ w @ y, rcond=1e-10)[0]
    fresh = [pick(k) for k in "abcabcabc"] + [b"zzz", b""]
    f = np.array([[kernel(grams(t) & known, own[i]) for i in marks] for t in fresh]) @ alpha
    lang, score = model.predict(fresh)
    assert np.allclose(score, np.clip((f.max(1) + 1) / 2, 0, 1), atol=2e-3)
    assert [x for x, s in zip(lang, np.sort(f, 1)) if s[-1] - s[-2] > 0.01] == [sorted(parts)[i] for i, s in zip(f.argmax(1), np.sort(f, 1)) if s[-1] - s[-2] > 0.01]


def test_languages_of_held_out_rows_are_not_read(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = df.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(held, F.lit("other")).otherwise(F.col("text")))
    a, b = (language.fit(x) for x in (df, other))
    assert a.langs == b.langs and np.array_equal(a.matrix, b.matrix) and np.array_equal(a.grams, b.grams)


def test_language_held_out_accuracy(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify_language(df, model := language.fit(df)).join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0
    odd = rows(language.identify_language(docs(spark, list(enumerate(ODD)) + [(None, "the")]), model))
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in odd)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in ODD[r["doc_id"]] or "")) for r in odd if r["doc_id"] is not None)
    clash = df.withColumn("letter", F.lit("x")).withColumn("c0", F.lit(1))
    assert language.drop_unknown_language(clash, model).columns == clash.columns
    assert language.drop_unknown_language(df, model).count() >= 0.98 * df.count()
    none = language.fit(df.limit(0))
    assert {r["lang_pred"] for r in rows(language.identify_language(df, none))} == {"und"}


def test_presence_is_that_of_plain_sets():
    texts = ["the cat sat".encode(), "éa bé".encode(), b"", b"zz"]
    model = language.KernelLanguages(texts * 2, ["a", "b", "a", "b"] * 2)
    known = set(model.grams.tolist())
    for t, p in zip(texts, model._presence(texts)):
        low = t.lower()
        own = {int.from_bytes(low[i : i + n], "big") | n << 32 for n in language.LENGTHS for i in range(len(low) - n + 1)}
        assert set(model.grams[p > 0].tolist()) == own & known


# op5


def test_warc_derivatives(spark):
    pages = [(1, "http://a.org/x y", "<!DOCTYPE html><title>T &amp; t</title><script>var a='<p>';</script><p>One<br>two&nbsp;<b>x</b></p><!-- no --><a href='/l?a=1&amp;b'>k</a>"), (2, None, None), (None, "", ""), (3, "http://b", "<!-- open"), (1, "http://a.org/x y", "<p>again")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record string")
    records = warc.responses(df)
    assert records.count() == 5
    got = [r for r in rows(warc.describe(warc.derivatives(records))) if r["target_uri"] == "http://a.org/x%20y" and "again" not in r["content"] and "T & t" in r["content"]]
    metadata, conversion = (next(r for r in got if r["warc_type"] == k) for k in ("metadata", "conversion"))
    assert conversion["content"] == "T & t\nOne\ntwo x\nk"
    source = warc.parse_record(warc.response_record(*pages[0]))[0]
    assert metadata["refers_to"] == conversion["refers_to"] == warc.value(source, "WARC-Record-ID")
    assert metadata["concurrent_to"] == conversion["record_id"]
    about = json.loads(metadata["content"])
    assert about["html"] == {"links": ["/l?a=1&b"], "title": "T & t"} and about["payload"]["matches"] and [list(h) for h in source] == about["source"]["headers"]
    assert conversion["source_payload_digest"] == warc.value(source, "WARC-Payload-Digest") == about["payload"]["digest"]
    assert conversion["block_digest"] == warc.digest(conversion["content"].encode())
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx")), (4, bytearray(warc.build_record([("WARC-Type", "request")], b"x")))], "page_id long, record binary")
    assert not warc.derivatives(broken).count() and not warc.responses(df.limit(0)).count()


class PlainPage(html.parser.HTMLParser):
    """The rules of a page's text once more, over the library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.links, self.titles, self.open = [], [], [], [], None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.out += ["\n"] * (tag in warc.LINES and not self.skip)
        if tag in warc.SKIPPED:
            self.skip.append(tag)
        if tag == "a" and not self.skip:
            self.links += [v or "" for k, v in attrs if k == "href"][:1]
        if tag == "title":
            self.open = ""

    def handle_endtag(self, tag):
        self.out += ["\n"] * (tag in warc.LINES and not self.skip)
        if tag in self.skip:
            self.skip.remove(tag)
        if tag == "title" and self.open is not None:
            self.titles.append(self.open)
            self.open = None

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)
        if self.open is not None:
            self.open += data

    def text(self):
        lines = (re.sub("[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_derivatives_of_all_pages_by_another_parser(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    made = rows(warc.describe(warc.derivatives(warc.responses(spark.read.parquet(f"{sf}/pages.parquet")))))
    assert len(made) == 2 * len(pages)
    for r in made:
        page = pages[r["page_id"]]
        plain = PlainPage(page.html or "")
        source = hashlib.sha1((page.html or "").encode()).digest()
        assert r["source_payload_digest"] in (None, "sha1:" + base64.b32encode(source).decode()) and r["target_uri"] == (page.url or None)
        if r["warc_type"] == "conversion":
            assert r["content"] == plain.text() and r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(plain.text().encode()).digest()).decode()
        else:
            about = json.loads(r["content"])
            assert about["html"]["links"] == plain.links and about["html"]["title"] == (" ".join(plain.titles[0].split()) if plain.titles else None)
            assert about["payload"]["matches"] and about["conversion"] == r["concurrent_to"]


def test_pages_in_one_pass():
    """Long pages of tags, comments and elements that never end take time in proportion."""
    cases = {
        "<a x": "<a x" * 2_500_000, "<a ": "", "< ": "", "<!--": "", "<script>": "", "</": "", "<": "", "<title>": "", "<a href=": "", "<a href='": "", "&#": "", "&": "", "<p": "", "<!": "", "<a x>": "", "</title": "", "<title></title ": "",
    }
    began = time.time()
    for piece in cases:
        text, links, _ = warc.read_page(piece * (2_000_000 // len(piece)))
        assert len(text) <= 2_000_000
    warc.read_page(cases["<a x"])
    assert time.time() - began < 60
    assert warc.plain_text("a<b <c> 1 < 2 <3 &#" + "9" * 5000 + "; <") == "a 1 < 2 <3 \ufffd <"
    assert warc.read_page("<TITLE>x <b>y</b>\n</TITLE><p data-href=no href='a'>k<a data-href=n HREF = 'q&amp;r'>l</a><a>m</a>") == ("x y\nkl" + "m", ["q&r"], "x y")


def test_bodies_with_codings():
    page = "<p>é" * 50
    body = gzip.compress(page.encode())
    chunked = b"".join(b"%x;x=y\r\n%b\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    for http, block in (("Content-Encoding: gzip", body), ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked), ("Content-Encoding: deflate", zlib.compress(page.encode())), ("Content-Encoding: br", page.encode()), ("Transfer-Encoding: chunked", page.encode())):
        raw = warc.build_record([("WARC-Type", "response")], f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{http}\r\n\r\n".encode() + block)
        assert warc.parse_record(warc.derive(raw)[1])[1].decode() == "\n".join(["é"] * 50)


def test_warc_file_round_trip(spark, tmp_path):
    raw = [warc.response_record(i, f"http://h/{i}", "<p>é" * i) for i in range(6)]
    inner = warc.response_record(7, "http://h/7", "a page with\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.0 inside")
    first = warc.build_record([("WARC-Type", "resource")], b"WARC/1.1 begins the block")
    none = warc.build_record([("WARC-Type", "resource")], b"")
    (tmp_path / "a.warc").write_bytes(b"".join([*raw[:2], b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\nshort\r\n\r\n", inner, b"WARC/1.1\r\nno length\r\n\r\n", first, none, raw[2]]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw[3:])))
    (tmp_path / "c.warc").write_bytes(b"junk before " + raw[0][:-2])
    got = [bytes(r.record) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([*raw, inner, first, none, raw[0]])
    rejected = sorted(bytes(r.rejected).strip() for r in warc.rejected_warc(spark, str(tmp_path)).collect())
    assert len(rejected) == 3 and rejected[0].startswith(b"WARC/1.1\r\nContent-Length: 99999999")
    many = [warc.response_record(i, f"http://h/{i}", "word " * (i % 400)) for i in range(900)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/e.warc").write_bytes(b"".join(many))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        split = warc.read_warc(spark, str(tmp_path / "d"))
        assert sorted(bytes(r.record) for r in split.collect()) == sorted(many) and split.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _warc_files(folder, seed):
    """Files of records whose payloads hold records, headers that end at the mark, broken ones and junk; with the records that are real."""
    rng, real = random.Random(seed), []
    folder.mkdir()
    for f in range(4):
        out = []
        for i in range(25):
            inner = [warc.build_record([("WARC-Type", "resource"), ("N", f"{f}/{i}/{k}")], bytes(rng.randrange(97, 123) for _ in range(rng.randrange(300)))) for k in range(rng.choice((0, 0, 0, 1, 1, 2, 30)))]
            block = rng.choice((b"", b"WARC/1.1\r\n", b"page ")) + b"".join(inner) + rng.choice((b"", b"\r\n\r\nWARC/1.1\r\nContent-Length: 5000\r\n\r\nx", b"tail" * rng.randrange(400)))
            real.append(warc.build_record([("WARC-Type", "response"), ("N", f"{f}/{i}")], block))
            out.append(real[-1])
            if rng.random() < 0.05:
                out.append(b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\nshort\r\n\r\n")
        data = b"".join(out)
        (folder / f"{f}.warc{'.gz' if f == 3 else ''}").write_bytes(gzip.compress(data) if f == 3 else data)
    return real


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_warc_records_do_not_depend_on_splits(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_SPANS", most)
    real = sorted(_warc_files(tmp_path / "w", most))
    for size in ("134217728", "20000") if most > 3 else ("5000",):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")  # splits of several files in a task
        try:
            assert sorted(bytes(r.record) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == real, size
            assert all(bytes(r.rejected).startswith(b"WARC/1.1\r\nContent-Length: 99999999") for r in warc.rejected_warc(spark, str(tmp_path / "w")).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_odd_files(spark, tmp_path):
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "junk.warc").write_bytes(b"no record\r\n\r\n")
    long = warc.build_record([("WARC-Type", "resource"), ("Long", "h" * 400_000)], b"a\r\n\r\nWARC/1.0 b")
    bare = b"WARC/1.0\r\nContent-Length: 0\r\n\r\n"
    (tmp_path / "long.warc").write_bytes(b"junk before " + long + bare + long)
    assert sorted(bytes(r.record) for r in warc.read_warc(spark, str(tmp_path)).collect()) == sorted([long, long, bare + b"\r\n\r\n"])
    assert sorted(bytes(r.rejected).strip() for r in warc.rejected_warc(spark, str(tmp_path)).collect()) == [b"junk before", b"no record"]


# op6, op7, op9


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


TEXT = st.text(st.one_of(st.sampled_from(list("aAeE'sStTrRvVlLmMdD<|>12½ \n\t\x85\xa0.,!éßΣİ́\x1c 한가𝒳")), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_encoders_equal_the_library(texts):
    texts = texts + ["x".join(texts), "<|endoftext|>".join(texts)]
    for path, own in ((WORDS, encoder(WORDS)), (BYTES, codec(BYTES))):
        want = [library_of(path).encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert [codec(BYTES).decode(x).decode() for x in codec(BYTES).encode(texts)] == [library_of(BYTES).decode(codec_ids, skip_special_tokens=False) for codec_ids in want]


_libraries = {}


def library_of(path):
    if path not in _libraries:
        _libraries[path] = library(path)
    return _libraries[path]


def test_greedy_words_that_fail_are_merged_exactly():
    rng = random.Random(8)
    words = [("".join(rng.choice("aeiouthnsrl") for _ in range(rng.randint(1, 40)))) for _ in range(3000)] + ["a" * 3000, "ab" * 700]
    c = codec(BYTES)
    raw = np.frombuffer("".join(words).encode(), np.uint8).astype(np.int64)
    size = np.array([len(w) for w in words])
    who, what = c.table.propose(raw, size)
    near = np.flatnonzero(who[1:] == who[:-1])
    assert 0 < (~c.table.compatible(what[near], what[near + 1])).sum() < len(near)
    ages, count = c.table.encode(raw, size)
    cut = np.concatenate(([0], np.cumsum(count)))
    for i, w in enumerate(words):
        assert ages[cut[i] : cut[i + 1]].tolist() == c.table.merged(list(w.encode()))


def test_bytes_that_are_no_text_decode_like_the_library():
    for ids in ([220, 5000, 225], [0, 255], [50256, 13], []):
        assert codec(BYTES).decode(np.array(ids, "<u4").tobytes()).decode() == library_of(BYTES).decode(ids, skip_special_tokens=False)


def test_byte_bpe_frames(spark):
    df = docs(spark, list(enumerate(ODD)) + [(None, "a")])
    ids = {r.doc_id: r.ids for r in encode(df, BYTES).collect()}
    assert {i: ids[i] for i, _ in enumerate(ODD)} == {i: library_of(BYTES).encode(t or "").ids for i, t in enumerate(ODD)}
    assert {r.doc_id: r.text for r in decode(encode(df, BYTES), BYTES).where("doc_id is not null").collect()} == {i: t or "" for i, t in enumerate(ODD)}
    got = {r["doc_id"]: r for r in rows(round_trip_digests(df, BYTES))}
    for i, t in enumerate(ODD):
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["n_tokens"] == len(ids[i])
    assert not round_trip_digests(df.limit(0), BYTES).count()


def test_token_files(spark):
    rng = random.Random(2)
    data = list(enumerate(ODD)) + [(50 + i, " ".join(rng.choice(["the", "cat", "Ωμέγα", "x1"]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rng.shuffle(data)
    path = scratch(spark, "tokens")
    token_files.write_token_files(docs(spark, data), path, WORDS)
    files = token_files.read_token_files(spark, path)
    got = {r["doc_id"]: r for r in rows(token_files.with_crc32(files))}
    start = 0
    for i, t in sorted(data):
        ids = library_of(WORDS).encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.ids for r in files.where("doc_id = 4").collect()] == [library_of(WORDS).encode(ODD[4]).ids + [2]]
    empty = scratch(spark, "tokens")
    token_files.write_token_files(docs(spark, []), empty, WORDS)
    assert not token_files.read_token_files(spark, empty).count()


def test_token_file_format(spark):
    import glob

    import pyarrow.parquet as pq

    path = scratch(spark, "tokens")
    token_files.write_token_files(docs(spark, [(i, "some words here " * 50) for i in range(200)]), path, WORDS)
    column = {c.path_in_schema: c for f in glob.glob(path.removeprefix("file://") + "/*.parquet") for g in [pq.ParquetFile(f).metadata.row_group(0)] for c in map(g.column, range(g.num_columns))}
    assert any("DICTIONARY" in e for e in column["ids.list.element"].encodings) and column["ids.list.element"].has_offset_index
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and column["doc_id"].has_column_index


def test_packing(spark):
    rng = random.Random(6)
    data = list(enumerate(ODD)) + [(100 + i, "word " * int(rng.paretovariate(0.7) * 8 % 9000)) for i in range(400)] + [(1, ""), (None, "a b")]
    got = rows(packing.pack(packing.pieces(docs(spark, data), WORDS)))
    check_packing(data, got)
    assert not packing.pack(packing.pieces(docs(spark, []), WORDS)).count()


def check_packing(data, got):
    want = Counter()
    for i, t in data:
        ids = library_of(WORDS).encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 4096) * 1.02 + 1


def test_least_squares_and_plan():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 30)), np.where(np.arange(30) % 7 == 0, rng.random(30), 0)
    found = packing.nonnegative_least_squares(a, a @ x)
    assert (found >= 0).all() and np.linalg.norm(a @ (found - x)) < 1e-5
    for histogram in ({}, {4096: 3}, {1: 9000}, {2049: 7, 2047: 5, 3: 4}, {int(n): int(c) for n, c in zip(rng.integers(1, 4097, 300), rng.integers(1, 9, 300))}):
        steps, used = packing.plan(histogram), Counter()
        for times, lengths in steps:
            assert times > 0 and sum(n * c for n, c in lengths) <= 4096
            for n, c in lengths:
                used[n] += times * c
        assert used == Counter(histogram)


# op10


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingle_sets():
    import pyarrow as pa

    texts = ODD + ["a b c d e", "a b c d", "A b C d e f g", "one two\tthree\nfour  five six"]
    sets = list(shingle_sets(pa.array(texts)))
    assert [len(s) for s, _ in sets] == [len(shingles(t)) for t in texts]
    assert sets[-4][0].tolist() != sets[-3][0].tolist() and shared(sets[-4], sets[-2]) == 1
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert shared(sets[i], sets[j]) == len(shingles(x) & shingles(y))


def test_digests_that_agree_in_one_half():
    x = (np.array([1, 5, 5, 9], np.uint64), np.array([2, 3, 4, 7], np.uint64))
    y = (np.array([1, 5, 9], np.uint64), np.array([2, 4, 8], np.uint64))
    assert shared(x, y) == 2 == shared(y, x)
    number = numbered(*(np.concatenate([a, b]) for a, b in zip(x, y)))
    assert number[0] == number[4] and number[2] == number[5] and len(set(number.tolist())) == 5
    up = _ascending(np.array([9, 5, 5, 5, 1], np.uint64), np.array([7, 4, 3, 4, 2], np.uint64))
    assert [h.tolist() for h in up] == [h.tolist() for h in x]


def thue_morse():
    """Two words of 4,096 letters that have the same polynomial hash modulo 2^64, whatever its odd base."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_polynomial_hash():
    import pyarrow as pa

    a, b = thue_morse()
    texts = [a + " " + b, b, a, b + " " + a + " " + a]
    for path, own in ((WORDS, encoder(WORDS)), (BYTES, codec(BYTES))):
        for some in (texts, texts[::-1], texts[1:2]):
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == [library_of(path).encode(t, add_special_tokens=False).ids for t in some]
    assert [codec(BYTES).decode(x).decode() for x in codec(BYTES).encode(texts)] == texts
    sets = list(shingle_sets(pa.array([a, b, a + " w x y z", b + " w x y z"])))
    assert not any(shared(sets[i], sets[j]) for i in range(4) for j in range(i))


def test_words_that_share_hashes_are_compared(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 90))) for _ in range(60)) for _ in range(12)]
    monkeypatch.setattr(word_store, "word_hashes", lambda cp, begin, end: ((end - begin) % 5 + cp[begin] % 3).astype(np.uint64))
    for path, own in ((WORDS, WordEncoder(WORDS)), (BYTES, ByteBPE(BYTES))):
        for t in texts:
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t, t])] == 2 * [library_of(path).encode(t, add_special_tokens=False).ids]


def test_documents_of_equal_polynomial_hash(spark):
    a, b = thue_morse()
    data = [(1, a), (2, b), (3, a + " w x y z"), (4, b + " w x y z"), (5, b + " W x\ty z"), (6, b + " " + a)]
    df = docs(spark, data)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6)]
    digests = {r.doc_id: r for r in round_trip_digests(df, BYTES).collect()}
    path = scratch(spark, "tokens")
    token_files.write_token_files(df, path, WORDS)
    files = {r.doc_id: r for r in token_files.with_crc32(token_files.read_token_files(spark, path)).collect()}
    for i, t in data:
        assert digests[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(library_of(BYTES).encode(t).ids, "<u4").tobytes()).hexdigest()
        assert files[i].ids_crc32 == zlib.crc32(np.array(library_of(WORDS).encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    check_packing(data, rows(packing.pack(packing.pieces(df, WORDS))))


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("edits", [1, 3, 8])
def test_blocks_brute_force(monkeypatch, apart, edits):
    """The components of a pair of blocks of near copies, however few sets each one is compared with."""
    import pyarrow as pa

    rng, texts = random.Random(edits), []
    for _ in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(rng.randint(1, 40)):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(60)] = f"e{rng.randrange(200)}"
            texts.append(" ".join(copy))
    reps, first = rng.sample(range(1000), len(texts)), [rng.random() < 0.5 for _ in texts]
    table = pa.table({"rep": pa.array(reps, pa.int64()), "first": pa.array(first), "b": [1 if apart else 2] * len(texts), "p": [0] * len(texts), "q": [1 if apart else 0] * len(texts), "text": texts})
    sets = [shingles(t) for t in texts]
    links = [(reps[i], reps[j]) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and not (apart and first[i] == first[j])]
    for many, few in ((64, 8), (3, 1), (0, 2)):
        monkeypatch.setattr(jaccard_join, "MANY", many)
        monkeypatch.setattr(jaccard_join, "FEW", few)
        got = jaccard_join._within(table).to_pydict()
        assert set(zip(got["a"], got["b"])) <= {p for a, b in links for p in ((a, b), (b, a))}
        assert components(reps, zip(got["a"], got["b"])) == components(reps, links)


@pytest.mark.parametrize("block", [1 << 18, 2000])
def test_jaccard_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(9)
    data = list(enumerate(ODD)) + [(40, "a b c"), (41, "A b  c"), (None, "a b c"), (None, "lonely row")]
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    i = 100
    for family in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))] + (passage if family % 3 == 0 else [])
        for _ in range(30 if family < 3 else rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            data += [(i + k, " ".join(copy)) for k in range(rng.choice([1, 1, 1, 3]))]
            i += 3
    sets = {i: shingles(t) for i, t in data if i is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, pairs)
    got = rows(jaccard_join.jaccard_components(docs(spark, data)))
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert sorted(r["component_id"] or -1 for r in got if r["doc_id"] is None) == [-1, 40]
    kept = jaccard_join.one_of_each(docs(spark, data).where("doc_id is not null"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and len(kept.columns) == 9
    assert not jaccard_join.jaccard_components(docs(spark, [])).count()


@pytest.mark.parametrize("canopies", [False, True])
def test_near_copies_by_row_not_by_identifier(spark, monkeypatch, canopies):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2 if canopies else 8)
    base = [[f"{k}v{i}" for i in range(60)] for k in "abcd"]
    text = lambda k, n=0: " ".join(base[k][: 60 - n])
    # 5 stands on two texts, each with a near copy; two near texts have no identifier, one resembles 9, one nothing
    data = [(5, text(0)), (3, text(0, 2)), (5, text(1)), (4, text(1, 2)), (None, text(2)), (None, text(2, 2)), (9, text(3)), (None, text(3, 2)), (None, "quite alone"), (7, "twice"), (7, "twice"), (None, None), (8, " ")]
    got = [(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, data)).collect()]
    assert sorted(got, key=repr) == sorted([(5, 3), (3, 3), (5, 4), (4, 4), (None, None), (None, None), (9, 9), (None, 9), (None, None), (7, 7), (7, 7), (None, None), (8, 8)], key=repr)
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(docs(spark, data)).collect()]
    of_c = [x for x in kept if x in [(None, text(2)), (None, text(2, 2))]]
    assert len(of_c) == 1
    assert sorted(kept, key=repr) == sorted([(3, text(0, 2)), (4, text(1, 2)), *of_c, (9, text(3)), (None, "quite alone"), (7, "twice"), (None, None), (8, " ")], key=repr)
