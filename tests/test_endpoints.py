"""Endpoints against a local server that is slow, lost, busy or wrong; counters that fill while jobs run."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from foliospark.config import EngineConfig
from foliospark.operators import records
from foliospark.sources import endpoints, providers
from foliospark.storage import scratch
from foliospark.streaming import counters, jobs

seen: dict = {}


class Server(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _say(self, body, code=200):
        raw = body if isinstance(body, bytes) else json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self):
        seen[self.path] = seen.get(self.path, 0) + 1
        if self.path.startswith("/slow"):
            time.sleep(2)
            self._say({})
        elif self.path.startswith("/busy") and seen[self.path] < 3:
            self._say({}, 503)
        elif self.path.startswith("/gone"):
            self._say({}, 404)
        elif self.path.startswith("/odd"):
            self._say(b"<html>")
        elif self.path.endswith("/v1/models"):
            self._say({"data": [{"id": "h1"}]} if self.headers.get("Authorization") == "Bearer secret" else {}, 200 if self.headers.get("Authorization") else 401)
        else:
            self._say({"models": [{"name": "small:1"}, {"name": "large:2"}]})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = asked.get("prompt") or asked["messages"][0]["content"]
        if "fail" in prompt:
            self._say({}, 400)
        elif self.path.endswith("/embeddings"):
            self._say({"embedding": [len(prompt), 1]})
        elif self.path.endswith("/completions"):
            self._say({"choices": [{"message": {"content": prompt.upper()}}], "usage": {"prompt_tokens": len(prompt), "completion_tokens": 2}})
        else:
            self._say({"response": prompt[::-1], "prompt_eval_count": len(prompt), "eval_count": 1})


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_models_of_endpoints(spark, url):
    seen.clear()
    places = [f"{url}/a", f"{url}/busy/", f"{url}/gone", f"{url}/odd", f"{url}/slow", "http://127.0.0.1:9"]
    frame = endpoints.models(spark, places, timeout="0.4", pause="0.01")
    rows = frame.collect()
    assert frame.rdd.getNumPartitions() == 6
    assert sorted((r.url[len(url) :], r.model) for r in rows if r.model) == [("/a", "large:2"), ("/a", "small:1"), ("/busy", "large:2"), ("/busy", "small:1")]
    errors = {r.url.removeprefix(url): r.error for r in rows if r.error}
    assert set(errors) == {"/gone", "/odd", "/slow", "http://127.0.0.1:9"} and "HTTP 404" in errors["/gone"] and "timed out" in errors["/slow"]
    assert seen["/gone/api/tags"] == 1 and seen["/busy/api/tags"] == 3
    hosted = endpoints.models(spark, [url], hosted="true", key="secret").collect() + endpoints.models(spark, [url], hosted="true", retries="0").collect()
    assert [(r.model, r.error is None) for r in hosted] == [("h1", True), (None, False)]
    assert endpoints.models(spark, []).count() == 0
    assert [r.ok for r in endpoints.models(spark, [f"{url}/a"]).groupBy().agg(F.collect_list("model").alias("all")).select(providers.installed(F.lit("small"), F.col("all")).alias("ok")).collect()] == [True]


def test_prompts_of_a_table(spark, url):
    prompts = spark.createDataFrame([(1, "abc"), (2, "please fail"), (3, None), (4, "")], "i int, prompt string")
    local = endpoints.HttpProvider(EngineConfig(local_url=url), "m", "e", pause=0.01)
    got = {r.i: r for r in endpoints.generated(prompts, local).collect()}
    assert (got[1].answer, got[1].tokens_in, got[1].tokens_out, got[1].error) == ("cba", 3, 1, None)
    assert got[2].answer is None and "HTTP 400" in got[2].error and got[3].answer is None and got[3].error is None and len(got) == 4
    hosted = endpoints.HttpProvider(EngineConfig(hosted_enabled=True, hosted_key="secret", hosted_url=url), "m", "e", pause=0.01)
    assert [r.answer for r in endpoints.generated(prompts.where("i = 1"), hosted).collect()] == ["ABC"]
    assert [r.answer for r in providers.answer(prompts, local).orderBy("i").collect()][:2] == ["cba", None]
    vectors = {r.i: r.embedding for r in providers.embed(prompts, local, "prompt").collect()}
    assert vectors == {1: [3.0, 1.0], 2: [], 3: [], 4: []} or vectors[1] == [3.0, 1.0] and vectors[2] == vectors[3] == []


def test_counters_equal_the_sums_of_what_was_written(spark, url):
    prompts = spark.createDataFrame([(i, "x" * i if i % 7 else "fail") for i in range(1, 40)], "i int, prompt string")
    answers, observed = counters.counted(endpoints.generated(prompts, endpoints.HttpProvider(EngineConfig(local_url=url), "m", "e", pause=0.01)))
    path = scratch(spark, "answers")
    answers.write.parquet(path)
    told = observed.get
    plain = records.token_stats(spark.read.parquet(path)).first()
    assert (told["docs"], told["tokens_in"], told["tokens_out"]) == (plain.docs, plain.tokens_in, plain.tokens_out) == (39, sum(i for i in range(1, 40) if i % 7), 34)
    assert records.with_costs(spark.createDataFrame([told], "docs long, tokens_in long, tokens_out long")).first() == plain


def test_streams_report_while_they_run(spark):
    base = scratch(spark, "calls")
    rows = [(i, 10 * i, i) for i in range(30)]
    schema = "i int, tokens_in long, tokens_out long"

    def run():
        stream = counters.counted_stream(jobs.document_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema, files_per_batch=1))
        return counters.logged(spark, lambda: jobs.run_jobs(stream, lambda b: b, f"{base}/out", f"{base}/checkpoint"))

    for k in range(2):
        spark.createDataFrame(rows[15 * k : 15 * k + 15], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    total = run()
    assert (total["docs"], total["tokens_in"], total["tokens_out"], total["rows_read"], total["batches"], total["last_batch"]) == (30, 4350, 435, 30, 2, 1)
    assert run()["docs"] == 0  # nothing new
    assert spark.read.parquet(f"{base}/out").count() == 30
