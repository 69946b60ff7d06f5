"""Model endpoints over HTTP: a data source that lists their models, and a provider with retries and time-outs."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..cluster import ship_package
from ..config import EngineConfig, generation_backend

# Paths of the endpoints and the time each kind of call may take, in seconds.
TAGS, EMBEDDINGS, GENERATE, MODELS, CHAT = "/api/tags", "/api/embeddings", "/api/generate", "/v1/models", "/v1/chat/completions"
LIST_TIME, EMBED_TIME, GENERATE_TIME, CHAT_TIME = 10, 60, 300, 120
#: Characters of an error that are kept.
MESSAGE = 300


class EndpointError(Exception):
    """A call that failed for good."""


def call(url: str, body: dict | None = None, headers: dict[str, str] | None = None, timeout: float = LIST_TIME, retries: int = 2, pause: float = 0.5) -> dict:
    """The JSON object that a GET, or with ``body`` a POST, is answered with.

    Lost connections, time-outs, answers that are no JSON object and the states 429 and 500 up are tried again, after a pause that doubles; other states are not.
    """
    data, error = None if body is None else json.dumps(body).encode(), ""
    for n in range(retries + 1):
        if n:
            time.sleep(pause * 2 ** (n - 1))
        try:
            ask = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})
            with urllib.request.urlopen(ask, timeout=timeout) as answer:
                said = json.loads(answer.read())
            if isinstance(said, dict):
                return said
            error = "no JSON object"
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code != 429 and e.code < 500:
                break
        except (OSError, ValueError) as e:
            error = str(e) or type(e).__name__
    raise EndpointError(f"{url}: {error}"[:MESSAGE])


class _Endpoint(InputPartition):
    def __init__(self, url: str, hosted: bool):
        self.url, self.hosted = url, hosted


class ModelSource(DataSource):
    """Format ``models``: url, model and error of the models that endpoints list, a partition each.

    Options: ``urls`` (separated by commas), ``hosted`` (true for the hosted form), ``key``, ``timeout``, ``retries``, ``pause``. An
    endpoint that can't be reached gives one row with an error; one without models none.
    """

    @classmethod
    def name(cls) -> str:
        return "models"

    def schema(self) -> str:
        return "url string, model string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _ModelReader(self.options)


class _ModelReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        hosted = self.options.get("hosted", "false").lower() == "true"
        return [_Endpoint(u.strip().rstrip("/"), hosted) for u in self.options.get("urls", "").split(",") if u.strip()]

    def read(self, partition: _Endpoint | None) -> Iterator[tuple]:
        if partition is None:  # no urls
            return
        headers = {"Authorization": f"Bearer {self.options['key']}"} if self.options.get("key") else {}
        try:
            said = call(partition.url + (MODELS if partition.hosted else TAGS), None, headers, float(self.options.get("timeout", LIST_TIME)), int(self.options.get("retries", 2)), float(self.options.get("pause", 0.5)))
        except EndpointError as e:
            yield partition.url, None, str(e)
            return
        for m in said.get("data" if partition.hosted else "models") or []:
            yield partition.url, m.get("id" if partition.hosted else "name"), None


def models(spark: SparkSession, urls: list[str], **options: str) -> DataFrame:
    """The models that endpoints list, see :class:`ModelSource`."""
    ship_package(spark)
    spark.dataSource.register(ModelSource)
    return spark.read.format("models").options(urls=",".join(urls), **options).load()


@dataclass(frozen=True)
class HttpProvider:
    """A provider (see :mod:`foliospark.sources.providers`) that calls the back-end which the configuration chooses; embeddings always come from the local one."""

    config: EngineConfig
    model: str
    embed_model: str
    most_tokens: int = 256
    retries: int = 2
    pause: float = 0.5
    times: dict = field(default_factory=lambda: {"embed": EMBED_TIME, "generate": GENERATE_TIME, "chat": CHAT_TIME})

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A call a text; a text whose call fails has an empty vector."""
        out = []
        for t in texts:
            try:
                out.append([float(v) for v in call(self.config.local_url.rstrip("/") + EMBEDDINGS, {"model": self.embed_model, "prompt": t}, None, self.times["embed"], self.retries, self.pause).get("embedding") or []])
            except EndpointError:
                out.append([])
        return out

    def answer(self, prompts: list[str]) -> list[str]:
        return [self.generate(p)[0] for p in prompts]

    def generate(self, prompt: str) -> tuple[str, int, int]:
        """The answer, and the tokens that went in and came out."""
        kind, url, headers = generation_backend(self.config)
        if kind == "hosted":
            body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": self.most_tokens, "stream": False, "response_format": {"type": "json_object"}}
            said = call(url + CHAT, body, headers, self.times["chat"], self.retries, self.pause)
            used, choices = said.get("usage") or {}, said.get("choices") or []
            if not choices:
                raise EndpointError(f"{url}: no answer")
            return choices[0]["message"]["content"], used.get("prompt_tokens", 0), used.get("completion_tokens", 0)
        body = {"model": self.model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": 0, "num_predict": self.most_tokens}}
        said = call(url + GENERATE, body, headers, self.times["generate"], self.retries, self.pause)
        return said.get("response", ""), said.get("prompt_eval_count", 0), said.get("eval_count", 0)


def generated(df: DataFrame, provider, prompt: str = "prompt") -> DataFrame:
    """With answer, error, tokens_in and tokens_out of each row's prompt: a call that fails gives an error, no row is lost; a null prompt isn't asked."""
    ship_package(df.sparkSession)

    @F.pandas_udf("struct<answer:string,error:string,tokens_in:long,tokens_out:long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b:
                try:
                    said, n_in, n_out = provider.generate(p) if p is not None else (None, 0, 0)
                    out.append((said, None, n_in, n_out))
                except Exception as e:  # noqa: BLE001
                    out.append((None, str(e)[:MESSAGE], 0, 0))
            yield pd.DataFrame(out, columns=["answer", "error", "tokens_in", "tokens_out"])

    said = df.withColumn("_said", run(F.col(prompt)))
    return said.select(*df.columns, *[F.col(f"_said.{c}").alias(c) for c in ("answer", "error", "tokens_in", "tokens_out")])
