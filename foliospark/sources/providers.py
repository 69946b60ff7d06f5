"""Models behind an interface: embeddings and JSON answers, with stand-ins that need no network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship_package


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def answer(self, prompts: list[str]) -> list[str]: ...


class OfflineProvider:
    """Hashed character trigrams as embeddings; answers repeat what follows a key and a colon in the text."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for i in range(len(t) - 2):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=4).digest(), "little")
                v[h % self.size] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    def answer(self, prompts: list[str]) -> list[str]:
        """Values of the keys that a prompt asks for; without keys all that stand in lines as ``label: value``, as suggestions if the prompt asks for fields."""
        out = []
        for p in prompts:
            text = p.rpartition("TEXT:\n")[2]
            keys = re.findall(r'^- "(.*?)":', p.partition("SEEN:")[0], re.M)
            lines = re.findall(r"(?m)^([^:\n]{1,40}?)[ \t]*:[ \t]*(\S.*)$", text)
            if keys:
                said = {k: m[1].strip() if (m := re.search(rf"(?im)^{re.escape(k)}\s*:\s*(.*)$", text)) else "" for k in keys}
            elif '"fields"' in p:
                said = {"fields": [{"label": k, "value": v.strip(), "data_type": "text"} for k, v in lines]}
            else:
                said = {"datos": {re.sub(r"\W+", "_", k.lower()).strip("_"): v.strip() for k, v in lines}}
            out.append(json.dumps(said, ensure_ascii=False))
        return out


def backend_of(enabled: Column, key: Column, remote_url: Column) -> Column:
    """Which back-end answers prompts, as :func:`foliospark.config.generation_backend` chooses."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(enabled & some(key), "hosted").when(some(remote_url), "remote").otherwise("local")


def installed(name: Column, models: Column) -> Column:
    """Whether a model is among those listed, by its whole name or what is before the colon."""
    return F.exists(models, lambda m: (m == name) | (F.split_part(m, F.lit(":"), F.lit(1)) == name))


def embed(df: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    """With the column embedding; null texts have an empty one."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            have = b.notna()
            found = iter(provider.embed(b[have].tolist()))
            yield pd.Series([next(found) if h else [] for h in have])

    return df.withColumn("embedding", run(F.col(text)))


def answer(df: DataFrame, provider: Provider, prompt: str = "prompt") -> DataFrame:
    """With the columns answer and error: a call that fails gives an error, not a lost row."""
    ship_package(df.sparkSession)

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b:
                try:
                    out.append((provider.answer([p])[0], None) if p is not None else (None, None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, str(e)[:300]))
            yield pd.DataFrame(out, columns=["answer", "error"])

    return df.withColumn("_said", run(F.col(prompt))).withColumn("answer", F.col("_said.answer")).withColumn("error", F.col("_said.error")).drop("_said")
