"""Asking a judge for the ratings that are missing."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import parse_response


def ask(prompts: DataFrame, judge: Callable[[str, str], str], retries: int = 10, delay: float = 5.0, at_once: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(row_id, filter, model, response) of (row_id, filter, model, prompt).

    ``judge(prompt, model)`` runs in each task, ``at_once`` calls at a time. Any
    failure is tried again after delay * 2**(attempt - 1) and up to half a
    second; a call that never succeeds gives null.
    """

    def call(pair: tuple[str, str]) -> str | None:
        for attempt in range(1, retries + 1):
            try:
                return judge(*pair)
            except Exception:
                if attempt < retries:
                    sleep(delay * 2 ** (attempt - 1) + random.uniform(0, 0.5))
        return None

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                out = b[["row_id", "filter", "model"]].copy()
                out["response"] = list(pool.map(call, zip(b["prompt"], b["model"], strict=True)))
                yield out

    return prompts.select("row_id", "filter", "model", "prompt").mapInPandas(run, "row_id long, filter string, model string, response string")


def parsed(responses: DataFrame) -> DataFrame:
    """Answers as long ratings; answers that can't be read are left out."""
    x = responses.withColumn("e", parse_response(F.col("response"))).where("e is not null")
    return x.select("row_id", "filter", "model", F.col("e.rating").cast("double").alias("rating"), "e.explanation", "e.quote")
