"""Run folders that one run alone gets, and logs of JSON events in them."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources import shards, versions


def claim_run(spark: SparkSession, root: str, now: datetime | None = None) -> str:
    """A new folder ``run_<time>_utc`` under ``root``; runs of one second get ``_2``, ``_3`` and so on behind it.

    The folder belongs to who creates its claim file, so no two runs share one.
    """
    name = (now or datetime.now(timezone.utc)).strftime("run_%Y%m%d_%H%M%S_utc")
    k = 1
    while True:
        run = os.path.join(root, name if k == 1 else f"{name}_{k}")
        if versions.create_exclusively(spark, os.path.join(run, "_claim")):
            return run
        k += 1


class Log:
    """Events of one run, each with its time; every ``flush`` adds a file and changes no earlier one."""

    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.home = spark, os.path.join(run, "log")
        self.parts = len(shards.list_files(spark, os.path.join(self.home, "part-*.jsonl")))
        self.held: list[str] = []

    def add(self, event: dict) -> None:
        stamped = {"time": datetime.now(timezone.utc).isoformat()} | event
        self.held.append(json.dumps(stamped, ensure_ascii=False))

    def flush(self) -> None:
        if self.held:
            versions.write_text(self.spark, os.path.join(self.home, f"part-{self.parts:08}.jsonl"), "\n".join(self.held) + "\n")
            self.parts, self.held = self.parts + 1, []


def read(spark: SparkSession, run: str, schema: str) -> DataFrame:
    """(nth, columns of ``schema``) of a run's events, in their order; fields that an event lacks are null."""
    from loomspark.sources import jsonl

    rows = jsonl.with_row_id(jsonl.read_jsonl(spark, shards.list_files(spark, os.path.join(run, "log", "part-*.jsonl"))))
    made = F.from_json(F.to_json("value"), schema)
    return rows.select(F.col("row_id").alias("nth"), made.alias("e")).select("nth", "e.*")
