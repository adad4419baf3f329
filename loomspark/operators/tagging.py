"""Scoring a corpus in batches of like length: packs of padded tokens, a run that can stop and go on, and rows written back in source order."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark import runtime
from loomspark.functions.permute import permuted
from loomspark.operators import scoring, upkeep
from loomspark.sources import shards, versions

LIMIT = 16_384  # padded tokens in a pack
PER_WAVE = 16  # length batches that are scored, and saved, together
SPAN, GROWTH = 30.0, 4  # seconds for which short waves are scored in one job, and times the waves of the job before, at most
VERSION = 1


def pack_ends(lengths: np.ndarray, limit: int) -> list[int]:
    """Ends of the packs of rows of rising length; the last one may still be open.

    A pack takes rows while their number times the longest one's length is at
    most ``limit``; a row that is longer than that makes a pack of its own.
    """
    ends, at = [], 0
    while at < len(lengths):
        most = max(1, limit // max(1, int(lengths[at])))
        window = lengths[at : at + most]
        fit = int(np.searchsorted(np.arange(1, len(window) + 1) * window, limit, side="right"))
        at += max(1, fit)
        ends.append(at)
    return ends


def _packs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Table]]:
    """(number within its batch, rows) of each pack of (__batch, __length, ...) rows; packs go over the ends of Arrow batches."""
    rest, number, last = None, 0, None
    for b in batches:
        rows = pa.Table.from_batches([b])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        group = np.array(rows["__batch"])
        edges = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        at = 0
        for edge in edges:
            if at == edge:
                continue
            number = number if group[at] == last else 0
            last = group[at]
            ends = [at + e for e in pack_ends(np.array(rows["__length"][at:edge]), limit)]
            if edge == len(group):
                ends = ends[:-1]  # more rows may fit into the last one
            for end in ends:
                yield number, rows.slice(at, end - at)
                number += 1
                at = end
        rest = rows.slice(at)
    if rest is not None and len(rest):
        yield number, rest


def score_packed(batched: DataFrame, load: Callable[[], Callable], n_targets: int, limit: int = LIMIT, most_tokens: int | None = None) -> DataFrame:
    """(row_id, batch, pack, pack_rows, padded_tokens, probs) of (row_id, batch, text, token_count) rows.

    ``load`` makes the model once for each task; it maps a list of texts to a
    list of ``n_targets`` probabilities each. Rows of a batch are packed by
    rising length, so padding each pack to its longest row costs at most
    ``limit`` tokens. A length counts from 1 to ``most_tokens``, where texts are
    cut by the model. Rows with a null text are scored as empty ones.
    """
    length = F.greatest(F.lit(1), F.coalesce("token_count", F.lit(0)))
    length = length if most_tokens is None else F.least(length, F.lit(most_tokens))
    rows = batched.select("row_id", F.col("batch").alias("__batch"), length.cast("long").alias("__length"), "text")
    rows = rows.repartition("__batch").sortWithinPartitions("__batch", "__length", "row_id")
    schema = pa.schema([("row_id", pa.int64()), ("batch", pa.int64()), ("pack", pa.int64()), ("pack_rows", pa.int64()), ("padded_tokens", pa.int64()), ("probs", pa.list_(pa.float32()))])

    def run(batches):
        model = None
        for number, t in _packs(batches, limit):
            model = model or load()
            p = model([x or "" for x in t["text"].to_pylist()])
            if len(p) != len(t) or any(len(x) != n_targets for x in p):
                raise ValueError(f"the model must give {n_targets} probabilities for each of {len(t)} texts")
            n, padded = len(t), len(t) * int(t["__length"][len(t) - 1].as_py())
            columns = [t["row_id"].combine_chunks(), t["__batch"].combine_chunks(), *(pa.array([v] * n, pa.int64()) for v in (number, n, padded)), pa.array([[float(y) for y in x] for x in p], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, "row_id long, batch long, pack long, pack_rows long, padded_tokens long, probs array<float>")


def _settings(source: DataFrame, model_name: str, targets: list[str], size: int, seed: int, first_row: int, per_wave: int) -> tuple[dict, int]:
    """What a run depends on, and how many rows it scores."""
    slim = source.where(F.col("row_id") >= first_row).select("row_id", "token_count")
    rows = upkeep.fingerprint(slim)
    n = int(rows.split("|")[0])
    return {"version": VERSION, "rows": rows, "model": model_name, "targets": targets, "batch_size": size, "seed": seed, "first_row": first_row, "per_wave": per_wave}, n


def _checked(state: dict, now: dict, n: int, size: int, per_wave: int) -> dict:
    wrong = [k for k in now if state.get("settings", {}).get(k) != now[k]]
    if wrong:
        raise ValueError(f"the saved run has other settings ({', '.join(wrong)}); start again with overwrite")
    waves = -(-(-(-n // size)) // per_wave)
    done, total = state.get("completed_waves"), state.get("waves")
    if any(not isinstance(x, int) or isinstance(x, bool) for x in (done, total)) or total != waves or not 0 <= done <= total:
        raise ValueError("the saved run's progress is damaged; start again with overwrite")
    return state


def _laid(spark: SparkSession, rows: str, waves: range, kind: T.StructType) -> tuple[int, DataFrame]:
    """(number of waves, their rows): ``waves``, up to the first of which the files are gone."""
    if not shards.list_files(spark, f"{rows}/wave={waves[0]}"):
        raise ValueError(f"the rows of wave {waves[0]} are gone; start again with overwrite")
    found = spark.read.schema(kind).parquet(f"{rows}/wave={{{','.join(map(str, waves))}}}")
    held = {int(re.search(r"/wave=(\d+)/[^/]*$", f)[1]) for f in found.inputFiles()}
    n = next((i for i, k in enumerate(waves) if k not in held), len(waves))
    return (n, found) if n == len(waves) else _laid(spark, rows, waves[:n], kind)


def next_span(waves: int, seconds: float) -> int:
    """Waves of the next job, after one of so many waves that took so long: what fits ``SPAN``, from 1 to ``GROWTH`` times as many."""
    return max(1, min(GROWTH * waves, int(waves * SPAN / max(seconds, 1e-3))))


def run(
    source: DataFrame,
    home: str,
    load: Callable[[], Callable],
    model_name: str,
    targets: list[str],
    size: int = 256,
    seed: int = 7,
    limit: int = LIMIT,
    first_row: int = 0,
    per_wave: int = PER_WAVE,
    resume: bool = False,
    overwrite: bool = False,
    most_waves: int | None = None,
) -> DataFrame:
    """(row_id, probs) of all (row_id, text, token_count) rows from ``first_row`` on, kept in the table under ``home``.

    Rows are put in batches of ``size`` by length, and the batches in a seeded
    order, of which ``per_wave`` make a wave. The texts are laid out by wave
    once, so each wave reads its own files alone. Waves are scored in spans, a
    job for each: one wave first, then as many as ``SPAN`` seconds hold by the
    time that the last span took. The scores of a span are added to the table
    together with the count of finished waves, so a run that is killed loses a
    wave or about ``SPAN`` seconds, and ``resume`` takes up the rest. A span
    that fails is halved down to the wave that does, and those before it are
    kept. The laid-out texts are deleted at the run's end. A run with other
    rows, lengths, model, targets or settings is refused, and so is a damaged
    state.
    """
    spark = source.sparkSession
    scoring.layout_of(targets)
    scores, rows = f"{home}/scores", f"{home}/rows"
    now, documents = _settings(source, model_name, targets, size, seed, first_row, per_wave)
    at = versions.version(spark, scores)
    if at is not None and not (resume or overwrite):
        raise ValueError(f"{home} holds a run; resume or overwrite it")
    if at is None and resume:
        raise ValueError(f"{home} holds no run to resume")
    if at is None or overwrite:
        batches = -(-documents // size)
        batched = scoring.length_batches(source.where(F.col("row_id") >= first_row).select("row_id", "token_count"), size)
        place = permuted(F.col("batch"), batches, seed)
        wave = batched.select("row_id", "batch", F.call_function("div", place, F.lit(per_wave).cast("long")).alias("wave"))
        laid = source.select("row_id", "text", "token_count").join(wave, "row_id")
        with runtime.freeing(spark):
            laid.repartition("wave").write.mode("overwrite").partitionBy("wave").parquet(rows)
        state = {"settings": now, "waves": -(-batches // per_wave), "completed_waves": 0, "documents": 0}
        at = versions.commit(spark.createDataFrame([], "row_id long, probs array<float>"), scores, at, state=state)
    state = _checked(versions.state(spark, scores, at), now, documents, size, per_wave)
    kind = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("token_count", source.schema["token_count"].dataType), T.StructField("batch", T.LongType())])
    done, width, failed = state["completed_waves"], 1, None  # failed: the end of a span in which a wave fails
    last = state["waves"] if most_waves is None else min(state["waves"], done + most_waves)
    while done < last:
        began = time.monotonic()
        n, batch = _laid(spark, rows, range(done, min(done + width, last)), kind)
        try:
            with runtime.freeing(spark):
                new = runtime.stored(score_packed(batch, load, len(targets), limit).select("row_id", "probs"))
        except Exception:
            if n == 1:
                raise
            width, failed = n // 2, done + n
            continue
        done += n
        state = state | {"completed_waves": done, "documents": state["documents"] + new.count()}
        at = versions.commit(new, scores, at, "append", state=state)
        runtime.discard(new)
        failed = failed if failed and done < failed else None
        width = max(1, (failed - done) // 2) if failed else next_span(n, time.monotonic() - began)
    if done == state["waves"]:
        runtime.delete(spark, rows)
    return versions.read(spark, scores, at)


def finished(spark: SparkSession, home: str) -> bool:
    state = versions.state(spark, f"{home}/scores")
    return state["completed_waves"] == state["waves"]


def tagged(source: DataFrame, scores: DataFrame, targets: list[str]) -> DataFrame:
    """``source`` with ``tags`` MAP<filter, MAP<judge, probability>> from (row_id, probs).

    Fails on a row without scores, on a number of scores other than that of the
    targets, on one that isn't from 0 to 1, and if the source has tags already.
    """
    return _with_tags(source.join(scores.select("row_id", "probs"), "row_id", "left"), source.columns, targets)


def _with_tags(found: DataFrame, columns: list[str], targets: list[str]) -> DataFrame:
    """``columns`` and ``tags`` of rows with their ``probs``."""
    if "tags" in columns:
        raise ValueError("the source has a tags column already")
    layout = scoring.layout_of(targets)
    say = lambda what: F.raise_error(F.concat(F.lit(what), F.col("row_id").cast("string"))).cast("array<double>")
    p = F.col("probs").cast("array<double>")
    p = F.when(F.col("probs").isNull(), say("no scores of row ")).when(F.size("probs") != len(layout), say("other targets in the scores of row "))
    p = p.when(F.exists("probs", lambda v: v.isNull() | F.isnan(v) | ~v.between(0, 1)), say("not a probability in row ")).otherwise(F.col("probs").cast("array<double>"))
    x = found.withColumn("__p", p)
    filters: dict[str, list] = {}
    for k, f, j in layout:
        filters.setdefault(f, []).extend([F.lit(j), F.col("__p")[k]])
    return x.withColumn("tags", F.create_map(*(c for f, pairs in filters.items() for c in (F.lit(f), F.create_map(*pairs))))).select(*columns, "tags")


def write_tagged(source: DataFrame, scores: DataFrame, targets: list[str], path: str, files: int | None = None) -> None:
    """``tagged`` rows as ``write_in_order`` writes them, with any further columns of ``scores``.

    Rows meet their scores in the ranges of row_id of the files, so texts are
    dealt out once.
    """
    own, more = [c for c in source.columns if c != "row_id"], [c for c in scores.columns if c not in ("row_id", "probs")]
    both = source.withColumn("__own", F.lit(True)).unionByName(scores.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    both = both.repartitionByRange(files or runtime.partitions(source.sparkSession), "row_id")
    there = (F.first(c, True).over(Window.partitionBy("row_id")).alias(c) for c in ("probs", *more))
    found = both.select("row_id", "__own", *own, *there).where("__own")
    rows = _with_tags(found, ["row_id", *own, *more], targets).sortWithinPartitions("row_id")
    with runtime.freeing(source.sparkSession):
        rows.drop("row_id").write.option("ignoreNullFields", "false").json(path)


def write_in_order(rows: DataFrame, path: str, files: int | None = None, order: str = "row_id", keep_order: bool = False) -> None:
    """Compact JSON lines of ``rows`` in files whose order, and lines in them, is that of ``order``.

    Rows are dealt out by ranges, so no task orders all of them.
    """
    files = files or runtime.partitions(rows.sparkSession)
    laid = rows.repartitionByRange(files, order).sortWithinPartitions(order)
    (laid if keep_order else laid.drop(order)).write.option("ignoreNullFields", "false").json(path)
