"""Builds and reads that go through ordered files in growing groups and stop when they have enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.operators import corpus
from loomspark.sources import jsonl, shards, versions

FIRST, GROWTH = 1, 4  # files in the first group; a group has at most so many times the files of the one before
COUNTS = ("kept", "short", "long", "excluded", "duplicate")


def group_size(last: int, have: int, target: int, done: int) -> int:
    """Files to read next: what the rate so far asks for, from 1 to ``GROWTH`` times the last group."""
    need = -(-(target - have) * done // have) if have else last * GROWTH
    return max(1, min(need, last * GROWTH))


def _settings(files: list[str], excluded: DataFrame, low: int, high: int) -> dict:
    """What a build must share with the one it carries on. More files may have come behind the old ones."""
    banned = excluded.select("digest").distinct().agg(F.count("*").alias("n"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("s")).first()
    return {"first_file": files[0].rsplit("/", 1)[-1], "exclusions": f"{banned.n}:{banned.s}", "low": low, "high": high}


def build(spark: SparkSession, source: str, out: str, excluded: DataFrame, low: int, high: int, target: int, text: str = "text", resume: bool = False, overwrite: bool = False, most_groups: int | None = None, require: bool = True) -> DataFrame:
    """Disjoint corpus of ``target`` tokens from the Parquet files under ``source``, kept in the table at ``out``.

    Files are read in the order of their paths; no file is opened after the
    group in which the target is reached. Rows of a group that are too short or
    long, excluded, or of a text that is there already are left out; the row
    that crosses the target is the last. Each group is a part of the table, with
    the files done and the counts of rows by reason in its state, so a build
    that stopped goes on with ``resume``; it must have the same settings.

    Returns (row_id, text, token_count, digest); row_id counts the source's
    rows. Fails if the source ends first, unless
    it isn't required to reach the target; what it gave stays for a resume. With
    ``most_groups`` the build stops after so many groups.
    """
    files = shards.list_files(spark, source, ".parquet")
    if not files:
        raise ValueError(f"no Parquet file under {source}")
    at = versions.version(spark, out)
    now = _settings(files, excluded, low, high)
    if at is not None and not (resume or overwrite):
        raise ValueError(f"{out} holds a build; resume or overwrite it")
    if at is None or overwrite:
        state = {"settings": now, "files": 0, "rows": 0, "next": 0, "tokens": 0, "group": 0} | dict.fromkeys(COUNTS, 0)
        empty = spark.createDataFrame([], f"row_id long, {text} string, token_count long, digest string")
        at = versions.commit(empty, out, at, state=state)
    state = versions.state(spark, out, at)
    _check(state, now, len(files))
    kept = versions.read(spark, out, at)
    if not kept.join(excluded.select("digest").distinct(), "digest", "left_semi").isEmpty():
        raise ValueError("the partial corpus holds excluded documents; start again")
    groups = 0
    while state["tokens"] < target:
        if state["files"] >= len(files):
            if not require:
                break
            raise ValueError(f"the source ends at {state['tokens']} of {target} tokens; the partial corpus stays at {out}")
        if most_groups is not None and groups == most_groups:
            break
        size = group_size(state["group"], state["tokens"], target, state["files"]) if state["group"] else FIRST
        group = files[state["files"] : state["files"] + size]
        at, state = _add(spark, out, at, state, group, excluded, low, high, target, text)
        groups += 1
    return versions.read(spark, out, at)


def _check(state: dict, now: dict, files: int) -> None:
    wrong = [k for k in now if state.get("settings", {}).get(k) != now[k]]
    if wrong:
        raise ValueError(f"the build at hand has other settings ({', '.join(wrong)}); start again")
    whole = all(isinstance(state.get(k), int) and not isinstance(state[k], bool) and state[k] >= 0 for k in ("files", "rows", "next", "tokens", "group", *COUNTS))
    if not whole or state["files"] > files or state["next"] < state["rows"]:
        raise ValueError("the build's state is damaged; start again")


def _add(spark: SparkSession, out: str, at: str, state: dict, group: list[str], excluded: DataFrame, low: int, high: int, target: int, text: str) -> tuple[str, dict]:
    """Add what one group of files gives; a group that isn't read to its end is read again from the next row on."""
    rows = shards.read_shards(spark, group, [text], state["rows"]).where(F.col("row_id") >= state["next"])
    keys = corpus.text_keys(rows, text)
    # digests of earlier groups count as duplicates, not as excluded ones
    seen = versions.read(spark, out, at).select("digest").withColumn("__seen", F.lit(True))
    told = corpus.reasons(keys.join(seen, "digest", "left"), excluded, low, high)
    told = told.withColumn("reason", F.when((F.col("reason") == "kept") & F.col("__seen"), "duplicate").otherwise(F.col("reason"))).drop("__seen")
    told = runtime.stored(told.withColumn("__kept", F.when(F.col("reason") == "kept", F.col("token_count")).otherwise(0)))
    read = corpus.running_sum(told, "__kept").where(F.col("cum") - F.col("__kept") < target - state["tokens"])
    read = runtime.stored(read.select("row_id", "token_count", "digest", "reason"))
    counts = {r.reason: (r.n, r.t) for r in read.groupBy("reason").agg(F.count("*").alias("n"), F.sum("token_count").alias("t")).collect()}  # at most five rows
    new = read.where("reason = 'kept'").drop("reason")
    new = rows.join(new, "row_id").select("row_id", text, "token_count", "digest")
    left, taken = keys.count(), sum(n for n, _ in counts.values())
    state = state | {k: state[k] + counts.get(k, (0, 0))[0] for k in COUNTS}
    state |= {"next": state["next"] + taken, "tokens": state["tokens"] + counts.get("kept", (0, 0))[1], "group": len(group)}
    if taken == left:
        state |= {"files": state["files"] + len(group), "rows": state["next"]}
    at = versions.commit(new, out, at, "append", state=state)
    runtime.discard(keys, told, read)
    return at, state


def repair(spark: SparkSession, source: str, out: str, excluded: DataFrame, low: int, high: int, target: int, text: str = "text") -> int:
    """Take excluded documents out of a finished build and fill it up again; returns how many there were.

    The build goes on behind the files it has read. If the refill fails, the
    table is again as it was. Nothing changes if it is disjoint already.
    """
    with versions.restoring(spark, out) as at:
        if at is None:
            raise ValueError(f"no build at {out}")
        bad = versions.read(spark, out, at).join(excluded.select("digest").distinct(), "digest", "left_semi").select("row_id", "token_count", "digest")
        bad = runtime.stored(bad)
        n = bad.agg(F.count("*").alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("t")).first()
        if n.n:
            state = versions.state(spark, out, at)
            files = shards.list_files(spark, source, ".parquet")
            state |= {"tokens": state["tokens"] - n.t, "kept": state["kept"] - n.n, "excluded": state["excluded"] + n.n, "settings": _settings(files, excluded, low, high)}
            versions.commit(bad.select("row_id"), out, at, "delete", ["row_id"], state)
            fixed = build(spark, source, out, excluded, low, high, target, text, resume=True)
            corpus.verify_disjoint(fixed, excluded).collect()
        runtime.discard(bad)
    return n.n


def read_jsonl_prefix(spark: SparkSession, path: str, documents: int, policy: str = "fail", blank_lines: bool = True) -> DataFrame:
    """The first ``documents`` usable rows of the JSON lines under ``path``, by file and line, with ``row_id``.

    The count is of documents, not of lines. Files are read in order in growing
    groups; those behind the group that is enough aren't opened.
    """
    files = shards.list_files(spark, path)
    if not files:
        raise ValueError(f"no file under {path}")
    done, have, size = 0, 0, FIRST
    while done < len(files) and have < documents:
        group = files[done : done + size]
        have += jsonl.read_jsonl(spark, group, policy, blank_lines).count()
        done += len(group)
        size = group_size(size, have, documents, done) if have < documents else 0
    read = jsonl.with_row_id(jsonl.read_jsonl(spark, files[: max(1, done)], policy, blank_lines))
    return read.where(F.col("row_id") < documents)
