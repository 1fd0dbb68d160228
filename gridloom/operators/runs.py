"""Runs, steps, review and cache, as append-only logs and their latest state.

Every change is a row; the state is the latest row of a key (an aggregate, with a partial one before the shuffle), so an upsert never rewrites a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_DAYS = 30
FLAGS = {"regions_confirmed": 2, "names_confirmed": 3, "crops_confirmed": 4, "bom_confirmed": 4}


def latest(log: DataFrame, *key: str, at: str = "ts", tie: str = "seq") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_last"))
    return last.select(*key, "_last.*")


def step_states(events: DataFrame) -> DataFrame:
    """events (run_id, step, kind start/complete/fail/rollback, ts, seq, error) -> one row for each step.

    A start clears what ended before; elapsed is the time from the last start to a later end.
    """
    e = events.withColumn("key", F.struct("ts", "seq"))
    got = e.groupBy("run_id", "step").agg(
        F.max_by("kind", "key").alias("kind"), F.max_by("error", "key").alias("error"),
        F.max(F.when(F.col("kind") == "start", F.col("key"))).alias("begun"), F.max(F.when(F.col("kind") != "start", F.col("key"))).alias("ended"),
    )
    status = F.create_map(*[F.lit(v) for kv in {"start": "running", "complete": "completed", "fail": "failed", "rollback": "invalidated"}.items() for v in kv])
    over = F.col("ended") > F.col("begun")
    seconds = F.when(over & F.col("kind").isin("complete", "fail"), F.unix_micros(F.col("ended.ts").cast("timestamp")) - F.unix_micros(F.col("begun.ts").cast("timestamp")))
    return got.select("run_id", "step", status[F.col("kind")].alias("status"), (seconds / 1e6).alias("elapsed"), F.when(F.col("kind") == "fail", F.col("error")).alias("error"))


def run_progress(steps: DataFrame) -> DataFrame:
    """Of each run its highest completed step and summed seconds; a step that completed once stays counted."""
    done = F.col("status") == "completed"
    return steps.groupBy("run_id").agg(F.coalesce(F.max(F.when(done, F.col("step"))), F.lit(0)).alias("current_step"), F.sum(F.when(done, F.col("elapsed"))).alias("seconds"))


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "run_id").limit(n)


def runs_of(runs: DataFrame, digest: str) -> DataFrame:
    return runs.where(F.col("pdf_hash") == digest).orderBy(F.desc("created_at"), "run_id")


def rolled_back_steps(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """Steps after their run's target become invalidated."""
    joined = steps.join(targets, "run_id", "left")
    after = F.coalesce(F.col("step") > F.col("target"), F.lit(False))
    return joined.withColumn("status", F.when(after, "invalidated").otherwise(F.col("status"))).select(*steps.columns)


def rolled_back_runs(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Runs with a target run again from it, without the confirmations of later steps."""
    joined = runs.join(targets, "run_id", "left")
    hit = F.col("target").isNotNull()
    cleared = {f: F.col(f) & ~(hit & (F.col("target") < before)) for f, before in FLAGS.items() if f in runs.columns}
    state = {"status": F.when(hit, "running").otherwise(F.col("status")), "current_step": F.coalesce("target", "current_step")}
    return joined.withColumns(cleared | state).select(*runs.columns)


def live_cache(cache: DataFrame, now, days: int = CACHE_DAYS) -> DataFrame:
    """The latest entry of each (pdf_hash, step) that is no older than its time to live."""
    fresh = cache.where(F.col("ts") > F.lit(now).cast(cache.schema["ts"].dataType) - F.expr(f"INTERVAL {days} DAYS"))
    return latest(fresh, "pdf_hash", "step")


def run_status(runs: DataFrame) -> DataFrame:
    """runs (run_id, failed, exception, completed, stored) -> the status that counts first: failed, an exception, completed, the stored one."""
    status = F.when(F.col("failed"), "failed").when(F.col("exception").isNotNull(), "error").when(F.col("completed"), "completed").otherwise(F.col("stored"))
    return runs.select("run_id", status.alias("status"))


def edited(rows: DataFrame, patches: DataFrame, key: tuple[str, ...] = ("page", "label")) -> DataFrame:
    """Rows after the reviewers' patches (key, action add/move/rename/delete, corners, new_label), the last patch of a key counting.

    A rename keeps the row's box; a move its label.
    """
    corners = ["x1", "y1", "x2", "y2"]
    p = latest(patches, *key)
    p = p.select(*key, "action", "new_label", *[F.col(c).alias(f"p_{c}") for c in corners])
    both = rows.join(p, list(key), "full_outer").where(F.coalesce("action", F.lit("")) != "delete")
    there = both.where(F.col("x1").isNotNull() | (F.col("action") == "add"))
    moved = {c: F.when(F.col("action").isin("add", "move"), F.col(f"p_{c}")).otherwise(F.col(c)) for c in corners}
    label = F.when(F.col("action") == "rename", F.col("new_label")).otherwise(F.col(key[-1]))
    return there.withColumns(moved | {key[-1]: label}).select(*key, *corners)


def selected_pages(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected pages of each document; all of one without a selection."""
    some = selection.select("doc").distinct().withColumn("some", F.lit(True))
    chosen = selection.select("doc", "page").distinct().withColumn("chosen", F.lit(True))
    return pages.join(some, "doc", "left").join(chosen, ["doc", "page"], "left").where(F.col("some").isNull() | F.col("chosen")).select(*pages.columns)


def numbered_new(existing: DataFrame, new: DataFrame, by: str = "page") -> DataFrame:
    """New crops with numbers after the page's highest: highest + their place; empty ones use up a number but don't come out."""
    top = existing.groupBy(by).agg(F.max("idx").alias("top"))
    joined = new.join(top, by, "left")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    out = joined.withColumn("idx", (F.coalesce("top", F.lit(0)) + place).cast("long")).drop("top")
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def answered_requests(requests: DataFrame, answers: DataFrame, wait: int = 3600) -> DataFrame:
    """Review requests (run_id, ts) with their first answer (run_id, ts, answer) within ``wait`` seconds: status answered or timed_out."""
    first = answers.groupBy("run_id").agg(F.min_by(F.struct(F.col("ts").alias("at"), "answer"), "ts").alias("a"))
    joined = requests.join(first, "run_id", "left")
    late = F.col("a.at") <= F.col("ts") + F.expr(f"INTERVAL {wait} SECONDS")
    in_time = F.coalesce(late & (F.col("a.at") >= F.col("ts")), F.lit(False))
    return joined.select("run_id", F.when(in_time, "answered").otherwise("timed_out").alias("status"), F.when(in_time, F.col("a.answer")).alias("answer"))
