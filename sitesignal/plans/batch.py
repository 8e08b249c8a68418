"""A batch run: resume, main pass, retry pass, rendered pass, final rows, history."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.operators.rollup import (
    categorize, flatten_result, latest_per_target, resume_remaining, retry_targets, second_pass_targets, summarize,
)
from sitesignal.plans.analyze import analyze, apply_rendered_pass
from sitesignal.session import stage
from sitesignal.sources.sinks import append_attempts, append_history, write_results_csv
from sitesignal.sources.tables import exists, read_attempts, read_completed, read_results


def run_batch(targets: DataFrame, captures: DataFrame, output_path: str, *, robots: DataFrame | None = None,
              sitemaps: DataFrame | None = None, mx: DataFrame | None = None,
              retry_captures: DataFrame | None = None, resume: bool = False, second_pass: bool = True,
              history_path: str | None = None, personal_salt: str | None = None, completed_path: str | None = None, **options) -> DataFrame:
    """Run a batch and return its final rows, one per target of this run.

    ``output_path`` gets ``attempts`` (every row of every pass, appended, so a
    crash loses nothing already written) and ``final`` (one CSV row per target
    over all runs). Targets that a result CSV at ``completed_path`` has a row
    for, error rows included, are left out. ``retry_captures`` is a later fetch of the failed targets;
    rendered captures, if any, are the ``pass='rendered'`` rows of ``captures``.
    """
    spark = targets.sparkSession
    attempts = f"{output_path.rstrip('/')}/attempts"
    todo = targets.select("input_url").distinct()
    if resume and exists(spark, attempts):
        todo = resume_remaining(todo, read_attempts(spark, attempts).select("input_url").distinct())
    elif exists(spark, attempts):
        raise FileExistsError(f"{attempts} exists; pass resume=True or another output path")
    if completed_path is not None:
        todo = resume_remaining(todo, read_completed(spark, completed_path))
    run = time.time_ns() // 1000 * 10  # three passes at most, numbered within the run

    passes = [stage(analyze(todo, captures, robots, sitemaps, mx, **options), "pass0")]
    append_attempts(flatten_result(passes[0], personal_salt), attempts, run)
    if retry_captures is not None:
        again = retry_targets(passes[0]).select("input_url")
        passes.append(stage(analyze(again, retry_captures, robots, sitemaps, mx, **options), "pass1"))
        append_attempts(flatten_result(passes[1], personal_salt), attempts, run + 1)
    latest = _latest(passes)
    if second_pass and "pass" in captures.columns and not options.get("use_rendered"):
        chosen = second_pass_targets(latest).drop("pass_order")
        extraction = {k: v for k, v in options.items() if k in ("blocked_domains", "blocked_locals", "strict_obfuscation")}
        passes.append(stage(apply_rendered_pass(chosen, captures, **extraction), "pass2"))
        append_attempts(flatten_result(passes[-1], personal_salt), attempts, run + 2)
        latest = _latest(passes)
    latest = stage(categorize(latest), "latest")
    write_results_csv(read_results(spark, attempts), f"{output_path.rstrip('/')}/final")
    if history_path is not None:
        append_history(summarize(latest), history_path)
    return latest


def _latest(passes: list[DataFrame]) -> DataFrame:
    rows = None
    for seq, df in enumerate(passes):
        numbered = df.withColumn("seq", F.lit(seq).cast("bigint"))
        rows = numbered if rows is None else rows.unionByName(numbered)
    return stage(latest_per_target(rows).drop("first_seq"), "latest-rows")
