"""How long each rule takes, with a time limit: the log of slow rules.

Java's regular expressions know no timeout.  What Spark offers is to cancel a job: a rule that is over its
limit ends with an error of its own and the others go on.  A task that is stuck inside one expression only
gives its core back where ``spark.task.reaper.enabled`` is set.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.operators.rules import RuleSet, apply_rules

LIMIT_SECONDS = 300.0
SLOW_SECONDS = 30.0
MEASURED = "group string, label string, rule string, seconds double, n_matched long, error string"


def within(spark: SparkSession, seconds: float, action: Callable):
    """The action's result; TimeoutError if its jobs were cancelled after ``seconds``."""
    context, tag, over = spark.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as error:
        if over.is_set():
            raise TimeoutError(f"over {seconds:g} s") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def rule_times(docs: DataFrame, rules: RuleSet, document: str = "text", limit: float = LIMIT_SECONDS) -> DataFrame:
    """One row a rule, measured by itself over ``docs``, which is best a sample that is cached."""
    spark, rows = docs.sparkSession, []
    for rule, criterion in rules.rules:
        alone = apply_rules(docs.select(document), RuleSet([(rule, criterion)], []), document)
        started, n, error = time.monotonic(), None, None
        try:
            n = within(spark, limit, lambda alone=alone: alone.where(F.size("labels") > 0).count())
        except TimeoutError as late:
            error = str(late)
        rows.append((rule.group, rule.label, rule.rule, time.monotonic() - started, n, error))
    rows += [(r.group, r.label, r.rule, 0.0, None, e) for r, e in rules.bad]
    measured = spark.createDataFrame(rows, MEASURED)
    return measured.select(F.current_timestamp().alias("ts"), "*")


def slow(times: DataFrame, seconds: float = SLOW_SECONDS) -> DataFrame:
    """Rules over the time, or stopped."""
    return times.where((F.col("seconds") >= seconds) | F.col("error").startswith("over "))


def append_log(times: DataFrame, path: str) -> None:
    """Add rows to the log; ``session.last_rows`` reads the newest distinct ones."""
    times.write.mode("append").parquet(path)
