"""Labels of streamed documents, and their counts in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.operators.rules import RuleSet, apply_rules


def label_stream(docs: DataFrame, rules: RuleSet, document: str = "text", **options) -> DataFrame:
    """Rows with their labels; stateless, so no watermark is needed (append mode)."""
    return apply_rules(docs, rules, document, **options)


def label_counts(labelled: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each label in tumbling windows; rows later than ``late`` are dropped."""
    rows = labelled.withWatermark(time_col, late).select(time_col, F.explode("labels").alias("label"))
    return rows.groupBy(F.window(time_col, window), "label").agg(F.count(F.lit(1)).alias("n"))
