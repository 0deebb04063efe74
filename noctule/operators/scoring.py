"""Batch scoring of frames with a user's own function."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORE_SCHEMA = "image string, class_idx int, score double"
DETECTION_SCHEMA = ("image string, cls int, name string, conf double, "
                    "x1 double, y1 double, x2 double, y2 double")


def score_frames(frames: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                 schema: str = SCORE_SCHEMA) -> DataFrame:
    """Apply a model to frames in Arrow batches.

    ``load`` runs once per task and returns the scorer, a function from a
    batch of frames to rows of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            yield scorer(batch)

    return frames.mapInPandas(run, schema)


def top_class(scores: DataFrame, key: str = "image") -> DataFrame:
    """Class with the highest score; the lower index wins a tie."""
    best = F.max_by("class_idx", F.struct("score", -F.col("class_idx")))
    return scores.groupBy(key).agg(best.alias("class_idx"), F.max("score").alias("score"))


def detection_summary(objects: DataFrame, key: str = "image") -> DataFrame:
    return objects.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("max_conf"),
                                            F.avg("conf").alias("avg_conf"))
