"""Scoring with a pluggable model, and a baseline that is trained here: logistic regression on summaries of the features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scorer is made once in each worker and maps a batch of feature vectors to probabilities.
Scorer = Callable[[np.ndarray], np.ndarray]


def scored(df: DataFrame, key: str, vector: str, make: Callable[[], Scorer]) -> DataFrame:
    """``key, score``: a row whose vector is null or that the model can't score has a null score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            known = frame["v"].notna().to_numpy()
            out = np.full(len(frame), np.nan)
            if known.any():
                try:
                    out[known] = model(np.stack(frame["v"][known].to_numpy()))
                except ValueError:
                    pass
            yield pd.DataFrame({"k": frame["k"], "score": pd.Series(out, index=frame.index).astype("Float64").mask(np.isnan(out))})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"k {kind}, score double").withColumnRenamed("k", key)


def results(score: Column, threshold: float) -> dict[str, Column]:
    """What a score says: a probability at the threshold is a drone."""
    drone = score >= threshold
    return {"drone_probability": score, "background_probability": 1 - score, "is_drone": drone, "margin": score - threshold, "confidence": F.greatest(score, 1 - score), "label_text": F.when(drone, "drone").when(score.isNotNull(), "no drone")}


def cross_entropy(score: Column, label: Column) -> Column:
    """Loss of each sample; null where the score or the label is."""
    return F.when(label.isin(0, 1), -F.log(F.greatest(F.lit(1e-12), F.when(label == 1, score).otherwise(1 - score))))


def summary_vector(features: Column) -> Column:
    """Mean and deviation of each channel of a feature matrix, as one vector."""

    def of(c: Column) -> Column:
        n = F.size(c)
        m = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / n
        square = F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / n
        return F.array(m, F.sqrt(F.greatest(F.lit(0.0), square - m * m)))

    return F.flatten(F.transform(features, lambda c: of(F.transform(c, lambda x: x.cast("double")))))


def trained_baseline(df: DataFrame, vector: str, label: str, iterations: int = 50):
    """A logistic regression over array vectors; the weights of the classes are balanced."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_class"))
    rows = df.join(F.broadcast(counts), label).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"), (1 / F.col("n_class")).alias("weight"))  # two rows
    return LogisticRegression(maxIter=iterations, regParam=0.01, weightCol="weight").fit(rows)


def baseline_scores(model, df: DataFrame, vector: str, *keep: str) -> DataFrame:
    rows = df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return model.transform(rows).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
