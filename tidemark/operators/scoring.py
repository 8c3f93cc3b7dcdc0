"""Batch scoring of window samples with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.calibrate import DEFAULT_FRICTION

Predict = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


class LinearModel:
    """logit = features . weights + bias; z = features * weights."""

    def __init__(self, weights: list[float], bias: float = 0.0):
        self.weights, self.bias = np.array(weights), bias

    def __call__(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = features * self.weights
        return z.sum(1) + self.bias, z


def score(samples: DataFrame, predict: Predict, keys: list[str], features: str = "features", batch: int = 256, threshold: float = 0.01, scale: float = 10_000.0) -> DataFrame:
    """keys, pred_bp (scaled logit) and z_sparsity (share of components under the threshold). predict maps a matrix to logits and components.

    NULL feature arrays give NULLs. The model goes to each worker once.
    """
    shared = samples.sparkSession.sparkContext.broadcast(predict)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for rows in batches:
            known = rows[features].notna().to_numpy()
            pred, sparse = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
            places = np.flatnonzero(known)
            for lo in range(0, len(places), batch):
                at = places[lo : lo + batch]
                logit, z = model(np.stack(rows[features].iloc[at].to_numpy()).astype(float))
                pred[at], sparse[at] = logit * scale, (np.abs(z) < threshold).mean(1)
            yield rows[keys].assign(pred_bp=pred, z_sparsity=sparse)

    kept = samples.select(*keys, features)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keys)])
    scored = kept.mapInPandas(kernel, f"{schema}, pred_bp double, z_sparsity double")
    return scored.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("pred_bp", "z_sparsity")})


def with_defaults(samples: DataFrame, **values) -> DataFrame:
    """samples with c, target_bp and date, or other named columns, present and without NULL: 0.842, 0 and an empty date where they are missing."""
    wanted = {"c": DEFAULT_FRICTION, "target_bp": 0.0, "date": ""} | values
    return samples.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in samples.columns else F.lit(v) for c, v in wanted.items()})


def mapped_samples(samples: DataFrame, function: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """Each sample through a function of one's own, from a dict of its columns to one of the schema's; None leaves it out. What `functions.book` has as expressions is faster there."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [out for row in rows.to_dict("records") if (out := function(row)) is not None]
            if found:
                yield pd.DataFrame(found)

    return samples.mapInPandas(kernel, schema)


def score_stream(samples: DataFrame, predict: Predict, keys: list[str], out: str, checkpoint: str, **options) -> None:
    """Scores what has arrived in a stream of samples since the last run and adds it to the Parquet table `out`. The checkpoint knows the files that are done: a run that is started again scores each file once, also after a failure half way."""
    scored = score(samples, predict, keys, **options)
    scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()


def unscored(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The samples of keys (such as dates or shards) that no prediction has yet: what a resumed run has to score."""
    return samples.join(done.select(key).distinct(), key, "left_anti")


def scoring_summary(predictions: DataFrame) -> DataFrame:
    """n, mean sparsity, share of samples that are half sparse or more."""
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg("z_sparsity").alias("mean_sparsity"), F.avg((F.col("z_sparsity") >= 0.5).cast("double")).alias("sparse_share"))
