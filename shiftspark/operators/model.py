"""The two random forests, their summary and storage.

The forests are ``pyspark.ml`` estimators: training is distributed over the
partitions of the training frame (per-node statistics are aggregated across
executors), so it scales with the cluster, not with one machine.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.session import path_exists


LEAST_BINS = 366


@dataclass(frozen=True)
class ForestParams:
    num_trees: int = K.N_TREES
    max_depth: int = K.MAX_DEPTH
    seed: int = K.SEED
    # Continuous features are split on at most this many thresholds.  None =
    # max(366, entities): every day of the year and every entity code has a bin
    # of its own, so any value can be a split.  Statistics of a node take
    # 6 features x bins x 3 doubles; ``max_memory_mb`` says how many nodes a pass holds.
    # Every task of a pass holds that much, and as much again while it is shuffled; more
    # passes of fewer nodes give the same forest.
    max_bins: int | None = None
    max_memory_mb: int = 256
    # The layout before the fit depends on the rows alone, so the same data and
    # seed give the same forest on any cluster: one partition per
    # ``fit_rows_per_partition`` rows, at least ``fit_least_partitions``.
    fit_rows_per_partition: int = 500_000
    fit_least_partitions: int = 8


def _forest(label: str, prediction: str, p: ForestParams, bins: int) -> RandomForestRegressor:
    # All features considered at every split and one bootstrap sample of the
    # full size per tree: the configuration of the forests being reproduced.
    # A pass sends the trees that it grows with its tasks.  Node ids, once cached, would
    # be 100 numbers a row, held and written anew after every pass.
    return RandomForestRegressor(
        featuresCol="features", labelCol=label, predictionCol=prediction,
        numTrees=p.num_trees, maxDepth=p.max_depth, seed=p.seed, maxBins=bins,
        featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True,
        maxMemoryInMB=p.max_memory_mb, cacheNodeIds=False)


def fit_layout(train: DataFrame, p: ForestParams) -> tuple[int, int]:
    """(partitions, maxBins) for the fit, from one aggregate over the training rows;
    see ``ForestParams``.  Entity codes are dense, so there are max + 1 entities."""
    rows, top = train.agg(F.count("*"), F.max(K.ID_ENCODED)).first()
    parts = max(p.fit_least_partitions, -(-rows // p.fit_rows_per_partition))
    return parts, p.max_bins or max(LEAST_BINS, (top or 0) + 1)


def prepare_training(train: DataFrame, partitions: int) -> DataFrame:
    """Deterministic, balanced layout for the fit.

    Rows are hashed on everything that tells them apart (with the file-order
    ``row_seq`` when present), so neither a hot id nor a hot day lands in one
    task, then sorted inside each partition: same data, same partition count
    and same seed give the same forest.
    """
    cols = [*K.FEATURES, K.START, K.END]
    keys = [K.ID, K.DATE, K.START, K.END] + (["row_seq"] if "row_seq" in train.columns else [])
    return (train.select(*dict.fromkeys(keys + cols))
            .repartition(partitions, *keys)
            .sortWithinPartitions(*keys)
            .select(*cols))


def feature_vector() -> VectorAssembler:
    """The features as one vector, in their fixed order."""
    return VectorAssembler(inputCols=K.FEATURES, outputCol="features")


def fit_models(train: DataFrame, p: ForestParams = ForestParams()) -> PipelineModel:
    """M3 + M4: one pipeline = feature vector + start forest + end forest."""
    partitions, bins = fit_layout(train, p)
    pipe = Pipeline(stages=[
        feature_vector(),
        _forest(K.START, "pred_start", p, bins),
        _forest(K.END, "pred_end", p, bins),
    ])
    data = prepare_training(train, partitions).persist()
    try:
        return pipe.fit(data)
    finally:
        data.unpersist()


def training_summary(train: DataFrame, trained_at: Column,
                     p: ForestParams = ForestParams()) -> DataFrame:
    """M8: one row -- rows, entities, features and parameters."""
    return train.agg(
        F.count("*").alias("data_row_count"),
        F.count_distinct(K.ID).alias("entity_count")).select(
        F.lit(True).alias("is_trained"),
        trained_at.alias("trained_at"),
        "data_row_count", "entity_count",
        F.lit(",".join(K.FEATURES)).alias("features"),
        F.lit("RandomForestRegressor").alias("model_type"),
        F.lit(p.num_trees).alias("n_estimators"),
        F.lit(p.max_depth).alias("max_depth"),
        F.lit(p.seed).alias("random_state"),
        F.greatest(F.lit(p.fit_least_partitions), F.ceil(F.col("data_row_count") / p.fit_rows_per_partition))
         .cast("int").alias("fit_partitions"),
        (F.lit(p.max_bins) if p.max_bins else F.greatest(F.lit(LEAST_BINS), "entity_count")).cast("int").alias("max_bins"))


def save_models(model: PipelineModel, index: DataFrame, summary: DataFrame, path: str) -> None:
    """Forests, id codes and the summary under one folder."""
    base = path.rstrip("/")
    model.write().overwrite().save(f"{base}/forests")
    index.write.mode("overwrite").parquet(f"{base}/ids")
    summary.write.mode("overwrite").json(f"{base}/summary")


def load_models(spark: SparkSession, path: str):
    """``(model, index, summary)`` or ``None`` when nothing was saved; a
    storage failure or a damaged model raises."""
    base = path.rstrip("/")
    if not path_exists(spark, f"{base}/forests"):
        return None
    model = PipelineModel.load(f"{base}/forests")
    index = spark.read.parquet(f"{base}/ids")
    summary = spark.read.json(f"{base}/summary")
    return model, index, summary


def model_info(summary: DataFrame) -> dict:
    """The summary as a dict (one row reaches the driver)."""
    rows = summary.limit(1).collect()
    if not rows:
        return {"is_trained": False}
    return json.loads(json.dumps(rows[0].asDict(), default=str))
