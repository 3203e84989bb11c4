"""Writers, caches, result files and saved models."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import median_fold

# The schema of a fold result.
RESULT_SCHEMA = ("fold int, metrics struct<accuracy:double,precision:double,recall:double,f1:double,"
                 "specificity:double,g_mean:double>, n_train bigint, n_val bigint, "
                 "best_params map<string,string>, selected_features array<string>")


def materialize(df: DataFrame, path: str, partition: Sequence[str] = (), order: Sequence[str] = (),
                overwrite: bool = False) -> DataFrame:
    """Columnar copy, reused if it is there already; sorted inside files for good pruning."""
    spark = df.sparkSession
    if not overwrite:
        found = _existing(spark, path)
        if found is not None:
            return found
    out = df.sortWithinPartitions(*order) if order else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return spark.read.parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def cache_key(params: Mapping) -> str:
    """Hash of every parameter that shapes a cached table."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:24]


def cached(spark: SparkSession, root: str, params: Mapping, make: Callable[[], DataFrame]) -> DataFrame:
    """Table stored under the hash of all its parameters, so another setting never reuses it."""
    path = f"{root.rstrip('/')}/{cache_key(params)}"
    found = _existing(spark, path)
    return found if found is not None else materialize(make(), path, overwrite=True)


def nest_results(results: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Flat fold results to the nested result shape."""
    m = F.struct("accuracy", "precision", "recall", "f1", "specificity", "g_mean").alias("metrics")
    extra = [c for c in ("n_train", "n_val", "best_params", "selected_features") if c in results.columns]
    return results.select(*keys, m, *extra)


def write_results(results: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    writer = results.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).json(path)


def read_results(spark: SparkSession, glob: str, schema: str = RESULT_SCHEMA, multi_line: bool = False,
                 path_columns: Mapping[str, str] | None = None) -> DataFrame:
    """Nested result files; ``path_columns`` adds columns extracted from the file path."""
    df = spark.read.schema(schema).option("multiLine", multi_line).json(glob)
    made = {n: F.regexp_extract(F.col("_metadata.file_path"), p, 1) for n, p in (path_columns or {}).items()}
    return df.withColumns(made) if made else df


def flatten_results(nested: DataFrame) -> DataFrame:
    others = [c for c in nested.columns if c != "metrics"]
    return nested.select(*others, "metrics.*")


MEDIAN_SCHEMA = "model string, fold_id long, f1_score double, best_params map<string,string>, selected_features array<string>"


def write_median(results: DataFrame, path: str) -> None:
    """Parameters, columns, number and F1 of every model's median fold, one JSON file a model."""
    rows = median_fold(results, ["best_params", "selected_features"], ["model"])
    rows.select("model", F.col("fold").alias("fold_id"), F.col("f1_median").alias("f1_score"), "best_params", "selected_features").repartition(
        "model").write.mode("overwrite").partitionBy("model").json(path)


def read_median(spark: SparkSession, path: str) -> dict[str, dict]:
    """What ``write_median`` wrote, by model; parameter values are numbers where they are numbers. A row a model is read."""
    out = {}
    for r in spark.read.schema(MEDIAN_SCHEMA).json(path).collect():
        out[r["model"]] = {"best_params": {k: _number(v) for k, v in (r["best_params"] or {}).items()},
                           "selected_features": r["selected_features"] or [], "fold_id": r["fold_id"], "f1_score": r["f1_score"]}
    return out


def _number(text: str) -> object:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows as CSV part files (every file has the header)."""
    df.write.mode("append").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
