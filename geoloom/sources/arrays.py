"""Array archives and sidecar files as DataFrames."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SIDECAR = (
    "name string, family string, n_samples int, n_features int, n_clusters int, seed long, noise double, shift double, scale double, cluster_std double, description string, source string, "
    "achieved_kmeans_ari double, target_range array<double>, in_target_range boolean, outliers int, primary_labels string, secondary_labels string, random_state int"
)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, pid, x, y`` of every archive that ``path`` (a folder or glob) names.

    Members are ``X`` and, for labels, ``y`` or else ``y_clean``; without either ``y``
    is null. An archive is read by one task.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.load(io.BytesIO(content), allow_pickle=False) as a:
                    x = np.asarray(a["X"], float)
                    y = next((np.asarray(a[k]).astype(np.int64) for k in ("y", "y_clean") if k in a.files), None)
                for i in range(0, len(x), 10_000):
                    part = x[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.rsplit("/", 1)[-1].removesuffix(".npz")] * len(part)), pa.array(np.arange(i, i + len(part))), pa.array(list(part), pa.list_(pa.float64())), pa.array(y[i : i + 10_000] if y is not None else [None] * len(part), pa.int64())],
                        ["dataset", "pid", "x", "y"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(unpack, "dataset string, pid long, x array<double>, y long")


def read_sidecars(spark: SparkSession, path: str, expected: int = 0) -> DataFrame:
    """Dataset descriptions, one pretty-printed JSON object a file; a count other than ``expected`` (0: any) is an error."""
    out = spark.read.schema(SIDECAR).option("multiLine", True).json(path).withColumn("dataset", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    if expected and (n := out.count()) != expected:
        raise ValueError(f"{n} sidecars where {expected} are expected")
    return out


def pending(datasets: DataFrame, done: DataFrame) -> DataFrame:
    """Datasets without a finished run, but for those of a thousand dimensions."""
    return datasets.where(~F.col("dataset").like("%1000d%")).join(done.select("dataset"), "dataset", "left_anti")
