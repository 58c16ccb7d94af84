"""Results of runs as partitioned Parquet, with a marker that is written last.

A run writes its tables to folders of its own. Only the marker makes them the
results of the dataset, so what a killed run leaves behind is never read, and a
later run replaces an earlier one by its marker.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MARKER = "dataset string, run string, finished timestamp, rows map<string, long>, summary string"


def write_run(spark: SparkSession, folder: str, dataset: str, tables: dict[str, DataFrame], summary: str | None = None) -> str:
    """Write ``tables`` and then the marker with their row counts; returns the run's id."""
    run, rows = uuid.uuid4().hex, {}
    for name, df in tables.items():
        path = f"{folder}/tables/{name}/dataset={dataset}/run={run}"
        df.write.parquet(path)
        rows[name] = spark.read.schema(df.schema).parquet(path).count()
    marker = spark.createDataFrame([(dataset, run, rows, summary)], "dataset string, run string, rows map<string, long>, summary string")
    marker.select("dataset", "run", F.current_timestamp().alias("finished"), "rows", "summary").coalesce(1).write.mode("append").parquet(f"{folder}/finished")
    return run


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """``dataset, run, finished, rows, summary`` of each dataset's last finished run; no rows where nothing was written yet."""
    try:
        markers = spark.read.schema(MARKER).parquet(f"{folder}/finished")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MARKER)
    last = Window.partitionBy("dataset").orderBy(F.desc("finished"), "run")  # a marker for each run of a dataset
    return markers.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of all finished datasets, with ``dataset``."""
    runs = finished(spark, folder).where(F.map_contains_key("rows", F.lit(name))).select("dataset", "run")
    return spark.read.option("basePath", f"{folder}/tables/{name}").parquet(f"{folder}/tables/{name}").join(F.broadcast(runs), ["dataset", "run"]).drop("run")
