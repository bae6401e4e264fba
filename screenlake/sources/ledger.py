"""The ledger of runs: one row a run, appended; the latest run of a name is found by an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, at timestamp, name string, config string, n long, metrics map<string,double>"


def append_run(spark: SparkSession, path: str, run: str, name: str, config: dict, n: int, metrics: dict[str, float]) -> None:
    """Add one run; what is there stays."""
    import json

    row = [(run, name, json.dumps(config, sort_keys=True), n, {k: float(v) for k, v in metrics.items()})]
    df = spark.createDataFrame(row, "run string, name string, config string, n long, metrics map<string,double>")
    df.select("run", F.current_timestamp().alias("at"), "name", "config", "n", "metrics").coalesce(1).write.mode("append").parquet(path)


def latest_runs(spark: SparkSession, path: str) -> DataFrame:
    """The latest run of each name (ties: the larger run id)."""
    runs = spark.read.schema(SCHEMA).parquet(path)
    return runs.groupBy("name").agg(F.max_by(F.struct("run", "at", "config", "n", "metrics"), F.struct("at", "run")).alias("x")).select("name", "x.*")


def summary(runs: DataFrame) -> DataFrame:
    """(name, metric, value) of runs, for a report."""
    return runs.select("name", F.explode("metrics").alias("metric", "value"))


def markdown(rows: DataFrame, columns: list[str], most: int = 200) -> str:
    """A report's table of the first ``most`` rows in order of the columns."""
    body = [[str(r[c]) for c in columns] for r in rows.select(*columns).orderBy(*columns).limit(most).collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [columns, ["-"] * len(columns), *body])
