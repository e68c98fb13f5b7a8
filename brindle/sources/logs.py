"""Append-only logs of JSON lines: merge metrics, audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE_METRICS = "merge_id string, started_at_ms bigint, phase_durations_ms map<string,bigint>, edges_regenerated bigint, compensated boolean, resumed_from_phase string, cardinality_violations array<string>"


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the log; lines that are not JSON of the schema are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_records(log: DataFrame, n: int, since_ms: int | None = None, ts: str = "started_at_ms", key: str = "merge_id") -> DataFrame:
    """The last n records by time, from since_ms on; n is held within 1 and 500, as the report's size."""
    df = log if since_ms is None else log.filter(F.col(ts) >= since_ms)
    return df.orderBy(F.desc(ts), F.desc(key)).limit(min(max(n, 1), 500))
