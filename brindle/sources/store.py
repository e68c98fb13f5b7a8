"""Versioned tables: every version is a folder written whole, and a small file names the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer was first."""


class Store:
    """Tables under a root, in Parquet or JSON; a version becomes visible when its name is written, after its tables are.

    An interrupted write leaves a folder that nothing names. Readers keep the version they opened.
    """

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        if fmt not in ("parquet", "json", "orc"):
            raise ValueError(f"unknown format: {fmt}")
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt

    def _heads(self) -> DataFrame:
        return self.spark.read.schema("no bigint, name string, schemas map<string,string>").option("pathGlobFilter", "*.json").json(f"{self.root}/heads").filter("name IS NOT NULL")

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _last(self) -> int:
        """The greatest number any writer has taken, whether or not it wrote the version."""
        fs, p = self._at(f"{self.root}/heads")
        return max((int(f.getPath().getName().split(".")[0]) for f in (fs.listStatus(p) if fs.exists(p) else ()) if f.getPath().getName()[0].isdigit()), default=0)

    def _name(self, no: int, row: dict) -> bool:
        """Creates the file that names a version; False if another writer was first to take its number."""
        fs, p = self._at(f"{self.root}/heads/{no:020d}.json")
        try:
            out = fs.create(p, False)
        except Exception:  # noqa: BLE001  only the Java side tells why; whether the file is there decides
            if not fs.exists(p):
                raise
            return False
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        return True

    def current(self) -> tuple[int, str, dict[str, str]] | None:
        fs, path = self._at(f"{self.root}/heads")
        if not fs.exists(path):
            return None
        row = self._heads().orderBy(F.desc("no")).head()
        return (row["no"], row["name"], row["schemas"]) if row else None

    def publish(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, expected: int | None = None) -> int:
        """Writes the tables as the next version, those not given are kept from the current one; returns its number.

        Compare and set: if another writer publishes meanwhile, or the current version is not the expected one (0: none),
        Conflict is raised and nothing is published. The name of a version is created once, by whoever is first.
        """
        was = self.current()
        if expected is not None and expected != (was[0] if was else 0):
            raise Conflict(f"version {was[0] if was else 0} is current, not {expected}")
        # A number that is taken but names nothing yet is a writer at work, or one that died: the next one is ours to try.
        no, name = self._last() + 1, uuid.uuid4().hex
        schemas = dict(was[2]) if was else {}
        for t, df in tables.items():
            at = f"{self.root}/{name}/{t}"
            df.write.partitionBy(*(partition_by or {}).get(t, [])).format(self.fmt).save(at)
            schemas[t] = f"{at}\n{df.schema.json()}"
        if not self._name(no, {"no": no, "name": name, "schemas": schemas}):
            raise Conflict(f"version {no} was published by another writer")
        return no

    def read(self, table: str, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        heads = self._heads()
        row = (heads.filter(F.col("no") == version) if version else heads.orderBy(F.desc("no"))).head()
        if row is None or table not in row["schemas"]:
            raise KeyError(f"no table {table} in version {version or 'current'}")
        at, _, schema = row["schemas"][table].partition("\n")
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).format(self.fmt).load(at)


def convert(spark: SparkSession, source: Store, target: Store, tables: list[str]) -> int:
    """Copies tables of the current version of one store to another, whatever their formats; the copy is compared before it counts.

    Rows are compared as multisets by the sum of their hashes, in one pass over each side. A difference raises ValueError.
    """
    before = target.current()
    no = target.publish({t: source.read(t) for t in tables}, expected=before[0] if before else 0)
    wrong = [t for t in tables if fingerprint(source.read(t)) != fingerprint(target.read(t, no))]
    if wrong:
        raise ValueError(f"copies differ: {wrong}")
    return no


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of hashes) of a table, the same whatever the order of its rows."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in sorted(df.columns)]).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.sum(h)).head()
    return n, int(total or 0)
