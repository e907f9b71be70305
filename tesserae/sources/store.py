"""Tables on disk as append-only parquet logs: open, append, current state, snapshots, parameterised queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.schema import TABLES


class Store:
    """A folder of tables. Every write appends rows with `_op` (put or delete) and `_at`, its order; states are derived.

    Within one write, rows share `_at`; a later write wins over an earlier one. Snapshots go to a new folder, so
    that no path is overwritten while it's read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def schema(self, table: str) -> T.StructType:
        if table not in TABLES:
            raise ValueError(f"unknown table {table}")
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in TABLES[table].fields])

    def _log(self, table: str) -> DataFrame:
        schema = T.StructType([*self.schema(table).fields, T.StructField("_op", T.StringType()), T.StructField("_at", T.LongType())])
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def _append(self, table: str, rows: DataFrame, op: str) -> None:
        last = self._log(table).agg(F.max("_at")).first()[0] or 0
        names = [f.name for f in self.schema(table).fields]
        kinds = {f.name: f.dataType for f in self.schema(table).fields}
        rows = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names], F.lit(op).alias("_op"), F.lit(last + 1).cast("long").alias("_at"))
        rows.write.mode("append").parquet(f"{self.path}/{table}")

    def put(self, table: str, rows: DataFrame) -> None:
        self._append(table, rows, "put")

    def delete(self, table: str, keys: DataFrame, key: str = "id") -> None:
        """Tombstones for the keys."""
        self._append(table, keys.select(key).distinct(), "delete")

    def table(self, name: str, key: str | None = "id") -> DataFrame:
        """Current rows: the last write of each key, if it's no delete. Without a key, the log as it is."""
        log = self._log(name)
        if key is None:
            return log.where("_op = 'put'").drop("_op", "_at")
        latest = W.partitionBy(key).orderBy(F.desc("_at"))
        return log.withColumn("_k", F.row_number().over(latest)).where("_k = 1 and _op = 'put'").drop("_k", "_op", "_at")

    def first(self, table: str, where: Column, order: list[Column]) -> DataFrame:
        """At most one row: the first in order of those that fit."""
        return self.table(table).where(where).orderBy(*order).limit(1)

    def wipe(self) -> None:
        """All tables are empty from now on."""
        for name in TABLES:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def snapshot(self, path: str | None = None) -> Store:
        """Write all current tables to a new folder and open it."""
        place = path or f"{self.path}-{uuid.uuid4().hex[:8]}"
        for name in TABLES:
            keyed = "id" if any(f.name == "id" for f in TABLES[name].fields) else None
            Store(self.spark, place).put(name, self.table(name, keyed))
        return Store(self.spark, place)

    def query(self, sql: str, args: dict | None = None) -> DataFrame:
        """SQL over the tables' current states, with named parameters."""
        for name in TABLES:
            keyed = "id" if any(f.name == "id" for f in TABLES[name].fields) else None
            self.table(name, keyed).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args or {})


def wipe(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Empty tables of the same schemas."""
    return {name: df.limit(0) for name, df in tables.items()}


def new_id(*parts: Column) -> Column:
    """A deterministic id from what it identifies."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
