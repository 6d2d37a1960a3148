"""A partitioned Parquet table whose loads rewrite only the partitions they touch and can be resumed.

A load first finds the touched partitions, reading key and partition columns alone, then writes their new contents to a
pending folder inside the table (hidden from readers), then marks that folder as ready, and only then replaces the
partitions by a dynamic overwrite. Whatever is interrupted, `recover` (which each load calls first) finishes a load that
is ready and drops one that is not, so a load happens wholly or not at all once it has been run again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import durable
from .tables import latest

#: Touched partitions up to which the driver lists them, so that a scan is pruned by their values; more are all read.
MOST_LISTED = 5_000
#: Keys of updates up to which they are broadcast when their old partitions are looked for.
MOST_BROADCAST = 500_000


@dataclass
class Store:
    """A table in `path` with the columns of `schema`, in folders by the columns `partition`."""

    spark: SparkSession
    path: str
    schema: T.StructType
    partition: list[str]

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names) if self._filled() else self.spark.createDataFrame([], self.schema)

    def upsert(self, updates: DataFrame, keys: list[str], order: str | None = None) -> None:
        """Merge updates by key; of several for a key the last in `order` wins. A row whose partition changes moves."""
        self.recover()
        last = durable(latest(updates, keys, order).select(*self.schema.names), "updates")
        touched = last.select(*self.partition)
        if not set(self.partition) <= set(keys):
            wanted = last.select(*keys).distinct()
            few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
            held = self.read().select(*{*keys, *self.partition})
            touched = touched.unionByName(_semi(held, F.broadcast(wanted) if few else wanted, keys).select(*self.partition))
        touched = durable(touched.distinct(), "touched")
        self._replace(touched, _anti(self._of(self.read(), touched), last, keys).unionByName(last))

    def delete(self, condition: str | Column) -> None:
        """Delete the rows for which the condition is true; partitions without such a row are not touched."""
        self.recover()
        c = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        touched = durable(self.read().where(c).select(*self.partition).distinct(), "touched")
        self._replace(touched, self._of(self.read(), touched).where(~c))

    def recover(self) -> None:
        """Finish loads that were ready when they were interrupted, and drop others."""
        for pending in self._list("_pending-"):
            if self._list("part-", f"{pending}/ready"):
                self._apply(pending)
            else:
                self._delete(pending)

    def _of(self, rows: DataFrame, touched: DataFrame) -> DataFrame:
        """Those of the table's rows that are in touched partitions. Listed values prune the scan; the join is exact."""
        listed = touched.limit(MOST_LISTED + 1).collect()
        if len(listed) > MOST_LISTED:
            return _semi(rows, touched, self.partition)
        for c in self.partition:
            values = {r[c] for r in listed}
            some = F.col(c).isin([v for v in values if v is not None])
            rows = rows.where(some | F.col(c).isNull() if None in values else some)
        return _semi(rows, F.broadcast(touched), self.partition) if len(self.partition) > 1 else rows

    def _replace(self, touched: DataFrame, new: DataFrame) -> None:
        pending = f"{self.path}/_pending-{uuid.uuid4().hex}"
        new.write.partitionBy(*self.partition).parquet(f"{pending}/data")
        files: list[str] = []
        if self._filled():  # an overwrite does not reach partitions that have become empty, so their files are named
            held = self.read().select(*self.partition, F.col("_metadata.file_path").alias("_file"))
            gone = _anti(touched, self._data(pending).select(*self.partition).distinct(), self.partition)
            files = [r["_file"] for r in self._of(held, durable(gone, "gone")).select("_file").distinct().collect()]
        self._mark(pending, files)
        self._apply(pending)

    def _mark(self, pending: str, files: list[str]) -> None:
        self.spark.createDataFrame([(json.dumps(files),)], "value string").coalesce(1).write.text(f"{pending}/ready")

    def _apply(self, pending: str) -> None:
        files = json.loads(self.spark.read.text(f"{pending}/ready").first()[0])
        new = self._data(pending)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.partition).parquet(self.path)
        for f in files:  # written as URIs
            self._delete(self.spark._jvm.java.net.URI(f))
        self._delete(pending)

    def _data(self, pending: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{pending}/data").select(*self.schema.names)

    def _fs(self, path):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _filled(self) -> bool:
        """Whether the table has any file or partition yet."""
        return any(not x.rpartition("/")[2].startswith(("_", ".")) for x in self._list())

    def _list(self, prefix: str = "", folder: str | None = None) -> list[str]:
        fs, p = self._fs(folder or self.path)
        return [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)] if fs.exists(p) else []

    def _delete(self, path) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


def _semi(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.alias("a").join(b.alias("b"), _same(a, b, keys), "left_semi")


def _anti(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.alias("a").join(b.alias("b"), _same(a, b, keys), "left_anti")
