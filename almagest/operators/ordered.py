"""Tables in canonical order: sorted over all files, with each file's bounds."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OrderedTable:
    """Rows sorted by one column from file to file, and (file, low, high, rows) beside them.

    Text compares byte by byte. A file holds about `rows_per_file` rows; a key with more rows
    than that goes on in the next file, ordered by a hash of the row. Rows without a key come
    first. A read of a range of keys opens only the files whose bounds it meets.
    """

    spark: SparkSession
    root: str
    key: str

    @property
    def rows_path(self) -> str:
        return f"{self.root}/rows"

    @property
    def bounds_path(self) -> str:
        return f"{self.root}/bounds"

    def write(self, df: DataFrame, rows_per_file: int = 1_000_000) -> None:
        files = max(1, -(-df.count() // rows_per_file))
        order = [F.col(self.key).asc_nulls_first(), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])]
        df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(self.rows_path)
        # the bounds are written last: without them there is nothing to read
        held = self.spark.read.schema(df.schema).parquet(self.rows_path).select(self.key, F.col("_metadata.file_path").alias("file"))
        held.groupBy("file").agg(
            F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(self.key).isNull()).alias("nulls")
        ).write.parquet(self.bounds_path)

    def bounds(self) -> DataFrame:
        return self.spark.read.parquet(self.bounds_path)

    def files(self, low, high) -> list[str]:
        """Files that can hold keys from low to high, both included."""
        met = self.bounds().where((F.col("high") >= F.lit(low)) & (F.col("low") <= F.lit(high)))
        return sorted(unquote(r.file) for r in met.select("file").collect())

    def read(self, low, high) -> DataFrame:
        """Rows with keys from low to high, both included."""
        schema = self.spark.read.parquet(self.rows_path).schema
        files = self.files(low, high)
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        return rows.where(F.col(self.key).between(F.lit(low), F.lit(high)))

    def is_sorted(self) -> DataFrame:
        """One row: whether no file begins before the one before it ends."""
        # one row per file
        order = F.array_sort(F.collect_list(F.struct("low", "high")))
        ends = self.bounds().where(F.col("low").isNotNull()).agg(order.alias("f"))
        steps = F.transform(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda x, i: x["low"] >= F.get("f", i)["high"])
        return ends.select(F.forall(steps, lambda ok: ok).alias("sorted"))
