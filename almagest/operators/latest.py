"""Latest snapshot, kept as parts that are replaced on their own."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions import variant as V
from almagest.operators.keys import first_per_key
from almagest.session import read_table


def replace_newer(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Header row per part after a publish: a part moves only to a strictly newer as_of.

    On equal times the stored row stays, so an older or repeated result changes nothing.
    """
    both = stored.withColumn("replaced", F.lit(False)).unionByName(
        new.withColumn("replaced", F.lit(True)), allowMissingColumns=True
    )
    return first_per_key(both, ["part"], [F.col("as_of").desc(), F.col("replaced").asc()])


def body_is_object(body: str) -> Column:
    """A usable part body is a non-empty JSON object."""
    return F.coalesce(
        (F.length(body) > 2) & V.json_type(V.parse(body)).startswith("OBJECT"), F.lit(False)
    )


def assemble(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """Header of the merged document: one row with partial, invalid, updated_at, publish.

    `parts` has part, uploaded_at, valid; `expected` is the fixed list of part names, so
    the collected lists are bounded by it. A broken part stops the publish (the old
    document stays); so does having no part at all.
    """
    joined = expected.join(parts, "part", "left")
    missing = F.col("uploaded_at").isNull()
    broken = ~missing & ~F.coalesce("valid", F.lit(False))
    usable = ~missing & ~broken
    return joined.agg(
        F.array_sort(F.collect_list(F.when(missing, F.col("part")))).alias("partial"),
        F.array_sort(F.collect_list(F.when(broken, F.col("part")))).alias("invalid"),
        F.max(F.when(usable, F.col("uploaded_at"))).alias("updated_at"),
        F.count_if(usable).alias("present"),
        ((F.count_if(broken) == 0) & (F.count_if(usable) > 0)).alias("publish"),
    )


def changed_parts(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Parts that were added, removed, or whose as_of moved."""
    old = previous.select("part", F.col("as_of").alias("old_as_of"), F.lit(True).alias("was"))
    new = current.select("part", "as_of", F.lit(True).alias("is"))
    both = old.join(new, "part", "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "removed")
        .when(~F.col("as_of").eqNullSafe(F.col("old_as_of")), "moved")
    )
    return both.select("part", "old_as_of", "as_of", change.alias("change")).where(F.col("change").isNotNull())


def freshest(parts: DataFrame) -> DataFrame:
    """Newest as_of over all parts; parts without a time are ignored."""
    return parts.agg(F.max("as_of").alias("as_of"))


@dataclass(frozen=True)
class LatestTable:
    """Newest snapshot per part, records included, on append-only parquet.

    Records are written before the header that makes them visible, as in the slot
    table; the header of a part is its newest as_of, the first one among equal times.
    Records lie in folders of their part and publish, so a read opens the current ones
    only, however many were published before. One writer at a time.
    """

    spark: SparkSession
    root: str

    @property
    def records_path(self) -> str:
        return f"{self.root}/records"

    @property
    def headers_path(self) -> str:
        return f"{self.root}/headers"

    def headers(self) -> DataFrame | None:
        rows = read_table(self.spark, self.headers_path, [])
        if rows is None:
            return None
        return first_per_key(rows, ["part"], [F.col("as_of").desc(), F.col("uploaded_at").asc(), F.col("publish_id").asc()])

    def publish(self, records: DataFrame, as_of: DataFrame, at_ms: int | None = None) -> DataFrame:
        """Replace the parts named in `as_of` (part, as_of) whose time is strictly newer.

        A part without records is published empty. Returns the accepted headers.
        """
        publish_id = uuid.uuid4().hex
        stored = self.headers()
        now = F.timestamp_millis(F.lit(at_ms)) if at_ms is not None else F.current_timestamp()
        fresh = as_of
        if stored is not None:
            old = stored.select("part", F.col("as_of").alias("old_as_of"))
            fresh = as_of.join(old, "part", "left").where(
                F.col("old_as_of").isNull() | (F.col("old_as_of") < F.col("as_of"))
            ).drop("old_as_of")
        # Decided once: the headers written last must name what was written first.
        fresh = fresh.withColumns({"publish_id": F.lit(publish_id), "uploaded_at": now}).persist()
        try:
            records.join(fresh.select("part", "publish_id"), "part").hint("rebalance", "part").write.partitionBy(
                "part", "publish_id"
            ).mode("append").parquet(self.records_path)
            fresh.write.mode("append").parquet(self.headers_path)
        finally:
            fresh.unpersist()
        return self.spark.read.parquet(self.headers_path).where(F.col("publish_id") == publish_id)

    def read(self, part: str | None = None) -> DataFrame | None:
        """Current records of all parts or of one; one part's folder is all that is opened then."""
        current = self.headers()
        if current is None:
            return None
        rows = read_table(self.spark, self.records_path, ["part", "publish_id"])
        if rows is None:
            return None
        if part is not None:
            rows, current = rows.where(F.col("part") == part), current.where(F.col("part") == part)
        # One id per part at most: a filter on folders.
        ids = [r.publish_id for r in current.select("publish_id").distinct().collect()]
        rows = rows.where(F.col("publish_id").isin(ids))
        return rows.join(current.select("part", "publish_id"), ["part", "publish_id"], "left_semi")


def document_text(header: DataFrame, parts: DataFrame) -> DataFrame:
    """The header row with `document`, the merged text of the usable parts in order of their number.

    `parts` has part, position, body; names that begin with "flight:" are regions of one layer.
    Bodies are taken as they are. There are as many parts as the fixed list names.
    """
    quoted = F.to_json(F.array("part"))
    region = F.startswith("part", F.lit("flight:"))
    name = F.when(region, F.to_json(F.array(F.substring("part", 8, 1_000_000)))).otherwise(quoted)
    entry = F.concat(F.substring(name, 2, 1_000_000).substr(F.lit(1), F.length(name) - 2), F.lit(":"), F.col("body"))
    pieces = parts.select("position", region.alias("region"), entry.alias("entry"))
    lists = pieces.agg(
        F.struct(
            F.array_sort(F.collect_list(F.when(~F.col("region"), F.struct("position", "entry")))).alias("layers"),
            F.array_sort(F.collect_list(F.when(F.col("region"), F.struct("position", "entry")))).alias("regions"),
        ).alias("p")
    )

    def joined(c: str) -> Column:
        return F.array_join(F.col(f"p.{c}.entry"), ",")

    flight = F.when(F.size("p.regions") > 0, F.concat(F.lit('"flight":{"regions":{'), joined("regions"), F.lit("}}")))
    layers = F.when(F.size("p.layers") > 0, joined("layers"))
    stamp = F.date_format(F.col("updated_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    partial = F.when(F.size("partial") > 0, F.concat(F.lit('"partial":'), F.to_json("partial"), F.lit(","))).otherwise("")
    text = F.concat(F.lit('{"updatedAt":"'), stamp, F.lit('",'), partial, F.lit('"layers":{'), F.concat_ws(",", layers, flight), F.lit("}}"))
    return header.withColumn("p", lists.scalar()).select(*header.columns, text.alias("document"))


@dataclass(frozen=True)
class LatestDocument:
    """The merged document of a fixed list of parts, published whole or not at all.

    A missing part is named in `partial`, a broken one or having no part at all keeps the
    document that is there. Documents are one row each in an append-only table; the newest is
    the current one.
    """

    spark: SparkSession
    root: str
    names: tuple[str, ...]

    def rows(self) -> DataFrame | None:
        return read_table(self.spark, self.root, [])

    def publish(self, parts: DataFrame, at_ms: int | None = None) -> bool:
        """Assemble (part, body, uploaded_at) and publish; whether there is a new document."""
        listed = self.spark.createDataFrame([(n, i) for i, n in enumerate(self.names)], "part string, position int")
        known = parts.join(F.broadcast(listed), "part").withColumn("valid", body_is_object("body"))
        header = assemble(known.select("part", "uploaded_at", "valid"), listed.select("part"))
        now = F.timestamp_millis(F.lit(at_ms)) if at_ms is not None else F.current_timestamp()
        rows = document_text(header.where("publish"), known.where("valid")).withColumn("published_at", now)
        before = self.rows()
        number = 0 if before is None else (before.agg(F.max("number")).first()[0] or 0) + 1
        [row] = rows.collect() or [None]  # one document of the fixed list's parts
        if row is None:
            return False
        self.spark.createDataFrame([row], rows.schema).withColumn("number", F.lit(number)).write.mode("append").parquet(self.root)
        return True

    def read(self) -> DataFrame | None:
        """The current document, one row; None before the first."""
        rows = self.rows()
        return None if rows is None else rows.orderBy(F.col("number").desc()).limit(1)
