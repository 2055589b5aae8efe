"""Reading landed feed files, and the raw archive."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.scalars import hour_of, stamp_time
from almagest.operators.keys import computed_once
from almagest.schema import NEWS_COLUMNS, REGIONS

EXPORT_NAME = r"([0-9]{14})\.export\.CSV\.zip$"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed document: path, body, landed_at."""
    return (
        spark.read.text(path, wholetext=True)
        .withColumns({"path": F.col("_metadata.file_path"), "landed_at": F.col("_metadata.file_modification_time")})
        .withColumnRenamed("value", "body")
    )


def stream_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same rows from files as they land."""
    return (
        spark.readStream.option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(path)
        .withColumns({"path": F.col("_metadata.file_path"), "landed_at": F.col("_metadata.file_modification_time")})
        .withColumnRenamed("value", "body")
    )


def regions(spark: SparkSession) -> DataFrame:
    """The fixed collection regions."""
    return spark.createDataFrame(REGIONS, "region_id string, lat double, lon double")


def export_stamp(path: Column | str) -> Column:
    """File time from an export's name, null for any other file."""
    c = F.col(path) if isinstance(path, str) else path
    return stamp_time(F.regexp_extract(c, EXPORT_NAME, 1))


def pointer_files(texts: DataFrame) -> DataFrame:
    """Pointer text to the export it names: last word of the first line, with its stamp."""
    line = F.trim(F.split_part(F.col("body"), F.lit("\n"), F.lit(1)))
    url = F.element_at(F.split(line, r"\s+"), -1)
    at = export_stamp(url)
    return texts.withColumns({"url": url, "file_at": at}).where(at.isNotNull())


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of every file below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def unzip_exports(spark: SparkSession, path: str, limit_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of the first entry of every zip, and one status row per zip.

    Both come from the same rows. An entry is read through once, so that its checksum
    is known to be right, before the first of its lines is handed on: a damaged zip gives
    no line and the status `failed`. Lines leave in batches, so a large file never becomes
    one large Python object. Nothing is too large unless the caller sets a limit; then
    the file's status is `degraded` and tells its size.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.export.CSV.zip")
        .load(path)
        .select("path", "content")
    )

    def lines_of(archive: zipfile.ZipFile, entry: zipfile.ZipInfo, name: str) -> Iterator[pd.DataFrame]:
        with archive.open(entry) as stream:
            text = io.TextIOWrapper(stream, "utf-8", errors="replace", newline="\n")
            numbered = enumerate(line.rstrip("\n") for line in text)
            while part := list(islice(numbered, 10_000)):
                numbers, lines = zip(*part, strict=True)
                yield rows(name, line_no=list(numbers), line=list(lines))

    def rows(name: str, **columns: list) -> pd.DataFrame:
        n = len(next(iter(columns.values())))
        out = {"path": [name] * n, "line_no": None, "line": None, "uncompressed": None, "outcome": None, **columns}
        return pd.DataFrame({c: [None] * n if v is None else v for c, v in out.items()})

    def inflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                size, outcome = None, "ok"
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        entry = archive.infolist()[0]
                        size = entry.file_size
                        if limit_bytes is not None and size > limit_bytes:
                            outcome = "degraded"
                        else:
                            with archive.open(entry) as stream:
                                while stream.read(1 << 20):
                                    pass
                            yield from lines_of(archive, entry, name)
                except (zipfile.BadZipFile, zlib.error, IndexError, OSError, EOFError, ValueError, NotImplementedError):
                    outcome = "failed"
                yield rows(name, uncompressed=[size], outcome=[outcome])

    kind = "path string, line_no bigint, line string, uncompressed bigint, outcome string"
    both = files.mapInPandas(inflate, kind)
    lines = both.where(F.col("outcome").isNull()).select("path", "line_no", "line")
    return lines, both.where(F.col("outcome").isNotNull()).select("path", "uncompressed", "outcome")


def news_lines(lines: DataFrame) -> DataFrame:
    """Split export lines and keep the wanted columns; blank lines are no rows at all.

    A line that lacks a wanted column gives null columns, which the grid job counts as
    dropped.
    """
    rows = lines.where(~F.col("line").isin("", "\r"))
    parts = computed_once(rows, ["file_sec", "line_no"], [F.split(F.col("line"), "\t", -1).alias("parts")])
    full = F.size("parts") > max(NEWS_COLUMNS.values())
    wanted = [F.when(full, F.get("parts", F.lit(i))).alias(name) for name, i in NEWS_COLUMNS.items()]
    return parts.select("file_sec", "line_no", *wanted)


def archive_raw(docs: DataFrame, root: str) -> None:
    """Append raw documents below source / dt / hour."""
    (
        docs.withColumns({"dt": F.date_format("landed_at", "yyyy-MM-dd"), "hour": hour_of("landed_at")})
        .write.partitionBy("source", "dt", "hour")
        .mode("append")
        .parquet(root)
    )


def absent_only(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Put-if-absent: rows whose key the table does not hold yet."""
    return new.join(known.select(key).distinct(), key, "left_anti")


