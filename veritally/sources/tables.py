"""Reading and writing tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column as text, nothing taken for missing.

    Blank fields come back as empty strings, so ``?``, ``None`` or ``NULL`` stay
    ordinary levels.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    # A null marker that no file holds keeps quoted blanks apart from missing fields.
    df = spark.read.schema(schema).option("header", True).option("nullValue", "\u0001").csv(path)
    return df.fillna("")


def coerce_numeric(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cast the named columns that exist; text that is no number becomes null."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in columns.items() if c in df.columns})


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str) -> str:
    """Result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))


def write_attributions(phis: DataFrame, row_id: str, names: list[str], path: str) -> str:
    """Attribution matrix as Parquet rows (row_id, feature, phi)."""
    labels = F.array(*[F.lit(n) for n in names])
    long = phis.select(row_id, F.inline(F.arrays_zip(labels.alias("feature"), F.col("phi"))))
    return write_parquet(long.toDF(row_id, "feature", "phi"), path)


WHOLE_BYTES = 16 << 20  # larger files are never held as a row
READ_BYTES = 1 << 22


def _opened(uri: str):
    """A file of one of the stores that Arrow reaches, as a stream."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if uri.startswith("file:"):  # Spark writes names as they are, without escapes
        return LocalFileSystem().open_input_stream("/" + uri[len("file:") :].lstrip("/"))
    scheme, rest = uri.split("://", 1)
    store, name = FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{quote(rest)}")
    return store.open_input_stream(name)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file under a path that isn't empty, whatever its size.

    A small file is one row that Spark reads. A larger one is listed without its content and streamed by the task that
    lists it. Stores other than the local one are read through Spark itself as far as Spark's rows reach
    (``spark.sql.sources.binaryFile.maxLength``, 2 GB); beyond that Arrow's file systems must reach them from the executors.
    """
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").head(1)
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    if first and first[0]["path"].startswith("file:"):
        most = min(most, WHOLE_BYTES)
    small, large = files.where(F.col("length") <= most), files.where(F.col("length") > most)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for uri in rows["path"]:
                digest = hashlib.sha256()
                with _opened(uri) as f:
                    while part := f.read(READ_BYTES):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield rows.assign(sha256=found)

    streamed = large.select("path", F.col("length").alias("bytes")).mapInPandas(digests, "path string, bytes bigint, sha256 string")
    return small.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).unionByName(streamed)


def piece_digests(spark: SparkSession, path: str, piece_bytes: int = 64 << 20) -> DataFrame:
    """path, bytes, pieces, sha256 of files of any size: the SHA-256 of the hexadecimal SHA-256 of each piece, in order.

    Files that aren't empty are listed without their content, and every piece is a row that some task reads on its own.
    The store must be one that Arrow's file systems reach from the executors; ``file_digests`` reads
    files of other stores through Spark itself.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    last = F.ceil(F.col("bytes") / piece_bytes) - 1
    pieces = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    shuffled = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "piece")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for rows in batches:
            found = []
            for uri, piece in zip(rows["path"], rows["piece"]):
                plain = uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[len("file:") :]
                store, name = FileSystem.from_uri(plain)
                with store.open_input_file(name) as f:
                    f.seek(int(piece) * piece_bytes)
                    found.append(hashlib.sha256(f.read(piece_bytes)).hexdigest())
            yield rows.assign(sha256=found)

    read = shuffled.mapInPandas(digests, "path string, bytes bigint, piece bigint, sha256 string")
    ordered = F.array_sort(F.collect_list(F.struct("piece", "sha256")))  # one short row a piece
    return read.groupBy("path", "bytes").agg(
        F.count(F.lit(1)).alias("pieces"), F.sha2(F.array_join(F.transform(ordered, lambda x: x.sha256), ""), 256).alias("sha256")
    )
