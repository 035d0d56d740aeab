"""Readers with explicit schemas (SRC-1 .. SRC-4).

Inference is only a fallback: the company and announcement files are read with
the types of a StructType so ``date`` is a DATE and the price flag a BOOLEAN on every run.
The source files use display headers (``Company Name``, ``announcementTypes``,
...); columns are selected by those names and renamed to snake_case.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPANIES_SCHEMA = T.StructType([
    T.StructField("company_name", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("load_seq", T.LongType()),
])
# header names as they appear in the files
COMPANIES_HEADER = ["Company Name", "Ticker", "load_seq"]

ANNOUNCEMENTS_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("announcement_types", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("is_price_sensitive", T.BooleanType()),
])
ANNOUNCEMENTS_HEADER = ["Ticker", "url", "Key", "announcementTypes", "date", "isPriceSensitive"]

RESPONSE_EVENTS_SCHEMA = T.StructType([
    T.StructField("response_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("delta", T.StringType()),
    T.StructField("ann_type", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("is_object", T.BooleanType()),
])


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, header: list) -> DataFrame:
    """Columns by the name in the file's header (display or field name), in any order, then cast.

    A file without ``load_seq`` gets one in file order; any other missing column is an error.
    """
    raw = spark.read.option("header", True).csv(path)
    out = []
    for field, shown in zip(schema.fields, header, strict=True):
        name = next((n for n in (shown, field.name) if n in raw.columns), None)
        if name is None and field.name != "load_seq":
            raise ValueError(f"{path} has no column {shown!r}")
        value = F.monotonically_increasing_id() if name is None else F.col(f"`{name}`")
        out.append(value.cast(field.dataType).alias(field.name))
    return raw.select(*out)


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType, header: list | None = None) -> DataFrame:
    if fmt == "csv":
        return _read_csv(spark, path, schema, header or schema.fieldNames())
    if fmt == "parquet":
        return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    raise ValueError(f"unsupported format {fmt}")


def read_companies(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC-1: company reference file -> (company_name, ticker, load_seq)."""
    return _read(spark, path, fmt, COMPANIES_SCHEMA, COMPANIES_HEADER)


def write_companies_csv(companies: DataFrame, path: str) -> str:
    """The company file in its display layout (header row, one file)."""
    (companies.select(*[F.col(c).alias(h) for c, h in zip(COMPANIES_SCHEMA.fieldNames(), COMPANIES_HEADER)])
     .coalesce(1).write.mode("overwrite").option("header", True).csv(path))
    return path


def read_announcements(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-2: announcements.  With the partitioned parquet layout of
    :func:`write_announcements`, date filters prune ``ym`` partitions and the
    ticker/date predicates are pushed into the row-group scan."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return _read(spark, path, fmt, ANNOUNCEMENTS_SCHEMA, ANNOUNCEMENTS_HEADER)


def write_announcements_csv(ann: DataFrame, path: str) -> str:
    """Announcements in their display layout, a header in each part file."""
    (ann.select(*[F.col(c).alias(h) for c, h in zip(ANNOUNCEMENTS_SCHEMA.fieldNames(), ANNOUNCEMENTS_HEADER)])
     .write.mode("overwrite").option("header", True).csv(path))
    return path


def write_announcements(ann: DataFrame, path: str) -> str:
    """Write once as parquet partitioned by year-month, sorted by (ticker, date) inside files.

    A derived ``ym`` partition column lets Catalyst prune partitions from a
    date predicate (it adds ``ym`` bounds via the generated filter below).
    """
    (ann.withColumn("ym", F.date_format("date", "yyyy-MM"))
     .repartition("ym").sortWithinPartitions("ticker", "date")
     .write.mode("overwrite").partitionBy("ym").parquet(path))
    return path


def prune_by_month(df: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Partition filter on ``ym`` equivalent to the closed date window (for pruning)."""
    return df.where(F.col("ym").between(date_from[:7], date_to[:7]))


def read_documents(docs: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """SRC-3: only the document bodies whose key is wanted (left semi join; duplicates in keys are harmless)."""
    return docs.join(keys.select(key_col).distinct(), key_col, "left_semi")


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The plain name of ``path`` if it lies in a file system that every machine mounts, else nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return full.getPath() if full.getScheme() == "file" else None


def _key_folder(key: str) -> str:
    """The folder of a key, as Spark names the folders of a partition column."""
    escaped = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", key)
    return f"key={escaped or '__HIVE_DEFAULT_PARTITION__'}"


def write_bodies(rows: Iterator, folder: str) -> None:
    """Rows (key, value) sorted by key, each key's values in one file that takes its name when it is whole."""
    for key, same in groupby(rows, lambda r: r.key):
        at = os.path.join(folder, _key_folder(key))
        os.makedirs(at, exist_ok=True)
        begun = os.path.join(at, f"_begun-{os.urandom(8).hex()}")       # a task may run twice at once
        with open(begun, "wb") as out:
            for r in same:
                out.write(r.value)
                out.write(b"\n")
        os.replace(begun, os.path.join(at, "body.txt"))


def write_document_files(docs: DataFrame, path: str, key_col: str = "key", text_col: str = "text") -> str:
    """Document bodies as UTF-8 files that end in a line break, a folder for every key under ``path``.

    A null text is an empty body, a null key has no file.  Bodies of a repeated
    key stand in one file.  Scale: in a mounted folder the tasks write their
    files themselves, as Spark's writer starts several programs (chmod) for
    every file there and moves every folder once more in the driver.
    """
    rows = (docs.where(F.col(key_col).isNotNull())
            .select(F.col(key_col).cast("string").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("value"))
            .repartition("key"))
    folder = _local_folder(docs.sparkSession, path)
    if folder is None:
        rows.write.partitionBy("key").option("lineSep", "\n").text(path)
    else:
        os.makedirs(folder)
        (rows.select("key", F.col("value").cast("binary").alias("value")).sortWithinPartitions("key")
         .foreachPartition(lambda part: write_bodies(part, folder)))
    return path


def read_bodies(keys: Iterator, folder: str) -> Iterator:
    """(key, bytes) of every file in the folders of the keys, in the order of its name; a key without a folder has none."""
    for key in keys:
        at = os.path.join(folder, _key_folder(key))
        if not key or key == "__HIVE_DEFAULT_PARTITION__" or not os.path.isdir(at):     # that folder is the null key's
            continue
        for name in sorted(os.listdir(at)):
            if name[0] not in "_." and not name.endswith("._COPYING_"):                 # what Spark's readers skip
                with open(os.path.join(at, name), "rb") as body:
                    yield key, body.read()


def read_document_files(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """SRC-3 from files: (key, text) of the wanted keys only.  A key without a file has no row.

    Scale: in a mounted folder the tasks go to the folders of their keys, and no
    machine lists the others.  Elsewhere Spark lists all files in the driver, and the
    semi join on the key, a partition column, prunes those that are opened.
    """
    wanted = keys.select(F.col(key_col).cast("string").alias("key")).where("key is not null").distinct()
    folder = _local_folder(spark, path)
    if folder is None:
        files = (spark.read.format("binaryFile")
                 .schema("path string, modificationTime timestamp, length long, content binary, key string").load(path))
        found = files.join(wanted, "key", "left_semi")
    else:
        def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in read_bodies(batch.column(0).to_pylist(), folder):
                    yield pa.RecordBatch.from_pydict({"key": [row[0]], "content": pa.array([row[1]], pa.binary())})

        # light in bytes and heavy in files: an explicit repartition, which adaptive execution keeps
        spread = wanted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
        found = spread.mapInArrow(bodies, "key string, content binary")
    text = F.decode("content", "utf-8")
    return found.select("key", text.substr(F.lit(1), F.length(text) - 1).alias("text"))


def read_response_events(spark: SparkSession, path: str, fmt: str = "json", streaming: bool = False) -> DataFrame:
    """SRC-4: response event files with the fixed event schema (batch or streaming)."""
    if streaming:
        reader = spark.readStream.schema(RESPONSE_EVENTS_SCHEMA)
        return reader.json(path) if fmt == "json" else reader.parquet(path)
    return _read(spark, path, fmt, RESPONSE_EVENTS_SCHEMA)
