"""Readers: label CSV, flow JSON lines, log files with a header of fields, alert lines, raw datasets, file inventory."""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators import harmonise

#: Bytes of a file that a task holds while it hashes it.
HASHED_AT_ONCE = 8 << 20

#: Code page 1252 has characters where Latin-1 has control codes.
CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0))
CHARACTERS = "".join(bytes([c]).decode("cp1252", "replace") for c in range(0x80, 0xA0))


def read_label_csv(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a label file in code page 1252 by position (repeated header names get their place), and its malformed rows.

    Rows whose fields are all empty are skipped; rows of another width are malformed. Everything stays text.
    """
    unique = [n if names.index(n) == k else f"{n}.{k}" for k, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in unique] + [T.StructField("_bad", T.StringType())])
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, encoding="ISO-8859-1", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    raw = raw.select(*[F.translate(F.col(f"`{n}`"), CONTROLS, CHARACTERS).alias(n) for n in [*unique, "_bad"]])
    empty = F.forall(F.array(*[F.col(f"`{n}`") for n in unique]), lambda v: v.isNull() | (F.trim(v) == ""))
    rows = raw.filter(~empty | F.col("_bad").isNotNull())
    return rows.filter("_bad is null").drop("_bad"), rows.filter("_bad is not null")


def read_exact_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines whose field set is exactly the schema's, and the other lines."""
    fields = sorted(f.name for f in T._parse_datatype_string(schema).fields)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.array_sort(F.json_object_keys("value"))
    exact = F.coalesce(keys == F.array(*map(F.lit, fields)), F.lit(False))
    parsed = lines.withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return parsed.filter(exact).select("_r.*"), parsed.filter(~exact).select("value")


def zeek_rows(lines: DataFrame, fields: list[str], value: str = "value") -> DataFrame:
    """Log rows by their tab-separated fields; ``-`` and ``(empty)`` are null, comment lines and rows of another width go. Works on streams."""
    parts = F.split(value, "\t", -1)
    ok = lines.filter(~F.col(value).startswith("#") & (F.size(parts) == len(fields)))
    null: Column = lambda c: F.when(~c.isin("-", "(empty)"), c)
    return ok.select(*[null(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(fields)])


def zeek_fields(spark: SparkSession, path: str) -> list[str]:
    """Field names from the first ``#fields`` line."""
    row = spark.read.text(path).filter(F.col("value").startswith("#fields")).first()
    return row["value"].split("\t")[1:] if row else []


def read_log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Alert, ready and summary lines with ``file`` and ``line`` numbers; lines that are no JSON keep null fields and ``bad``.

    Files are read in blocks, as any text; a line's number is the count of the lines in the file's blocks before its own,
    and its place within the block.
    """
    block = ["file", "_block"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    sizes = lines.groupBy(*block).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(sizes.select(*block, before.alias("_before")), block).withColumn("line", (F.col("_before") + F.row_number().over(W.partitionBy(*block).orderBy("_id"))).cast("int"))
    rows = numbered.filter(F.trim("value") != "").withColumn("_r", F.from_json("value", schema))
    return rows.select("file", "line", "_r.*", F.json_object_keys("value").isNull().alias("bad"))


def read_dataset(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    """A raw dataset of CSV files with a header, or Parquet; the schema is given, never inferred."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE") if form == "csv" else spark.read.schema(schema).parquet(path)


def read_firewall(spark: SparkSession, path: str) -> DataFrame:
    """A firewall log as the first layer's columns and ``y``."""
    names = spark.read.csv(path, header=True).columns  # the header alone: every field is read as text
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, header=True)
    out = harmonise.clean_firewall(raw)
    return out.select(*[F.col(c).cast("double").alias(c) if c != "y" else F.col(c) for c in out.columns])


def read_cic(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CIC flow files without redundant columns, with ``y``."""
    return harmonise.clean_cic(read_dataset(spark, path, schema))


def read_unsw(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """UNSW files with ``y``; texts are coded file by file, by first appearance."""
    parts = [harmonise.clean_unsw(read_dataset(spark, p, schema).withColumn("_order", F.monotonically_increasing_id()), "_order").drop("_order") for p in paths]
    return reduce(DataFrame.unionByName, parts)


def read_botiot(spark: SparkSession, path: str) -> DataFrame:
    """A NetFlow dataset in Parquet with ``y``, flags out of the mask and microseconds."""
    return harmonise.clean_botiot(spark.read.parquet(path))


def hash_files(files: DataFrame, name: str = "sha256") -> DataFrame:
    """``files`` (with ``path``) and the SHA-256 of each file's bytes, of any length: a task streams its files through the hash, a block at a time.

    The file systems are those that Arrow opens by address (local, HDFS, object stores); a null path has a null hash.
    """

    @F.arrow_udf("string")
    def digest(paths: pa.Array) -> pa.Array:
        return pa.array([None if p is None else file_hash(p) for p in paths.to_pylist()], pa.string())

    return files.withColumn(name, digest("path"))


def file_hash(path: str) -> str:
    system, at = fs.FileSystem.from_uri(quote(re.sub("^(file:)?/+", "file:///", path), safe="/:@"))
    running = hashlib.sha256()
    with system.open_input_stream(at, buffer_size=0) as stream:
        while block := stream.read(HASHED_AT_ONCE):
            running.update(block)
    return running.hexdigest()


def inventory(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Size, content hash, rows and header of every CSV file; whether it has the required columns; whether its name occurs twice.

    Rows and headers come from the files' blocks; the hash from streams of the files' bytes.
    """
    at = F.regexp_replace("path", "^file:/+", "file:/")
    sizes = spark.read.format("binaryFile").load(path).select(at.alias("path"), "length")
    hashes = hash_files(sizes.select("path").repartition("path"))  # one file a row, dealt over tasks
    lines = spark.read.option("encoding", "ISO-8859-1").text(path).filter(F.rtrim(F.col("value")) != "")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # escaped here, plain in the other reader
    read = lines.select(F.regexp_replace(address, "^file:/+", "file:/").alias("path"), "value", place.alias("place")).groupBy("path").agg((F.count("*") - 1).alias("rows"), F.min_by("value", "place").alias("first"))
    f = sizes.join(hashes, "path", "left").join(read, "path", "left")
    header = F.transform(F.split(F.coalesce("first", F.lit("")), ","), lambda x: F.trim(x))
    f = f.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "sha256", F.coalesce("rows", F.lit(-1)).cast("int").alias("rows"), header.alias("header"))
    names = f.groupBy("name").agg((F.count("*") > 1).alias("duplicate_name"))
    return f.join(names, "name").withColumn("complete", F.size(F.array_except(F.array(*map(F.lit, required)), "header")) == 0)
