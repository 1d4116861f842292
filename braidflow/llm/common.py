"""Helpers that all text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    It is chosen here only for a local master, where one machine runs everything; a cluster must name its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, with a lineage that ends at the files.

    All tables of an application lie in one folder, which :func:`sweep` deletes.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/braidflow/{spark.sparkContext.applicationId}"


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` made and that nothing reads any more."""
    _delete(table.sparkSession, table.written_to)


def sweep(spark: SparkSession) -> None:
    """Deletes what this application's operators have written; call it when their results have been saved."""
    _delete(spark, _run_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """Array of the runs of characters other than :data:`SPACES`; empty for null and for text without a word."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN, -1)).otherwise(F.array().cast("array<string>"))


def row_key(text: Column) -> Column:
    """Tells rows apart that carry one ``doc_id`` with different texts; repeated rows share it."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` rows (counted); else as it is, for a shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


#: Rows of a narrow table that may be broadcast, and the share of all rows beyond which a key is hot (one in so many).
FEW_ROWS = 500_000
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, on: str, total: int, how: str, also: Column | None = None) -> DataFrame:
    """``left`` joined with ``right`` by the column ``on``; ``right.n`` is how many of ``left``'s ``total`` rows have the key.

    ``how`` is inner, left or left_semi; ``also`` is a further condition. A small ``right`` (counted) is
    broadcast. Otherwise its hot keys are, at most a thousand whatever the corpus, and the rest meets by a shuffle.
    """

    def joined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        same = F.col(on) == F.col("_key")
        return a.join(b, same if also is None else same & also, how).drop("_key")

    right = right.withColumnRenamed(on, "_key")
    if small_enough(right, FEW_ROWS):
        return joined(left, F.broadcast(right), how)
    keys = F.broadcast(right.filter(F.col("n") > max(total / HOT_SHARE, 1)).select(F.col("_key").alias("_hot")).distinct())
    ours, theirs = F.col(on) == F.col("_hot"), F.col("_key") == F.col("_hot")
    hot = joined(left.join(keys, ours, "left_semi"), F.broadcast(right.join(keys, theirs, "left_semi")), how)
    return hot.unionByName(joined(left.join(keys, ours, "left_anti"), right.join(keys, theirs, "left_anti"), how))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """A deterministic sample of about ``bound`` rows (all rows where there are fewer), chosen by a hash of ``key``."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, even where ``use`` names it inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, step, show, kind: str) -> Column:
    """``show(state before, item)`` (of type ``kind``) for every item of an array, with ``state = step(state, item)`` carried from item to item.

    Appending to one array copies it each time, so the result is built in blocks of about the root of the array's
    length: n items cost n * sqrt(n) copied references, with no other growth.
    """
    block = f"array<{kind}>"

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.array_append(acc["out"], show(acc["state"], x)).alias("out"))

    def over(bound: Column) -> Column:
        all_, size = bound["items"], bound["size"]

        def chunk(acc: Column, k: Column) -> Column:
            empty = F.array().cast(block)
            done = F.aggregate(F.slice(all_, k * size + 1, size), F.struct(acc["state"].alias("state"), empty.alias("out")), one)
            return let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["out"], d["out"]).alias("out")))

        chunks = F.sequence(F.lit(0), F.ceil(F.size(all_) / size).cast("int") - 1)
        whole = F.aggregate(chunks, F.struct(zero.alias("state"), F.array().cast(f"array<{block}>").alias("out")), chunk)
        return F.when(F.size(all_) > 0, F.flatten(whole["out"])).otherwise(F.array().cast(block))

    size = lambda items: F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"), F.lit(1))
    return let(items, lambda i: let(F.struct(i.alias("items"), size(i).alias("size")), over))


#: Code points in a block of :func:`blocks`.
BLOCK = 4096


def blocks(text: Column) -> Column:
    """The text cut after every :data:`BLOCK` code points, so that a place in it is found without counting from its begin."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive, 0-based) of a text given by its :func:`blocks`."""
    at = lambda i: F.coalesce(F.get(cut, i), F.lit(""))
    first, last = (start / BLOCK).cast("int"), (end / BLOCK).cast("int")
    a, b = start % BLOCK, end % BLOCK
    inner = F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, F.substring(at(first), a + 1, b - a)).otherwise(F.concat(F.substring(at(first), a + 1, F.lit(BLOCK)), inner, F.substring(at(last), F.lit(1), b)))
