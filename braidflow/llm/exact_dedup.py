"""Exact duplicates through counting quotient filters.

1. Every text is normalised (white space runs become one space) and gets a 64-bit fingerprint; a narrow table of row
   number, key, fingerprint and digest is written, so that later steps move no text that is unique.
2. Each task puts the fingerprints of its rows into counting quotient filters, one for each range of leading bits: the
   quotient is the place, the remainder is stored in sorted order, and equal fingerprints are one entry with a counter.
   Filters hold whole fingerprints, so those of one range are merged without loss by their sorted remainders, and a
   fingerprint that a third of all rows share is one entry for each task.
3. Fingerprints with a count above one go on to the bytes: their texts are compared as a whole, by a map-side-combined
   aggregation over fingerprint and text. A fingerprint that only one text has is a group; one that several texts
   share is as many groups, told apart by the texts' digests (two texts with equal digests would stop the job).
4. Of a group the row with the least key stays, and of rows with one key and one text exactly one.

Defined results: null counts as empty text; rows with a null key come last among those of a group; rows that repeat a
key are rows of their own; an empty table gives no rows; columns other than key, text and ``carry`` are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

#: Fingerprints that one filter range holds on average, and those a task keeps before it writes its filters.
RANGE_ROWS = 250_000
HELD_ROWS = 2_000_000
HEADER = struct.Struct("<QBBB")


def pack(fps: np.ndarray, counts: np.ndarray, low: int) -> bytes:
    """A counting quotient filter of sorted distinct fingerprints of ``low`` bits.

    The quotients are kept as run lengths in unary (a one for each entry, a zero for each quotient), the remainders as
    bytes in their sorted order, counters above one behind a bit that says which entries have them.
    """
    n = len(fps)
    q = min(low, max(1, int(n - 1).bit_length()))
    quotient = (fps >> np.uint64(low - q)).astype(np.int64)
    runs = np.zeros(n + (1 << q), np.uint8)
    runs[np.arange(n) + quotient] = 1
    width = -(-(low - q) // 8)
    remainders = (fps & np.uint64((1 << (low - q)) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    many = counts > 1
    extra = counts[many].astype("<u8")
    w = max(1, -(-int(extra.max(initial=0)).bit_length() // 8))
    return b"".join((HEADER.pack(n, q, low, w), np.packbits(runs).tobytes(), remainders.tobytes(), np.packbits(many).tobytes(), extra.view(np.uint8).reshape(-1, 8)[:, :w].tobytes()))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The entries of :func:`pack` in sorted order, and their counts."""
    n, q, low, w = HEADER.unpack_from(data)
    at = HEADER.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    def numbers(rows: int, width: int) -> np.ndarray:
        wide = np.zeros((rows, 8), np.uint8)
        wide[:, :width] = take(rows * width).reshape(rows, width)
        return wide.reshape(-1).view("<u8")

    runs = np.unpackbits(take(-(-(n + (1 << q)) // 8)), count=n + (1 << q))
    quotient = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
    fps = quotient << np.uint64(low - q) | numbers(n, -(-(low - q) // 8))
    many = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[many] = numbers(int(many.sum()), w)
    return fps, counts


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entries of several filters of one range, with their counts added up."""
    parts = [unpack(x) for x in filters]
    fps, counts = np.concatenate([x for x, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(fps, kind="stable")  # a merge of runs that are sorted already
    fps, counts = fps[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]]))
    return fps[first], np.add.reduceat(counts, first)


def filters(rows: DataFrame, ranges: int) -> DataFrame:
    """``range, filter``: the counting quotient filters of each task's ``fp``, one for each of ``ranges`` (a power of two) ranges."""
    top = ranges.bit_length() - 1

    def build(held: list[np.ndarray]) -> pa.RecordBatch:
        fps, counts = np.unique(np.concatenate(held), return_counts=True)
        range_ = (fps >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(fps), np.int64)
        own = fps & np.uint64((1 << (64 - top)) - 1)
        cut = np.searchsorted(range_, np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(cut))
        packed = [pack(own[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]], 64 - top) for k in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names=["range", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += batch.num_rows
            if size >= HELD_ROWS:
                yield build(held)
                held, size = [], 0
        if size:
            yield build(held)

    return rows.select("fp").mapInArrow(run, "range int, filter binary")


def repeated(rows: DataFrame, ranges: int) -> DataFrame:
    """``fp, n``: fingerprints that the merged filters count more than once."""
    top = ranges.bit_length() - 1

    def of_range(key: tuple, table: pa.Table) -> pa.Table:
        fps, counts = merge(table.column("filter").to_pylist())
        many = counts > 1
        fps = fps[many] | np.uint64(key[0].as_py() << (64 - top) if top else 0)
        return pa.table({"fp": fps.view(np.int64), "n": counts[many]})

    return filters(rows, ranges).groupBy("range").applyInArrow(of_range, "fp bigint, n bigint")


def normalised(text: Column) -> Column:
    """Runs of white space become one space; only runs that are not one space already are touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), bits: int = 64) -> DataFrame:
    """``key``, the ``carry`` columns, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row.

    ``bits`` is the length of a fingerprint; a short one only sends more texts to the comparison of bytes.
    """
    t = normalised(F.col(text))
    fp = F.shiftrightunsigned(F.xxhash64(t), 64 - bits)
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.struct(*carry).alias("carry") if carry else F.lit(None).cast("int").alias("carry"), fp.alias("fp"), F.unhex(F.sha2(t, 256)).alias("digest")), "texts")
    total = rows.count()
    ranges = 1 << max(4, (total // RANGE_ROWS).bit_length())
    many = written(repeated(rows, ranges), "repeated")

    texts = join_counted(docs.select(fp.alias("fp"), t.alias("t")), many, "fp", total, "left_semi")
    names = texts.groupBy("fp", "t").agg(F.count("*").alias("n")).select("fp", F.unhex(F.sha2("t", 256)).alias("digest")).groupBy("fp", "digest").agg(F.count("*").alias("same"))
    one = F.when(F.col("same") == 1, F.lit(1)).otherwise(F.raise_error(F.lit("two texts share fingerprint and digest")).cast("int"))
    split = names.groupBy("fp").agg(F.sum(one).alias("texts")).filter("texts > 1")  # different texts under one fingerprint
    proved = written(many.join(split, "fp", "left").select("fp", "n", F.coalesce("texts", F.lit(1)).alias("texts")), "proved")

    member = join_counted(rows, proved, "fp", total, "inner").withColumn("name", F.when(F.col("texts") > 1, F.col("digest")))
    best = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "row")).alias("best")
    groups = member.groupBy("fp", "name").agg(best, F.count("*").alias("n"), F.first("texts").alias("texts")).filter("n > 1")
    groups = written(groups.select("fp", "name", F.col("best.key").alias("keep"), F.col("best.row").alias("keep_row"), "n"), "groups")
    out = join_counted(rows, groups, "fp", total, "left", F.col("name").isNull() | (F.col("digest") == F.col("name")))
    return out.select(
        F.col("key").alias(key), *[F.col(f"carry.`{c}`").alias(c) for c in carry], F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
