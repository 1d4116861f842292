"""Benchmark decontamination by a prefix-filtered join (Spark expressions only).

A window is 13 consecutive words of a benchmark item (a shorter item is one window). A window occurs in a document only
if all its words do, so under any order of words its first word is a necessary prefix. Ordering words by rarity in the
corpus makes that prefix the window's rarest word, and the join on it gives few candidates. A candidate whose position
leaves no room for the window is dropped (positional and length bounds); what is left is compared word by word.

The benchmark's windows are broadcast if they are few (checked); otherwise they are joined by a shuffle on the word.
Defined results: null text has no words; an item without words has no window; an empty benchmark leaves all documents
clean; rows that repeat a ``doc_id`` are judged each by its own text; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, row_key, small_enough, written

WINDOW = 13
#: All but letters and digits of ASCII separates words; other characters belong to words.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000


def raw_words(text: Column) -> Column:
    """Words of a text in their own case; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP, -1)
    return F.array_remove(parts, "")


def lower_ascii(word: Column) -> Column:
    """The word with A-Z lowered and all else kept."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """``item_id, words`` (array) for every distinct window of every item."""
    items = benchmark.select("item_id", F.transform(raw_words(F.col("text")), lower_ascii).alias("w")).filter(F.size("w") > 0)
    n = F.greatest(F.size("w") - length, F.lit(0))
    starts = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), n)).alias("at"))
    return starts.select("item_id", F.slice("w", F.col("at") + 1, length).alias("words")).distinct()


def anchors(docs: DataFrame, wins: DataFrame, text: str = "text") -> DataFrame:
    """Each window with its rarest word in ``docs`` and that word's place: ``word, place, item_id, words``."""
    places = wins.select("item_id", "words", F.posexplode("words").alias("place", "word"))
    vocabulary = places.select("word").distinct()
    few = small_enough(vocabulary, BROADCAST_ROWS)
    tokens = docs.select(F.explode(raw_words(F.col(text))).alias("raw")).select(lower_ascii(F.col("raw")).alias("word"))
    if few:
        counts = tokens.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("seen"))
    else:  # words are counted in each task before any of them moves
        counts = tokens.groupBy("word").agg(F.count("*").alias("seen")).join(vocabulary, "word", "left_semi")
    ranked = places.join(F.broadcast(counts) if few else counts, "word", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    first = W.partitionBy("item_id", "words").orderBy("seen", "word", "place")
    return ranked.withColumn("r", F.row_number().over(first)).filter("r = 1").select("word", "place", "item_id", "words")


#: Bits of the filter that keeps words without an anchor out of a shuffle, and parts that the tokens of a hot anchor are dealt to.
FILTER_BITS = 1 << 24
SALTS = 64


def anchored_tokens(tokens: DataFrame, side: DataFrame) -> DataFrame:
    """``tokens`` joined with the windows of ``side`` by their word, for windows too many to be broadcast.

    A broadcast bitmap of the anchors' hashes, of fixed size, keeps other words out of the shuffle. Anchors with over a
    thousandth of what is left are dealt over :data:`SALTS` tasks, and their windows repeated for each.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    spans = side.select(bit("anchor").alias("b")).distinct().select((F.col("b") / 32_768).cast("int").alias("part"), (F.col("b") % 32_768).alias("at"))
    bitmap = spans.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))  # 512 rows of 4 KB at most
    at = bit("word")
    byte = F.conv(F.hex(F.substring("bits", (at % 32_768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = tokens.join(F.broadcast(bitmap), (at / 32_768).cast("int") == F.col("part")).filter(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("part", "bits")
    counts = written(some.groupBy("word").agg(F.count("*").alias("n")), "anchor-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") > max(total / 1000, SALTS)).select(F.col("word").alias("hot")))  # a thousand at most
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int")).otherwise(0)
    each = F.explode(F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    left = some.join(hot, F.col("word") == F.col("hot"), "left").withColumn("salt", salt).drop("hot")
    right = side.join(hot, F.col("anchor") == F.col("hot"), "left").select(*side.columns, each)
    return left.join(right, (F.col("word") == F.col("anchor")) & (F.col("salt") == F.col("_salt"))).drop("salt", "_salt")


def occurrences(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, row, at, size, item_id``: every place (0-based word) where a window of an item occurs in a document."""
    wins = windows(benchmark)
    anchored = written(anchors(docs, wins, text), "anchors")
    small = small_enough(anchored, BROADCAST_ROWS)
    side = anchored.withColumnRenamed("word", "anchor")
    by_word = side.groupBy("anchor").agg(F.collect_list(F.struct("place", "item_id", "words")).alias("wins")) if small else side
    rows = docs.select(F.col(key), row_key(F.col(text)).alias("row"), raw_words(F.col(text)).alias("w"))
    tokens = rows.select(key, "row", "w", F.posexplode("w").alias("pos", "raw")).withColumn("word", lower_ascii(F.col("raw")))
    if small:
        hits = tokens.join(F.broadcast(by_word), F.col("word") == F.col("anchor")).select(key, "row", "w", "pos", F.explode("wins").alias("c"))
    else:  # the words' arrays stay out of this shuffle
        near = anchored_tokens(tokens.select(key, "row", "pos", "word"), side).select(key, "row", "pos", F.struct("place", "item_id", "words").alias("c"))
        near = written(near.distinct(), "near").select(F.col(key).alias("_k"), F.col("row").alias("_r"), "pos", "c")
        hits = rows.join(broadcast_if(near, BROADCAST_ROWS), F.col(key).eqNullSafe(F.col("_k")) & (F.col("row") == F.col("_r"))).drop("_k", "_r")
    at, size = F.col("pos") - F.col("c.place"), F.size("c.words")
    roomy = hits.filter((at >= 0) & (at + size <= F.size("w")))
    same = F.transform(F.slice("w", at + 1, size), lower_ascii) == F.col("c.words")
    return roomy.filter(same).select(key, "row", at.alias("at"), size.alias("size"), F.col("c.item_id").alias("item_id"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least_share: int = 20) -> DataFrame:
    """``key, row, n_words, n_hit, n_items, item_ids`` (sorted strings) and ``contaminated`` for every row of ``docs``.

    ``row`` is :func:`~.common.row_key` of the text. A document is contaminated if a twentieth of its words are hit.
    """
    found = occurrences(docs, benchmark, key, text).groupBy(key, "row").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.collect_set("item_id").alias("items"))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    found = found.select(
        F.col(key).alias("_k"), F.col("row").alias("_r"), F.size(hit).cast("long").alias("hits"), F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("ids")
    )
    base = docs.select(F.col(key), row_key(F.col(text)).alias("row"), F.size(raw_words(F.col(text))).cast("long").alias("n_words"))
    out = base.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col("row") == F.col("_r")), "left")
    n_hit = F.coalesce("hits", F.lit(0).cast("long"))
    return out.select(
        key, "row", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; columns as they were."""
    bad = broadcast_if(contaminated_keys(docs, benchmark, key, text), BROADCAST_ROWS)
    packed = docs.select(F.struct("*").alias("doc"), F.col(key).alias("_key"), row_key(F.col(text)).alias("_row"))  # so that no name can clash
    return packed.join(bad, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left_anti").select("doc.*")


def contaminated_keys(docs: DataFrame, benchmark: DataFrame, key: str, text: str) -> DataFrame:
    c = contamination(docs, benchmark, key, text)
    return written(c.filter("contaminated").select(F.col(key).alias("_k"), F.col("row").alias("_r")), "contaminated")
