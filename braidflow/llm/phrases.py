"""Phrases of two and three words that stand together more often than chance, by multikey quicksort of suffix pointers.

1. Texts are lowered, cut into pieces and words, and every task counts its words; each language's frequent words follow.
2. Every word is the beginning of a suffix, of which three words within its piece matter. A task combines equal windows
   and sends them to the partition of their leading word. Windows are cut before a word that is rare in its language (no
   phrase with it is frequent). Leading words with very many occurrences are routed by two words, pairs with very many
   by three, so that none meets in one task.
3. A partition sorts pointers to its windows by three-way quicksort, word by word down to three words: the pointers equal
   to the pivot are one prefix, whose size is its count and whose members are sorted on by the next word. Parts whose
   size is below the least count are abandoned. All parts of a round are split at once by array operations.
4. Counts of prefixes that are spread over partitions are added up; then phrases meet the counts of their parts.

Memory of a task: one block of text, or :data:`MOST_ROWS` windows; a leading word with more is sorted in blocks whose
counts, whole, are added up by Spark. Nothing but hot words and a bounded list of frequent words reaches the driver.
Defined results: null text has no words; a null language is ``und``; repeated rows count each; an empty table gives no
rows; columns other than text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, small_enough, written

LEAST = 10
DEPTH = 3
#: Bytes of text in one block of a task: a block of so many has less than two to the 21st words.
BLOCK = 1 << 21
HELD = 16 * BLOCK
#: A word or pair is hot from one occurrence in so many; frequent words beyond this number are not sent to the tasks.
HOT_WORDS, HOT_PAIRS = 20_000, 1000
FREQUENT_MOST = 4_000_000
ROWS_AT_ONCE, MOST_ROWS = 1 << 18, 1 << 20
FEW_ROWS = 500_000
#: Kinds of bytes: 0 belongs to a word, 1 separates words, 2 separates pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2


def blocks(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in blocks, each with the number of last words that the next block counts.

    A block ends at the end of a piece if there is one, else between words; then the next begins two words earlier.
    """
    at, size = 0, BLOCK
    while len(text) - at > size:
        kind = KIND[np.frombuffer(text, np.uint8, size, at)]
        ends, begins = np.flatnonzero(kind == 2), np.flatnonzero((kind[1:] == 0) & (kind[:-1] != 0)) + 1
        if ends.size:
            yield text[at : at + int(ends[-1]) + 1], 0
            at += int(ends[-1]) + 1
        elif begins.size >= DEPTH:  # the last word may go on in the next block
            yield text[at : at + int(begins[-1])], DEPTH - 1
            at += int(begins[-DEPTH])
        else:  # a few enormous words
            size *= 2
            continue
        size = BLOCK
    yield text[at:], 0


def tokens(data: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of every word in the list of distinct words, that list, and the number of the piece that each word is in."""
    raw = np.frombuffer(data.lower(), np.uint8)
    kind = KIND[raw]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = kind == 0
    begin, end = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    array = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word[1:-1]])]).dictionary_encode()
    return array.indices.to_numpy(), array.dictionary, piece


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
    """Language, text and number of last words to leave, in blocks; short texts of a language share one, parted as pieces are."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if len(text) > BLOCK:
                yield from ((lang, part, left) for part, left in blocks(text))
                continue
            more = size.get(lang, 0) + len(text) + 1
            for k in [lang] * (more > BLOCK and lang in held) or list(held) * (sum(size.values()) > HELD):
                yield k, b"\n".join(held.pop(k)), 0
                size.pop(k)
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
    for lang, texts in held.items():
        yield lang, b"\n".join(texts), 0


def follow(ids: np.ndarray, piece: np.ndarray, step: int) -> np.ndarray:
    """The word ``step`` places on, from 1; 0 where the piece ends before it."""
    out = np.zeros(len(ids), np.int64)
    if len(ids) > step:
        out[:-step] = np.where(piece[step:] == piece[:-step], ids[step:].astype(np.int64) + 1, 0)
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, w, w2, n``: counts of words (``w2`` null) by task, and of pairs that are frequent in a block of text.

    A pair with one in :data:`HOT_PAIRS` of all occurrences has at least half that share over the blocks that name it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, left in pooled(batches):
            ids, words, piece = tokens(data)
            whole = len(ids) - left
            n = np.bincount(ids[:whole], minlength=len(words))
            seen = np.flatnonzero(n)
            pair = (ids[:whole].astype(np.int64) << 22) | follow(ids, piece, 1)[:whole]
            pair, often = np.unique(pair[(pair & ((1 << 22) - 1)) > 0], return_counts=True)
            hot = often * 2 * HOT_PAIRS > max(whole, 1)
            pair, often = pair[hot], often[hot]
            first = np.concatenate([seen, pair >> 22])
            second = pa.concat_arrays([pa.nulls(len(seen), pa.string()), words.take(pa.array((pair & ((1 << 22) - 1)) - 1))])
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(first), np.int8))), words.take(pa.array(first)), second, pa.array(np.concatenate([n[seen], often]))], names=["lang", "w", "w2", "n"])

    each = docs.mapInArrow(run, "lang string, w string, w2 string, n bigint")
    return each.groupBy("lang", "w", "w2").agg(F.sum("n").alias("n"))


def windows(docs: DataFrame, hot_words: dict[str, set[str]], hot_pairs: dict[str, set[tuple[str, str]]], frequent: np.ndarray | None) -> DataFrame:
    """Each task's distinct windows of at least two words: those that go the same way are one row.

    ``level`` words of a window (``w1, w2, w3``, the others null) say where it goes. ``rest`` has the second and third
    word of every window (an absent one is empty), joined by spaces, and ``n`` their counts.
    ``frequent`` has the sorted hashes of all frequent words (two words with one hash do no harm), or is None.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hot_words, hot_pairs, frequent))
    mask = (1 << 21) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, pairs, often = shared.value
        for lang, data, left in pooled(batches):
            ids, words, piece = tokens(data)
            names = words.to_pylist()
            whole = len(ids) - left
            w1, w2, w3 = ids[:whole].astype(np.int64) + 1, follow(ids, piece, 1)[:whole], follow(ids, piece, 2)[:whole]
            if often is not None:
                seed = xxhash.xxh64_intdigest(lang, 42)
                h = np.array([xxhash.xxh64_intdigest(x, seed) for x in names], np.uint64)
                at = np.minimum(np.searchsorted(often, h), max(len(often) - 1, 0))
                good = np.concatenate([[False], often[at] == h]) if len(often) else np.zeros(len(h) + 1, bool)
                w2 = np.where(good[w2], w2, 0)
                w3 = np.where(good[w3] & (w2 > 0), w3, 0)
                w2 = np.where(good[w1], w2, 0)
            key, n = np.unique(((w1 << 42) | (w2 << 21) | w3)[w2 > 0], return_counts=True)
            a, b, c = key >> 42, (key >> 21) & mask, key & mask
            number = {x: k + 1 for k, x in enumerate(names)}
            level = np.where(np.isin(a, [number[x] for x in hot.get(lang, ()) if x in number]), 2, 1)
            level[np.isin(key >> 21, [number[x] << 21 | number[y] for x, y in pairs.get(lang, ()) if x in number and y in number])] = 3
            # windows that go the same way are one row
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (level[1:] != level[:-1]) | (level[1:] == 3) | (level[1:] == 2) & (b[1:] != b[:-1])])[: len(key)]
            begin = np.flatnonzero(new)
            offsets = pa.array(np.concatenate([begin, [len(key)]]).astype(np.int32))
            w = lambda x: words.take(pa.array(x - 1, mask=x == 0))
            rest = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.binary_join_element_wise(w(b), pc.fill_null(w(c), ""), " ")), " ")
            lv = level[begin]
            columns = [pa.array([lang]).take(pa.array(np.zeros(len(begin), np.int8))), w(a[begin]), w(np.where(lv > 1, b[begin], 0)), w(np.where(lv > 2, c[begin], 0)), pa.array(lv.astype(np.int32)), rest, pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "w1", "w2", "w3", "level", "rest", "n"])

    return docs.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, level int, rest string, n array<int>")


def expanded(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """The windows of :func:`windows` one by one, with their ``route``, so many at once."""
    size = np.diff(batch.column("n").offsets.to_numpy())
    upto = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + ROWS_AT_ONCE, side="right")))
        part = batch.slice(at, end - at)
        own = pa.array(np.repeat(np.arange(end - at), size[at:end]))
        words = pc.list_flatten(pc.split_pattern(part.column("rest"), " "))
        third = words.take(pa.array(np.arange(1, len(words), 2)))
        columns = {c: part.column(c).take(own) for c in ("route", "lang", "w1", "level")}
        yield pa.table({**columns, "w2": words.take(pa.array(np.arange(0, len(words), 2))), "w3": pc.if_else(pc.equal(third, ""), None, third), "n": pc.list_flatten(part.column("n")).cast(pa.int64())})
        at = end


def prefixes(words: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, a pointer and the count of every prefix with at least ``least`` occurrences, from ``words`` (depth x windows; 0: none).

    Three-way quicksort of pointers: all parts that are still open are split around the words of their middle pointers.
    """
    pointers = np.arange(len(n))
    lo, hi, depth = np.zeros(1, np.int64), np.full(1, len(n), np.int64), np.zeros(1, np.int64)
    while len(lo := lo[(open_ := hi > lo)]):
        hi, depth = hi[open_], depth[open_]
        size = hi - lo
        before = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(lo - before, size)
        p = pointers[at]
        pivot = words[depth, pointers[lo + size // 2]]
        key, middle = words[np.repeat(depth, size), p], np.repeat(pivot, size)
        weight = n[p]
        parts, base = [], lo
        for which in (key < middle, key == middle, key > middle):
            members = np.flatnonzero(which)
            upto = np.concatenate([[0], np.cumsum(which)])
            count = upto[before + size] - upto[before]
            pointers[np.arange(len(members)) + np.repeat(base - upto[before], count)] = p[members]
            sums = np.concatenate([[0], np.cumsum(weight[members])])
            total = sums[upto[before + size]] - sums[upto[before]]
            parts.append((base, base + count, total))
            base = base + count
        (a0, a1, a), (b0, b1, b), (c0, c1, c) = parts
        found = (b >= least) & (pivot > 0)
        for d in range(words.shape[0]):
            if (here := found & (depth == d)).any():
                yield d + 1, pointers[b0[here]], b[here]
        deeper = found & (depth + 1 < words.shape[0])
        lo, hi = np.concatenate([a0[a >= least], b0[deeper], c0[c >= least]]), np.concatenate([a1[a >= least], b1[deeper], c1[c >= least]])
        depth = np.concatenate([depth[a >= least], depth[deeper] + 1, depth[c >= least]])


def count_phrases(routed: DataFrame, least: int) -> DataFrame:
    """``lang, w1, w2, w3, n``: occurrences of every pair and triple, whole or in parts that add up, from windows dealt and sorted by ``route``."""

    def sort(rows: pa.Table, parts: bool) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        words = pa.concat_arrays([chunk for c in ("w1", "w2", "w3") for chunk in rows.column(c).chunks]).dictionary_encode()
        ids = pc.fill_null(pc.add(words.indices, 1), 0).to_numpy().astype(np.int64).reshape(DEPTH, -1)
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        ids[0] += lang.indices.to_numpy().astype(np.int64) * (len(words.dictionary) + 1)
        n, level = rows.column("n").to_numpy(), rows.column("level").to_numpy()
        for spread in (False, True):
            own = np.flatnonzero((level == DEPTH) == spread)
            for d, at, count in prefixes(ids[:, own], n[own], 1 if parts or spread else least) if len(own) else ():
                if d > 1:
                    take = rows.take(pa.array(own[at]))
                    third = take.column("w3") if d == DEPTH else pa.nulls(len(at), pa.string())
                    ok = pa.array(np.full(len(at), parts or d < DEPTH) | (count >= least))
                    yield from pa.table([take.column("lang"), take.column("w1"), take.column("w2"), third, pa.array(count)], names=["lang", "w1", "w2", "w3", "n"]).filter(ok).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, going_on = 0, None  # the route whose first blocks have been given out in parts
        for windows_ in (x for batch in batches for x in expanded(batch)):
            held.append(windows_)
            size += windows_.num_rows
            if size < ROWS_AT_ONCE:
                continue
            rows = pa.concat_tables(held)
            route = rows.column("route").to_numpy()
            cut = int(np.searchsorted(route, route[-1]))  # the last route may go on
            if going_on is not None and route[0] == going_on:
                mine = int(np.searchsorted(route, going_on, side="right"))
                yield from sort(rows.slice(0, mine), True)
                rows, cut = rows.slice(mine), max(cut - mine, 0)
                going_on = going_on if not rows.num_rows else None
            if cut:
                yield from sort(rows.slice(0, cut), False)
                rows = rows.slice(cut)
            if rows.num_rows >= MOST_ROWS:
                going_on = rows.column("route")[0].as_py()
                yield from sort(rows, True)
                rows = rows.slice(0, 0)
            held, size = [rows] if rows.num_rows else [], rows.num_rows
        if size:
            rows = pa.concat_tables(held)
            mine = int(np.searchsorted(rows.column("route").to_numpy(), going_on, side="right")) if going_on is not None and rows.column("route")[0].as_py() == going_on else 0
            if mine:
                yield from sort(rows.slice(0, mine), True)
            if rows.num_rows > mine:
                yield from sort(rows.slice(mine), False)

    return routed.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, n bigint")


def score(a: str, left: str, right: str) -> str:
    """floor(1000000 * a * a / (left * right)), exact for counts below ten to the 16th."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return f"cast(cast({wide(a)} * {wide(a)} as decimal(32, 0)) * 1000000 div ({wide(left)} * {wide(right)}) as bigint)"


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 2000, least: int = LEAST, share: int = 50) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``most`` phrases.

    A phrase within a longer one that has ``share`` per cent of its occurrences or more is left out.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = written(count_words(given), "words")
    words = counted.filter("w2 is null").select("lang", "w", "n")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    total = words.agg(F.sum("n")).first()[0] or 0
    hot_words: dict[str, set] = {}
    hot_pairs: dict[str, set] = {}
    for r in words.filter(F.col("n") > max(total / HOT_WORDS, least)).collect():  # at most HOT_WORDS rows
        hot_words.setdefault(r["lang"], set()).add(r["w"])
    for r in counted.filter("w2 is not null").filter(F.col("n") > max(total / (2 * HOT_PAIRS), least)).collect():  # at most 2 * HOT_PAIRS rows
        hot_pairs.setdefault(r["lang"], set()).add((r["w"], r["w2"]))
    frequent = words.filter(F.col("n") >= least)
    known = None
    if small_enough(frequent, FREQUENT_MOST):
        known = np.sort(frequent.select(F.xxhash64("lang", "w").alias("h")).toArrow().column("h").to_numpy().view(np.uint64))

    route = F.when(F.col("level") == 1, F.xxhash64("lang", "w1")).when(F.col("level") == 2, F.xxhash64("lang", "w1", "w2")).otherwise(F.xxhash64("lang", "w1", "w2", "w3"))
    routed = windows(given, hot_words, hot_pairs, known).repartition(route).withColumn("route", route).sortWithinPartitions("route")
    found = count_phrases(routed, least).groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = written(found, "phrases")

    one = broadcast_if(written(frequent, "frequent"), FEW_ROWS)
    two, three = found.filter("w3 is null").drop("w3"), found.filter("w3 is not null")

    def with_word(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(one.select("lang", F.col("w").alias(column), F.col("n").alias(name)), ["lang", column])

    pair = broadcast_if(two, FEW_ROWS)
    rest = three.join(pair.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("rest")), ["lang", "w2", "w3"])
    both = rest.join(pair.select("lang", "w1", "w2", F.col("n").alias("first")), ["lang", "w1", "w2"])
    long_ = with_word(with_word(both, "w1", "head"), "w3", "tail").withColumns({"s1": F.expr(score("n", "head", "rest")), "s2": F.expr(score("n", "first", "tail"))})
    early = F.col("s1") <= F.col("s2")
    long_ = long_.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.when(early, F.col("head")).otherwise(F.col("first")).alias("l"), F.when(early, F.col("rest")).otherwise(F.col("tail")).alias("r"), F.least("s1", "s2").alias("score"))

    inside = F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p")
    longest = three.select("lang", inside, "n").groupBy("lang", "p.w1", "p.w2").agg(F.max("n").alias("longer"))
    short = two.join(longest, ["lang", "w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))
    short = with_word(with_word(short, "w1", "l"), "w2", "r").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r", F.expr(score("n", "l", "r")).alias("score"))

    # each task keeps its first ``most`` of a language before they meet
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = short.unionByName(long_).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
