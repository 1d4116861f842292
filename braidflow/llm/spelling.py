"""Spelling variants: words one edit apart, found through a reduced alphabet.

1. Words are counted, each task adding up what it has read. Those with enough occurrences are the vocabulary.
2. Letters are dealt to a few symbols, so that all symbols are about equally frequent in the vocabulary. A word's reduced
   form is its sequence of symbols; words that share one are a bucket.
3. For every distinct reduced form the full neighbourhood of one deletion, replacement or insertion is generated (and the
   form itself, since letters of one symbol may replace each other), as hashes that follow from running sums over the
   form. It is joined with the vocabulary's reduced forms, each pair of forms once.
4. Words of joined forms are compared as they are written; a hash that two forms share costs a comparison, no more.
5. A bucket of very many words is not compared with its neighbours word by word: its words get their neighbourhoods in
   the full alphabet, where a form is one word.
6. A word's form is its most frequent near word, if that is frequent enough; roots come from doubling steps along forms,
   whose number is bounded by the logarithm of the greatest count.

Nothing of the vocabulary's size reaches the driver but a bounded list of hashes that thins neighbourhoods out early.
Defined results: null text has no words; a null key counts as empty; rows that repeat a key count each; an empty table or
vocabulary gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, small_enough, written

#: Runs of letters up to U+00FF as bytes of that code page; other characters end a run there too.
RUN = r"[a-z\xc0-\xff]+"
TYPO = 199
SHORTEST, LEAST, RATIO = 6, 5, 5
SYMBOLS = 4
#: Words of a bucket that are compared word by word; hashes that are sent to the tasks; distinct words a task holds.
CROWD = 256
KNOWN_MOST = 4_000_000
HELD = 500_000
FEW_ROWS = 500_000
AT_ONCE = 1 << 21
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of words with enough letters and occurrences, from ``key, text`` rows."""
    run_ = re.compile(RUN.encode("latin-1"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(run_.findall(text.encode("latin-1", "replace").lower())).items():
                    if len(word) < SHORTEST:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begin)
                    if h % TYPO == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < SHORTEST:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.mapInArrow(counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def symbols(words: DataFrame, k: int) -> np.ndarray:
    """The symbol, from 1, of every letter: letters in the order of their frequency go each to the symbol with the fewest so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    rows = letters.orderBy(F.desc("n"), "c").collect()  # at most as many as there are letters
    out, load = np.zeros(256, np.uint64), [0] * k
    for r in rows:
        s = load.index(min(load))
        out[ord(r["c"])] = s + 1
        load[s] += r["n"]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _sums(forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and running sums of symbol times power (rows x length + 1), modulo two to the 64th."""
    powers = np.full(forms.shape[1] + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros((forms.shape[0], forms.shape[1] + 1), np.uint64)
    np.cumsum(forms * powers[:-1], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return powers, sums


def hashes(forms: np.ndarray) -> np.ndarray:
    """Hash of each row of symbols."""
    return _mixed(_sums(forms)[1][:, -1])


def neighbourhood(forms: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and hash of every distinct form one edit away from each row of ``forms``, and of the form itself.

    Of the edits with one result one is made: the first of a run of equal symbols is deleted, none is put behind its equal.
    """
    powers, sums = _sums(forms)
    whole, rows = sums[:, -1:], np.arange(len(forms))
    rest = whole - sums
    ahead = np.ones((len(forms), 1), bool)
    yield rows, _mixed(whole[:, 0])
    first = np.concatenate([ahead, forms[:, 1:] != forms[:, :-1]], axis=1)
    yield np.nonzero(first)[0], _mixed((sums[:, :-1] + rest[:, 1:] * np.uint64(INVERSE))[first])
    for c in alphabet:
        other = forms != c
        yield np.nonzero(other)[0], _mixed((whole + (c - forms) * powers[:-1])[other])
        fits = np.concatenate([ahead, other], axis=1)
        yield np.nonzero(fits)[0], _mixed((sums + c * powers + rest * np.uint64(BASE))[fits])


def _by_length(words: list[str], code: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and symbols of words of one length, so many that a neighbourhood has about ``at_once`` entries for each symbol."""
    raw = [w.encode("latin-1") for w in words]
    size = np.array([len(w) for w in raw])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        step = max(1, at_once // int(n))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            yield part, code[np.frombuffer(b"".join(raw[k] for k in part), np.uint8).reshape(len(part), n)]


def coded(words: DataFrame, code: np.ndarray) -> DataFrame:
    """``word, n`` with the hash ``x`` of its reduced form and ``e`` of its letters."""
    full = np.arange(256, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((2, batch.num_rows), np.int64)
            texts = batch.column(0).to_pylist()
            for which, table in enumerate((code, full)):
                for at, forms in _by_length(texts, table, AT_ONCE):
                    x[which, at] = hashes(forms)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x[0]), pa.array(x[1])], names=["word", "n", "x", "e"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, x bigint, e bigint")


def edges(forms: DataFrame, code: np.ndarray, known: np.ndarray | None, once: bool) -> DataFrame:
    """``x, y`` from ``word, x``: the neighbourhood of each word under ``code``.

    With ``once`` only neighbours that are not less than the word's own hash. ``known`` has the sorted hashes of all forms
    that exist, or is None.
    """
    shared = forms.sparkSession.sparkContext.broadcast(known)
    alphabet = np.unique(code[code > 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shared.value
        for batch in batches:
            own = batch.column(1).to_numpy()
            for at, symbols_ in _by_length(batch.column(0).to_pylist(), code, AT_ONCE // (2 * len(alphabet))):
                parts = []
                for row, y in neighbourhood(symbols_, alphabet):
                    keep = y >= own[at[row]] if once else np.ones(len(y), bool)
                    if there is not None:
                        place = np.minimum(np.searchsorted(there, y), len(there) - 1)
                        keep &= there[place] == y
                    parts.append((row[keep], y[keep]))
                row, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.lexsort((y, row))
                row, y = row[order], y[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (y[1:] != y[:-1])])[: len(row)]
                yield pa.RecordBatch.from_arrays([pa.array(own[at[row[new]]]), pa.array(y[new])], names=["x", "y"])

    return forms.select("word", "x").mapInArrow(run, "x bigint, y bigint")


def _known(hashes_: DataFrame) -> np.ndarray | None:
    """The sorted distinct hashes of a one-column table if they are few enough (counted) to be sent to every task."""
    if not small_enough(hashes_, KNOWN_MOST):
        return None
    return np.unique(hashes_.toArrow().column(0).to_numpy())


def near_words(words: DataFrame, k: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """``word, n, other, m``: every ordered pair of words of ``word, n`` that are one edit apart, with their counts."""
    code = symbols(words, k)
    table = written(coded(words, code), "coded")
    buckets = written(table.groupBy("x").agg(F.min("word").alias("word"), F.count("*").alias("size")), "buckets")
    few, many = buckets.filter(F.col("size") <= crowd), buckets.filter(F.col("size") > crowd).select("x")
    crowded = not many.isEmpty()
    plain = table.join(many, "x", "left_anti") if crowded else table
    apart = F.expr("levenshtein(word, other, 1) = 1")

    def side(names: tuple[str, str, str]) -> DataFrame:
        return plain.select(*[F.col(c).alias(n) for c, n in zip(("word", "n", "x"), names, strict=True)])

    pairs = edges(few, code, _known(few.select("x")), once=True).join(side(("word", "n", "x")), "x").join(side(("other", "m", "y")), "y")
    pairs = pairs.filter((F.col("x") < F.col("y")) | (F.col("word") < F.col("other"))).filter(apart)
    here, there = F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))
    found = pairs.select(F.inline(F.array(here, there)))
    if crowded:
        full = np.arange(256, dtype=np.uint64)
        full[code == 0] = 0  # letters that no word has
        dense = table.join(many, "x", "left_semi")
        close = edges(dense.select("word", F.col("e").alias("x")), full, _known(table.select("e")), once=False)
        close = close.join(dense.select(F.col("e").alias("x"), "word", "n"), "x").join(table.select(F.col("e").alias("y"), F.col("word").alias("other"), F.col("n").alias("m"), F.col("x").alias("b")), "y").filter(apart)
        close = close.join(many.select(F.col("x").alias("b"), F.lit(True).alias("too")), "b", "left")
        found = found.unionByName(close.select(F.inline(F.when(F.col("too"), F.array(here)).otherwise(F.array(here, there)))))
    return found


def roots(links: DataFrame, steps: int) -> DataFrame:
    """``word, root``: the end of the chain that begins with ``word, form``; no chain has over ``steps`` links."""
    at = written(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        further = broadcast_if(at.select(F.col("word").alias("_w"), F.col("root").alias("_r")), FEW_ROWS)
        before, at = at, written(at.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")), "roots")
        discard(before)
    return at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the vocabulary."""
    words = written(count_words(docs.select(F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("")))), "vocabulary")
    best = F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    near = near_words(words, k, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best)
    frequent = -F.col("best.m") >= RATIO * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n"))
    found = written(found, "variants")
    most = words.agg(F.max("n")).first()[0] or 1
    ends = roots(found.filter("form is not null"), math.ceil(math.log(max(most, 1), RATIO)) + 1)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
