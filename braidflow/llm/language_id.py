"""Language identification by multilingual mixture inference.

Every language has a distribution over hashed character 3-grams, counted over all training documents. A document is a
mixture: each of its words was drawn from one language. Expectation-maximisation over the words estimates the
proportions, and the set of languages is chosen by penalised likelihood (languages are dropped, smallest share first,
while the information criterion improves). The largest share of the chosen set names the document.

Counting sends at most ``languages x buckets`` rows from a task; the finished table of that size is broadcast (its
size is checked). Scoring is row by row in blocks of bounded size, so any text length fits.
Defined results: null text, or text without a letter, gives ``und`` with score 0; without training documents all rows do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BITS = 15
BUCKETS = 1 << BITS
MOST_CELLS = 64 << 20
BLOCK_CHARS = 500_000
CELLS_AT_ONCE = 8 << 20
STILL = 1e-3


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def _codes(texts: list[str]) -> np.ndarray:
    """Lower-case code points of the texts, each text after a 0; all but letters are 0, so that words lie between zeros."""
    c = np.frombuffer(("\0" + "\0".join(texts) + "\0").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[c], c, 0)


def _grams(c: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bucket (of ``bits`` bits) of the 3-gram around each inner position."""
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)


def _blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) lists of about ``chars`` characters; long texts are cut between words."""
    out: list[tuple[int, str]] = []
    size = 0
    for row, t in enumerate(texts):
        at = 0
        while at < len(t) or at == 0:
            end = at + chars
            if end < len(t) and (space := t.rfind(" ", at + 1, end)) > 0:
                end = space
            out.append((row, t[at:end]))
            size += min(end, len(t)) - at + 1
            at = max(end, 1)
            if size >= chars:
                yield out
                out, size = [], 0
    if out:
        yield out


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, bucket, n`` over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, k in zip(batch.column(0), batch.column(1), strict=True):
                by.setdefault(k.as_py(), []).append(t.as_py())
            for k, texts in by.items():
                into = seen.setdefault(k, np.zeros(BUCKETS, dtype=np.int64))
                for block in _blocks(texts):
                    c = _codes([t for _, t in block])
                    into += np.bincount(_grams(c)[c[1:-1] > 0], minlength=BUCKETS)
        for k, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(text), F.col(lang)).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = rows.mapInArrow(run, "lang string, bucket int, n bigint")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names and log probabilities (buckets x languages).

    With over 2048 languages, neighbouring buckets share a row, so that the table stays within :data:`MOST_CELLS`.
    """
    counts = written(count_grams(docs, text, lang), "grams")
    shared = max((counts.select("lang").distinct().count() * BUCKETS - 1) // MOST_CELLS, 0).bit_length()
    counts = counts.groupBy("lang", F.shiftright("bucket", shared).alias("bucket")).agg(F.sum("n").alias("n"))
    counts = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))  # at most MOST_CELLS entries in all
    rows = sorted(counts.collect(), key=lambda r: r["lang"])
    table = np.zeros((max(BUCKETS >> shared, 1), len(rows)))
    for k, r in enumerate(rows):
        c = np.array(r["c"], dtype=np.int64).reshape(-1, 2)
        table[c[:, 0], k] = c[:, 1]
    logp = np.log(table + 0.5) - np.log((table + 0.5).sum(axis=0, keepdims=True)) if rows else table
    return [r["lang"] for r in rows], logp.astype(np.float32)


def _chars(languages: int) -> int:
    """Characters that are scored at once: the fewer, the more languages there are."""
    return min(BLOCK_CHARS, max(CELLS_AT_ONCE // max(languages, 1), 4096))


def _word_scores(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of all words (words x languages), and the number of words of each text."""
    scores, counts = [np.zeros((0, logp.shape[1]), np.float32)], np.zeros(len(texts), np.int64)
    bits = int(logp.shape[0]).bit_length() - 1
    for block in _blocks(texts, _chars(logp.shape[1])):
        c = _codes([t for _, t in block])
        inner = c[1:-1] > 0
        if not inner.any():
            continue
        starts = np.flatnonzero(inner & (c[:-2] == 0))
        part = np.where(inner[:, None], logp[_grams(c, bits)], np.float32(0))
        scores.append(np.add.reduceat(part, starts, axis=0))
        bounds = np.cumsum([len(t.lower()) + 1 for _, t in block])
        np.add.at(counts, np.array([r for r, _ in block])[np.searchsorted(bounds, starts, side="right")], 1)
    return np.concatenate(scores), counts


def _settle(like: np.ndarray, share: np.ndarray, of: np.ndarray, starts: np.ndarray, size: np.ndarray, rounds: int) -> None:
    """Expectation-maximisation in place, until no share of a text moves by :data:`STILL`; settled texts leave the rounds."""
    left = np.arange(len(size))
    for k in range(rounds):
        r = like * share[left][of]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(r, starts, axis=0) / size[:, None]
        moving = np.abs(new - share[left]).max(axis=1) > STILL
        share[left] = new
        if not moving.any():
            return
        if k % 4 == 3 and 2 * moving.sum() < len(left):
            like, left, size = like[moving[of]], left[moving], size[moving]
            of, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size


def mixtures(scores: np.ndarray, counts: np.ndarray, rounds: int = 200, penalty: float = 1.0) -> np.ndarray:
    """Proportions (texts x languages) of the language set that penalised likelihood selects for each text."""
    n, k = len(counts), scores.shape[1]
    used = counts > 0
    out = np.zeros((n, k))
    if not used.any():
        return out
    top = scores.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(scores - top, -60))
    starts, size = (np.cumsum(counts) - counts)[used], counts[used]
    of = np.repeat(np.arange(len(size)), size)
    allowed, best = np.ones((len(size), k), bool), np.full(len(size), -np.inf)
    chosen = np.zeros((len(size), k))
    for left in range(k, 0, -1):
        share = allowed / allowed.sum(axis=1, keepdims=True)
        _settle(like, share, of, starts, size, rounds if left > 1 else 1)
        fit_ = np.add.reduceat(np.log(np.maximum((like * share[of]).sum(axis=1), 1e-300)), starts)
        worth = fit_ - penalty * (left - 1) * np.log(size + 1)
        better = worth > best
        best[better], chosen[better] = worth[better], share[better]
        allowed[np.arange(len(size)), np.where(allowed, share, np.inf).argmin(axis=1)] = left == 1
    out[used] = chosen
    return out


def predict(docs: DataFrame, names: list[str], logp: np.ndarray, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``carry`` columns, ``lang_pred, score`` and ``langs`` (every language of the chosen set with its share)."""
    shared = docs.sparkSession.sparkContext.broadcast((names, logp))
    few = 2000

    def rows(texts: list[str]) -> Iterator[tuple[str, float, str]]:
        names, logp = shared.value
        share = mixtures(*_word_scores(texts, logp)) if names else np.zeros((len(texts), 1))
        for s in share:
            k = int(s.argmax())
            if s[k] <= 0:
                yield "und", 0.0, ""
            else:
                yield names[k], float(min(s[k], 1.0)), ",".join(f"{names[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] >= 0.0005)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, few):
                batch = whole.slice(at, few)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                found: list[tuple[str, float, str]] = []
                group: list[str] = []
                size = 0
                for t in texts:
                    group.append(t)
                    size += len(t)
                    if size > _chars(len(shared.value[0])):
                        found += rows(group)
                        group, size = [], 0
                found += rows(group) if group else []
                columns = [batch.column(k) for k in range(batch.num_columns - 1)]
                columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *carry, "lang_pred", "score", "langs"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry)) + ", lang_pred string, score double, langs string"
    return docs.select(key, *carry, text).mapInArrow(run, schema)
