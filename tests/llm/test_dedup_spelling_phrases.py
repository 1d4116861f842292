"""Exact duplicates, spelling variants and phrases against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from braidflow.llm import common, exact_dedup, phrases, queries, spelling
from braidflow.llm.common import table

LONG = "palabra larga " * 30_000
ODD = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (None, "a  b c", "en"), (4, "a b\tc", "en"), (4, "a b\tc", "en"), (4, "a b c d", "en"), (5, LONG, "es"), (6, LONG, "es"), (7, "x" * 300_000, "de"), (8, "ÀÉ×÷ßabcdeç Ωabcdef ABCDEF\x00g", None),
]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, "x", 0, 7) for k, t, lang in rows], "doc_id long, text string, lang string, row string, n int, fp long")


def plain(rows):
    return sorted(rows, key=lambda r: tuple("" if x is None else repr(x) for x in r))


# op11


def slow_duplicates(rows):
    groups = {}
    for at, (k, t, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((k is None, k or 0, at))
    out = []
    for t, members in groups.items():
        best = min(members)
        out += [(None if m[0] else m[1], None if best[0] else best[1], len(members), m == best, hashlib.sha256(t.encode()).hexdigest()) for m in members]
    return plain(out)


def found_duplicates(df, **more):
    return plain(exact_dedup.exact_duplicates(df, **more).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("bits", [64, 5, 1])
@pytest.mark.parametrize("few", [10**6, 0])
def test_exact_duplicates(spark, sf_dir, monkeypatch, bits, few):
    monkeypatch.setattr(common, "FEW_ROWS", few)
    assert found_duplicates(frame(spark, ODD), bits=bits) == slow_duplicates(ODD)
    if bits == 5:
        docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
        assert found_duplicates(table(spark, sf_dir, "documents"), bits=bits) == slow_duplicates(docs)


def test_exact_duplicates_of_nothing_and_with_other_columns(spark):
    assert found_duplicates(frame(spark, ODD).filter("false")) == []
    got = exact_dedup.exact_duplicates(frame(spark, ODD), carry=("row", "n"))
    assert got.columns[:3] == ["doc_id", "row", "n"] and {(r["row"], r["n"]) for r in got.collect()} == {("x", 0)}


def test_quotient_filters_keep_everything():
    rng = np.random.default_rng(5)
    for n, low in ((1, 64), (7, 60), (3000, 52), (3000, 12), (64, 6)):
        parts = [rng.integers(0, 1 << min(low, 62), n, dtype=np.uint64) for _ in range(3)]
        parts[1][: n // 2] = parts[0][: n // 2]
        packed = []
        for p in parts:
            fps, counts = np.unique(np.concatenate([p, p[:1], p[:1].repeat(300)]), return_counts=True)
            packed.append(exact_dedup.pack(fps, counts, low))
            assert [x.tolist() for x in exact_dedup.unpack(packed[-1])] == [fps.tolist(), counts.tolist()]
        fps, counts = exact_dedup.merge(packed)
        assert dict(zip(fps.tolist(), counts.tolist())) == Counter(x for p in parts for x in [*p.tolist(), *[p[0].item()] * 301]) and (np.diff(fps.astype(object)) > 0).all()


# op12


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows):
    n = Counter()
    for k, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out, form = {}, {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = len(near)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return plain(rows)


def some_words(seed, letters, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(size)]
    rows = []
    for k in range(40):
        picked = [rng.choice(words) for _ in range(60)] + [words[0]] * 40 + [words[1]] * 4
        rows.append((None if k == 3 else k, " ".join(w.upper() if rng.random() < 0.1 else w for w in picked), "en"))
    return [*rows, *ODD, *ODD, *ODD]


@pytest.mark.parametrize(("letters", "k", "crowd"), [("abé", 4, 256), ("abcdefgé", 2, 3), ("abcd", 2, 1), ("abcdefgh", 4, 0)])
def test_spelling_variants(spark, letters, k, crowd):
    rows = some_words(7, letters, 60)
    assert plain(spelling.variants(frame(spark, rows), k=k, crowd=crowd).collect()) == slow_variants(rows)


def test_spelling_over_documents_and_without_the_list_of_hashes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(spelling, "KNOWN_MOST", 0)
    monkeypatch.setattr(spelling, "FEW_ROWS", 0)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert plain(queries.op12_spelling(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()) == slow_variants(docs)
    assert spelling.variants(frame(spark, ODD).filter("false")).count() == 0


def test_neighbourhoods_are_whole():
    alphabet = np.arange(1, 4, dtype=np.uint64)
    hash_of = lambda s: spelling.hashes(np.array([s], np.uint64))[0]
    for form in ([1], [1, 1, 2], [3, 2, 2, 2, 1], [1, 2, 3, 1, 2, 3]):
        want = {tuple(form)} | {tuple(form[:i] + form[i + 1 :]) for i in range(len(form)) if len(form) > 1}
        want |= {tuple([*form[:i], c, *form[i + 1 :]]) for i in range(len(form)) for c in (1, 2, 3)} | {tuple([*form[:i], c, *form[i:]]) for i in range(len(form) + 1) for c in (1, 2, 3)}
        got = np.concatenate([h for _, h in spelling.neighbourhood(np.array([form], np.uint64), alphabet)]).tolist()
        if len(form) == 1:
            got.remove(0)  # the empty form, whose hash no word has
        assert sorted(got) == sorted(hash_of(w) for w in want)


# op13


def slow_phrases(rows, least=10, most=2000):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + size]) for size in (1, 2, 3) for i in range(len(words) - size + 1))
    found = {}
    for p, a in f.items():
        if len(p) < 3 or a < least:
            continue
        cuts = [(10**6 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        found[p] = (a, *min(cuts))
    covered = {q for p, (a, *_) in found.items() if len(p) == 4 for q in (p[:3], (p[0], *p[2:])) if 100 * a >= 50 * f[q]}
    out = []
    for lang in n:
        own = sorted((-s, -a, " ".join(p[1:]).encode(), left, right) for p, (a, s, _, left, right) in found.items() if p[0] == lang and p not in covered)[:most]
        out += [(lang, k + 1, w.decode(), -a, left, right, n[lang], -s) for k, (s, a, w, left, right) in enumerate(own)]
    return plain(out)


def some_text(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "CITY", "é", "x\x00y", "Ω1", *("w%d" % k for k in range(30))]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "\r\n", "! "]) for _ in range(200))
    hot = "common pair %d " * 400
    rows = [(k, text() + "the new york city " * 3 + hot % tuple(rng.randrange(50) for _ in range(400)), rng.choice(["en", "en", "en", None, "de"])) for k in range(40)]
    return [*rows, *ODD]


def test_phrases(spark):
    rows = some_text(1)
    assert plain(phrases.phrases(frame(spark, rows)).collect()) == slow_phrases(rows)
    assert plain(phrases.phrases(frame(spark, rows), most=7).collect()) == slow_phrases(rows, most=7)
    assert phrases.phrases(frame(spark, rows).filter("false")).count() == 0


def test_phrases_of_hot_words_in_parts(spark, monkeypatch):
    rows = some_text(2)
    for name, value in {"HOT_WORDS": 20, "HOT_PAIRS": 10, "FREQUENT_MOST": 0, "ROWS_AT_ONCE": 50, "MOST_ROWS": 80, "FEW_ROWS": 0}.items():
        monkeypatch.setattr(phrases, name, value)
    assert plain(phrases.phrases(frame(spark, rows)).collect()) == slow_phrases(rows)


def test_phrases_over_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, sf_dir, "documents").collect()]
    assert plain(queries.op13_phrases(spark, sf_dir).collect()) == slow_phrases(docs)


def test_blocks_count_every_word_once(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 16)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab    ,") if rng.random() < 0.9 else "c" * 40 for _ in range(rng.randint(0, 200))).encode()
        windows = lambda t, left: [tuple(p[i : i + 3]) for p in map(bytes.split, t.split(b",")) for i in range(len(p))][: -left or None]
        assert [w for part, left in phrases.blocks(text) for w in windows(part, left)] == windows(text, 0)


def test_prefixes_are_counted():
    rng = np.random.default_rng(4)
    for least, size, high in ((1, 0, 3), (1, 500, 4), (5, 3000, 12), (10, 3000, 400)):
        words = rng.integers(1, high, (3, size))
        words[2, : size // 5] = 0
        words[1, : size // 9] = 0
        n = rng.integers(1, 4, size)
        want = Counter()
        for k in range(size):
            for d in range(1, 4):
                if words[d - 1, k]:
                    want[tuple(words[:d, k].tolist())] += int(n[k])
        got = {tuple(words[:d, p].tolist()): int(c) for d, at, count in phrases.prefixes(words, n, least) for p, c in zip(at, count)}
        assert got == {p: c for p, c in want.items() if c >= least}
