"""The text operators against brute-force versions, the vocabulary file's own library, and held-out labels."""

import hashlib
import html
import math
import re
import sys
import textwrap
import time

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidflow.llm import bpe, chat_format, decontaminate, html_text, language_id, license_scan, pii, quality_classifier, quality_rules, queries, simhash
from braidflow.llm.common import table
from braidflow.llm.doc_stats import FEATURES, thresholds, with_stats

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "a b a b a b a b"), (6, "x " * 30_000), (7, "1" * 5000 + "@" * 50 + "+" * 50), (8, "É Σ ΑΣ\x1c z​ <|endoftext|>İ"),
]


def odd(spark):
    return spark.createDataFrame([(k, t, "en", "s", "x") for k, t in ODD], "doc_id long, text string, lang string, source string, row string")


def nothing(spark):
    return odd(spark).filter("false")


def docs_of(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


# op1


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {w: windows.count(w) for w in set(windows)} if len(windows) < 500 else None
    if seen is None:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_base_matches_brute_force(spark, sf_dir):
    texts = docs_of(spark, sf_dir)
    for r in queries.op1_quality_rules(spark, sf_dir).collect():
        n, *rest = base_of(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_keep_good_documents(spark):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    r = queries.op1_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter(~F.col("base_failed"))
    n = r.agg(F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 1 and not kept")).alias("lost"), F.count_if(F.expr("quality = 0 and kept")).alias("let"), F.count_if(F.expr("quality = 0")).alias("bad")).first()
    assert n["lost"] <= 0.01 * n["good"] and n["let"] <= 0.5 * n["bad"]


def test_quality_rules_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(odd(spark), labels).collect()
    assert [(r["n_words"], r["n_repeat_words"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [base_of(t)[::4] for _, t in ODD]
    assert quality_rules.quality_rules(nothing(spark), labels.filter("false")).count() == 0


# op2


def check_codec(spark, docs):
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], r["text"])
    for r in bpe.encode_decode(docs, VOCABULARY, with_ids=True).collect():
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library(spark, sf_dir):
    check_codec(spark, table(spark, sf_dir, "documents"))
    check_codec(spark, odd(spark))
    assert bpe.encode_decode(nothing(spark), VOCABULARY).count() == 0


def test_bpe_every_character():
    t = Tokenizer.from_file(VOCABULARY)
    codec = bpe.Codec(bpe.read_vocabulary(VOCABULARY), cached_words=50)
    wrong = []
    for c in [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600, 0x10FFFD]:
        s = f"a{chr(c)}b {chr(c)} 1{chr(c)}"
        packed, decoded = codec.encode(s)
        ids = t.encode(s, add_special_tokens=False).ids
        if packed != np.array(ids, "<u4").tobytes() or decoded != t.decode(ids, skip_special_tokens=False):
            wrong.append(c)
    assert wrong == []


# op3


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.op3_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    n = r.agg(F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 1 and not kept")).alias("lost"), F.count_if(F.expr("quality = 0")).alias("bad"), F.count_if(F.expr("quality = 0 and kept")).alias("let")).first()
    assert n["lost"] <= 0.01 * n["good"] and n["let"] <= 0.35 * n["bad"]


def test_quality_classifier_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = odd(spark).withColumn("kept", F.lit(7)).withColumn("n_words", F.lit("seven"))
    got = quality_classifier.classify(docs, none, *queries.document_site())
    assert got.count() == len(ODD) and got.filter("kept").count() == len(ODD)
    assert quality_classifier.classify(nothing(spark), none, *queries.document_site()).count() == 0


# op4


def test_language_id_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.op4_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert r.filter("lang_pred = lang").count() >= 0.97 * r.count()
    assert r.filter("score < 0 or score > 1").count() == 0


def test_language_id_odd_rows(spark):
    model = language_id.fit(odd(spark))
    got = {r["doc_id"]: r for r in language_id.predict(odd(spark), *model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 7)] == ["und"] * 4 and got[4]["lang_pred"] == "en"
    assert language_id.predict(nothing(spark), *language_id.fit(nothing(spark))).count() == 0


def test_language_mixture():
    scores = np.log(np.array([[0.9, 0.1]] * 60 + [[0.1, 0.9]] * 40 + [[0.9, 0.1]] * 100, dtype=np.float32))
    share = language_id.mixtures(scores, np.array([100, 100, 0]))
    assert 0.5 < share[0, 0] < 0.8 and share[0, 1] > 0 and share[1].tolist() == [1, 0] and share[2].sum() == 0


# op5


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


PRIVATE = [
    (1, None), (2, ""), (3, "a@b.c_d@e.fg x@y..z a@b q@r.s.t. %@-.-"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.255 1.2.3 9.9.9.9.9"),
    (5, "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111111 79927398713 é4111111111111111"), (6, "+1 (743) 555-3824 +1--2 +123456789 +12345678 ++49.30.1234567) +"),
    (7, "😀 mail: é@x.de bob@x.de, call +49 30 1234567."), (8, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' * 3), (9, "7" * 20_000 + " " + "a" * 20_000 + "@"),
]


def check_spans(spark, docs, texts):
    for r in pii.digest(pii.detect(docs)).collect():
        want = base_spans(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (r["doc_id"], joined, r["spans"])
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_pii_base_equals_brute_force(spark, sf_dir):
    for d in (sf_dir, "/root/testdata/sf0.01"):
        check_spans(spark, table(spark, d, "documents").select("doc_id", "text"), docs_of(spark, d))
    check_spans(spark, spark.createDataFrame(PRIVATE, "doc_id long, text string"), dict(PRIVATE))
    assert pii.detect(nothing(spark)).count() == 0


def test_pii_finds_secrets_and_masks(spark):
    docs = spark.createDataFrame([*PRIVATE, (7, "twice@x.de")], "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long")).withColumn("spans", F.lit("mine"))
    got = {(r["doc_id"], r["text"]): r for r in pii.mask(docs, "text", "n_chars").collect()}
    assert (7, "😀 mail: é<EMAIL> <EMAIL>, call <PHONE>.") in got or (7, "😀 mail: é@x.de <EMAIL>, call <PHONE>.") in got
    assert (7, "<EMAIL>") in got and got[(7, "<EMAIL>")]["n_chars"] == 7 and got[(7, "<EMAIL>")]["spans"] == "mine"
    assert (1, None) in got and (2, "") in got


# op6


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(filter(None, blocks))


def test_html_article_text(spark):
    for p in table(spark, "/root/testdata/sf0.01", "pages").collect():
        assert html_text.main_text(p["html"]) == article_of(p["html"]), p["page_id"]
        without = re.sub("</?article>", lambda m: m.group().replace("article", "div"), p["html"])
        assert html_text.main_text(without) == article_of(p["html"]), p["page_id"]


def test_html_densities_choose_the_text(spark, monkeypatch):
    """Without densities most pages come out wrong, without names few."""
    pages = [r["html"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    changed = lambda: sum(html_text.main_text(p) != article_of(p) for p in pages)
    densities = html_text.densities
    with monkeypatch.context() as m:
        m.setattr(html_text, "select", lambda nodes, own, total: [True] * len(nodes))  # all text that no name has dropped
        assert changed() > 0.9 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_text, "densities", lambda nodes: [[1.0] * len(x) for x in densities(nodes)])
        assert changed() > 0.9 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_text, "is_boilerplate", lambda *a: (False, False))
        m.setattr(html_text, "is_furniture", lambda *a: False)
        assert changed() < 0.06 * len(pages)


def test_html_page_without_semantic_names():
    part = "The river rose in spring, and the old mill at the bend stood still for many weeks until the water fell again. " * 2
    menu = "".join(f"<div><a href='/{k}'>Menu entry {k}</a></div>" for k in range(20))
    page = f"<body><div>{menu}</div><div><div>Title of it all</div><div>{part}</div><div>{part}<a href=x>more</a></div><div>{part}</div></div><div><a href=1>About</a> <a href=2>Imprint</a></div></body>"
    assert html_text.main_text(page) == "\n".join(["Title of it all", part.strip(), part + "more", part.strip()])


def test_html_positions_and_broken_markup_in_linear_time():
    assert html_text.main_text("İ" * 50 + "<script>var a</SCRIPT ><p>hello there this is text</p><p>second paragraph</p>") == "İ" * 50 + "\nhello there this is text\nsecond paragraph"
    n, began = 50_000, time.time()
    assert html_text.main_text("<div>" * n + "x" + "</span>" * n + "</div>" * n) == "x"
    assert html_text.main_text("<p>" + "<b>" * n + "<td>" * n + "<li>x" * n + "</i>" * n).count("x") == n
    assert time.time() - began < 20


def test_html_boilerplate_and_broken_markup(spark):
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies a lot, really a lot of them.</div><nav><a href=x>Home</a></nav>"
        "<main><h1>Head&nbsp;line &amp; more</h1><div class=content><p>First  paragraph, <a href=y>with</a> a\nlink.<p>Second<br>one &lt;tag&gt; &#233;<ul><li>Item<li>Other</ul></div>"
        "<section class='comments'><p>" + "Nice post! " * 60 + "</p></section></main><aside><p>Side text</p></aside><form><p>Name</p></form><script>if (a < b) { '</p>' }</script><footer>&copy; x"
    )
    assert html_text.main_text(page) == "Head line & more\nFirst paragraph, with a link.\nSecond one <tag> é\nItem\nOther"
    rows = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "just text < 5 & more"), (4, "u", "<p"), (5, None, "<div " * 3000 + ">x" * 10)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(rows).collect()}
    assert got[1] == got[2] == "" and got[3] == "just text < 5 & more" and len(got) == 5
    assert html_text.extract(rows.filter("false")).count() == 0


# op7


def test_html_names_do_not_drop_the_article():
    part = "The river rose in spring, and the old mill at the bend stood still for many weeks until the water fell again. " * 3
    article = f"<p>{part}one</p><p>{part}two</p>"
    menu = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul>"
    pages = [
        f"<body><div class='content has-sidebar'>{article}</div></body>", f"<body><div id='page-no-sidebar'>{article}</div></body>", f"<body><div class='social-science'>{article}</div></body>",
        f"<body><div class='sidebar'>{menu}<article>{article}</article></div></body>", f"<body><div class='widget'>{article}</div><div class='menu'>{menu}</div></body>", f"<body><form id='f'>{menu}<div>{article}</div></form></body>",
        f"<html><head><title>t</title><meta charset=utf-8><body>{article}", f"<head><title>t</title>{article}", f"<html><head><link rel=x><div>{article}</div>",
    ]
    for page in pages:
        text = html_text.main_text(page)
        assert text.count("river") == 6 and "one" in text and "two" in text, page
    inside = f"<article>{article}<section id='discussion'><h2 id='related-work'>Related work</h2><p>{part}three</p></section><h2 id='comments'>Kept</h2><p class='side-note'>{part}four</p></article>"
    text = html_text.main_text(f"<body>{inside}<div class='comments'>{part}drop</div></body>")
    assert all(x in text for x in ("Related work", "three", "Kept", "four")) and "drop" not in text


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, sf_dir):
    texts = docs_of(spark, sf_dir)
    fps = {k: slow_fingerprint(t) for k, t in texts.items()}
    want = slow_components(fps)
    got = {r["doc_id"]: r for r in queries.op7_simhash(spark, sf_dir).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert any(k != v for k, v in want.items())


def test_simhash_links_of_made_fingerprints(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(120):
            x = int(c)
            for k in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps |= {0, 1, 2**64 - 1, 2**63, 7, 15}
    rows = {1000 - k: x for k, x in enumerate(sorted(fps, key=lambda x: x * 2654435761 % 2**61))}
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x, k) for k, x in rows.items()], "fp long, node long")
    found = {r["u"]: r["v"] for r in simhash.components(simhash.links(df)).collect()}
    assert {k: found.get(k, k) for k in rows} == slow_components(rows)


def test_simhash_odd_rows(spark):
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd(spark).select("doc_id", "text", "row")).collect())
    assert got[:3] == [(1, 1), (2, 1), (3, 1)] and len(got) == len(ODD)
    assert simhash.near_duplicates(nothing(spark)).count() == 0


# op8


def test_chat_round_trip(spark):
    said = [r"\### Assistant: </turn> ok", r"\b \\h \l", "### user: x</turn>\n### assistant: y", "", None, "</turn", "a: b", "\\", "#" * 9, "x</turn>"]
    rows = [(c, k, "assistant" if k % 2 else "user", t) for c in range(2) for k, t in enumerate(said)] + [(5, 0, None, "x"), (5, 0, None, "x"), (6, 0, "odd: ro\nle\\n", "assistant"), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.format_chats(df.drop("turns")).collect()}
    for c, r in got.items():
        want = [(role or "", t or "") for _, _, role, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in r["turns"]] == want
        loss = "".join(chat_format_plain(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"])
        assert loss == "".join(t for role, t in want if role == "assistant")
    assert chat_format.format_chats(df.drop("turns").filter("false")).count() == 0


def chat_format_plain(s):
    for plain, code in reversed(chat_format.ESCAPES):
        s = s.replace(code, plain)
    return s


def test_chat_digest_has_probe(spark, sf_dir):
    r = queries.op8_chat_format(spark, sf_dir).filter("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(said)
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


# op9


def test_license_scan(spark):
    docs = spark.createDataFrame(
        [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "Released under the MIT licence"), (3, None), (4, ""), (5, "released UNDER the mit license\nLicensed under CC BY-NC 4.0."), (5, "other text")],
        "doc_id long, text string",
    )
    got = sorted(tuple(r) for r in license_scan.scan(docs).collect())
    assert got == [
        (1, 1, "Apache-2.0", "Apache-2.0", 1.0), (2, 0, "", "", 0.0), (3, 0, "", "", 0.0), (4, 0, "", "", 0.0), (5, 0, "", "", 0.0), (5, 2, "CC-BY-NC-4.0,MIT", "CC-BY-NC-4.0", 1.0),
    ]
    assert license_scan.scan(nothing(spark)).count() == 0


def wrapped(text, width=70, start=""):
    return "\n".join(start + x for x in textwrap.wrap(text, width))


def test_license_scan_wrapped_and_inline(spark):
    longer = {}
    for name, text in license_scan.PASSAGES:
        longer.setdefault(name, text)
    story = "The river rose in spring and the mill stood still for weeks. " * 8
    texts = [
        (1, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(longer["MIT"]), "MIT"),
        (2, wrapped(longer["GPL-3.0"], 70, " * ") + "\n\nint main() {}", "GPL-3.0"),
        (3, wrapped(longer["GPL-2.0"], 60, "# "), "GPL-2.0"),
        (4, wrapped(longer["AGPL-3.0"], 75), "AGPL-3.0"),
        (5, story + "Licensed under CC BY-NC 4.0. " + story, "CC-BY-NC-4.0"),
        (6, story + "\n" + wrapped(longer["BSD-2-Clause"], 66) + "\n" + story, "BSD-2-Clause"),
        (7, wrapped(longer["BSD-3-Clause"], 66), "BSD-3-Clause"),
        (8, longer["ISC"] + "\nReleased under the MIT License.", "ISC,MIT"),
        (9, story + "\n" + story, ""),
        (None, story + "Released under the MIT License. " + story, "MIT"),
    ]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for k, _, names in texts:
        assert got[k]["licenses"] == names, k
        assert got[k]["n_matches"] == (names.count(",") + 1 if names else 0), k


def test_license_passages_equal_brute_force():
    notices = [(n, license_scan.WORD.findall(t.lower())) for n, t in license_scan.TEMPLATES + license_scan.PASSAGES]
    rng = np.random.default_rng(3)
    finder = license_scan.Passages()
    for _ in range(40):
        words = list(notices[rng.integers(len(notices))][1])
        for _ in range(int(rng.integers(0, 1 + len(words) // 6))):
            words[rng.integers(len(words))] = f"w{rng.integers(9)}"
        words = ["x", "of", "the"] * int(rng.integers(0, 3)) + words + ["and", "the", "software", "is"] * int(rng.integers(0, 3))
        grams = list(zip(words, words[1:]))
        for t, (_, own, n, _) in enumerate(finder.templates):
            size, want = min(n - 1, len(grams)), set()
            for k in range(len(grams) - size + 1):
                g = set(grams[k : k + size])
                if 2 * len(g & own) / (len(g) + len(own)) >= 0.8:
                    want.add((k, k + size + 1))
            anchors = [k for k, g in enumerate(grams) if t in finder.rare.get(g, ())]
            assert {(a, b) for _, _, a, b in finder.windows(grams, t, anchors)} == want


# op10


def slow_contamination(text, items):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), s or ""))
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), 13)
        for win in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else ():
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) == win:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 3])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    passage = "the quick brown Fox jumps over THE lazy dog and then it sleeps all day long é É"
    items = [(1, passage), (10, passage + " again"), (2, "tiny item"), (3, None), (4, "..."), (5, "the the the the"), (1, passage)]
    texts = [
        (1, f"x {passage} y"), (2, f"{passage} {passage}"), (3, "a tiny-item, tiny"), (4, None), (5, ""), (6, "word " * 400 + passage), (7, "the " * 9), (7, "the " * 9), (8, passage.replace("É", "é")), (8, "Tiny  Item"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("pos", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench)
    rows = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], list(r["item_ids"]), r["contaminated"]) for r in got.collect())
    want = sorted((k, n, h, len(i), i, c) for k, t in texts for n, h, i, c in [slow_contamination(t, items)])
    assert rows == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not slow_contamination(t, items)[3] for _, t in texts)
    assert decontaminate.contamination(docs, bench.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.filter("false"), bench).count() == 0


def test_decontamination_keeps_hits_of_null_ids_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 3)
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(None, f"so {passage} ends"), (None, "other words"), (1, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, f"{passage} fourteen fifteen sixteen seventeen")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect()) == [(0, 0), (0, 13), (1, 13)]
    assert [r["text"] for r in decontaminate.clean(docs, bench).collect()] == ["other words"]


# pipeline


def test_pipeline_near_duplicates_judges_rows_that_share_an_id(spark, sf_dir):
    import corpus_pipeline

    a, b, c = ("".join(f"{w}{k} " for k in range(60)) for w in ("alpha", "beta", "gamma"))
    docs = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (8, c, 5), (8, c, 6), (None, a, 7), (None, "only one here " * 9, 8)], "doc_id long, text string, n int")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "only one here " * 9), (3, a), (5, b), (8, c)]


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline
    from braidflow.llm.common import written

    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), "test")
        assert name == names[-1] or out.columns == docs.columns
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        if name == "simhash":
            before = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.collect()}
            assert set(kept[name]) == {k for k, v in slow_components(before).items() if k == v}
        if name == "decontaminate":
            items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
            assert set(kept[name]) == {r["doc_id"] for r in docs.collect() if not slow_contamination(r["text"], items)[3]}
        if name == "pii":
            assert not any(base_spans(r["text"]) for r in kept[name].values())
        docs = out
    assert set(kept["pii"]) == set(kept["bpe"])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    assert sum(labels.get(k) == 1 for k in kept["quality_classifier"]) >= 0.98 * sum(v == 1 for v in labels.values())
    assert sys.getsizeof(kept) > 0


def test_many_matches_in_one_text_take_linear_time(spark):
    n = 80_000
    text = " ".join(f"user{k}@ex.com" for k in range(n)) + " call (743) 555-3824 now"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = pii.digest(pii.detect(docs)).first()
    want = base_spans(text)
    assert r["n_email"] == n and r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    masked = pii.mask(docs).first()["text"]
    assert masked.startswith("<EMAIL> <EMAIL> ") and masked.count("<EMAIL>") == n and masked.endswith(" now")
    chat = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('### hello ', id) as text")
    r = chat_format.digest(chat_format.format_chats(chat)).first()
    said = "".join(f"### hello {k}" for k in range(1, 20_000, 2))
    assert r["n_turns"] == 20_000 and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert time.time() - began < 120


def test_pii_spans_added_apart_from_base(spark):
    base, more = [(2, 5), (10, 20), (30, 31)], [(0, 2), (4, 6), (5, 10), (12, 13), (8, 40), (31, 33), (20, 30), (10, 20)]
    rows = spark.createDataFrame([([(0, *b) for b in base], [(4, *m) for m in more])], "base array<struct<kind:int,start:int,end:int>>, more array<struct<kind:int,start:int,end:int>>")
    got = rows.select(pii._apart(F.col("more"), F.col("base")).alias("a")).first()["a"]
    assert sorted((s["start"], s["end"]) for s in got) == sorted(m for m in more if not any(b[0] < m[1] and m[0] < b[1] for b in base))


def test_simhash_hands_large_groups_on(spark, monkeypatch):
    """Groups beyond the limit are traversed by shuffles, with the same components."""
    rng = np.random.default_rng(7)
    centre, fps = int(rng.integers(0, 2**64, dtype=np.uint64)), set()
    for _ in range(700):
        x = centre
        for k in rng.choice(64, rng.integers(0, 9), replace=False):
            x ^= 1 << int(k)
        fps.add(x)
    rows = dict(enumerate(sorted(fps, key=lambda x: x * 2654435761 % 2**61)))
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x, k) for k, x in rows.items()], "fp long, node long")
    for most, at_once in ((20, 16), (1, 1), (10**6, 1 << 16)):
        monkeypatch.setattr(simhash, "MOST_IN_TASK", most)
        monkeypatch.setattr(simhash, "ROWS_AT_ONCE", at_once)
        found = {r["u"]: r["v"] for r in simhash.components(simhash.links(df)).collect()}
        assert {k: found.get(k, k) for k in rows} == slow_components(rows), most


def test_trie_links_equal_brute_force():
    rng = np.random.default_rng(11)
    fps = np.unique(np.concatenate([rng.integers(0, 2**64, 50, dtype=np.uint64), np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))]))
    n = len(fps)
    none = lambda a0, a1, b0, b1: np.zeros(len(a0), bool)
    got = {(int(i), int(j)) for x, y in simhash.trie_links(fps, np.array([[0], [n], [0], [n]]), none) for i, j in zip(x, y, strict=True)}
    assert {tuple(sorted(p)) for p in got} == {(i, j) for i in range(n) for j in range(i + 1, n) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}


def test_language_id_with_more_languages_than_the_table_holds(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_CELLS", 4 * language_id.BUCKETS)
    texts = {f"l{k}": " ".join(f"{a}{k % 10}{b}" for a in "abcdefgh" for b in "xyzuvw").translate(str.maketrans("0123456789", "qrstjklmno")) for k in range(9)}
    docs = spark.createDataFrame([(k, t, n) for k, (n, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    names, logp = language_id.fit(docs)
    assert len(names) == 9 and logp.size <= language_id.MOST_CELLS
    assert all(r["lang_pred"] == f"l{r['doc_id']}" for r in language_id.predict(docs, names, logp).collect())


def slow_shares(words, rounds):
    """Proportions by expectation-maximisation over words' likelihoods, one language at a time."""
    k = len(words[0])
    share = [1 / k] * k
    for _ in range(rounds):
        new = [0.0] * k
        for w in words:
            total = sum(s * x for s, x in zip(share, w, strict=True))
            for j in range(k):
                new[j] += share[j] * w[j] / total / len(words)
        share = new
    return share


def test_language_shares_equal_slow_version():
    rng = np.random.default_rng(2)
    counts = np.array([40, 7, 90])
    scores = rng.normal(0, 2, (counts.sum(), 3)).astype(np.float32)
    scores[:40, 0] += 2
    scores[47:90, 1] += 3
    at = 0
    for n in counts:
        like = np.exp(scores[at : at + n].astype(float))
        share = np.full((1, 3), 1 / 3)
        language_id._settle(like, share, np.zeros(n, int), np.array([0]), np.array([n]), 500)
        assert np.abs(share[0] - slow_shares(like.tolist(), 500)).max() < 0.02
        at += n


def test_bpe_marks_behind_words_equal_the_library():
    t = Tokenizer.from_file(VOCABULARY)
    codec = bpe.codec_of(bpe.read_vocabulary(VOCABULARY))
    assert codec is bpe.codec_of(bpe.read_vocabulary(VOCABULARY))
    for word in ("word", "Éa", "ÀÿŃ", "ß", "ªº", "İx", "ſ", "é", "don't", "x1", "ǅ", "日本", "µm", ""):
        for marks in ("", ".", ",.;", "?!:", "...", "'s,", ",a", "</w>", "<|endoftext|>.", "́."):
            s = f"{word}{marks} {marks}{word}{marks}"
            packed, decoded = codec.encode(s)
            ids = t.encode(s, add_special_tokens=False).ids
            assert packed == np.array(ids, "<u4").tobytes() and decoded == t.decode(ids, skip_special_tokens=False), s


def slow_rules(rows, cuts, params):
    """Sequential covering over a list of (features, y, grows), one test and one row at a time."""
    holds = lambda r, t: r[0][t[0]] > t[2] if t[3] else r[0][t[0]] <= t[2]
    rules, tried = [], set()
    while len(rules) < params.max_rules:
        tests = []
        while len(tests) < params.max_tests:
            inside = [r for r in rows if r[2] and all(holds(r, t) for t in tests)]
            names = [f for f in FEATURES if cuts[f] and (tests or f not in tried)]
            p0, n0 = sum(r[1] for r in inside), sum(1 - r[1] for r in inside)
            best, found = 1e-9, None
            if not p0 or not n0:
                break
            for f in names:
                for rank, cut in enumerate(cuts[f]):
                    for above in (False, True):
                        got = [r for r in inside if holds(r, (f, rank, cut, above))]
                        p, n = sum(r[1] for r in got), sum(1 - r[1] for r in got)
                        if p >= params.least_support:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best:
                                best, found = gain, (f, rank, cut, above)
            if found is None:
                break
            tests.append(found)
        if not tests:
            break
        first = tests[0][0]
        held, worth = [r for r in rows if not r[2]], {}
        for k in range(1, len(tests) + 1):
            got = [r[1] for r in held if all(holds(r, t) for t in tests[:k])]
            worth[k] = (round((sum(got) + 1) / (len(got) + 2), 3), -k, sum(got), len(got) - sum(got))
        k = max(worth, key=lambda k: worth[k][:2])
        p, n = worth[k][2:]
        tests = tests[:k]
        if 2 * p < params.least_support or p / max(p + n, 1) < params.least_precision:
            tried |= {first}
            continue
        tried = set()
        wide = []
        for t in tests:
            inner = [r[0][t[0]] for r in rows if r[1] == 1 and all(holds(r, x) for x in tests)]
            beyond = [r[0][t[0]] for r in rows if not holds(r, t) and all(holds(r, x) for x in tests if x is not t)]
            edge = (max if t[3] else min)(beyond, default=None)
            wide.append((t[0], t[3], t[2] if edge is None or not inner else (edge + (min if t[3] else max)(inner)) / 2))
        rules.append(wide)
        rows = [r for r in rows if not all(holds(r, t) for t in tests)]
    return rules


def test_quality_rules_equal_slow_covering(spark):
    sf = "/root/testdata/sf0.01"
    params = quality_rules.Params(max_rules=4, bins=8)
    labelled = quality_rules.labelled_stats(table(spark, sf, "documents"), table(spark, sf, "labels"), params)
    grows = F.pmod(F.xxhash64(*FEATURES), F.lit(3)) != 0
    rows = [({f: r[f] for f in FEATURES}, r["y"], r["g"]) for r in labelled.select("*", grows.alias("g")).collect()]
    want = slow_rules(rows, thresholds(labelled, params.bins), params)
    got = [[(t.feature, t.above, t.cut) for t in tests] for tests in quality_rules.learn(labelled, params)]
    assert want and [[x[:2] for x in r] for r in got] == [[x[:2] for x in r] for r in want]
    assert [x[2] for r in got for x in r] == pytest.approx([x[2] for r in want for x in r], rel=1e-12)


def test_quality_classifier_equals_slow_version(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_classifier.fit(docs, labels)
    stats = with_stats(docs.select("doc_id", "text", "source", "lang")).collect()

    def evidence(r):
        return model.scale * sum(model.ratios[f][sum(r[f] > c for c in model.cuts[f])] for f in FEATURES)

    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    logit = math.log(model.share / (1 - model.share))
    sites = {}
    for r in stats:
        path = "/".join(x for x in (r["source"], r["lang"]) if x is not None)
        n, s = sites.get((r["source"], path), (0, 0.0))
        sites[r["source"], path] = (n + 1, s + sigmoid(evidence(r) + logit))
    hosts = {}
    for (h, _), (n, s) in sites.items():
        hosts[h] = (hosts.get(h, (0, 0))[0] + n, hosts.get(h, (0, 0))[1] + s)

    def strength(rows):  # (n, s, prior)
        total, var = sum(n for n, _, _ in rows), sum(n * q * (1 - q) for n, _, q in rows)
        if not total or not var or len(rows) < 2:
            return 10.0
        spread = sum(n * (s / n - q) ** 2 for n, s, q in rows) / total
        between = max(spread - len(rows) * (var / total) / total, 1e-6)
        return min(max(var / total / between - 1, 1.0), 1e4)

    k = strength([(n, s, model.share) for n, s in hosts.values()])
    host = {h: (s + k * model.share) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(n, s, host[h]) for (h, _), (n, s) in sites.items()])
    share = {key: (s + k * host[key[0]]) / (n + k) for key, (n, s) in sites.items()}
    want = {}
    for r in stats:
        q = share[r["source"], "/".join(x for x in (r["source"], r["lang"]) if x is not None)]
        want[r["doc_id"]] = sigmoid(evidence(r) + math.log(q / (1 - q)))
    got = quality_classifier.classify(docs, labels, *queries.document_site(), carry=["doc_id"]).select("doc.doc_id", "p_good", "kept").collect()
    assert len(got) == len(want) and all(abs(r["p_good"] - want[r["doc_id"]]) < 1e-9 and r["kept"] == (r["p_good"] >= 0.1) for r in got)


def test_clashing_columns_and_ties(spark):
    chats = spark.createDataFrame([(1, 1, "user", "b", 9, "x"), (1, 1, "user", "a", 9, "x"), (1, 0, "assistant", "c", 9, "x")], "conv_id long, turn long, role string, text string, turns int, formatted string")
    assert [tuple(t) for t in chat_format.format_chats(chats).first()["turns"]] == [("assistant", "c"), ("user", "a"), ("user", "b")]
    notice = "Released under the MIT License."
    docs = spark.createDataFrame([(1, notice), (1, notice), (2, f"{notice}\n{notice}"), (3, "Licensed under CC BY 4.0.")], "doc_id long, text string").withColumns({"line": F.lit(1), "row": F.lit(2), "license": F.lit("x"), "q": F.lit(1)})
    got = sorted(tuple(r)[:3] for r in license_scan.scan(docs).collect())
    assert got == [(1, 1, "MIT"), (1, 1, "MIT"), (2, 2, "MIT"), (3, 1, "CC-BY-4.0")]
    texts = spark.createDataFrame([(k, "same words in each of them") for k in (5, 3, 9)], "doc_id long, text string").withColumns({"fp": F.lit(1), "node": F.lit(2), "component_id": F.lit(3), "u": F.lit(4)})
    assert [r["component_id"] for r in simhash.near_duplicates(texts).collect()] == [3, 3, 3]
    twice = spark.createDataFrame([(1, "de heute ist ein Tag", "de"), (1, "the day is today", "en"), (2, None, "en")], "doc_id long, text string, lang string").withColumns({"bucket": F.lit(1), "n": F.lit(1), "score": F.lit(1)})
    names, logp = language_id.fit(twice)
    assert names == ["de", "en"] and sorted(r["lang_pred"] for r in language_id.predict(twice, names, logp).collect()) == ["de", "en", "und"]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_rules.quality_rules(twice, labels).count() == 3


def test_pipeline_stages_on_nothing_and_nulls(spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for name in ("labels", "benchmark"):
        table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(f"{sf}/{name}.parquet")
    docs.limit(0).write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
    odd = docs.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).unionByName(docs.limit(2))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert 1 <= out.count() <= 5


def test_html_names_of_several_parts():
    said = lambda name, inside=False: html_text.is_boilerplate("div", f" class='{name}'", inside)[0] or html_text.is_furniture("div", f" class='{name}'", inside)
    assert all(map(said, ("comment-list", "reader-comments", "ad_slot", "sidebar-left", "cookie-banner", "site-header", "nav", "article-comments", "newsletter-box")))
    assert not any(map(said, ("has-sidebar", "page-no-sidebar", "social-science", "side-note", "related-work", "page-header", "entry-header", "post-content", "article", "list", "ad-free", "")))
    assert said("top") and not said("top", True) and said("comments", True)
    part = "The river rose in spring, and the old mill at the bend stood still for many weeks until the water fell again. "
    page = f"<body><div class=site-header>Site of all</div><div class=story><h1>Title</h1><p>{part}</p><p>{part * 2}</p><div class=comment-list><p>{part}first!</p></div></div><div class='sidebar-right'><p>Read this too, it is good</p></div></body>"
    assert html_text.main_text(page) == f"Title\n{part.strip()}\n{(part * 2).strip()}"

def test_simhash_links_through_rows_without_a_key(spark, monkeypatch):
    rows = [(1, 0), (None, 7), (2, 63), (9, 2**40 - 1), (8, 2**40 - 4), (None, -1), (None, -2)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, key, text, carry: docs.select(key, "fp"))
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["fingerprint"]: (r["component_id"], r["component"]) for r in simhash.near_duplicates(df).collect()}
    digits = lambda x: f"{x % 2**64:016x}"
    assert {digits(x): got[digits(x)][0] for _, x in rows} == {digits(x): k for x, k in {0: 1, 7: 1, 63: 1, 2**40 - 1: 8, 2**40 - 4: 8, -1: None, -2: None}.items()}
    assert len({c for _, c in got.values()}) == 3


def test_decontamination_keeps_columns_of_any_name(spark, monkeypatch):
    words = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, words, "a", 5, 6), (2, "other words", "b", 7, 8), (None, words + " x", "c", 9, 0)], "doc_id long, text string, _row string, _k int, _key int")
    bench = spark.createDataFrame([("i", words)], "item_id string, text string")
    for few in (10**6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", few)
        got = decontaminate.clean(docs, bench)
        assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "other words", "b", 7, 8)]


def test_decontamination_beyond_the_broadcast_with_a_hot_anchor(spark, monkeypatch):
    common = "the cat sat on the mat and the dog sat on the cat"
    texts = [f"{common} number {k} {common}" if k % 3 else f"w{k} the the the" for k in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (None, common)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", common), ("b", "the the"), ("c", " ".join(f"rare{k}" for k in range(30))), ("d", "")], "item_id string, text string")
    want = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "SALTS", 3)
    assert sorted(map(str, decontaminate.contamination(docs, bench).collect())) == want and sum("contaminated=True" in w for w in want) == 61
