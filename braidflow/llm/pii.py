"""Personal data by weak supervision (Spark expressions only).

Candidates are the matches of a few patterns. Three labelers vote on each: the pattern's own validity test, a gazetteer
(issuers, top-level domains, country codes, key words) and the words around it. Candidates with equal kind, votes and
shape are counted over all documents; expectation-maximisation on that table (its size depends on the kinds and
labelers, not on the corpus) estimates how reliable each labeler is, and the posteriors train the final span
classifier, an additive score over votes and shape. It may add spans; spans of the base rules always stay.

Texts are read once, candidates are written as a narrow table, and only the count is shuffled.
Defined results: null text counts as empty; no candidates gives empty spans; repeated rows get equal results.

Positions come from the gaps between matches, so they count code points. Patterns use possessive quantifiers and begin
only where a run begins (or where the last match ended), so that long runs cost linear time. What is carried from match
to match is built in blocks, and text is cut in blocks before it is masked, so that texts of many matches take n * sqrt(n)
light steps at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import between, blocks, let, running, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# Patterns of candidates, each behind a cheap test of the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{24,}+"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# Gazetteers.
TOP_DOMAINS = r"\.(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|co|uk|de|fr|es|it|nl|eu|us|ca|au|jp|cn|in|br|ru|ch|at|se|no|fi|dk|pl|pt)$"
RESERVED_IP = r"^(?:0|10|127|255)\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^169\.254\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-8]|30|6011|6[245])"
COUNTRY_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEY_WORDS = r"(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|private[_ -]?key)\W*$"
# Words before a span that speak for or against its kind.
FOR = {
    "email": r"(?:mail|contact|write|reply|from|to)\W*$",
    "ip": r"(?:\bip|host|address|server|client|by|from)\W*$",
    "card": r"(?:card|visa|mastercard|credit|debit|payment|amex)\W*$",
    "phone": r"(?:tel|phone|call|fax|mobile|cell|dial)\W*$",
    "secret": r"[=:]\s*[\"']?$",
}
AGAINST = {"email": r"[/:]$", "ip": r"(?:version|release|section|\bv)\W*$|[0-9.]$", "card": r"(?:isbn|order|id|no|invoice|serial)\W*$|[.,]$", "phone": r"[0-9=]$", "secret": r"[/.]$"}
CONTEXT = 24


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes the Luhn test."""
    padded = F.lpad(digits, 20, "0")

    def digit(k: Column) -> Column:
        d = F.substring(padded, k, F.lit(1))
        return F.when(k % 2 == 1, F.translate(d, "0123456789", "0246813579")).otherwise(d).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda acc, k: acc + digit(k)) % 10 == 0


def _found(text: Column, pattern: str) -> Column:
    """``start, end, s`` of all matches, in order, and ``before``: the :data:`CONTEXT` code points in front of each."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = lambda gaps: F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), matched, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    tail = lambda *parts: F.right(F.concat(*parts), F.lit(CONTEXT))
    start = lambda acc, x: acc["at"] + F.length(x["g"])

    def step(acc: Column, x: Column) -> Column:
        return F.struct((start(acc, x) + F.length(x["m"])).alias("at"), tail(acc["tail"], x["g"], x["m"]).alias("tail"))

    def show(acc: Column, x: Column) -> Column:
        begin = start(acc, x)
        return F.struct(begin.alias("start"), (begin + F.length(x["m"])).alias("end"), x["m"].alias("s"), tail(acc["tail"], x["g"]).alias("before"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    return running(let(F.split(text, pattern, -1), pieces), zero, step, show, "struct<start:int,end:int,s:string,before:string>")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _vote(yes: Column, no: Column | None = None) -> Column:
    """``1`` for, ``0`` against, ``-`` abstains."""
    return F.when(yes, "1").otherwise(F.when(no, "0").otherwise("-") if no is not None else F.lit("0"))


def _candidates(text: Column, kind: str, pattern: str, gate: Column, valid, known, own: bool) -> Column:
    """Candidates of one pattern with their votes and shape; ``own``: valid ones belong to the base."""

    def judged(x: Column) -> Column:
        before = F.translate(x["before"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        votes = F.concat(_vote(valid(x["s"])), known(x["s"], before), _vote(F.rlike(before, F.lit(FOR[kind])), F.rlike(before, F.lit(AGAINST[kind]))))
        size = F.floor(F.log2(F.length(x["s"]).cast("double"))).cast("int")
        shape = F.concat(size.cast("string"), F.when(F.rlike(before, F.lit(r"\w$")), "w").otherwise("b"))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (valid(x["s"]) if own else F.lit(False)).alias("base"), votes.alias("votes"), shape.alias("shape")
        )

    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,votes:string,shape:string>>")
    return F.when(gate, F.transform(_found(text, pattern), judged)).otherwise(none)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (without ``text``) and ``found``, the array of all candidates."""
    t = F.coalesce(F.col(text), F.lit(""))
    likely = lambda pattern: F.rlike(t, F.lit(pattern))
    card = lambda s: (F.length(_digits(s)).between(13, 19)) & _luhn(F.substring(_digits(s), 1, 19))
    parts = [
        _candidates(t, "email", EMAIL, F.contains(t, F.lit("@")), lambda s: F.length(s) > 0, lambda s, b: _vote(F.rlike(F.lower(s), F.lit(TOP_DOMAINS)), F.lit(False)), True),
        _candidates(t, "ip", IP, likely(r"[0-9]\.[0-9]"), lambda s: F.rlike(s, F.lit(rf"^0*{OCTET}(?:\.0*{OCTET}){{3}}$")), lambda s, b: _vote(~F.rlike(s, F.lit(RESERVED_IP))), True),
        _candidates(t, "card", CARD, likely(r"[0-9](?:[ -]?[0-9]){12}"), card, lambda s, b: _vote(F.rlike(_digits(s), F.lit(ISSUERS))), True),
        _candidates(t, "phone", PHONE, F.contains(t, F.lit("+")), lambda s: F.length(_digits(s)).between(9, 15), lambda s, b: _vote(F.rlike(s, F.lit(COUNTRY_CODES)), F.lit(False)), True),
        _candidates(t, "phone", LOCAL_PHONE, likely(r"[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"), lambda s: F.rlike(s, F.lit(r"^[(2-9]")), lambda s, b: F.lit("-"), False),
        _candidates(
            t, "secret", SECRET, likely(SECRET), lambda s: F.rlike(s, F.lit("[0-9]")) & F.rlike(s, F.lit("[A-Za-z]")), lambda s, b: _vote(F.rlike(b, F.lit(KEY_WORDS)), F.lit(False)), False
        ),
    ]
    keep = [c for c in docs.columns if c != text]
    likely_card = lambda x: (x["kind"] != 2) | (x["end"] - x["start"] >= 13)
    return docs.select(*keep, F.filter(F.concat(*parts), likely_card).alias("found"))


def pattern_counts(found: DataFrame) -> list[tuple[int, str, str, int]]:
    """How often each (kind, votes, shape) occurs: kinds x votes x shapes rows at most."""
    c = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n"))
    return [tuple(r) for r in c.orderBy("kind", "votes", "shape").collect()]


def reliabilities(counts: list[tuple[int, str, str, int]], rounds: int = 50) -> dict[int, tuple[float, list[tuple[float, float]]]]:
    """By kind: the share of true candidates, and each labeler's chance of voting 1 on true and on false ones."""
    out = {}
    for kind in sorted({c[0] for c in counts}):
        rows = [(c[1], c[3]) for c in counts if c[0] == kind]
        share, ab = 0.5, [(0.9, 0.1), (0.7, 0.3), (0.7, 0.3)]
        for _ in range(rounds):
            post = [(v, n, posterior(v, share, ab)) for v, n in rows]
            share = (sum(n * p for _, n, p in post) + 1) / (sum(n for _, n in rows) + 2)
            new = []
            for k, (a0, b0) in enumerate(((9, 1), (7, 3), (7, 3))):
                on = [(v[k] == "1", n, p) for v, n, p in post if v[k] != "-"]
                new.append(
                    (
                        (sum(n * p for y, n, p in on if y) + a0) / (sum(n * p for _, n, p in on) + a0 + b0),
                        (sum(n * (1 - p) for y, n, p in on if y) + b0) / (sum(n * (1 - p) for _, n, p in on) + a0 + b0),
                    )
                )
            ab = new
        out[kind] = share, ab
    return out


def posterior(votes: str, share: float, ab: list[tuple[float, float]]) -> float:
    odds = math.log(share / (1 - share))
    for v, (a, b) in zip(votes, ab, strict=True):
        odds += {"1": math.log(a / b), "0": math.log((1 - a) / (1 - b)), "-": 0.0}[v]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def classifier(counts: list[tuple[int, str, str, int]]) -> dict[str, float]:
    """Additive log odds: ``kind`` for the prior, ``kind|votes`` and ``kind/shape`` for the evidence."""
    rel = reliabilities(counts)
    true: dict[str, float] = {}
    false: dict[str, float] = {}
    for kind, votes, shape, n in counts:
        p = posterior(votes, *rel[kind])
        for key in (f"{kind}", f"{kind}|{votes}", f"{kind}/{shape}"):
            true[key] = true.get(key, 0.0) + n * p
            false[key] = false.get(key, 0.0) + n * (1 - p)
    out = {}
    for key in true:
        kind = key.split("|")[0].split("/")[0]
        base = 0.0 if key == kind else math.log((true[kind] + 1) / (false[kind] + 1))
        out[key] = math.log((true[key] + 0.5) / (false[key] + 0.5)) - base
    return out


def _score(x: Column, weights: dict[str, float]) -> Column:
    kind = x["kind"].cast("string")
    table = F.create_map(*[F.lit(v) for item in sorted(weights.items()) for v in item])
    look = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    return look(kind) + look(F.concat(kind, F.lit("|"), x["votes"])) + look(F.concat(kind, F.lit("/"), x["shape"]))


def with_spans(found: DataFrame, weights: dict[str, float], least: float = math.log(9)) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of kind (number in :data:`KINDS`), start and end, in that order."""
    plain = lambda x: F.struct(x["kind"], x["start"], x["end"])
    b = found.withColumn("base", F.array_sort(F.transform(F.filter("found", lambda x: x["base"]), plain)))
    if not weights:
        return b.withColumn("spans", F.col("base"))
    more = F.transform(F.filter("found", lambda x: ~x["base"] & (_score(x, weights) >= least)), plain)
    b = b.withColumn("more", more)
    spans = F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", F.when(F.size("base") == 0, F.col("more")).otherwise(_apart(F.col("more"), F.col("base"))))))
    return b.withColumn("spans", spans).drop("more")


def _apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that no span of ``base`` overlaps: two runs over all spans in order of their places."""
    placed = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(own).alias("own")))
    ordered = F.array_sort(F.concat(placed(base, True), placed(more, False)))
    fields = "start:int,end:int,kind:int,own:boolean"
    reach = running(
        ordered, F.lit(0), lambda at, s: F.when(s["own"], F.greatest(at, s["end"])).otherwise(at), lambda at, s: F.struct(s["start"], s["end"], s["kind"], s["own"], at.alias("reach")), f"struct<{fields},reach:int>"
    )
    after = running(
        F.reverse(reach), F.lit(2**31 - 1), lambda at, s: F.when(s["own"], F.least(at, s["start"])).otherwise(at), lambda at, s: F.struct(s["start"], s["end"], s["kind"], s["own"], s["reach"], at.alias("next")), f"struct<{fields},reach:int,next:int>"
    )
    free = F.filter(after, lambda s: ~s["own"] & (s["reach"] <= s["start"]) & (s["next"] >= s["end"]))
    return F.transform(free, lambda s: F.struct(s["kind"], s["start"], s["end"]))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (without ``text``) with ``base`` and ``spans``; see :func:`with_spans`."""
    found = written(candidates(docs, text), "pii-candidates")
    return with_spans(found, classifier(pattern_counts(found))).drop("found")


def listed(spans: str | Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return spans.select(key, *map(n, BASE_KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span (overlapping ones as one) replaced by its kind's name in angle brackets."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    placed = running(
        ordered, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")), "struct<at:int,start:int,kind:int>"
    )
    end = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))

    def parts(b: Column) -> Column:
        cut = b["cut"]
        new = F.transform(F.filter(placed, lambda s: s["start"] >= s["at"]), lambda s: F.concat(between(cut, s["at"], s["start"]), F.get(names, s["kind"])))
        return F.concat(F.array_join(new, ""), between(cut, b["end"], b["size"]))

    bound = F.struct(blocks(text).alias("cut"), end.alias("end"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, let(bound, parts)).otherwise(text)


def mask(docs: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text``; rows and columns stay, ``n_chars`` is renewed if named."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))
    d = detect(packed.select("doc", "text"), "text").select("doc", masked(F.col(f"doc.`{text}`"), F.col("spans")).alias("new"))
    new = {text: F.col("new")} | ({n_chars: F.length("new").cast(dict(docs.dtypes)[n_chars])} if n_chars else {})
    return d.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
