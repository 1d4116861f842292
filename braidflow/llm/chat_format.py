"""Chat formatting with a grammar round trip (Spark expressions only).

    formatted := turn*          turn := "### " role ": " text "</turn>\\n"

The text of a turn may not hold the strings that mark turns, nor the escapes themselves. Each conversation is rendered
as it is, read again by the parser below, and compared with its source; turns that do not come back are escaped
(``\\\\b`` backslash, ``\\\\h`` number sign, ``\\\\l`` less-than, ``\\\\c`` colon, ``\\\\n`` line feed), and if the whole still
differs, all turns are. The parser always undoes escapes, so reading needs no flag.

One conversation is one output row, so its turns must meet in one task: that size is the product's own, and grouping
spills by Spark's sort. All else is a projection.
Defined results: null text and null role count as empty; rows are ordered by turn, then role, then text, so ties and
repeated rows keep a fixed order and each is a turn; a null ``conv_id`` is a conversation like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import between, blocks, let, running

#: The template and the escapes, in the order in which they are written.
OPEN, MIDDLE, END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\n", "\\n"))
TEXT_ESCAPES = ESCAPES[:3]


def escape(s: Column, codes=TEXT_ESCAPES) -> Column:
    for plain, code in codes:
        s = F.replace(s, F.lit(plain), F.lit(code))
    return s


def unescape(s: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        s = F.replace(s, F.lit(code), F.lit(plain))
    return s


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, ESCAPES), F.lit(MIDDLE), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns (array of role, text) that the deterministic parser recovers; marks inside a text end or break its turn."""
    pieces = F.filter(F.split(formatted, "</turn>\n?", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        body = F.element_at(F.split(piece, OPEN, 3), 2)
        at = F.instr(body, MIDDLE)
        return F.struct(
            unescape(F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body)).alias("role"),
            unescape(F.when(at > 0, F.substring(body, at + len(MIDDLE), F.length(body))).otherwise(F.lit(""))).alias("text"),
        )

    return F.transform(F.filter(pieces, lambda p: F.startswith(p, F.lit(OPEN))), turn)


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns in order, as an array of role and text."""
    clean = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return clean.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def format_chats(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans, turns``.

    ``loss_spans`` are the places (code points, end exclusive) of the trained role's texts in ``formatted``, the loss
    mask; ``turns`` is what the parser reads back from ``formatted``.
    """
    source = conversations(rows)
    same = lambda r, t, e: parse(render_turn(r, e)) == F.array(F.struct(r.alias("role"), t.alias("text")))
    minimal = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.when(same(t["role"], t["text"], t["text"]), t["text"]).otherwise(escape(t["text"])).alias("text")))
    a = source.select("conv_id", "turns", minimal.alias("shown"))
    whole = lambda turns: F.array_join(F.transform(turns, lambda t: render_turn(t["role"], t["text"])), "")
    b = a.select("conv_id", "turns", "shown", whole("shown").alias("once"))
    all_escaped = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))
    c = b.select("conv_id", F.when(parse(F.col("once")) == F.col("turns"), F.col("shown")).otherwise(all_escaped).alias("shown"))
    size = lambda t, text: F.length(render_turn(t["role"], text))
    step = lambda at, t: at + size(t, t["text"])
    show = lambda at, t: F.struct((at + size(t, F.lit("")) - len(END)).alias("start"), (at + size(t, t["text"]) - len(END)).alias("end"), t["role"].alias("role"))
    spans = F.filter(running(F.col("shown"), F.lit(0), step, show, "struct<start:int,end:int,role:string>"), lambda s: s["role"] == trained_role)
    d = c.select("conv_id", whole("shown").alias("formatted"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"))
    return d.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"))


def digest(chats: DataFrame) -> DataFrame:
    """The contract's digests, read back from the formatted text and its loss spans."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = let(blocks(F.col("formatted")), lambda cut: F.array_join(F.transform("loss_spans", lambda s: unescape(between(cut, s["start"], s["end"]))), ""))
    c = chats.select("conv_id", "turns", "formatted", turns.alias("all"), loss.alias("loss"))
    return c.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("all", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` and a conversation -7 whose texts hold the template's own marks."""
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
