"""Splitting oversized texts at natural boundaries, with overlap.

Method: bounded-quantifier regex extraction. The alternatives are ordered by the strength of the
boundary: blank line, line break, end of sentence, then any white space, then any character; each
consumes up to the limit. The pieces extracted tile the text; SQL array functions give each
its offset and put in front of it the end of the piece before, back to a natural boundary.

A natural boundary lies behind a line break and behind ``.``, ``!`` or ``?`` with all the white space that
follows. A piece ends elsewhere only where the limit holds none, and from such pieces, and nothing
else, a text is known to be cut by force.

- null and texts up to the limit: one piece, the text itself (null stays null);
- a piece never exceeds the limit, overlap included; lengths are code points;
- the overlap is the last ``overlap`` characters of the piece before or, where a boundary lies in them, what
  follows the first one; in front of a piece that leaves less room, what follows the first boundary in that room
  (the piece begins at a boundary itself, so nothing where there is none);
- pieces without their overlaps, joined, are the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python has it, spelt out so that Java agrees.
WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]"
LINE = "\\n"
SENTENCE = f"(?:[.!?]{WS}+)"
NATURAL = f"(?:{LINE}|{SENTENCE})"
#: Parts whose lengths are summed at a time.
BLOCK = 256


def _extract(limit: int, first: int) -> str:
    """One piece of at most ``limit`` characters, or ``first`` where only that reaches a boundary or the end of the text."""
    more = first - limit
    strong = [f"\\n{WS}{{0,{more}}}\\n", LINE, f"[.!?]{WS}{{1,{more + 1}}}(?!{WS})"]
    natural = [f".{{0,{limit - 2}}}{e}" for e in strong]
    # beyond the limit: every boundary up to ``first``, however long the white space before it
    wide = [
        f".{{1,{first}}}\\z",
        f".{{0,{first - 2}}}(?:{LINE}|[.!?]{WS}(?!{WS}))",
        f"(?=.{{0,{first}}}[.!?]{WS}{{2}}).{{1,{first}}}(?<={WS})(?!{WS})(?<=[.!?]{WS}{{1,{first}}})",
        f".{{0,{first - 1}}}{LINE}",
    ]
    return "(?s)(" + "|".join([f".{{1,{limit}}}\\z", *natural, *wide, f".{{0,{limit - 1}}}{WS}", f".{{1,{limit}}}"]) + ")"


def cores(text: Column, limit: int, overlap: int) -> Column:
    """The text cut into successive parts: no part is lost, none is doubled."""
    return F.regexp_extract_all(text, F.lit(_extract(limit - overlap, limit)), F.lit(1))


def forced(parts: Column) -> Column:
    """Whether a part but the last ends elsewhere than at a natural boundary."""

    def ends_by_force(z: Column) -> Column:
        natural = z["part"].endswith("\n") | (z["part"].rlike(f"[.!?]{WS}+\\z") & ~z["next"].rlike(f"\\A{WS}"))
        return z["next"].isNotNull() & ~natural

    following = F.slice(parts, F.lit(2), F.size(parts))
    return F.exists(F.arrays_zip(parts.alias("part"), following.alias("next")), ends_by_force)


def offsets(lengths: Column) -> Column:
    """The sum of the lengths before each, in blocks, so that the cost stays near the number of parts."""
    last = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    add = lambda a, n: a + n
    zero = F.lit(0).cast("int")
    sums = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
    start = F.struct(F.array().cast("array<int>").alias("at"), zero.alias("sum"))
    firsts = F.aggregate(sums, start, lambda s, n: F.struct(F.array_append(s["at"], s["sum"]).alias("at"), (s["sum"] + n).alias("sum")), lambda s: s["at"])

    def block(x: Column, b: Column) -> Column:
        own = F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))
        begin = F.struct(F.array().cast("array<int>").alias("at"), x.alias("sum"))
        return F.aggregate(own, begin, lambda s, n: F.struct(F.array_append(s["at"], s["sum"]).alias("at"), (s["sum"] + n).alias("sum")), lambda s: s["at"])

    return F.flatten(F.transform(firsts, block))


def pieces(df: DataFrame, text: str, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """``df`` with one row a piece: ``piece_no`` from 0, ``start`` (of what is new in it), ``piece``
    and ``cut`` (``whole``, ``natural`` or ``forced``). Columns of those names are replaced."""
    t = F.col(text)
    clash = [c for c in ("piece_no", "start", "piece", "cut") if c in df.columns and c != text]
    parts = F.when(F.length(t) > limit, cores(t, limit, overlap)).otherwise(F.array(t))
    label = F.when(F.length(t) <= limit, "whole").when(forced(F.col("_parts")), "forced").otherwise("natural")
    before = F.concat(F.array(F.lit("")), F.slice("_parts", F.lit(1), F.size("_parts") - 1))
    zipped = F.arrays_zip(F.col("_parts").alias("part"), before.alias("before"), offsets(F.transform("_parts", F.length)).alias("start"))
    room = F.least(F.lit(overlap), F.lit(limit) - F.length("_p.part"))
    tail = F.when(F.col("_room") > 0, F.expr("right(_p.before, _room)")).otherwise(F.lit(""))
    # back to a natural boundary: what follows the first boundary in the tail
    settled = F.regexp_replace("_tail", f"(?s)\\A.*?{NATURAL}(?=.)", "")
    kept = F.when((F.col("_room") < overlap) & (F.length("_tail") > 0) & ~F.col("_tail").rlike(f"(?s){NATURAL}."), "").otherwise(settled)
    out = (
        df.drop(*clash)
        .withColumn("_parts", parts)
        .withColumn("cut", F.when(t.isNotNull(), label))
        .withColumn("_zipped", zipped)
        .drop("_parts")
        .select("*", F.posexplode_outer("_zipped").alias("piece_no", "_p"))
        .drop("_zipped")
        .withColumn("start", F.coalesce("_p.start", F.lit(0)))
        .withColumn("_room", room)
        .withColumn("_tail", tail)
        .withColumn("piece", F.concat(kept, F.col("_p.part")))
    )
    return out.drop("_p", "_room", "_tail")
