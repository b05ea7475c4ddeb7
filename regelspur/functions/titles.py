"""Display titles of documents. Nulls stay null, except where a fallback is stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regelspur.functions.text import WS, clean, strip

#: Publishers of regulations whose designations are recognised (fixed values; add your own).
PUBLISHERS = ("DGUV", "UVK")
_KIND = "(?i:Regel|Information|Vorschrift|Grundsatz)"
_NAME = "(?i:" + "|".join(PUBLISHERS) + ")"
DESIGNATION = f"{_NAME}{WS}+{_KIND}{WS}+[\\p{{L}}\\p{{N}}_-]+"
QUOTES = "[„“”\"»«]"
#: Lines of a cover that are no part of a title (fixed values).
COVER_NOISE = (
    "(?i)^(Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Ausgabe|Stand|Fassung|Auflage)\\b"
    "|Berufsgenossenschaft?\\b|Unfallversicherung|gesetzliche|Holz und Metall|Deutsche Gesetzliche|^BG\\w*$"
)


def _trim(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, F.lit(f"^[{chars}]+|[{chars}]+\\z"), F.lit(""))


def undouble(text: Column) -> Column:
    """A title stored twice in a row, once: its second half says the same as its first, up to white space, or a
    designation begins it anew."""
    middle = F.floor(F.length(text) / 2).cast("int")
    # the halves may differ by the white space between and around them: up to eight characters
    near = F.filter(F.sequence(middle - 8, middle + 8), lambda c: (c > 0) & (c < F.length(text)))
    halves = F.transform(near, lambda c: F.struct(strip(F.left(text, c)).alias("a"), strip(F.substring(text, c + 1, F.length(text))).alias("b")))
    same = F.get(F.filter(halves, lambda h: h["a"] == h["b"]), F.lit(0))["a"]
    until = strip(F.regexp_extract(text, f"(?s)^(.*?{DESIGNATION}.*?){DESIGNATION}", 1))
    return F.coalesce(same, F.nullif(until, F.lit("")), text)


def tidy(text: Column) -> Column:
    """Without quotes, single spaces, ``designation - subject`` where it starts with a designation."""
    flat = _trim(F.regexp_replace(F.regexp_replace(text, F.lit(QUOTES), F.lit("")), F.lit(WS + "+"), F.lit(" ")), " \\-–")
    named = F.regexp_extract(flat, f"^{DESIGNATION}", 0)
    subject = _trim(F.substring(flat, F.length(named) + 1, F.length(flat)), " \\-–:")
    subject = F.regexp_replace(subject, F.lit(f"^{_NAME}{WS}+(?i:Regel|Information|Vorschrift){WS}*"), F.lit(""))
    both = F.filter(F.array(named, subject), lambda x: x != "")
    return F.when(named == "", flat).when(named.isNotNull(), _trim(F.array_join(both, " - "), " \\-"))


def from_metadata(raw: Column) -> Column:
    return undouble(clean(F.translate(F.coalesce(raw, F.lit("")), "\r\n", "  ")))


def from_cover(lines: Column) -> Column:
    """A title of the lines of a first page: the line with a designation, then up to three of the first ten that say something."""
    kept = F.filter(F.transform(lines, clean), lambda x: (F.length(x) > 3) & ~x.rlike("^[\\d\\W]+$"))
    named = F.coalesce(F.get(F.filter(kept, lambda x: x.rlike(DESIGNATION)), F.lit(0)), F.lit(""))
    body = F.filter(F.slice(kept, 1, 10), lambda x: (x != named) & (F.length(x) > 12) & ~x.rlike(COVER_NOISE))
    return F.array_join(F.concat(F.when(named != "", F.array(named)).otherwise(F.array().cast("array<string>")), F.slice(body, 1, 3)), " ")


def read_title(raw: Column, lines: Column, stem: Column) -> Column:
    """The best title there is: the document's own, else its cover's, else the file's name without ending."""
    own = from_metadata(raw)
    short = F.length(strip(F.regexp_replace(own, F.lit(QUOTES), F.lit("")))) < 12
    return F.coalesce(F.nullif(tidy(F.when(short, from_cover(lines)).otherwise(own)), F.lit("")), stem)


def describe(title: Column, source: Column) -> Column:
    """The title, or the file's name where there is none."""
    return F.coalesce(F.nullif(title, F.lit("")), source)
