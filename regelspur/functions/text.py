"""Text rules as Column expressions: repair, normal form, terms, headings, ids.

Every class is spelt out so that Java, RE2 and Python agree; see the constants. Nulls stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, word characters and hyphens as Python's ``re`` has them.
WS = r"[\s\p{Z}\x{000b}\x{0085}\x{001c}-\x{001f}]"
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
HYPHEN = r"[-\x{2010}\x{2011}]"
SOFT = r"\x{00ad}"

#: The repair chain and its patterns, whose results must match: (pattern, replacement), in this order. Single line breaks become spaces through
#: the detour of \x01, which the chain has removed before, so no look-around is needed.
CLEAN = (
    (SOFT + WS + "*", ""),
    (f"({W}){HYPHEN}{WS}*\\n{WS}*(und|oder|bzw|sowie)($|{NOT_W})", "$1- $2$3"),
    (f"({W}){HYPHEN}{WS}*\\n{WS}*([a-zäöüß])", "$1$2"),
    (f"({W}){HYPHEN}{WS}*\\n{WS}*([A-ZÄÖÜ0-9])", "$1-$2"),
    (r"[\x{00a0}\x{2007}\x{2009}\x{202f}]", " "),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
    (r"[ \t]+(\n|\z)", "$1"),
    (r"\n{2,}", "\x01"),
    (r"\n", " "),
    ("\x01", "\n\n"),
    (f"^{WS}+|{WS}+\\z", ""),
)
NORMALISE = (
    (r"\x{00a0}", " "),
    (SOFT + WS + "*", ""),
    (f"({W}){HYPHEN}{WS}*\\n{WS}*({W})", "$1$2"),
    (r"[\x{2010}-\x{2014}]", "-"),
    (r"[\x{201a}\x{201e}\x{201c}\x{201d}\x{2018}\x{2019}]", '"'),
)
#: What a text must hold for the chains to change it at all; most hold none of it.
CLEAN_TRIGGER = r"[\x{00ad}\x{00a0}\x{2007}\x{2009}\x{202f}\x00-\x08\n\x0b\x0c\x0e-\x1f\x7f]|[ \t]\z|^" + WS + "|" + WS + r"\z"
NORMALISE_TRIGGER = r"[\x{00a0}\x{00ad}\x{2010}-\x{2014}\x{2018}-\x{201e}\n]"
PARAGRAPH_SIGN = (f"§{WS}*(\\p{{Nd}}+[a-z]?)", "§$1")
TERM = r"([a-zäöüß0-9§]+(?:-[a-zäöüß0-9]+)*)"
HEADING = f"^{WS}*(\\d+(\\.\\d+){{1,4}}($|{NOT_W})|[A-Z]\\.\\d+(\\.\\d+)*($|{NOT_W})|(Anhang|Tabelle|Bild){WS}+[^\\s\\p{{Z}}])"
TOKEN = r"[\p{L}]+|[\p{N}]{1,3}|[^\s\p{L}\p{N}]"
LEADERS = r"\.{4,}"
IMPRINT = f"^(?i:impressum|herausgegeben von|bildnachweis|isbn)($|{NOT_W})"

#: Terms that are never indexed. Modal verbs are kept on purpose.
STOPWORDS = (
    "wer wen wem wessen wie was wo wann warum wieso weshalb weswegen wohin woher wofür womit worauf worin wobei wozu wieviel wieviele "
    "welche welcher welches welchen welchem "
    "und oder aber denn doch nur auch noch schon sehr viel mehr meisten sowie sowohl beziehungsweise bzw "
    "der die das den dem des ein eine einen einer eines einem dieser diese dieses diesen diesem "
    "in im an am auf aus bei beim mit nach von vom vor zu zum zur über unter durch für gegen ohne um "
    "ist sind war waren wird werden wurde wurden sein hat haben hatte hatten "
    "nicht kein keine keinen als wenn dass sich es man ich sie ihr ihre ihren seine seinen dabei damit dazu"
).split()


def types(df: DataFrame) -> str:
    """The columns of a frame as a schema in words."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _chain(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


def once(expression: Column) -> Column:
    """An expression that later filters and projections refer to but never repeat.

    The planner pushes filters below projections and writes their expressions out again at each use; it
    does not do so through a generator, here one of a single row.
    """
    return F.explode(F.array(expression))


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(text, F.lit(f"^{WS}+|{WS}+\\z"), F.lit(""))


def clean(text: Column) -> Column:
    """Repaired text: soft hyphens and broken words joined, fixed spaces and control characters
    replaced, line breaks inside paragraphs turned to spaces, paragraphs kept apart by a blank line."""
    return F.when(text.rlike(CLEAN_TRIGGER), _chain(text, CLEAN)).otherwise(text)


def _plain(text: Column) -> Column:
    return F.lower(F.when(text.rlike(NORMALISE_TRIGGER), _chain(text, NORMALISE)).otherwise(text))


def normalise(text: Column) -> Column:
    """The form in which texts are compared: joined words, plain hyphens and quotes, lower case, single spaces."""
    flat = F.regexp_replace(_plain(text), F.lit(WS + "+"), F.lit(" "))
    return F.regexp_replace(flat, F.lit("^ | \\z"), F.lit(""))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, F.lit(r"[^\p{L}]"), F.lit("")))


def is_boilerplate(text: Column, kind: Column) -> Column:
    """Empty, dot leaders, imprint, or (tables apart) fewer than 35 letters in a hundred characters."""

    def judge(bare: Column) -> Column:
        share = letters(bare) / F.nullif(F.length(bare), F.lit(0))
        return (
            F.when(F.length(bare) == 0, True)
            .when(bare.rlike(LEADERS) | bare.rlike(IMPRINT), True)
            .when(F.coalesce(kind, F.lit("")) == "Table", False)
            .otherwise(share < 0.35)
        )

    # the stripped text is used five times and worked out once
    return F.get(F.transform(F.array(strip(F.coalesce(text, F.lit("")))), judge), F.lit(0))


def tokenize(text: Column) -> Column:
    """All terms of a text, in order: those of its normal form, whose single spaces make no difference to terms."""
    plain = _plain(text)
    signed = F.when(F.contains(text, F.lit("§")), F.regexp_replace(plain, F.lit(PARAGRAPH_SIGN[0]), F.lit(PARAGRAPH_SIGN[1]))).otherwise(plain)
    return F.regexp_extract_all(signed, F.lit(TERM), F.lit(1))


def filter_tokens(tokens: Column) -> Column:
    """Terms of two characters or more that are no stopwords."""
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def analyse(text: Column) -> Column:
    """The terms that are indexed and searched, the same for passages and questions."""
    return filter_tokens(tokenize(text))


def is_heading(text: Column) -> Column:
    return text.rlike(HEADING)


def token_estimate(text: Column) -> Column:
    """About how many tokens a subword tokenizer makes of a text."""
    return F.regexp_count(text, F.lit(TOKEN))


def chunk_id(source: Column, page: Column, kind: Column, text: Column) -> Column:
    """The content-derived id of a passage: 16 hex digits. A missing page reads ``None``."""
    page = F.coalesce(page.cast("string"), F.lit("None"))
    bar = F.lit("|")
    return F.substring(F.sha2(F.concat(source, bar, page, bar, kind, bar, text), 256), 1, 16)


def location(source: Column, page: Column) -> Column:
    """``file p.page`` as reports show it."""
    return F.concat(source, F.lit(" p."), F.coalesce(page.cast("string"), F.lit("None")))
