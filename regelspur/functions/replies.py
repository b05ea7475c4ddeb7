"""Replies of a language model: citations, refusals, JSON, prompts. Nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regelspur.functions.text import WS, strip

#: The forms the prompt asks the model for.
CITATION = f"(?i)\\[([^\\[\\]]+?){WS}*,{WS}*Seite{WS}*(\\d+){WS}*\\]"
REFUSAL_TOKEN = "[KEINE_ANTWORT]"
REFUSAL = f"(?i)^{WS}*\\[{WS}*KEINE_ANTWORT{WS}*\\]{WS}*"
FENCE = f"^```(?:json)?{WS}*|{WS}*```$"
NO_PASSAGE = "Dazu habe ich keine relevanten Informationen in den Dokumenten gefunden."


def citations(answer: Column) -> Column:
    """The distinct (file, page) pairs an answer cites; ``.pdf`` is added where it is missing."""
    names, pages = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), F.regexp_extract_all(answer, F.lit(CITATION), F.lit(2))

    def pair(z: Column) -> Column:
        name = strip(z["n"])
        full = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
        return F.struct(full.alias("file"), z["p"].cast("int").alias("page"))

    return F.array_distinct(F.transform(F.arrays_zip(names.alias("n"), pages.alias("p")), pair))


def is_refusal(answer: Column) -> Column:
    """Whether an answer starts with the refusal token; one further inside is none."""
    return answer.rlike(REFUSAL)


def without_refusal(answer: Column) -> Column:
    return F.when(is_refusal(answer), strip(F.regexp_replace(answer, F.lit(REFUSAL), F.lit("")))).otherwise(answer)


def unfence(reply: Column) -> Column:
    """A reply without the code fence around it."""
    bare = strip(reply)
    return F.when(bare.startswith("```"), F.regexp_replace(bare, F.lit(FENCE), F.lit(""))).otherwise(bare)


def json_object(reply: Column) -> Column:
    """The reply as a variant if it is a JSON object, else null: text, arrays and scalars are rejected."""
    parsed = F.try_parse_json(unfence(reply))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def json_field(parsed: Column, name: str) -> Column:
    """A stripped text field; missing, null and non-text fields read as an empty text."""
    return F.coalesce(strip(F.try_variant_get(parsed, f"$.{name}", "string")), F.lit(""))


def prompt(template: str, **fields: Column) -> Column:
    """``template`` with ``{name}`` replaced by columns; the page is withheld simply by not naming it."""
    out = F.lit(template)
    for name, column in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column, F.lit("")))
    return out
