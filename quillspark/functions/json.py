"""Lenient reading of JSON objects in model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _valid(text: Column) -> Column:
    """The text if it is one JSON value and nothing else, else null. (The parser alone ignores what follows a value.)"""
    single = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(single & F.try_parse_json(text).isNotNull(), text)


def _object(text: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return F.when(text.rlike(r"(?s)^\s*\{"), _valid(text))


def extract_object(raw: Column) -> Column:
    """JSON text of the first object found: the whole answer, else a fenced block, else from the first brace to the last,
    else the first element of the outermost list. Null where there is none."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    cut = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    fenced = F.trim(cut(r"(?s)```(?:json)?\s*(.*?)```"))
    braces, brackets = cut(r"(?s)(\{.*\})"), cut(r"(?s)(\[.*\])")
    first = F.when(F.try_parse_json(brackets).isNotNull(), F.get_json_object(brackets, "$[0]"))
    return F.coalesce(_object(text), _object(fenced), _object(braces), _object(first))


def extract_text(raw: Column) -> Column:
    """JSON text of an answer, objects and arrays alike: the whole, else a fenced block, else from the first brace to the last,
    else from the first bracket to the last; the trimmed answer where none of them parses."""
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    cut = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    fenced = F.regexp_replace(cut(r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"), r"(?U)^\s+|\s+$", "")
    return F.coalesce(_valid(text), _valid(fenced), _valid(cut(r"(?s)(\{.*\})")), _valid(cut(r"(?s)(\[.*\])")), text)


def field(json: Column, name: str, kind: str, default=None) -> Column:
    """A field of a JSON object, or its default where it is missing or of another kind."""
    value = F.get_json_object(json, f"$.{name}").try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def vote_of(raw: Column) -> Column:
    """struct(verdict, confidence, reasoning) of an answer, with defaults and the confidence kept in 0 to 1; null without an object."""
    found = extract_object(raw)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), field(found, "confidence", "double", 0.0)))
    return F.when(
        found.isNotNull(),
        F.struct(field(found, "verdict", "string", "cannot_verify").alias("verdict"), confidence.alias("confidence"), field(found, "reasoning", "string", "").alias("reasoning")),
    )
