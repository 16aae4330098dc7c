"""Spans of regular-expression matches as array columns, without Python.

Spark has no function for match positions. ``regexp_extract_all`` gives the
matches and, with what comes before a match in a group, the gaps between them; so
a match begins where the gaps and matches before it end. ``split`` would do, but
compiles its pattern for every row. Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (lambda bodies share nothing else)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all matches; offsets in code points from 0. Null text gives null."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        return let(
            state["at"] + x["gap"],
            lambda low: let(
                low + F.length(x["text"]),
                lambda high: F.struct(high.alias("at"), F.concat(state["out"], F.array(F.struct(low.alias("start"), high.alias("end"), x["text"].alias("text")))).alias("out")),
            ),
        )

    def place(t: Column, found: Column) -> Column:
        # each match goes on where the last one ended, so the rest after the last match is scanned once
        gaps = F.regexp_extract_all(t, F.lit(rf"\G((?s:.*?))(?:{pattern})"), F.lit(1))
        pairs = F.zip_with(gaps, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("text")))
        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(F.aggregate(pairs, start, step, lambda state: state["out"]))

    return let(text, lambda t: F.when(t.isNotNull(), let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: place(t, found))))


def before(text: Column, pattern: str) -> Column:
    """What comes before the first match; the whole text without one."""
    return F.regexp_extract(text, rf"^((?s:.*?))(?:{pattern}|\z)", 1)
