"""Joins of spans that are held in separate tables.

A span is dealt to bins on a grid as wide as itself or wider: its own level is
the first, of widths that grow eightfold, at which it lies in two bins at most.
Two spans meet at the coarser of their own levels, so a span is sent two rows for
each level that any span has, however long it is. A pair that shares both bins
is kept in the first of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the narrowest bins, and how much wider each level is.
WIDTH, STEP = 64, 8


def _own_level(start: Column, last: Column, width: int) -> Column:
    levels = [k for k in range(21) if width * STEP**k < 1 << 62]
    out = F.lit(levels[-1])
    for k in reversed(levels):
        out = F.when(last - start < width * STEP**k, k).otherwise(out)
    return out


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "overlaps", width: int = WIDTH) -> DataFrame:
    """Rows of both sides with equal keys whose spans [start, end) meet, with columns l_start, l_end, r_start, r_end in place of these.

    ``how``: ``overlaps`` (a place in common), or ``starts_in`` (the right span begins within the left one). A span without
    length is taken for its first place. Other columns must have different names on both sides; null keys or bounds join nothing.
    """
    keys = list(keys)

    def placed(df: DataFrame, side: str) -> DataFrame:
        start, end = F.col("start").cast("long"), F.col("end").cast("long")
        df = df.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumns({f"{side}_start": start, f"{side}_end": F.greatest(end, start + 1)}).drop("start", "end")
        return df.withColumn(f"{side}_level", _own_level(F.col(f"{side}_start"), F.col(f"{side}_end") - 1, width))

    left, right = placed(left, "l"), placed(right, "r")
    # at most as many values as there are levels
    levels = sorted(r[0] for r in left.select("l_level").union(right.select("r_level")).distinct().collect())
    size = F.lit(width).cast("long") * F.pow(F.lit(STEP), F.col("level")).cast("long")

    def dealt(df: DataFrame, side: str) -> DataFrame:
        some = df.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col(f"{side}_level"))))
        some = some.withColumn(f"{side}_first", F.floor(F.col(f"{side}_start") / size))
        return some.withColumn("bin", F.explode(F.sequence(F.col(f"{side}_first"), F.floor((F.col(f"{side}_end") - 1) / size))))

    if not levels:
        levels = [0]
    met = dealt(left, "l").join(dealt(right, "r"), [*keys, "level", "bin"])
    meets = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    if how == "starts_in":
        meets = (F.col("l_start") <= F.col("r_start")) & (F.col("r_start") < F.col("l_end"))
    once = (F.col("level") == F.greatest("l_level", "r_level")) & (F.col("bin") == F.greatest("l_first", "r_first"))
    return met.filter(meets & once).drop("level", "bin", "l_level", "r_level", "l_first", "r_first")
