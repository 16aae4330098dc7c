"""Accents and names: Unicode normalisation, for which Spark has no function, as Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles that a name may begin with.
PARTICLES = ("de", "van", "von", "del", "der", "den", "di", "da", "la", "le", "el", "al", "bin", "ibn", "dos", "das")
_PARTICLE = re.compile(rf"^({'|'.join(PARTICLES)})\s+")


def plain(name: str | None) -> str | None:
    """Lower case without accents and one leading particle."""
    if name is None:
        return None
    letters = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return _PARTICLE.sub("", letters.lower().strip())


def plain_name(name: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(plain, na_action="ignore"), "string")(name)


def nfc(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore"), "string")(text)


def last_name(name: Column) -> Column:
    """What stands before a comma, else the last word."""
    words = F.split(F.trim(name), r"\s+")
    return F.when(F.contains(name, F.lit(",")), F.trim(F.get(F.split(name, ","), F.lit(0)))).otherwise(F.element_at(words, -1))
