"""Unicode steps that Spark has no function for, as Arrow-batched functions; everything after them stays on the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _folded(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition: full-width and other variant forms as their plain letters. Null stays null."""
    return F.pandas_udf(_nfkc, "string")(text)


def casefold(text: Column) -> Column:
    """Full case folding, which differs from lower case in a few letters."""
    return F.pandas_udf(_folded, "string")(text)


def spaced(text: Column) -> Column:
    """Normalised text with every run of white space as one blank and none at the ends."""
    return F.btrim(F.regexp_replace(nfkc(text), r"(?U)\s+", " "))


def letters_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def compact(text: Column) -> Column:
    """Upper-case letters and digits of the normalised text: the key under which readings of one target or title meet."""
    return letters_digits(F.upper(nfkc(text)))
