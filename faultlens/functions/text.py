"""Text helpers with Python ``str.strip()`` / ``str.split()`` semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the characters Python's str.strip() removes (str.isspace) -------
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
# -------------------------------------------------------------------------------


# Java's Unicode \s (White_Space) plus U+001C..U+001F is exactly str.isspace(); this class is
# also faster than an explicit list of the characters.
_SPLIT_RUNS = r"(?U)[\s\x1c-\x1f]+"


def py_strip(col: Column) -> Column:
    """``str.strip()``: drop leading/trailing whitespace (a character-set trim, no regex)."""
    return F.btrim(col, F.lit(PY_WHITESPACE))


def split_runs(col: Column) -> Column:
    """The parts between runs of Python whitespace; of a stripped, non-empty line none is empty."""
    return F.split(col, _SPLIT_RUNS)


def tokens(col: Column) -> Column:
    """``str.split()`` on any line: runs of Python whitespace, no empty tokens."""
    return F.filter(split_runs(py_strip(col)), lambda w: w != "")


def hot_cold_key(col: Column) -> Column:
    """Skew mapper key: stripped line starting with ``hot_key`` else ``cold_key``."""
    return F.when(py_strip(col).startswith("hot_key"), F.lit("hot_key")).otherwise(F.lit("cold_key"))
