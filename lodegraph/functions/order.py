"""The order of text as readers expect it: letters before their capitals, marks before both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def locale(x: Column | str) -> Column:
    """A key that sorts by the root locale, in ``orderBy``, windows, minima and maxima.  Strings that differ in
    nothing but their code points (forms of one character) are equal: end a sort with the column itself."""
    return F.collate(F.col(x) if isinstance(x, str) else x, "UNICODE")
