"""Changed slots between two versions of a text, sentence by sentence."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import text as T


@F.pandas_udf(LongType())
def _slots(a: pd.Series, b: pd.Series) -> pd.Series:
    def count(x, y):
        return sum(max(i2 - i1, j2 - j1) for op, i1, i2, j1, j2 in SequenceMatcher(None, list(x), list(y)).get_opcodes() if op != "equal")

    return pd.Series([None if x is None or y is None else count(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def changed_slots(a: Column, b: Column) -> Column:
    """Sentences that matching blocks leave over, the longer side of each run. The blocks are those of the standard
    library's matcher (no longest common subsequence), hence a Pandas UDF; null texts give null."""
    return _slots(T.sentences(a), T.sentences(b))
