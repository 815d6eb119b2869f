"""Sequence ratio of two texts, as an Arrow UDF."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(texts: pd.Series, queries: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of text and query, in this argument order."""
    # The matcher indexes its second sequence, so it is set once per distinct query.
    matcher = SequenceMatcher(None)
    scores = pd.Series(0.0, index=texts.index)
    for query, group in texts.groupby(queries, sort=False):
        matcher.set_seq2(query)
        for row, value in group.items():
            matcher.set_seq1(value)
            scores.at[row] = matcher.ratio()
    return scores


#: Marked so that a filter on the score is never merged with, and so repeats, the computation.
ratio = _ratio.asNondeterministic()
