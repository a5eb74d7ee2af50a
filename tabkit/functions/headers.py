"""Header names of delimited files."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repair_header(names: Sequence[str]) -> list[str]:
    """Unique column names: a blank name becomes 'Unnamed: i', the n-th repeat of a
    name gets the suffix '.n', or the next number that no column uses."""
    given = [name if name else f"Unnamed: {i}" for i, name in enumerate(names)]
    # Blank names are settled last, so a column that is really called 'Unnamed: 1'
    # keeps its name.
    order = sorted(range(len(names)), key=lambda i: (not names[i], i))
    repeats: Counter[str] = Counter()
    taken = list(given)
    for i in order:
        wanted = given[i]
        name, n = wanted, repeats[wanted]
        if n:
            name = f"{wanted}.{n}"
            while name in taken:
                n += 1
                name = f"{wanted}.{n}"
        repeats[wanted] = n + 1
        repeats[name] += name != wanted
        taken[i] = name
    return taken


@F.pandas_udf(T.ArrayType(T.StringType()))
def repaired_header(headers: pd.Series) -> pd.Series:
    """Repair a column of headers. For one row per file or header, not per line."""
    return headers.map(lambda names: None if names is None else repair_header(list(names)))
