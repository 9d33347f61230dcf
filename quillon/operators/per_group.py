"""Sequential functions applied to each group of rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_group(rows: DataFrame, key: str, columns: list[str], f: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """key and schema's columns: the rows that f makes of each group's rows, tuples of columns in their order.

    Groups are gathered in the JVM and travel many to an Arrow batch. A group must fit in a task's
    memory, as the rows of one page do; f needs them all at once.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [(k, *r) for k, group in zip(b["k"], b["g"], strict=True) for r in f([tuple(x[c] for c in columns) for x in group])]
            yield pd.DataFrame(out, columns=names)

    names = [key, *(c.split()[0] for c in schema.split(", "))]
    groups = rows.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("g"))
    return groups.mapInPandas(run, f"{key} {kind}, {schema}")
