"""Costly functions of texts, evaluated once for each different text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def costly(function: Callable, returns: str) -> Callable[..., Column]:
    """A pandas function as a column that is evaluated where it stands, once.

    Otherwise the optimiser moves filters on its result below repartitions and evaluates it there and again.
    """
    return F.pandas_udf(function, returns).asNondeterministic()


def _digest(text: Column) -> Column:
    """Stands for the text in the shuffle; a null text has one of its own."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def of_each(rows: DataFrame, texts: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows joined with what made gives for each different combination of their texts (string columns).

    made gets the texts and returns them with any further columns, in no row, one or several: rows follow. Repeats are
    combined before the shuffle, and only digests of the texts meet in the join, so a text that very many rows share is
    evaluated once and its rows can be split over tasks. Texts are few bytes for the work that they make, so how many
    tasks share it is set here and not left to their size.
    """
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    own, other = ([f"__{side}{i}" for i in range(len(texts))] for side in ("own", "other"))
    digests = [_digest(F.col(t)) for t in texts]
    told = made(rows.select(*texts).distinct().repartition(tasks, F.xxhash64(*texts))).withColumns(dict(zip(other, digests, strict=True))).drop(*texts)
    equal = [F.col(a) == F.col(b) for a, b in zip(own, other, strict=True)]
    return rows.withColumns(dict(zip(own, digests, strict=True))).join(told, equal).drop(*own, *other)
