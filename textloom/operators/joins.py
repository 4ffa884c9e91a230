"""Joins that no key makes uneven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is joined by broadcast: there can't be more than its inverse of them.
HOT_SHARE = 1e-3


def evenly(rows: DataFrame, groups: DataFrame, keys: list[str], size: Column, hot_share: float = HOT_SHARE, how: str = "inner") -> DataFrame:
    """ROWS with the columns of GROUPS (one row for each key, which counts SIZE rows); HOW "left" keeps rows without a group.

    Keys that hold a large share are few, by their share: they are broadcast, and their rows are joined where they are. Only the other rows are shuffled, so no task gathers a hot key.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = size >= max(2, total * hot_share)
    few = F.broadcast(groups.where(hot))
    cold = rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti").join(groups.where(~hot), keys, how)
    return rows.join(few, keys).unionByName(cold)
