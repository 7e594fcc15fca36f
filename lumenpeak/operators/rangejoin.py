"""Interval join: points with lo <= value <= hi, as an equi join on bins.

Every interval is copied to the bins it touches and every point lies in one bin,
so the join hashes on (keys, bin) and never compares all pairs of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width)))


def binned_points(points: DataFrame, value: str, width: float) -> DataFrame:
    return points.withColumn("__bin", bin_of(F.col(value), width))


def binned_intervals(intervals: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """One row per touched bin; intervals with hi < lo match nothing."""
    return intervals.where(F.col(lo) <= F.col(hi)).withColumn("__bin", F.explode(F.sequence(
        bin_of(F.col(lo), width), bin_of(F.col(hi), width))))


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], value: str,
                  lo: str, hi: str, width: float) -> DataFrame:
    """Inner join, both ends inclusive.  A pair matches in exactly one bin."""
    left = binned_points(points, value, width)
    right = binned_intervals(intervals, lo, hi, width)
    joined = left.join(right, [*keys, "__bin"])
    return joined.where((F.col(value) >= F.col(lo)) & (F.col(value) <= F.col(hi))).drop("__bin")
