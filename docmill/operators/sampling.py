"""Samples of the elements of an array, the same in every run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sampling:
    """``all``, ``count`` (value elements at most) or ``percentage`` (a share of them, rounded down)."""

    mode: str = "all"
    value: float = 1.0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.mode not in ("all", "count", "percentage"):
            raise ValueError(f"no such sampling mode: {self.mode}")
        if self.value < 0:
            raise ValueError("a sample can't be negative")


def sample_size(n: Column, sampling: Sampling) -> Column:
    """How many of ``n`` elements a sample takes."""
    if sampling.mode == "all":
        return n
    if sampling.mode == "count":
        return F.least(n, F.lit(int(sampling.value)))
    return F.least(n, F.floor(n * F.lit(float(sampling.value))).cast("int"))


def sample_array(key: Column, array: Column, sampling: Sampling, least: int = 0) -> Column:
    """A sample of an array in the order of its elements; arrays of fewer than ``least`` elements stay whole.

    Elements are ranked by a hash of key, seed and position, so that the sample is without
    replacement and depends on nothing else.
    """
    if sampling.mode == "all":
        return array
    ranked = F.array_sort(F.transform(array, lambda x, i: F.struct(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(sampling.seed)), i.cast("string"))).alias("h"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, F.lit(1), sample_size(F.size(array), sampling)), lambda x: x["i"]))
    picked = F.transform(chosen, lambda i: array[i])
    return F.when(F.size(array) < least, array).otherwise(picked) if least else picked
