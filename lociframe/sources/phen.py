"""Phenotype files. They have a line for each pool, so they are read whole on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import SparkSession

from lociframe.operators.association import Phenotypes
from lociframe.operators.gwalpha import Quantiles

# How a missing phenotype is written.
MISSING = ("", "NA", "NAN", "NaN", "na", "nan")


def _lines(spark: SparkSession, path: str) -> list[str]:
    return [r[0] for r in spark.read.text(path).collect()]


def parse_delimited(lines: Sequence[str], delimiter: str = ",", name: int = 0, size: int = 1, values: Sequence[int] = (2,)) -> Phenotypes:
    """Names, sizes and the chosen columns; ``#`` lines are comments."""
    rows = [[x.strip() for x in line.split(delimiter)] for line in lines if line.strip() and not line.startswith("#")]
    if not rows:
        raise ValueError("there is no pool")
    number = lambda x: float("nan") if x in MISSING else float(x)
    return Phenotypes(tuple(r[name] for r in rows), np.array([float(r[size]) for r in rows]), np.array([[number(r[c]) for c in values] for r in rows]))


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", name: int = 0, size: int = 1, values: Sequence[int] = (2,)) -> Phenotypes:
    return parse_delimited(_lines(spark, path), delimiter, name, size, values)


def parse_quantiles(lines: Sequence[str]) -> Quantiles:
    """Lines ``key=value;`` with sig, MIN, MAX, perc and q: cumulative shares of the pools but the last, and quantiles at these."""
    found = {m[1].lower(): m[2] for line in lines if (m := re.match(r"\s*(\w+)\s*=\s*(.*?)\s*;?\s*$", line))}
    listed = lambda key: np.array([float(x) for x in found[key].strip("[]").split(",")])
    low, high = float(found["min"]), float(found["max"])
    bins = np.diff(np.concatenate([[0.0], listed("perc"), [1.0]]))
    q = np.concatenate([[0.0], (listed("q") - low) / (high - low)])
    if len(q) != len(bins):
        raise ValueError("perc and q differ in length")
    return Quantiles(bins, q, float(found["sig"]), low, high)


def read_quantiles(spark: SparkSession, path: str) -> Quantiles:
    return parse_quantiles(_lines(spark, path))
