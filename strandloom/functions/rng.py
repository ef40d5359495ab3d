"""Counter-based random numbers: the same for a seed, stream and key, however the data are split."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *key: Column | str) -> Column:
    """A number in the open interval (0, 1) from the md5 of seed, stream and key."""
    parts = [F.lit(f"{seed}|{stream}"), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")
    return (h + 1) / F.lit(float(2**48 + 2))


def generator(*key: object) -> np.random.Generator:
    """A numpy generator seeded by any key."""
    digest = hashlib.sha256("|".join(map(str, key)).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "big")))


def pick(u: Column, cumulative: list[float]) -> Column:
    """Index of the first cumulative weight that u does not exceed; weights end at 1."""
    out = F.lit(len(cumulative) - 1)
    for i in range(len(cumulative) - 2, -1, -1):
        out = F.when(u <= cumulative[i], i).otherwise(out)
    return out


def cumulative(weights: list[float]) -> list[float]:
    w = np.asarray(weights, float)
    if (w < 0).any() or w.sum() <= 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    return (np.cumsum(w) / w.sum()).tolist()
