"""Values for fixtures and benchmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator: x = x * FACTOR + STEP in 64 bits; each byte is bits 16 to 23.
FACTOR, STEP = 1103515245, 12345


def lcg_bytes(seed: Column, size: int) -> Column:
    """size pseudo-random bytes for each seed; all seeds of a batch advance together."""

    @F.pandas_udf("binary")
    def make(seeds: pd.Series) -> pd.Series:
        x = seeds.to_numpy(dtype=np.int64).astype(np.uint64)
        out = np.empty((len(x), size), dtype=np.uint8)
        for i in range(size):
            x = x * np.uint64(FACTOR) + np.uint64(STEP)
            out[:, i] = (x >> np.uint64(16)) & np.uint64(0xFF)
        return pd.Series([row.tobytes() for row in out])

    return make(seed.cast("bigint"))
