"""Fixed ranges of a key: splitters are drawn once, and every branch of a query deals rows by the same ones.

A range is a number that follows from the key and the splitters alone. So ranks, neighbours and boundaries agree however often,
and by whatever plan, Spark computes the rows again.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows drawn for each range, at most; that many times ranges reach the driver.
DRAWN = 64


def splitters(rows: DataFrame, key: str, n: int | None = None) -> list:
    """At most n - 1 quantiles, each once, of a bounded random sample; n is the number of shuffle partitions by default."""
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = rows.select(F.col(key).alias("k")).filter("k IS NOT NULL").orderBy(F.rand(7)).limit(n * DRAWN).collect()
    keys = sorted(bytes(r["k"]) if isinstance(r["k"], bytearray) else r["k"] for r in drawn)
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def _literal(x) -> Column:
    return F.lit(bytearray(x) if isinstance(x, bytes) else x)


def number(key: Column, cuts: list) -> Column:
    """How many splitters are at or before key; a null key is in range 0. Two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    width = isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def upto(array: Column) -> Column:
        return F.size(F.filter(array, lambda s: s <= key))

    heads = upto(F.array(*(_literal(b[0]) for b in blocks)))
    inner = F.array(*(F.array(*(_literal(x) for x in b)) for b in blocks))
    return F.when(heads == 0, 0).otherwise((heads - 1) * width + upto(F.element_at(inner, F.greatest(heads, F.lit(1)))))
