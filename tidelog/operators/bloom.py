"""A Bloom filter with fixed hash and probe rules, as expressions over the bytes of keys.

k = clamp(floor(0.69 x bits per key), 1, 30); bits = max(64, keys x bits per key), rounded up to bytes. The hash starts from
SEED and for each byte is h x FACTOR + byte in 32 bits; probe i is h + i x rotl(h, 15) in 32 bits, modulo bits.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SEED, FACTOR = 0xBC9F1D34, 0x9E3779B9
WORD = 1 << 32


def n_probes(bits_per_key: int) -> int:
    return max(1, min(30, int(bits_per_key * 0.69)))


def n_bits(keys: int, bits_per_key: int) -> int:
    return -(-max(64, keys * bits_per_key) // 8) * 8


def bloom_hash(key: Column) -> Column:
    """32-bit hash of a key's bytes, as a long. The product is taken in halves, which stays within 64 bits."""
    raw = F.hex(key.cast("binary"))
    n = F.shiftright(F.length(raw), 1)
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    bytes_ = F.when(F.length(raw) > 0, bytes_).otherwise(F.array().cast("array<bigint>"))
    high, low = FACTOR >> 16, FACTOR & 0xFFFF

    def step(h: Column, b: Column) -> Column:
        return (h * low + (h * high) % (1 << 16) * (1 << 16) + b) % WORD

    return F.aggregate(bytes_, F.lit(SEED).cast("bigint"), step)


def positions(h: Column, bits: int | Column, probes: int) -> Column:
    """The bits of a key with hash h, a column of its own so that it is computed once, as an array of longs."""
    delta = (h * (1 << 15)) % WORD + F.shiftright(h, 17)
    return F.array(*((h + i * delta) % WORD % bits for i in range(probes)))


def create(keys: DataFrame, bits_per_key: int, key: str = "user_key", n: int | None = None) -> DataFrame:
    """The set bits of a filter over distinct keys: bit. Duplicates are dropped by each task first."""
    distinct = keys.select(key).distinct()
    bits = n_bits(distinct.count() if n is None else n, bits_per_key)
    hashed = distinct.select(bloom_hash(F.col(key)).alias("_h"))
    return hashed.select(F.explode(positions(F.col("_h"), bits, n_probes(bits_per_key))).alias("bit")).distinct()


def packed(bits: DataFrame, n: int) -> bytes:
    """Filter bytes, the last being k's place left 0; for filters whose size is a chosen parameter."""
    out = bytearray(n // 8)
    for row in bits.groupBy(F.expr("bit div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 AS INT))")).alias("x")).collect():
        out[row["at"]] = row["x"]
    return bytes(out)


def probe(keys: DataFrame, filter_bits: DataFrame, bits: int, probes: int, key: str = "user_key") -> DataFrame:
    """keys with may_contain: all of a key's bits are set. An empty filter contains nothing. A join on bits, no pairs of keys."""
    hashed = keys.select(key).distinct().withColumn("_h", bloom_hash(F.col(key)))
    want = hashed.withColumn("_bits", F.array_distinct(positions(F.col("_h"), bits, probes)))
    hit = want.select(F.col(key), F.explode("_bits").alias("bit"), F.size("_bits").alias("_need")).join(filter_bits, "bit")
    full = hit.groupBy(key).agg(F.count("*").alias("_n"), F.first("_need").alias("_need")).select(F.col(key), (F.col("_n") == F.col("_need")).alias("may_contain"))
    return keys.join(full, key, "left").withColumn("may_contain", F.coalesce("may_contain", F.lit(False)))


class FilterPolicy(ABC):
    """How a store's runs tell which keys they can't hold. A policy of one's own gives the writer's options for a key column."""

    @abstractmethod
    def writer_options(self, column: str) -> dict[str, str]:
        """Options of the Parquet writer; readers find what they put into the files by themselves."""


class NoFilter(FilterPolicy):
    """Only the least and greatest key of files and row groups."""

    def writer_options(self, column: str) -> dict[str, str]:
        return {}


class BloomPolicy(FilterPolicy):
    """Parquet's Bloom filter on the key, as large as the keys of a file need for the false positives of so many bits a key."""

    def __init__(self, bits_per_key: int = 10):
        if bits_per_key < 1:
            raise ValueError("bits_per_key must be 1 or more")
        self.bits_per_key = bits_per_key

    def writer_options(self, column: str) -> dict[str, str]:
        probes = n_probes(self.bits_per_key)
        fpp = (1 - 2.718281828459045 ** (-probes / self.bits_per_key)) ** probes
        return {
            f"parquet.bloom.filter.enabled#{column}": "true",
            f"parquet.bloom.filter.fpp#{column}": f"{min(0.5, max(1e-6, fpp)):.6f}",
            "parquet.bloom.filter.adaptive.enabled": "true",
        }
