"""Merge operators: what operands written after a key's base add up to.

A key's base is its newest put or deletion; its operands are the merges after that, in the order of seq. The key is live if
the base is a put or there is an operand. Without an operator a merge is a put.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, MERGE, PUT
from .resolve import KEY, as_of, latest_wins


#: Operands of a custom operator that one call of partial_merge joins before their key's rows meet.
OPERANDS = 10_000


class MergeOperator(ABC):
    """One's own operator. full_merge folds operands into a base; partial_merge joins operands without one, or gives None.

    Where partial_merge is defined, a key's operands are joined in stretches of seq first, so that a key with very many of them
    is spread over tasks; what it gives takes the place of the operands in full_merge.
    """

    name = "custom"

    @abstractmethod
    def full_merge(self, key: str | bytes, base: str | bytes | None, operands: list) -> str | bytes | None: ...

    def partial_merge(self, key: str | bytes, operands: list) -> str | bytes | None:
        return None


class ExpressionMerge(ABC):
    """An operator that is an aggregate expression; it stays in the JVM, and tasks pre-aggregate if the expression can."""

    name = "expression"

    @abstractmethod
    def full(self) -> Column:
        """Aggregate of rows (seq, op, value) of a key: its base, if that is a put, and its operands."""

    @abstractmethod
    def partial(self) -> Column:
        """Aggregate of operands alone; null if they can't be joined."""


def _integer(value: Column) -> Column:
    """The decimal integer that a text is, [+-]?[0-9]+ within 64 bits, or null."""
    text = value.cast("string")
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


class CounterMerge(ExpressionMerge):
    """Sums; what isn't an integer counts as 0 in a base and is left out among operands."""

    name = "counter"

    def full(self) -> Column:
        return F.coalesce(F.sum(_integer(F.col("value"))), F.lit(0)).cast("string")

    def partial(self) -> Column:
        n = _integer(F.col("value"))
        return F.when(F.bool_and(n.isNotNull()), F.sum(n).cast("string"))


class StringAppendMerge(ExpressionMerge):
    """Joins texts with a delimiter in the order of seq; an empty or absent base takes none before the first operand."""

    name = "append"

    def __init__(self, delimiter: str = ","):
        self.delimiter = delimiter

    def _joined(self, rows: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(rows), lambda r: r["v"]), self.delimiter)

    def full(self) -> Column:
        row = F.struct("seq", F.make_valid_utf8(F.col("value").cast("binary").cast("string")).alias("v"))
        operands = F.collect_list(F.when(F.col("op") == MERGE, row))
        base = F.max(F.when(F.col("op") != MERGE, F.make_valid_utf8(F.col("value").cast("binary").cast("string"))))
        joined = self._joined(operands)
        none = F.size(operands) == 0
        return F.when(none, base).when(F.coalesce(base, F.lit("")) == "", joined).otherwise(F.concat(base, F.lit(self.delimiter), joined))

    def partial(self) -> Column:
        row = F.struct("seq", F.make_valid_utf8(F.col("value").cast("binary").cast("string")).alias("v"))
        return F.when(F.count("*") > 0, self._joined(F.collect_list(row)))


def since_base(log: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Of each key the rows that count: its base, if that is a put, and its operands.

    Bases are an aggregate that tasks begin on their own rows, joined back: a key with very many versions makes a skewed
    join, which AQE splits, and no window of one task.
    """
    base = log.filter(F.col("op") != MERGE).groupBy(*key).agg(F.max("seq").alias("_base"))
    found = log.join(base, list(key), "left").filter(F.col("seq") >= F.coalesce("_base", F.lit(-1)))
    return found.filter(F.col("op") != DELETE).select(*log.columns)


def fold(
    log: DataFrame, operator: MergeOperator | ExpressionMerge | None = None, *, snapshot: int | Column | None = None, key: Sequence[str] = KEY
) -> DataFrame:
    """Live keys: key columns, seq of the newest version, value. The join with bases and the aggregate share the log's shuffle."""
    if operator is None:
        return latest_wins(log, snapshot=snapshot, key=key).select(*key, "seq", "value")
    rows = since_base(as_of(log, snapshot), key)
    kind = log.schema["value"].dataType
    if isinstance(operator, ExpressionMerge):
        # A key that was only put keeps its value as it is.
        folded = rows.groupBy(*key).agg(F.max("seq").alias("seq"), operator.full().alias("_full"), F.bool_or(F.col("op") == MERGE).alias("_any"), F.max(F.when(F.col("op") == PUT, F.col("value"))).alias("_base"))
        return folded.select(*key, "seq", F.when(F.col("_any"), F.col("_full").cast(kind)).otherwise(F.col("_base")).alias("value"))
    schema = ", ".join([*(f"{k} {log.schema[k].dataType.simpleString()}" for k in key), "seq bigint", f"value {kind.simpleString()}"])

    def custom(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        base = pdf.loc[pdf["op"] == PUT, "value"]
        operands = pdf.loc[pdf["op"] == MERGE, "value"].tolist()
        first = base.iloc[-1] if len(base) else None
        value = operator.full_merge(keys[-1], first, operands) if operands else first
        return pd.DataFrame([[*keys, int(pdf["seq"].iloc[-1]), value]], columns=[*key, "seq", "value"])

    return _joined_stretches(rows, operator, key).groupBy(*key).applyInPandas(custom, schema)


def _joined_stretches(rows: DataFrame, operator: MergeOperator, key: Sequence[str]) -> DataFrame:
    """rows whose operands partial_merge has joined by stretches of OPERANDS seqs; a stretch it gives None for stays as it is."""
    if type(operator).partial_merge is MergeOperator.partial_merge:
        return rows
    names = [*key, "seq", "op", "value"]

    def join(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if keys[-1] is None or len(pdf) < 2:
            return pdf[names]
        pdf = pdf.sort_values("seq")
        value = operator.partial_merge(keys[-2], pdf["value"].tolist())
        return pdf[names] if value is None else pdf[names].iloc[-1:].assign(value=[value])

    stretch = F.when(F.col("op") == MERGE, F.expr(f"seq div {OPERANDS}"))
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, stretch.alias("_stretch")).groupBy(*key, "_stretch").applyInPandas(join, schema)


def partial_fold(log: DataFrame, operator: ExpressionMerge | MergeOperator, *, key: Sequence[str] = KEY) -> DataFrame:
    """Operands of each key joined without their base: key columns, n operands, value (null if they can't be joined)."""
    operands = log.filter(F.col("op") == MERGE)
    if isinstance(operator, ExpressionMerge):
        return operands.groupBy(*key).agg(F.count("*").alias("n"), operator.partial().alias("value"))
    schema = ", ".join([*(f"{k} {log.schema[k].dataType.simpleString()}" for k in key), "n bigint", f"value {log.schema['value'].dataType.simpleString()}"])

    def joined(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*keys, len(pdf), operator.partial_merge(keys[-1], pdf.sort_values("seq")["value"].tolist())]], columns=[*key, "n", "value"])

    return operands.select(*key, "seq", "value").groupBy(*key).applyInPandas(joined, schema)
