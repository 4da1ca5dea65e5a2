"""Exact order statistics on the native type: radix selection, one level per scan.

Integers beyond 2^53 and decimals of 38 digits keep every digit.  A number is seen as a whole
number that keeps its order: units of the last place, or the ordered bits of a double.  A
target (column, rank) starts with the interval from minimum to maximum.  Each level cuts the
intervals of all targets into ``BUCKETS`` equal parts, counts the rows of each part in one scan
over all columns, and goes on with the part that holds the rank.  Cuts are compared in the type
of the column, so nothing overflows or rounds, and rows outside the intervals are filtered at
the scan.  Once ``FEW`` rows are left in an interval they are counted value by value.

A level hands at most BUCKETS counts per target to the driver, the last scan at most FEW
values, whatever the size or skew of the table; no value is shuffled before.  There are at most
13 levels for 64 bits, and about log32(rows / FEW) for values that are evenly spread.

NULLs take no part, NaN is the greatest double, -0.0 and 0.0 are one value, a column without a
value has n = 0 and NULLs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.functions.columns import col
from proofmark.workspace import columnar, local_table

BUCKETS = 32
FEW = 4_096
_WIDE = Context(prec=80)
_LOWEST = -(1 << 63)


class _Scale:
    """Values of a numeric type, given as text, as whole numbers in the same order."""

    def __init__(self, kind: T.DataType):
        self.binary = isinstance(kind, (T.FloatType, T.DoubleType))
        self.type = "double" if self.binary else kind.simpleString()
        self.places = kind.scale if isinstance(kind, T.DecimalType) else 0

    def number(self, text: str) -> int:
        if not self.binary:
            return int(Decimal(text).scaleb(self.places, _WIDE))
        (bits,) = struct.unpack(">q", struct.pack(">d", float(text) + 0.0))
        return bits if bits >= 0 else _LOWEST - bits - 1

    def text(self, number: int) -> str:
        if not self.binary:
            return format(Decimal(number).scaleb(-self.places, _WIDE), "f")
        bits = number if number >= 0 else _LOWEST - number - 1
        return repr(struct.unpack(">d", struct.pack(">q", bits))[0])

    def literal(self, number: int) -> str:
        return f"CAST('{self.text(number)}' AS {self.type})"

    def middle(self, low: int, high: int) -> str:
        """The mean of two values; exact unless binary."""
        if self.binary:
            a, b = float(self.text(low)), float(self.text(high))
            return repr(a if low == high else a / 2 + b / 2)
        twice = Decimal(low + high).scaleb(-self.places, _WIDE)
        half = _WIDE.divide(twice, Decimal(2))
        return format(half if (low + high) % 2 else Decimal(self.text((low + high) // 2)), "f")


@dataclass
class _Target:
    """The row of ``rank`` (from 0) among the ``rows`` rows of a column between two numbers."""

    value: str
    scale: _Scale
    rank: int
    rows: int
    low: int
    high: int

    def inside(self) -> str:
        low, high = self.scale.literal(self.low), self.scale.literal(self.high)
        return f"{self.value} BETWEEN {low} AND {high}"

    def edges(self) -> list[int]:
        """The first number of every part."""
        width = self.high - self.low + 1
        return sorted({self.low + width * i // BUCKETS for i in range(BUCKETS)})

    def part(self) -> str:
        edges = self.edges()

        def tree(first: int, last: int) -> str:
            if first == last:
                return str(first)
            middle = (first + last + 1) // 2
            above = f"{self.value} >= {self.scale.literal(edges[middle])}"
            return f"IF({above}, {tree(middle, last)}, {tree(first, middle - 1)})"

        return tree(0, len(edges) - 1)

    def narrow(self, counts: dict[int, int]) -> None:
        ends = [e - 1 for e in self.edges()[1:]] + [self.high]
        for part, (low, high) in enumerate(zip(self.edges(), ends)):
            rows = counts.get(part, 0)
            if self.rank < rows:
                self.low, self.high, self.rows = low, high, rows
                return
            self.rank -= rows
        raise RuntimeError("the table changed between two scans")


def _counted(df: DataFrame, targets: Sequence[_Target], key: Callable[[_Target], str]) -> list[dict]:
    """Rows per key of each target, in one scan; targets with one interval are counted once."""
    places = list(dict.fromkeys(t.inside() for t in targets))
    keys = {t.inside(): key(t) for t in targets}
    items = [
        F.when(F.expr(near), F.expr(f"named_struct('place', {i}, 'key', {keys[near]})"))
        for i, near in enumerate(places)
    ]
    found = (
        df.where(" OR ".join(places))
        .select(F.inline(F.array_compact(F.array(*items))))
        .groupBy("place", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts: list[dict] = [{} for _ in places]
    for place, label, n in found.collect():
        counts[place][label] = n
    return [counts[places.index(t.inside())] for t in targets]


def select_ranks(df: DataFrame, targets: Sequence[_Target]) -> None:
    """Narrow every target to its value."""
    while wide := [t for t in targets if t.low < t.high and t.rows > FEW]:
        for target, counts in zip(wide, _counted(df, wide, _Target.part)):
            target.narrow(counts)
    if few := [t for t in targets if t.low < t.high]:
        values = _counted(df, few, lambda t: f"CAST({t.value} AS string)")
        for target, counts in zip(few, values):
            numbers: dict[int, int] = {}
            for text, n in counts.items():
                number = target.scale.number(text)
                numbers[number] = numbers.get(number, 0) + n
            for number in sorted(numbers):
                if target.rank < numbers[number]:
                    target.low = target.high = number
                    break
                target.rank -= numbers[number]


def exact_numbers(df: DataFrame) -> DataFrame:
    """(column, n, min, max, lower_median, upper_median, median) of all numeric columns, as
    text with every digit; the two medians differ where n is even."""
    df = columnar(df)
    fields = [f for f in df.schema if isinstance(f.dataType, T.NumericType)]
    scales = [_Scale(f.dataType) for f in fields]
    names = [f"_v{i}" for i in range(len(fields))]
    values = [F.col(c) for c in names]
    df = df.select(*[col(f.name).cast(s.type).alias(c) for f, s, c in zip(fields, scales, names)])
    rows = []
    if fields:
        first = df.agg(
            *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
            *[F.min(v).cast("string").alias(f"a{i}") for i, v in enumerate(values)],
            *[F.max(v).cast("string").alias(f"b{i}") for i, v in enumerate(values)],
        ).first()
        targets: dict[tuple[int, int], _Target] = {}
        for i, (value, scale) in enumerate(zip(names, scales)):
            n = first[f"n{i}"]
            for rank in {(n - 1) // 2, n // 2} if n else ():
                low, high = scale.number(first[f"a{i}"]), scale.number(first[f"b{i}"])
                targets[i, rank] = _Target(value, scale, rank, n, low, high)
        select_ranks(df, list(targets.values()))
        for i, (field, scale) in enumerate(zip(fields, scales)):
            n = first[f"n{i}"]
            if not n:
                rows.append((field.name, 0, *[None] * 5))
                continue
            below, above = targets[i, (n - 1) // 2].low, targets[i, n // 2].low
            ends = [scale.text(scale.number(first[f"{side}{i}"])) for side in "ab"]
            middle = scale.middle(below, above)
            rows.append((field.name, n, *ends, scale.text(below), scale.text(above), middle))
    kinds = {"column": pa.string(), "n": pa.int64()}
    heads = [*kinds, "min", "max", "lower_median", "upper_median", "median"]
    lists = list(zip(*rows)) or [()] * len(heads)
    return local_table(
        df.sparkSession,
        {name: (kinds.get(name, pa.string()), list(v)) for name, v in zip(heads, lists)},
    )
