"""Histories that are too long for one task: windows over blocks of times, and medians from histograms.

A window over an address's history is a task's work for one address.  ``in_blocks`` cuts histories into blocks of
times; a row also goes to the blocks after its own that look back as far as the row, as their halo, so the
blocks of one address run in different tasks and every finite frame still sees its rows.  What needs the whole
history, the median by address and the running total, is put together from sums by block or by histogram bucket,
which tasks combine before anything is shuffled.

Panels are dense: every address has every time of ``index`` (time, t).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ROW, TS

#: Times in a block; shorter histories are one block.
BLOCK = 8192
_FRAME = re.compile(r"ROWS BETWEEN (\d+) PRECEDING|\blag\(\w+, (\d+)|\blag\((\w+)\)")
_TOTAL = re.compile(r"^sum\((\w+)\) OVER \(PARTITION BY address ORDER BY time ROWS UNBOUNDED PRECEDING\)$")
_MEDIAN = re.compile(r"^MEDIAN_OF\((\w+), address\)$")
_WHOLE = re.compile(r"PARTITION BY address\)|UNBOUNDED FOLLOWING|PARTITION BY address ORDER BY (?!time\b)")
#: Buckets of the first pass to a doubling of the value, and of the second pass.
FINE, EQUAL = 16, 1024


def frame(expression: str) -> int:
    """How many rows an expression looks back."""
    return max((int(a or b or 1) for a, b, _ in _FRAME.findall(expression)), default=0)


def reach(layers: list[dict[str, str]]) -> int:
    """How many rows layers look back, one after another."""
    return sum(max((frame(x) for x in layer.values()), default=0) for layer in layers)


def blocked(expression: str) -> str:
    """The expression inside a block, on rows with their time's number ``__t`` and their block ``__block``."""
    if _WHOLE.search(expression):
        raise ValueError(f"no block can give {expression}")
    return expression.replace(ROW, "(__t + 1)").replace(TS, "PARTITION BY address, __block ORDER BY time").replace("PARTITION BY time", "PARTITION BY time, __block")


def in_blocks(df: DataFrame, layers: list[dict[str, str]], times: int, block: int) -> DataFrame:
    """``df`` (with ``__t``) and the columns of ``layers``, in Spark's text, every window of which stays inside a block."""
    if not any(layers):
        return df
    halo, last = reach(layers), -(-times // block) - 1
    own = F.floor(F.col("__t") / block).cast("int")
    until = F.least(F.floor((F.col("__t") + halo) / block).cast("int"), F.lit(last))
    out = df.withColumn("__block", F.explode(F.sequence(own, F.greatest(own, until))))
    for layer in layers:
        out = out.withColumns({c: F.expr(blocked(x)) for c, x in layer.items()})
    return out.where(F.col("__block") == own).drop("__block")


def totals(df: DataFrame, columns: dict[str, str], block: int) -> DataFrame:
    """Running totals over an address's history: inside blocks of times, plus the sums of the blocks before."""
    rows = df.withColumn("__block", F.floor(F.col("__t") / block).cast("int"))
    by = rows.groupBy("address", "__block").agg(*[F.sum(x).alias(f"{c}__before") for c, x in columns.items()])
    before = Window.partitionBy("address").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    by = by.select("address", "__block", *[F.coalesce(F.sum(f"{c}__before").over(before), F.lit(0.0)).alias(f"{c}__before") for c in columns])
    inside = Window.partitionBy("address", "__block").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.sum(x).over(inside) for c, x in columns.items()}).join(by, ["address", "__block"])
    return rows.withColumns({c: F.col(c) + F.col(f"{c}__before") for c in columns}).drop("__block", *[f"{c}__before" for c in columns])


def medians(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(address, one column for each of ``columns``): lower medians of the columns that they name, nulls aside.

    Two passes narrow the place of the median down: buckets by order of magnitude, then equal parts of the bucket that
    holds it.  The last pass counts the distinct values of one such part.  All columns go together; each pass shuffles a
    row for each address, column and bucket.
    """
    entries = [F.struct(F.lit(c).alias("c"), (F.col(x).cast("double") + F.lit(0.0)).alias("x")) for c, x in columns.items()]
    long = df.select("address", F.explode(F.array(*entries)).alias("e")).select("address", "e.c", "e.x").where("x IS NOT NULL")
    key = ["address", "c"]

    def narrowed(counts: DataFrame, order: str) -> DataFrame:
        """The bucket that holds the wanted place, and the place in it."""
        so_far = F.sum("n").over(Window.partitionBy(*key).orderBy(order))
        found = counts.withColumn("_end", so_far).where((F.col("_end") >= F.col("place")) & (F.col("_end") - F.col("n") < F.col("place")))
        return found.withColumn("place", F.col("place") - F.col("_end") + F.col("n")).drop("_end", "n")

    size = F.floor(F.log2(F.abs("x")) * FINE)
    rough = F.when(F.col("x") == 0, 0).when(F.isnan("x"), 1 << 20).when(F.col("x") > 0, 40000 + size).otherwise(-40000 - size).cast("long")
    first = long.groupBy(*key, rough.alias("rough")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    first = first.withColumn("place", F.ceil(F.sum("n").over(Window.partitionBy(*key)) / 2))
    one = narrowed(first, "rough")
    inside = long.withColumn("rough", rough).join(one, [*key, "rough"])
    part = F.when(F.col("high") == F.col("low"), 0).otherwise(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * EQUAL)).cast("int")
    second = inside.withColumn("part", F.coalesce(part, F.lit(0))).groupBy(*key, "rough", "part", "place", "low", "high").agg(F.count(F.lit(1)).alias("n"))
    two = narrowed(second, "part").select(*key, "rough", "part", "place")
    values = inside.drop("place").withColumn("part", F.coalesce(part, F.lit(0))).join(two, [*key, "rough", "part"])
    third = narrowed(values.groupBy(*key, "place", "x").agg(F.count(F.lit(1)).alias("n")), "x")
    return third.groupBy("address").agg(*[F.max(F.when(F.col("c") == c, F.col("x"))).alias(c) for c in columns])


def layered(df: DataFrame, layers: list[dict[str, str]], times: int, block: int, text) -> DataFrame:
    """The columns of ``layers`` (``text`` turns an expression into Spark's), whatever of them needs the whole history apart."""
    out, waiting = df, []
    for layer in layers:
        middle = {c: m[1] for c, x in layer.items() if (m := _MEDIAN.match(x))}
        running = {c: m[1] for c, x in layer.items() if (m := _TOTAL.match(x))}
        if middle or running:
            out, waiting = in_blocks(out, waiting, times, block), []
        if running:
            out = totals(out, running, block)
        if middle:
            out = out.join(medians(out, middle), "address", "left")
        waiting.append({c: text(x) for c, x in layer.items() if c not in middle and c not in running})
    return in_blocks(out, waiting, times, block)
