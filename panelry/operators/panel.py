"""Panel construction: main contracts, resampling, densifying, targets and splits."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_address():
    """A window over an address's history."""
    return Window.partitionBy("address").orderBy("time")


def so_far():
    """The same, up to the current row."""
    return by_address().rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Profile:
    """Costs and scales of a market: fees, least liquidity, trade size, bars a year and a day, return clip."""

    base_fee: float = 0.0003
    min_liquidity: float = 1000.0
    trade_size: float = 10000.0
    bars_per_year: float = 252.0
    bars_per_day: int = 1
    ret_clamp: float = 0.2

    @property
    def target_turnover(self) -> float:
        """Turnover a bar under which a run counts as lazy."""
        return 0.05 / self.bars_per_day

    @property
    def lazy_turnover(self) -> float:
        """Turnover a bar under which the full penalty falls due."""
        return 0.01 / self.bars_per_day


def densify(panel: DataFrame, columns: Iterable[str], times: DataFrame | None = None) -> DataFrame:
    """Every address at every time; gaps take the last value before them, or zero.

    A row stands for the times from its own up to the next of its address, and the first one for those before it as well,
    where all is zero.  So rows are filled in and spread out where they are, by address, and nothing is joined to the
    grid.  ``times`` has the times where they are known more cheaply than from the panel.
    """
    columns = list(columns)
    index = time_index(panel if times is None else times)
    at = index.select(F.col("time").alias("_at"), "t")
    rows = panel.select("address", "time", *columns).join(F.broadcast(at), F.col("time").eqNullSafe(F.col("_at"))).drop("_at")  # a row a time
    rows = rows.select("address", "t", F.lead("t").over(by_address()).alias("_next"), F.lag("t").over(by_address()).alias("_before"), *[F.coalesce(F.last(F.when(F.col("time").isNotNull(), F.col(c)), ignorenulls=True).over(so_far()), F.lit(0.0)).alias(c) for c in columns])
    last = index.agg(F.max("t").alias("_last"))  # one row
    rows = rows.crossJoin(F.broadcast(last))
    start, end = F.when(F.col("_before").isNull(), 0).otherwise(F.col("t")), F.coalesce(F.col("_next") - 1, F.col("_last"))
    rows = rows.withColumn("_t", F.explode(F.sequence(start, end)))
    spread = rows.select("address", "_t", *[F.when(F.col("_t") >= F.col("t"), F.col(c)).otherwise(0.0).alias(c) for c in columns])
    return spread.join(F.broadcast(index.withColumnRenamed("t", "_t")), "_t").select("address", "time", *columns)  # a row a time


def with_day(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("day", F.to_date("datetime"))


def contract_interest(ticks: DataFrame) -> DataFrame:
    """Mean open interest and last price of each contract and day."""
    return with_day(ticks).groupBy("product_id", "exchange", "symbol", "day").agg(F.avg("close_oi").alias("avg_oi"), F.max_by("close", "datetime").alias("last_close"))


def main_contract(ticks: DataFrame) -> DataFrame:
    """The contract of each product and day with the highest mean open interest (ties: smaller symbol)."""
    best = Window.partitionBy("product_id", "exchange", "day").orderBy(F.desc("avg_oi"), "symbol")
    return contract_interest(ticks).withColumn("place", F.row_number().over(best)).where("place = 1").select("product_id", "exchange", "day", "symbol", "avg_oi")


def main_ticks(ticks: DataFrame) -> DataFrame:
    """The ticks of main contracts, with their day and address."""
    chosen = main_contract(ticks).select("product_id", "exchange", "day", "symbol")
    return with_day(ticks).join(chosen, ["product_id", "exchange", "day", "symbol"], "left_semi").withColumn("address", F.concat_ws(".", "product_id", "exchange"))


def secondary_contracts(ticks: DataFrame) -> DataFrame:
    """The two contracts with most open interest, by day: F1_close, F2_close and symbols; days with both only."""
    best = Window.partitionBy("product_id", "exchange", "day").orderBy(F.desc("avg_oi"), "symbol")
    top = contract_interest(ticks).withColumn("place", F.row_number().over(best)).where("place <= 2")
    one = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    wide = top.groupBy(F.concat_ws(".", "product_id", "exchange").alias("address"), F.col("day").alias("time")).agg(
        one("last_close", 1).alias("F1_close"), one("last_close", 2).alias("F2_close"), one("symbol", 1).alias("F1_symbol"), one("symbol", 2).alias("F2_symbol")
    )
    return wide.where("F1_close IS NOT NULL AND F2_close IS NOT NULL")


def expiry_features(pairs: DataFrame) -> DataFrame:
    """Days to the 15th of each contract's month (from the trailing yymm), and the gap between the two, at least 1."""

    def expiry(symbol: str):
        code = F.regexp_extract(symbol, r"(\d{4})$", 1)
        return F.make_date((2000 + F.substring(code, 1, 2).cast("int")), F.substring(code, 3, 2).cast("int"), F.lit(15))

    days = lambda s: F.greatest(F.datediff(expiry(s), "time"), F.lit(1))
    gap = F.greatest(F.abs(F.datediff(expiry("F2_symbol"), expiry("F1_symbol"))), F.lit(1))
    return pairs.withColumns({"days_to_expiry": days("F1_symbol"), "expiry_gap": gap})


def resample(ticks: DataFrame, minutes: int) -> DataFrame:
    """Bars of ``minutes`` minutes by address; one minute is a projection."""
    if minutes == 1:
        return ticks.select("address", F.col("datetime").alias("time"), "open", "high", "low", "close", "volume", (F.col("volume") * F.col("close")).alias("liquidity"), F.lit(0.0).alias("fdv"))
    bars = ticks.groupBy("address", F.window("datetime", f"{minutes} minutes").getField("start").alias("time")).agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume")
    )
    return bars.withColumns({"liquidity": F.col("volume") * F.col("close"), "fdv": F.lit(0.0)})


def limit_by_row_count(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` addresses that have most rows (ties: smaller address)."""
    top = panel.groupBy("address").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "address").limit(n)
    return panel.join(F.broadcast(top.select("address")), "address", "left_semi")  # n rows


def target_return(panel: DataFrame, clamp: float = 0.2) -> DataFrame:
    """Return to the next bar, 0 for the last, clipped."""
    raw = (F.lead("close").over(by_address()) - F.col("close")) / (F.col("close") + F.lit(1e-9))
    return panel.withColumn("target_ret", F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.coalesce(raw, F.lit(0.0)))))


def rebalance_mask(panel: DataFrame, unit: str = "day", times: DataFrame | None = None) -> DataFrame:
    """True at the first bar of each trading date (or month, ...); the panel stays where it is if ``times`` has its times."""
    if times is None:
        return panel.withColumn("is_rebalance", F.col("time") == F.min("time").over(Window.partitionBy(F.date_trunc(unit, "time"))))
    first = times.groupBy(F.date_trunc(unit, "time")).agg(F.min("time").alias("time")).select("time", F.lit(True).alias("is_rebalance"))
    return panel.join(F.broadcast(first), "time", "left").fillna(False, ["is_rebalance"])  # a row a unit


def time_index(panel: DataFrame) -> DataFrame:
    """(time, t): the distinct times numbered from 0 (one row per time)."""
    return panel.select("time").distinct().withColumn("t", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("time")) - 1)


def train_test_split(panel: DataFrame, ratio: float) -> DataFrame:
    """Adds ``split``: the first ``int(T * ratio)`` times are train, the rest test."""
    index = time_index(panel)
    count = index.agg(F.count(F.lit(1)).alias("n"))
    index = index.crossJoin(count)  # one row
    return panel.join(index, "time").withColumn("split", F.when(F.col("t") < F.floor(F.col("n") * F.lit(ratio)), "train").otherwise("test")).drop("t", "n")


def simple_returns(panel: DataFrame) -> DataFrame:
    """Bar return clipped to 0.2; 0 at the first bar."""
    before = F.lag("close").over(by_address())
    raw = (F.col("close") - before) / (F.abs(before) + F.lit(1e-10))
    return panel.withColumn("ret", F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.coalesce(raw, F.lit(0.0)))))


def open_to_open_return(panel: DataFrame) -> DataFrame:
    """Return from the next open to the one after; the last two bars have 0."""
    one, two = F.lead("open", 1).over(by_address()), F.lead("open", 2).over(by_address())
    return panel.withColumn("oto_ret", F.coalesce((two - one) / (one + F.lit(1e-6)), F.lit(0.0)))


def inv_lunar_yoy(values: DataFrame, calendar: DataFrame, years: int = 2, near: int = 3) -> DataFrame:
    """(address, time, inv_lunar_yoy): a value against the mean of the same lunar day of the last ``years`` lunar years.

    ``values`` is (address, time, value), ``calendar`` (time, lunar_year, lunar_month, lunar_day).  Without any such
    value the days one, two, and up to ``near`` away in the same lunar month are tried, nearest first.  Only
    positive values count; of several on one lunar day the last.  Each row looks its days up by key, so
    nothing is paired but what is compared.
    """
    dated = values.join(calendar, "time").where("value > 0")
    past = dated.groupBy("address", F.col("lunar_year").alias("y"), F.col("lunar_month").alias("m"), F.col("lunar_day").alias("d")).agg(F.max_by("value", "time").alias("before"))
    keys = dated.withColumn("y", F.explode(F.sequence(F.col("lunar_year") - years, F.col("lunar_year") - 1))).withColumn("off", F.explode(F.sequence(F.lit(-near), F.lit(near))))
    keys = keys.select("address", "time", "value", "y", F.col("lunar_month").alias("m"), (F.col("lunar_day") + F.col("off")).alias("d"), F.abs("off").alias("away")).where("d BETWEEN 1 AND 30")
    by = keys.join(past, ["address", "y", "m", "d"]).groupBy("address", "time", "away").agg(F.max("value").alias("value"), F.avg("before").alias("mean"))
    best = by.groupBy("address", "time").agg(F.min_by(F.struct("value", "mean"), "away").alias("x"))
    return best.select("address", "time", (F.col("x.value") / F.col("x.mean") - 1).alias("inv_lunar_yoy"))
