"""Sources and sinks: selection, incremental appends, upserts, caches, and the tables behind them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a local session without one gets a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for plans that read it several times; its shuffle files go once it is written."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def read_ticks(spark: SparkSession, path: str, **where) -> DataFrame:
    """Ticks from a Parquet folder partitioned by ``day``; the filters reach the scan."""
    return select_ticks(spark.read.parquet(path), **where)


def select_ticks(ticks: DataFrame, products: Iterable[str] | None = None, exchanges: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Ticks of some products and exchanges, from ``start`` up to but not at ``end``."""
    if products is not None:
        ticks = ticks.where(F.col("product_id").isin(list(products)))
    if exchanges is not None:
        ticks = ticks.where(F.col("exchange").isin(list(exchanges)))
    for bound, op in ((start, ">="), (end, "<")):
        if bound:
            limit = F.lit(bound).cast("timestamp")
            ticks = ticks.where(F.col("datetime") >= limit if op == ">=" else F.col("datetime") < limit)
            if "day" in ticks.columns:  # prunes partitions
                ticks = ticks.where(F.col("day") >= F.to_date(limit) if op == ">=" else F.col("day") <= F.to_date(limit))
    return ticks


def read_bars(spark: SparkSession, path: str, timeframe: str, known: DataFrame | None = None) -> DataFrame:
    """Bars of one timeframe (a partition), of known addresses if given."""
    bars = spark.read.parquet(path).where(F.col("timeframe") == timeframe)
    return bars_of_known(bars, known) if known is not None else bars


def read_bars_jdbc(spark: SparkSession, url: str, table: str, timeframe: str, **options: str) -> DataFrame:
    """Bars from a database; the timeframe filter is pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(F.col("timeframe") == timeframe)


def bars_of_known(bars: DataFrame, known: DataFrame) -> DataFrame:
    return bars.join(known.select("address").distinct(), "address", "left_semi")


def join_caches(panel: DataFrame, caches: dict[str, DataFrame]) -> DataFrame:
    """Adds each cache's value by (address, time), filled forward, then zero."""
    past = Window.partitionBy("address").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    for name, cache in caches.items():
        panel = panel.join(cache.select("address", "time", F.col("value").alias(name)), ["address", "time"], "left")
    return panel.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(past), F.lit(0.0)) for n in caches})


def list_products(ticks: DataFrame, limit: int) -> DataFrame:
    return ticks.groupBy("product_id", "exchange").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "product_id").limit(limit)


def append_ticks(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Append the rows that are later than what the folder holds, partitioned by day."""
    try:
        last = spark.read.parquet(path).agg(F.max("datetime").alias("m")).first()["m"]
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        last = None
    if last is not None:
        new = new.where(F.col("datetime") > F.lit(last))
    new.withColumn("day", F.to_date("datetime")).write.mode("append").partitionBy("day").parquet(path)


def upsert_instruments(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows, old rows, and where both exist the old one with the new symbol and last_updated."""
    o, n = old.alias("o"), new.alias("n")
    fresh = ("symbol", "last_updated")
    rest = [c for c in old.columns if c not in ("address", *fresh)]
    joined = o.join(n, F.col("o.address") == F.col("n.address"), "full")
    return joined.select(F.coalesce("n.address", "o.address").alias("address"), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fresh], *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in rest])


def new_rows(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The batch's rows whose key is new to the target, each key once."""
    return batch.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def append_bars(target_path: str, batch: DataFrame, key: list[str]) -> None:
    """Append the new rows of a batch; duplicates lose themselves only, not the batch."""
    new_rows(batch.sparkSession.read.parquet(target_path), batch, key).write.mode("append").parquet(target_path)


def merge_cache(existing: DataFrame, new: DataFrame, key: tuple[str, ...] = ("address", "time")) -> DataFrame:
    """Both, and where a key is in both the new row."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in key]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_new").alias("_row"))
    return last.select(*key, "_row.*")


def universe_filter(rows: DataFrame, min_liquidity: float = 0.0, min_fdv: float | None = None, max_fdv: float | None = None) -> DataFrame:
    rows = rows.where(F.col("liquidity") >= min_liquidity)
    if min_fdv is not None:
        rows = rows.where(F.col("fdv") >= min_fdv)
    return rows if max_fdv is None else rows.where(F.col("fdv") <= max_fdv)


def unpivot_edb(wide: DataFrame, addresses: dict[str, str]) -> DataFrame:
    """(address, time, value) of a wide indicator table; indicators without an address and empty values go."""
    columns = [c for c in wide.columns if c in addresses]
    names = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(addresses[c]))])
    return wide.unpivot("time", columns, "indicator", "value").where("value IS NOT NULL").select(F.element_at(names, F.col("indicator")).alias("address"), "time", "value")


def index_constituents(weights: DataFrame, basics: DataFrame, limit: int, scale: float = 10000.0) -> DataFrame:
    """Members at the latest trade date, with market value (in single units), the largest first."""
    last = weights.agg(F.max("trade_date").alias("trade_date"))
    members = weights.join(F.broadcast(last), "trade_date", "left_semi").select("code").distinct()  # one row
    return members.join(basics, "code").select("code", (F.col("market_value") * scale).alias("market_value")).orderBy(F.desc("market_value"), "code").limit(limit)


def best_pair(pairs: DataFrame, chain: str | None = None) -> DataFrame:
    """The pair with most liquidity of each token (ties: smaller pair)."""
    if chain is not None:
        pairs = pairs.where(F.col("chain") == chain)
    return pairs.groupBy("token").agg(F.max_by("pair", F.struct(F.round("liquidity", 4), -F.col("pair"))).alias("pair"), F.max("liquidity").alias("liquidity"))


def normalize_daily(rows: DataFrame) -> DataFrame:
    """Dates from yyyyMMdd, hands to shares, thousands to single units."""
    return rows.withColumns({"time": F.to_date("trade_date", "yyyyMMdd"), "volume": F.col("vol") * 100, "amount": F.col("amount") * 1000}).drop("trade_date", "vol")


def market_overview(bars: DataFrame, limit: int) -> DataFrame:
    """Bars at the latest time, most liquid first."""
    last = bars.agg(F.max("time").alias("time"))
    return bars.join(F.broadcast(last), "time", "left_semi").orderBy(F.desc("liquidity"), "address").limit(limit)  # one row


def write_results(rows: DataFrame, path: str, form: str = "json") -> None:
    """Signals, positions or scores as JSON or Parquet."""
    rows.write.mode("overwrite").format(form).save(path)


def clean_bars(bars: DataFrame, order: str = "batch") -> DataFrame:
    """The last row of each key; close filled forward, missing prices from close, missing volume 0; no price, no row."""
    rest = [c for c in bars.columns if c not in ("address", "time")]
    last = bars.groupBy("address", "time").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("address", "time", "_row.*")
    past = Window.partitionBy("address").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("close", F.last("close", ignorenulls=True).over(past))
    return last.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")} | {"volume": F.coalesce("volume", F.lit(0.0))}).where("close > 1e-15")


def basic_factors(panel: DataFrame) -> DataFrame:
    """Log return, volatility of 20, volume shock and trend against the mean of 60, by address; 0 while a window is not full."""
    w = Window.partitionBy("address").orderBy("time")
    out = panel.where("close > 0").withColumns({"_i": F.row_number().over(w), "log_ret": F.coalesce(F.log(F.col("close") / F.lag("close").over(w)), F.lit(0.0))})
    k, long = w.rowsBetween(-19, 0), w.rowsBetween(-59, 0)
    return out.withColumns(
        {
            "volatility": F.when(F.col("_i") >= 20, F.stddev_samp("log_ret").over(k)).otherwise(0.0), "vol_shock": F.when(F.col("_i") >= 20, F.col("volume") / (F.avg("volume").over(k) + 1e-9)).otherwise(0.0),
            "trend": F.when(F.col("_i") < 60, 0.0).when(F.col("close") > F.avg("close").over(long), 1.0).otherwise(-1.0),
        }
    ).drop("_i")


def member_interest(lineitem: DataFrame) -> DataFrame:
    """(time, address, member, long_oi, short_oi) from the order lines."""
    from .fixtures import _priced

    side = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    return _priced(lineitem).groupBy("address", "time", F.col("l_suppkey").alias("member")).agg(side("A").alias("long_oi"), side("R").alias("short_oi"))


def member_long_short(members: DataFrame) -> DataFrame:
    return members.groupBy("address", "time").agg((F.sum("long_oi") - F.sum("short_oi")).alias("ls_raw"))


def member_concentration(members: DataFrame) -> DataFrame:
    """Sample deviation of the members' shares of long interest; 0 without interest or with one member."""
    total = F.sum("long_oi").over(Window.partitionBy("address", "time"))
    shares = members.withColumns({"_total": total}).withColumn("_share", F.try_divide("long_oi", "_total"))
    return shares.groupBy("address", "time").agg(F.when((F.max("_total") <= 0) | (F.count(F.lit(1)) <= 1), 0.0).otherwise(F.stddev_samp("_share")).alias("long_conc_std"))


def member_short_weighted(members: DataFrame) -> DataFrame:
    agg = members.groupBy("address", "time").agg(F.sum(F.col("short_oi") * F.col("short_oi")).alias("q"), F.sum("short_oi").alias("s"), F.count(F.lit(1)).alias("n"))
    return agg.select("address", "time", F.when((F.col("s") <= 0) | (F.col("n") <= 1), 0.0).otherwise(F.try_divide("q", "s")).alias("short_weighted"))
