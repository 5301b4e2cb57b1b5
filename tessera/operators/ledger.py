"""The cost ledger: prices, periods, sums, budget."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_PRICE, PRICES

#: Days of each period; ``all`` has no limit.
PERIODS = {"1d": 1, "7d": 7, "30d": 30, "90d": 90, "all": None}


def price(entries: DataFrame, prices: dict[str, float] | None = None, default: float = DEFAULT_PRICE) -> DataFrame:
    """``entries`` with cost_usd of their tokens: dollars per million by model, another rate for unknown models."""
    table = entries.sparkSession.createDataFrame(list((prices or PRICES).items()), "model string, _rate double")
    out = entries.drop("cost_usd").join(F.broadcast(table), "model", "left")  # a price list of a few rows
    return out.withColumn("cost_usd", F.col("tokens") * F.coalesce("_rate", F.lit(default)) / F.lit(1e6)).drop("_rate")


def since(entries: DataFrame, period: str, now: Column | datetime) -> DataFrame:
    """Entries of a period up to ``now``; those without a readable time stamp count only in ``all``."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}: use {', '.join(PERIODS)}")
    if PERIODS[period] is None:
        return entries
    ts = F.col("ts") if dict(entries.dtypes)["ts"].startswith("timestamp") else F.try_to_timestamp("ts")
    return entries.filter(ts >= (now if isinstance(now, Column) else F.lit(now)) - F.expr(f"INTERVAL {PERIODS[period]} DAYS"))


def of_source(entries: DataFrame, source: str | None) -> DataFrame:
    return entries if source is None else entries.filter(F.col("source") == source)


def _filled(entries: DataFrame) -> DataFrame:
    fill = {"source": "unknown", "model": "unknown", "cost_usd": 0.0, "tokens": 0}
    return entries.select([F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in entries.columns])


def totals(entries: DataFrame) -> DataFrame:
    """count, total_tokens and total_usd (rounded to 4) as one row; zeros for no entries."""
    return _filled(entries).agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("total_usd"))


def totals_by(entries: DataFrame, *keys: str) -> DataFrame:
    """The same by source, model, project .. in the order of the keys; sums are rounded once they are complete."""
    grouped = _filled(entries).groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("count"), F.sum("tokens").cast("long").alias("total_tokens"), F.round(F.sum("cost_usd"), 4).alias("total_usd")).orderBy(*keys)


def summary(entries: DataFrame) -> DataFrame:
    """All sums in one pass: in all, by source and by model (kind tells which)."""
    sets = _filled(entries).groupingSets([[], ["source"], ["model"]], "source", "model")
    kind = F.when(F.grouping_id() == 3, "total").when(F.grouping_id() == 1, "source").otherwise("model")
    out = sets.agg(kind.alias("kind"), F.count(F.lit(1)).alias("count"), F.sum("tokens").cast("long").alias("total_tokens"), F.round(F.sum("cost_usd"), 4).alias("total_usd"))
    return out.select("kind", F.coalesce("source", "model").alias("key"), "count", "total_tokens", "total_usd")


def over_budget(entries: DataFrame, cap_usd: float | None, sources: tuple[str, ...] = ("dream",)) -> DataFrame:
    """spent and exceeded, as one row; without a cap nothing exceeds it."""
    spent = F.coalesce(F.sum("cost_usd"), F.lit(0.0))
    exceeded = F.lit(False) if cap_usd is None else spent >= cap_usd
    return entries.filter(F.col("source").isin(*sources)).agg(F.round(spent, 6).alias("spent"), exceeded.alias("exceeded"))


def entry(spark, **fields: object) -> DataFrame:
    """One row to append to the ledger; cost_usd is rounded to 6, further fields become columns."""
    base = {"ts": datetime.now().astimezone().isoformat(), "source": "", "project": "global", "model": "", "tokens": 0, "cost_usd": 0.0, "context": ""} | fields
    base["cost_usd"] = round(float(base["cost_usd"]), 6)
    return spark.createDataFrame([tuple(base.values())], list(base))


def agent_usage(reports: DataFrame, column: str = "report", *, cached: bool = True) -> DataFrame:
    """``reports`` with cost_usd and tokens out of an agent's JSON report: input, output and, if ``cached``, tokens read from cache."""
    v = F.try_parse_json(F.col(column))
    n = lambda k: F.coalesce(F.try_variant_get(v, f"$.usage.{k}", "long"), F.lit(0))
    tokens = n("input_tokens") + n("output_tokens") + (n("cache_read_input_tokens") if cached else F.lit(0))
    return reports.withColumn("cost_usd", F.coalesce(F.try_variant_get(v, "$.total_cost_usd", "double"), F.lit(0.0))).withColumn("tokens", tokens)


def display(entries: DataFrame, today: str) -> DataFrame:
    """Entries as they are shown: time, source, project, model, token and cost labels."""
    from ..functions import text as X

    return entries.select(
        X.time_label(F.col("ts"), today).alias("time"), "source", F.coalesce("project", F.lit("global")).alias("project"), "model", X.token_label(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.format_string("$%.4f", F.coalesce("cost_usd", F.lit(0.0))).alias("cost")
    )
