"""Token prices by day, what usage would have cost, and subscription fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VARIANT = "struct<input: double, output: double, read: double, write: double>"
PRICES = f"effective_from string, model string, provider string, variants array<{VARIANT}>"
#: Days after the catalogue was fetched for which its last version still prices.
STALE_DAYS = 30


def versions(prices: DataFrame) -> DataFrame:
    """Add effective_to: the day of the next version of the whole catalogue, exclusive; null for the last."""
    days = prices.select("effective_from").distinct().withColumn("effective_to", F.lead("effective_from").over(Window.orderBy("effective_from")))
    return prices.join(days, "effective_from")  # one row per catalogue version


def base_model(model: Column, provider: Column) -> Column:
    """The catalogue's id within a dated snapshot id: -YYYYMMDD for anthropic, -YYYY-MM-DD for openai."""
    return F.when(provider == "anthropic", F.regexp_replace(model, r"-\d{8}$", "")).otherwise(F.regexp_replace(model, r"-\d{4}-\d{2}-\d{2}$", ""))


def priced(rows: DataFrame, prices: DataFrame, fetched_day: str) -> DataFrame:
    """Left join of rows (model, day, ...) to the catalogue of their day. An exact id goes before a dated snapshot's base.

    Days more than STALE_DAYS after fetched_day have no price. The catalogue is small: a row per model and version.
    """
    p = versions(prices).select(F.col("model").alias("p_model"), "provider", "variants", "effective_from", "effective_to")
    on_day = (F.col("day") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("day") < F.col("effective_to"))) & (F.col("day") <= F.date_add(F.lit(fetched_day).cast("date"), STALE_DAYS).cast("string"))
    same = F.col("model") == F.col("p_model")
    dated = base_model(F.col("model"), F.col("provider")) == F.col("p_model")
    keyed = rows.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
    found = keyed.join(p, on_day & (same | dated), "left")
    best = found.groupBy("_row").agg(F.max_by(F.struct("provider", "variants"), F.when(same, 2).otherwise(1)).alias("price"))
    return best.select("_row.*", F.col("price.provider").alias("provider"), F.col("price.variants").alias("variants"))


def cost_range(variants: Column, provider: Column, tokens: tuple[str, str, str, str]) -> tuple[Column, Column]:
    """Lowest and highest cost over variants; null where a counter is unknown or negative, or a needed rate is missing.

    For openai the cached tokens are a part of the input, for others they come beside it.
    """
    input_, output, read, write = (F.col(c) for c in tokens)
    uncached = F.when(provider == "openai", input_ - read - write).otherwise(input_)

    def one(v: Column) -> Column:
        lacking = ((write > 0) & v["write"].isNull()) | ((read > 0) & v["read"].isNull())
        zero = F.lit(0.0)
        return F.when(~lacking, (uncached * v["input"] + output * v["output"] + read * F.coalesce(v["read"], zero) + write * F.coalesce(v["write"], zero)) / 1e6)

    costs = F.transform(variants, one)
    usable = (F.least(uncached, input_, output, read, write) >= 0) & F.col(tokens[0]).isNotNull() & output.isNotNull() & read.isNotNull() & write.isNotNull() & (F.size(variants) > 0) & ~F.exists(costs, lambda c: c.isNull())
    return F.when(usable, F.array_min(costs)), F.when(usable, F.array_max(costs))


DAY = "array<struct<day: string, n: long, input: long, output: long, read: long, write: long>>"
TOKENS = ("input", "output", "read", "write")


def price_days(usage: DataFrame) -> DataFrame:
    """(model, effort, day, n, input, output, read, write) from the days that a usage row lists."""
    number = lambda x, k: F.get_json_object(x, f"$[{k}]").cast("long")
    entries = F.from_json("price_days", "array<string>")
    rows = usage.select("model", "effort", F.explode(entries).alias("x"))
    return rows.select("model", "effort", F.get_json_object("x", "$[0]").alias("day"), *(number("x", k + 1).alias(c) for k, c in enumerate(("n", *TOKENS))))


def cost_historical(usage: DataFrame, prices: DataFrame, fetched_day: str) -> DataFrame:
    """Per model and effort: each day at that day's prices, summed; null where no day could be priced."""
    days = priced(price_days(usage), prices, fetched_day)
    low, high = cost_range(F.col("variants"), F.col("provider"), TOKENS)
    days = days.withColumns({"low": low, "high": high})
    return days.groupBy("model", "effort").agg(F.sum(F.when(F.col("low").isNotNull(), F.col("n"))).alias("priced_requests"), F.sum("low").alias("cost_min"), F.sum("high").alias("cost_max"))


def cost_estimate(usage: DataFrame, prices: DataFrame, day: str) -> DataFrame:
    """Per model and effort: the complete requests' tokens at one day's prices."""
    rows = usage.filter("complete_usage_requests > 0").select("model", "effort", F.lit(day).alias("day"), *(F.col(f"complete_{a}").alias(b) for a, b in zip(("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"), TOKENS, strict=True)))
    low, high = cost_range(F.col("variants"), F.col("provider"), TOKENS)
    return priced(rows, prices, day).select("model", "effort", low.alias("cost_min"), high.alias("cost_max"))


def cost_summary(usage: DataFrame, prices: DataFrame, fetched_day: str) -> DataFrame:
    """Per model and effort with requests: cost, priced requests, and why it isn't complete."""
    cost = cost_historical(usage, prices, fetched_day).select(F.col("model").alias("_m"), F.col("effort").alias("_e"), "priced_requests", "cost_min", "cost_max")
    rows = usage.filter("api_requests > 0").select("model", "effort", "api_requests", "complete_usage_requests", "cost_usd", "reported_cost_requests", F.lit(fetched_day).alias("day"))
    rows = priced(rows, prices, fetched_day).withColumn("known", F.col("provider").isNotNull()).drop("day", "provider", "variants")
    out = rows.join(cost, (F.col("model") == F.col("_m")) & F.col("effort").eqNullSafe(F.col("_e")), "left")
    out = out.withColumn("priced_requests", F.coalesce("priced_requests", F.lit(0).cast("long")))
    complete = F.coalesce(F.col("complete_usage_requests") > 0, F.lit(False))
    reason = (
        F.when(complete & (F.col("priced_requests") == 0), "no-historical-rate")
        .when(~F.col("known") & F.col("cost_min").isNull(), "unsupported")
        .when(F.col("complete_usage_requests").isNull(), "coverage-unknown")
        .when(F.col("cost_min").isNull(), "incomplete")
        .when(F.col("priced_requests") < F.col("api_requests"), "partial")
        .otherwise("complete")
    )
    return out.withColumn("reason", reason).drop("_m", "_e", "known")


def router_api_cost(usage: DataFrame, prices: DataFrame, fetched_day: str) -> DataFrame:
    """Per model and effort in millionths, by the first variant; null if any day has no price."""
    v = F.col("variants")[0]
    zero = F.lit(0.0)
    lacking = v.isNull() | ((F.col("write") > 0) & v["write"].isNull()) | ((F.col("read") > 0) & v["read"].isNull())
    cost = (F.col("input") - F.col("read") - F.col("write")) * v["input"] + F.col("output") * v["output"] + F.col("read") * F.coalesce(v["read"], zero) + F.col("write") * F.coalesce(v["write"], zero)
    days = priced(price_days(usage), prices, fetched_day).withColumns({"lacking": lacking, "micros": cost})
    return days.groupBy("model", "effort").agg(F.when(~F.bool_or("lacking"), F.round(F.sum("micros"))).cast("long").alias("micros"))


def plan_history(observed: DataFrame) -> DataFrame:
    """Plan periods of each account from daily observations (account, day, plan, price): a row per change."""
    w = Window.partitionBy("account").orderBy("day")
    state = F.struct("plan", "price")
    changed = observed.withColumn("before", F.lag(state).over(w)).filter(~F.col("before").eqNullSafe(state))
    return changed.withColumn("until", F.lead("day").over(w)).select("account", F.col("day").alias("from_day"), "until", "plan", "price")


def period_fee(periods: DataFrame, days: int, end: str) -> DataFrame:
    """Per account: list prices over the `days` days to `end`, a month being 30. The first plan reaches back; an unknown price makes the fee unknown."""
    first = F.row_number().over(Window.partitionBy("account").orderBy("from_day")) == 1
    start, stop = F.date_sub(F.lit(end).cast("date"), days - 1), F.date_add(F.lit(end).cast("date"), 1)
    rows = periods.withColumn("a", F.when(first, start).otherwise(F.greatest(F.col("from_day").cast("date"), start))).withColumn("b", F.least(F.coalesce(F.col("until").cast("date"), stop), stop))
    rows = rows.withColumn("n", F.greatest(F.datediff("b", "a"), F.lit(0))).filter("n > 0")
    return rows.groupBy("account").agg(F.when(F.count_if(F.col("price").isNull()) == 0, F.sum(F.col("price") * F.col("n")) / 30).alias("fee"))


def subscription_comparison(fees: DataFrame, summary: DataFrame, free: str = "codex-auto-review") -> DataFrame:
    """One row: the fee of all accounts (null if one is unknown) beside what their usage would cost; free reviews apart."""
    fee = fees.agg(F.when((F.count("*") > 0) & (F.count("*") == F.count("fee")), F.sum("fee")).alias("period_cost"))
    usage = summary.agg(
        F.coalesce(F.sum(F.when(F.col("model") != free, F.col("priced_requests"))), F.lit(0).cast("long")).alias("priced_requests"), F.sum(F.when(F.col("model") != free, F.col("cost_min"))).alias("equivalent_min"),
        F.sum(F.when(F.col("model") != free, F.col("cost_max"))).alias("equivalent_max"), F.coalesce(F.sum(F.when(F.col("model") == free, F.col("api_requests"))), F.lit(0).cast("long")).alias("free_reviews"),
    )
    return fee.crossJoin(usage)  # one row each


def accepted_history(old: DataFrame, new: DataFrame) -> bool:
    """Whether a new catalogue only appends: old versions stay as they were, later days only, rates known and not negative."""
    if old.exceptAll(new).limit(1).count():
        return False
    last = old.agg(F.max("effective_from")).first()[0]
    added = new.exceptAll(old)
    rates = F.exists("variants", lambda v: (v["input"] < 0) | (v["output"] < 0) | v["input"].isNull() | v["output"].isNull() | F.isnan(v["input"]) | F.isnan(v["output"]))
    bad = added.filter(rates | (F.col("effective_from") <= F.lit(last)) if last else rates)
    return not bad.limit(1).count()


def price_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PRICES)
