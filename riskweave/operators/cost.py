"""Cost of model calls."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import fixed_values as V

_COST = "decimal(38,12)"


def _price(model: Column, prices: Iterable[tuple[str, str, str]], field: int) -> Column:
    """Price of the longest listed name the model starts with; an exact name is the longest.

    The price list is a few literals, so this is one expression and no join.
    """
    longest_first = sorted(prices, key=lambda p: len(p[0]))
    return reduce(
        lambda rest, p: F.when(model.startswith(p[0]), F.lit(Decimal(p[field]))).otherwise(rest),
        longest_first, F.lit(None).cast("decimal(18,9)"),
    ).cast("decimal(18,9)")


def with_prices(usage: DataFrame, prices: DataFrame, at: str | None = None) -> DataFrame:
    """Adds `price_in` and `price_out`, null for unknown models, from a table of prices.

    `prices` has `name, price_in, price_out, valid_from, valid_to`: a price
    holds from a day on and before another, null for no bound. The longest
    name that the model starts with and that holds on the day counts, of equal
    ones that which came last. `at` names the day in `usage`; without it,
    prices that hold without end count.

    Names are prefix keys: a model is looked up by its beginnings of the lengths
    that names have, so the match is an equi-join however many prices there are.
    Each model is looked up once per day.
    """
    days = [at] if at else []
    lengths = sorted(prices.agg(F.collect_set(F.length("name")).alias("n")).first()["n"])
    models = usage.select("model", *days).filter("model is not null").distinct()
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("model"))
    keys = models.withColumn("name", F.explode(F.transform(sizes, lambda n: F.substr("model", F.lit(1), n))))
    day = F.col(at) if at else None
    holds = F.col("valid_to").isNull() if day is None else (
        (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))
    price = F.struct(*[F.col(c).cast("decimal(18,9)").alias(c) for c in ("price_in", "price_out")])
    last = F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))
    best = keys.join(prices, "name").filter(holds).groupBy("model", *days).agg(
        F.max(F.struct(F.length("name"), last, price.alias("price")))["price"].alias("_price"))
    return usage.join(best, ["model", *days], "left").select(*usage.columns, "_price.price_in", "_price.price_out")


def llm_cost(
    usage: DataFrame, prices: Iterable[tuple[str, str, str]] | DataFrame = V.MODEL_PRICES, at: str | None = None
) -> DataFrame:
    """Adds `cost_usd`, zero for unknown models, and `emitted_cost_usd`, null instead of zero.

    Exact decimals, so totals do not depend on the order of the rows. A table of
    prices (`with_prices`) may take the place of the list.
    """
    columns = usage.columns
    if isinstance(prices, DataFrame):
        usage = with_prices(usage, prices, at)
    else:
        prices, model = tuple(prices), F.col("model")
        usage = usage.select("*", _price(model, prices, 1).alias("price_in"), _price(model, prices, 2).alias("price_out"))

    def side(tokens: str, price: str) -> Column:
        per_token = (F.col(price) * F.lit(Decimal("0.001"))).cast("decimal(18,12)")
        return (F.col(tokens).cast("decimal(19,0)") * per_token).cast(_COST)

    cost = F.coalesce(side("input_tokens", "price_in") + side("output_tokens", "price_out"), F.lit(0)).cast(_COST)
    usage = usage.withColumn("cost_usd", cost).select(*columns, "cost_usd")
    return usage.withColumn("emitted_cost_usd", F.nullif(F.col("cost_usd"), F.lit(0)))


def llm_cost_by_model(usage: DataFrame, prices: Iterable[tuple[str, str, str]] = V.MODEL_PRICES) -> DataFrame:
    return llm_cost(usage, prices).groupBy("model").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").cast(_COST).alias("cost_usd"),
    )
