"""Model catalogue: choice of provider and model, and prices.

The catalogue is a small table. Its joins carry no broadcast hint: Spark broadcasts it while its
known size is under `spark.sql.autoBroadcastJoinThreshold` and shuffles it beyond.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed
from corpusforge.functions.prompts import estimate_cost

_ARROW_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW_SCHEMA = pa.schema([(n, _ARROW_TYPES[t]) for n, t in (c.split(" ") for c in fixed.MODEL_CATALOG_SCHEMA.split(", "))])

def model_catalog(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The catalogue as a table whose size Spark knows (an Arrow table becomes a local relation)."""
    names = [column.split(" ")[0] for column in fixed.MODEL_CATALOG_SCHEMA.split(", ")]
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows or fixed.MODEL_CATALOG], schema=_ARROW_SCHEMA)
    return spark.createDataFrame(table, fixed.MODEL_CATALOG_SCHEMA)


def pick_highest_priority(entries: DataFrame, name: str = "provider", priority: str = "priority", seq: str = "seq") -> DataFrame:
    """One entry per name: the highest priority, and of equals the first. An aggregation rather
    than a ranking window, so a name with very many entries is reduced before the shuffle."""
    best = F.max_by(F.struct(*entries.columns), F.struct(F.col(priority), -F.col(seq))).alias("_best")
    return entries.groupBy(F.col(name).alias("_name")).agg(best).select("_best.*")


def price_lookup(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach prices by provider and model; an unknown model costs 0."""
    prices = catalog.select("provider", "model", "input_per_1k", "output_per_1k", "image_price")
    return calls.join(prices, ["provider", "model"], "left")


def with_cost(calls: DataFrame, catalog: DataFrame, tokens: str = "tokens", output_tokens: str | None = None, images: str | None = None) -> DataFrame:
    """Add `cost`; output tokens default to the input's, and images cost the model's image price."""
    priced = price_lookup(calls, catalog)
    output = F.col(output_tokens) if output_tokens else None
    counted = F.coalesce(F.col(images), F.lit(0)) if images else None
    cost = estimate_cost(F.col(tokens), F.col("input_per_1k"), F.col("output_per_1k"), output, counted, F.col("image_price"))
    return priced.withColumn("cost", cost).drop("input_per_1k", "output_per_1k", "image_price")


def cost_report(calls: DataFrame, catalog: DataFrame, by: list[str], tokens: str = "tokens", output_tokens: str | None = None, images: str | None = None) -> DataFrame:
    """Tokens, images and cost per group. Prices are per model, so counts are summed before the join."""
    groups = list(dict.fromkeys([*by, "provider", "model"]))
    more = {"output_tokens": output_tokens, "images": images}
    sums = calls.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(tokens).alias("tokens"), *[F.sum(c).alias(n) for n, c in more.items() if c])
    return with_cost(sums, catalog, "tokens", *[n if c else None for n, c in more.items()])


def resolve_provider(requests: DataFrame, catalog: DataFrame, provider: str = "provider", model: str = "model", vision_only: bool = False) -> DataFrame:
    """Provider and model that serve each request.

    The requested provider, with the requested model or else its default; else the first provider
    offering the model; else the first provider and its default. Providers come in name order,
    a provider's default model is its first one.
    """
    usable = catalog.filter("vision") if vision_only else catalog
    default = usable.groupBy("provider").agg(F.min_by("model", "seq").alias("_default"))
    owner = usable.groupBy("model").agg(F.min("provider").alias("_owner"))
    first = default.agg(
        F.min("provider").alias("_first"), F.min_by("_default", "provider").alias("_first_default")
    )
    asked = requests.withColumnsRenamed({provider: "asked_provider", model: "asked_model"})
    offered = usable.select(F.col("provider").alias("asked_provider"), F.col("model").alias("asked_model"), F.lit(True).alias("_offered"))
    joined = (
        asked.join(default.withColumnRenamed("provider", "asked_provider"), "asked_provider", "left")
        .join(offered, ["asked_provider", "asked_model"], "left")
        .join(owner.withColumnRenamed("model", "asked_model"), "asked_model", "left")
        .withColumn("_fallback", F.struct(first.select("_first").scalar().alias("p"), first.select("_first_default").scalar().alias("m")))
    )
    chosen = (
        F.when(F.col("_default").isNotNull(), F.struct(F.col("asked_provider").alias("p"),
               F.when(F.col("_offered"), F.col("asked_model")).otherwise(F.col("_default")).alias("m")))
        .when(F.col("_owner").isNotNull(), F.struct(F.col("_owner").alias("p"), F.col("asked_model").alias("m")))
        .otherwise(F.col("_fallback"))
    )
    return joined.withColumn("_c", chosen).select(
        *[c for c in asked.columns], F.col("_c.p").alias("provider"), F.col("_c.m").alias("model")
    )


def route_task(task: Column) -> tuple[Column, Column]:
    """Provider and model of a task by the routing settings, with the fallback route for others."""
    pairs = [F.lit(x) for item in fixed.TASK_ROUTES.items() for x in item]
    models = [F.lit(x) for item in fixed.ROUTE_MODELS.items() for x in item]
    route = F.coalesce(F.try_element_at(F.create_map(*pairs), task), F.lit(fixed.FALLBACK_ROUTE))
    return F.split_part(route, F.lit("/"), F.lit(1)), F.try_element_at(F.create_map(*models), route)
