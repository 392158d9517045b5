"""Run logs: phase times and the cost of model usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT_PREFIX = "agent."


def phase_timings(spans: DataFrame) -> DataFrame:
    """(section, phase, spans, duration_ms): phases, then agents, then the total of the phases.

    Agent spans lie inside a phase and are kept out of the total.
    """
    phase = F.coalesce("phase", F.lit("unknown"))
    is_agent = phase.startswith(AGENT_PREFIX)
    rows = spans.select(
        F.when(is_agent, "agent").otherwise("phase").alias("section"),
        F.when(is_agent, F.substring(phase, len(AGENT_PREFIX) + 1, 1000)).otherwise(phase).alias("phase"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
    )
    measured = (F.count(F.lit(1)).alias("spans"), F.sum("duration_ms").alias("duration_ms"))
    by_phase = rows.groupBy("section", "phase").agg(*measured)
    total = (
        by_phase.filter("section = 'phase'")
        .agg(F.sum("spans").alias("spans"), F.sum("duration_ms").alias("duration_ms"))
        .select(
            F.lit("total").alias("section"),
            F.lit("total").alias("phase"),
            F.coalesce("spans", F.lit(0)).alias("spans"),
            F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
        )
    )
    return by_phase.unionByName(total)


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost per agent and model, per agent, and overall.

    ``usage`` has (agent, model, prompt_tokens, completion_tokens), ``prices`` (model,
    prompt_price, completion_price) per 1000 tokens. A model without a price costs nothing.
    """
    def cost(tokens, price):
        return F.col(tokens) / 1000 * F.coalesce(price, F.lit(0.0))

    per_row = cost("prompt_tokens", F.col("prompt_price")) + cost(
        "completion_tokens", F.col("completion_price")
    )
    used = usage.groupBy("agent", "model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
    return (
        used.join(prices, "model", "left")
        .withColumn("cost", per_row)
        .rollup("agent", "model")
        .agg(
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.sum("cost").alias("cost"),
            F.grouping_id().alias("level"),
        )
    )
