"""Paired comparison of two variants: McNemar's exact test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many discordant pairs the binomial is summed in doubles; beyond it in logarithms.
DIRECT = 1000


@F.pandas_udf(T.DoubleType())
def _by_logs(fixed: pd.Series, broken: pd.Series) -> pd.Series:
    def p(f: int, b: int) -> float:
        n = f + b
        if n == 0:
            return 1.0
        top = math.lgamma(n + 1) - n * math.log(2)
        return min(1.0, 2 * sum(math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1)) for i in range(min(f, b) + 1)))

    return pd.Series([p(int(f), int(b)) for f, b in zip(fixed, broken)])


def p_value(fixed: Column, broken: Column) -> Column:
    """min(1, 2 * sum of C(n, i) / 2^n for i up to the smaller count), 1 without discordant pairs."""
    n = fixed + broken
    start = F.struct(F.pow(F.lit(2.0), -n.cast("double")).alias("c"), F.lit(0.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        return F.struct((a["c"] * (n - i) / (i + 1)).alias("c"), (a["s"] + a["c"]).alias("s"))

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(fixed, broken).cast("long")), start, step, lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).when(n <= DIRECT, F.least(F.lit(1.0), 2 * total)).otherwise(_by_logs(fixed, broken))


def outcomes(log: DataFrame, config: str, measure: str) -> DataFrame:
    """(variant, id, hit) of one config; a repeated row counts once; an unknown measure is an error."""
    if measure not in log.columns:
        raise ValueError(f"the log has no {measure}; it has {', '.join(log.columns)}")
    return log.where(F.col("config") == config).groupBy("variant", "id").agg(F.max(F.col(measure)).alias("hit"))


def mcnemar(log: DataFrame, before: str, after: str, measures: tuple[str, ...] = ("hit_at_5", "hit_at_20"), level: float = 0.05) -> DataFrame:
    """(variant, measure, questions, fixed, broken, net, p_value, significant) of the questions both configs have."""
    out: DataFrame | None = None
    for m in measures:
        a, b = outcomes(log, before, m).withColumnRenamed("hit", "was"), outcomes(log, after, m).withColumnRenamed("hit", "now")
        both = a.join(b, ["variant", "id"])
        counted = both.groupBy("variant").agg(
            F.lit(m).alias("measure"),
            F.count(F.lit(1)).alias("questions"),
            F.count_if(~F.col("was") & F.col("now")).alias("fixed"),
            F.count_if(F.col("was") & ~F.col("now")).alias("broken"),
        )
        out = counted if out is None else out.unionByName(counted)
    tested = out.withColumn("net", F.col("fixed") - F.col("broken")).withColumn("p_value", F.round(p_value(F.col("fixed"), F.col("broken")), 6))
    return tested.withColumn("significant", F.col("p_value") < level)
