"""Traces: paths of probes as rows (by..., path, disposition), and the graph that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pruned(traces: DataFrame, by: list[str], path: str, most: int) -> DataFrame:
    """The first ``most`` traces of each probe by path, with how many the probe has (traces)."""
    n = traces.groupBy(*by).agg(F.count("*").alias("traces"))
    k = F.row_number().over(Window.partitionBy(*by).orderBy(path))  # with a rank filter right behind it Spark cuts each sorted group early
    return traces.withColumn("__k", k).where(F.col("__k") <= most).drop("__k").join(n, by)


def dag(traces: DataFrame, by: list[str], path: str) -> DataFrame:
    """(by..., src, dst, at, traces): the hops of all traces with their place, each once, and how many traces go over it; path: array of nodes."""
    hops = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda k: F.struct(F.element_at(path, k).alias("src"), F.element_at(path, k + 1).alias("dst"), k.alias("at")))
    got = traces.where(F.size(path) > 1).select(*by, F.explode(hops).alias("h"))
    return got.groupBy(*by, "h.src", "h.dst", "h.at").agg(F.count("*").alias("traces"))
