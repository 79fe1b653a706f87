"""Answer tables: options, predicates, diffs, exclusions, assertions, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "IS": lambda a, b: a.eqNullSafe(b), "ISNOT": lambda a, b: ~a.eqNullSafe(b)}


def text_filter(column: str, text: str, exact: bool = False) -> Column:
    """Case-insensitive: the column holds the text, or with exact is the text, plain or in double quotes."""
    value = F.lower(F.col(column).cast("string"))
    return value.isin(text.lower(), f'"{text.lower()}"') if exact else value.contains(text.lower())


def predicate(left: str, op: str, right) -> Column:
    """One comparison; nulls are equal to nulls for IS and ISNOT only."""
    if op not in OPS:
        raise ValueError(f"unknown comparison {op}")
    return OPS[op](F.col(left), right if isinstance(right, Column) else F.lit(right))


def row_options(df: DataFrame, columns: list[str] | None = None, filters: list[Column] = (), unique: bool = False, sort: list[tuple[str, bool]] = (), offset: int = 0, rows: int | None = None) -> DataFrame:
    """Filter, project, distinct, sort (column, reversed), offset, limit, in this order."""
    for c in columns or []:
        if c not in df.columns:
            raise ValueError(f"no column {c}; there are {', '.join(df.columns)}")
    for f in filters:
        df = df.where(f)
    df = df.select(*columns) if columns else df
    df = df.distinct() if unique else df
    if sort:
        df = df.orderBy(*(F.desc(c) if back else F.asc(c) for c, back in sort))
    df = df.offset(offset) if offset else df
    return df.limit(rows) if rows is not None else df


def table_diff(snapshot: DataFrame, reference: DataFrame, keys: list[str], one_sided: bool = True) -> DataFrame:
    """Rows whose values differ under equal keys (nulls equal): keys, KeyPresence, then Snapshot_ and Reference_ of each value."""
    values = [c for c in snapshot.columns if c not in keys]
    a = snapshot.select(*(F.col(k).alias(f"a_{k}") for k in keys), *(F.col(v).alias(f"Snapshot_{v}") for v in values), F.lit(True).alias("__a"))
    b = reference.select(*(F.col(k).alias(f"b_{k}") for k in keys), *(F.col(v).alias(f"Reference_{v}") for v in values), F.lit(True).alias("__b"))
    on = reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    got = a.join(b, on, "full_outer" if one_sided else "inner")
    presence = F.when(F.col("__b").isNull(), "Only in Snapshot").when(F.col("__a").isNull(), "Only in Reference").otherwise("In both")
    changed = reduce(lambda x, y: x | y, [~F.col(f"Snapshot_{v}").eqNullSafe(F.col(f"Reference_{v}")) for v in values], F.lit(False))
    got = got.withColumn("KeyPresence", presence).where((F.col("KeyPresence") != "In both") | changed)
    return got.select(*(F.when(F.col("__a").isNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys), "KeyPresence", *(F.col(f"{side}_{v}") for v in values for side in ("Snapshot", "Reference")))


def exclusions(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with ``exclusion``: the name of the first rule that covers the row, null for rows that stay."""
    name = F.lit(None).cast("string")
    for rule, cond in reversed(rules):
        name = F.when(cond, rule).otherwise(name)
    return df.withColumn("exclusion", name)


def metrics(df: DataFrame, maxima: list[str], excluded: str | None = None) -> DataFrame:
    """One row: rows, excluded rows, the columns that are null everywhere, the maximum of each of maxima."""
    for c in maxima:
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    aggs = [F.count("*").alias("num_rows"), F.count(excluded).alias("num_excluded") if excluded else F.lit(0).cast("long").alias("num_excluded")]
    one = df.agg(*aggs, *(F.max(c).alias(f"max_{c}") for c in maxima), *(F.count(c).alias(f"__{c}") for c in df.columns))
    empty = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"__{c}") == 0, c) for c in sorted(df.columns)))), ",")
    return one.select("num_rows", "num_excluded", empty.alias("empty_columns"), *(f"max_{c}" for c in maxima))


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows the same number of times; one aggregation, no collect."""
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("__n").alias("n")).agg(F.coalesce(F.every(F.col("n") == 0), F.lit(True)).alias("equal"))


def best(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows of each group that no other is preferred to; equals stay, as equal-cost routes do."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rank", F.rank().over(w)).where("__rank = 1").drop("__rank")


def classes_of_same_name(df: DataFrame, name: list[str], definition: str, member: str) -> DataFrame:
    """Equivalence classes of equally named structures: (name..., definition, members, n)."""
    return df.groupBy(*name, definition).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias("members"), F.count_distinct(member).alias("n"))


def outliers(classes: DataFrame, name: list[str], definition: str, threshold: float) -> DataFrame:
    """Minority classes: all but the largest (ties by definition), where they make up the threshold's share at most."""
    w = Window.partitionBy(*name)
    got = classes.withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), definition))).withColumn("total", F.sum("n").over(w))
    got = got.withColumn("conformers", F.max(F.when(F.col("place") == 1, F.col("n"))).over(w))
    share = (F.col("total") - F.col("conformers")) / F.col("total")
    return got.where((F.col("place") > 1) & (share <= threshold)).drop("place")
