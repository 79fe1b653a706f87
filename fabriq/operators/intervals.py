"""Sets of integers as rows (key, lo, hi), both ends in.  Set algebra by sweeps over the ends: sorted windows, no range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage


def _sweep(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Elementary intervals of all parts' ends, with how many intervals of part k cover each (c0, c1, ...)."""
    ends = None
    for k, df in enumerate(parts):
        zero = [F.lit(0).alias(f"d{j}") for j in range(len(parts))]
        on = [F.lit(1).alias(f"d{j}") if j == k else zero[j] for j in range(len(parts))]
        off = [F.lit(-1).alias(f"d{j}") if j == k else zero[j] for j in range(len(parts))]
        got = df.select(*key, F.col("lo").alias("x"), *on).unionByName(df.select(*key, (F.col("hi") + 1).alias("x"), *off))
        ends = got if ends is None else ends.unionByName(got)
    ends = ends.groupBy(*key, "x").agg(*(F.sum(f"d{j}").alias(f"d{j}") for j in range(len(parts))))
    w = Window.partitionBy(*key).orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    got = ends.select(*key, F.col("x").alias("lo"), (F.lead("x").over(w) - 1).alias("hi"), *(F.sum(f"d{j}").over(run).alias(f"c{j}") for j in range(len(parts))))
    return got.where("hi is not null")


def _merged(df: DataFrame, key: list[str]) -> DataFrame:
    """Neighbouring disjoint intervals as one."""
    w = Window.partitionBy(*key).orderBy("lo")
    fresh = F.coalesce(F.lag("hi").over(w) + 1 < F.col("lo"), F.lit(True))
    got = df.withColumn("run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return got.groupBy(*key, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def union(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return _merged(_sweep([a, b], key).where("c0 > 0 or c1 > 0").select(*key, "lo", "hi"), key)


def intersect(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return _merged(_sweep([a, b], key).where("c0 > 0 and c1 > 0").select(*key, "lo", "hi"), key)


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return _merged(_sweep([a, b], key).where("c0 > 0 and c1 = 0").select(*key, "lo", "hi"), key)


def complement(a: DataFrame, key: list[str], lo: int, hi: int) -> DataFrame:
    """What a lacks of [lo, hi], for each key that a has."""
    return difference(a.select(*key).distinct().withColumn("lo", F.lit(lo).cast("long")).withColumn("hi", F.lit(hi).cast("long")), a, key)


def atoms(lines: DataFrame, key: list[str]) -> DataFrame:
    """Elementary intervals between all ends of a key's lines that at least one line covers: (key, lo, hi)."""
    return _sweep([lines], key).where("c0 > 0").select(*key, "lo", "hi")


def placed(lines: DataFrame, key: list[str], line: str = "line") -> tuple[DataFrame, DataFrame]:
    """The key's atoms (key..., lo, hi, place), and the lines with the places p to q of the atoms that they cover."""
    w = Window.partitionBy(*key).orderBy("lo")
    cut = lineage.cut(atoms(lines, key).withColumn("place", F.row_number().over(w) - 1))
    first = lines.join(cut.select(*key, "lo", F.col("place").alias("p")), [*key, "lo"])
    both = first.join(cut.select(*key, "hi", F.col("place").alias("q")), [*key, "hi"])
    return cut, both.select(*key, line, "p", "q")


#: Levels of blocks of places: a key has less than 2 ** LEVELS atoms.
LEVELS = 40


def blocks(p: Column, q: Column) -> Column:
    """array<struct<level, block>>: the few aligned blocks of 2 ** level places that make up p to q."""
    start = F.struct(p.cast("long").alias("l"), (q + 1).cast("long").alias("r"), F.expr("cast(array() as array<struct<level:int,block:bigint>>)").alias("out"))

    def step(s, k):
        l, r = s["l"], s["r"]
        odd_l, odd_r = (l < r) & (l % 2 == 1), (l < r) & (r % 2 == 1)
        left = F.when(odd_l, F.array(F.struct(k.alias("level"), l.alias("block"))))
        right = F.when(odd_r & (F.when(odd_l, l + 1).otherwise(l) < r), F.array(F.struct(k.alias("level"), (r - 1).alias("block"))))
        none = F.expr("cast(array() as array<struct<level:int,block:bigint>>)")
        l2, r2 = F.when(odd_l, l + 1).otherwise(l), F.when(odd_r, r - 1).otherwise(r)
        return F.struct(F.floor(l2 / 2).cast("long").alias("l"), F.floor(r2 / 2).cast("long").alias("r"), F.concat(s["out"], F.coalesce(left, none), F.coalesce(right, none)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, lambda s: s["out"])


def owners(lines: DataFrame, key: list[str], line: str = "line") -> DataFrame:
    """First-match ownership: each atom with the first line that covers it.

    A line is laid over the few aligned blocks of atoms that make up its range, an atom asks the blocks that it is in: both are
    logarithmic, so lines times atoms are never made.
    """
    cut, spans = placed(lines, key, line)
    over = spans.select(*key, line, F.explode(blocks(F.col("p"), F.col("q"))).alias("b")).groupBy(*key, "b.level", "b.block").agg(F.min(line).alias(line))
    top = cut.groupBy(*key).agg(F.max("place").alias("top"))
    asked = cut.join(top, key).select(*key, "place", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("top") + 1)).cast("int"))).alias("level"))
    asked = asked.withColumn("block", F.expr("shiftright(cast(place as bigint), level)"))
    least = asked.join(over, [*key, "level", "block"]).groupBy(*key, "place").agg(F.min(line).alias(line))
    return least.join(cut, [*key, "place"]).drop("place")
