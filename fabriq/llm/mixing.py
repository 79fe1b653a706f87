"""Mixing sources to target weights by hierarchical budgeting.  DataFrame functions only.

Documents hang in a tree, by default domain - language - source.  A budget of tokens flows from the root: each node
deals its budget out to its children by weight, none above its capacity (its tokens times ``epochs``); what a child can't take
goes to its siblings by weight, and only what a whole node can't take has gone to the node's own siblings, as capacities
are summed up the tree before budgets go down it.  Shares are whole tokens: floors, then one token more for the first
children by name until the budget is spent.

Each leaf takes its budget from seeded epochs: whole passes over its documents first, then the token-prefix of one more
pass in the order of md5(seed:epoch:doc_id); the document at the end of the prefix gives the tokens that are still due.

Weights are whole numbers of 0 to 100 000.  Tokens are runs of bytes other than white space.  Defined results: a null in a tree column is the
node ``(none)``; a node without a stated weight weighs ``default``; a weight of 0, or a document without tokens, is never taken; ties
of the hash (repeated rows) stand by id, then by size; a target above all capacity takes everything ``epochs`` times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

TOKEN = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of the hash by which a leaf's pass is cut into buckets, so that no leaf is sorted in one task.
DIGITS = 3


def _weight(level: str, weights: dict[str, int], default: int) -> Column:
    picks = [F.when(F.col(level) == k, F.lit(v)) for k, v in weights.items()]
    return F.coalesce(*picks, F.lit(default)).cast("long")


def _budgets(children: DataFrame, parents: DataFrame, above: list[str], level: str) -> DataFrame:
    """children (above, level, w, cap) with the budget that each takes of its parent's (above, budget)."""
    got = children.join(parents, above) if above else children.crossJoin(F.broadcast(parents))  # the root's budget is one row
    got = got.where("w > 0 and cap > 0")
    by = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), level)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    got = got.withColumn("before", before).withColumn("onward", onward)
    got = got.withColumn("full", F.col("cap") * F.col("onward") <= (F.col("budget") - F.col("before")) * F.col("w"))
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))
    open_ = F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0))
    got = got.withColumn("rest", F.col("budget") - spent).withColumn("open", open_)
    got = got.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(rest * w) div open")))
    over = F.col("rest") - F.coalesce(F.sum(F.when(~F.col("full"), F.col("share"))).over(by), F.lit(0))
    rank = F.row_number().over(by.orderBy("full", level))
    got = got.withColumn("over", over).withColumn("rank", rank)
    share = F.col("share") + F.when(~F.col("full") & (F.col("rank") <= F.col("over")), 1).otherwise(0)
    return got.select(*above, level, share.cast("long").alias("budget"))


def mix(docs: DataFrame, levels: list[tuple[str, Column]], weights: dict[str, dict[str, int]], percent: int, epochs: int, seed: int, default: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, epoch, levels..., tokens, taken_tokens): what is taken for a target of ``percent`` per cent of all tokens."""
    names = [n for n, _ in levels]
    scratch = Scratch(docs.sparkSession, "mixing")
    tree = [F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in levels]
    sized = scratch.save(docs.select(F.col(id_col).alias("doc_id"), *tree, F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN)), F.lit(0)).cast("long").alias("tokens")))
    sums = [sized.groupBy(*names).agg(F.sum("tokens").alias("tokens"))]
    leaf = sums[0].withColumn("cap", F.col("tokens") * epochs)
    # a node's capacity is what its children can take: those of weight 0 take nothing
    for n in names:
        leaf = leaf.withColumn(f"w_{n}", _weight(n, weights.get(n, {}), default))
    live = leaf.where(reduce(lambda a, b: a & b, [F.col(f"w_{n}") > 0 for n in names]))
    live = scratch.save(live)
    budget = sized.agg(F.expr(f"coalesce(sum(tokens), 0) * {int(percent)} div 100").cast("long").alias("target"))
    top = live.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"))
    budget = budget.crossJoin(F.broadcast(top)).select(F.least("target", "cap").alias("budget"))  # two tables of one row
    for k, n in enumerate(names):
        level = live.groupBy(*names[: k + 1]).agg(F.max(f"w_{n}").alias("w"), F.sum("cap").alias("cap"))
        budget = _budgets(level, budget, names[:k], n)
    plan = live.select(*names, F.col("tokens").alias("leaf_tokens")).join(budget, names)
    plan = scratch.save(plan.select(*names, F.expr("budget div leaf_tokens").alias("passes"), F.expr("budget % leaf_tokens").alias("due")))
    placed = sized.where("tokens > 0").join(plan, names)
    whole = placed.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))))
    whole = whole.select("doc_id", "epoch", *names, "tokens", F.col("tokens").alias("taken_tokens"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("passes").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    part = placed.where("due > 0").withColumn("key", key).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums_ = part.groupBy(*names, "bucket").agg(F.sum("tokens").alias("here"))
    up_to = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums_ = sums_.withColumn("ahead", F.coalesce(F.sum("here").over(up_to), F.lit(0))).drop("here")
    part = part.join(sums_, [*names, "bucket"]).where("ahead < due")
    inside = Window.partitionBy(*names, "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("due") - F.col("ahead") - F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    part = part.withColumn("left", left).where("left > 0")
    part = part.select("doc_id", F.col("passes").cast("int").alias("epoch"), *names, "tokens", F.least("tokens", "left").alias("taken_tokens"))
    return whole.unionByName(part)


#: The query's tree and weights.
WEIGHTS = {"domain": {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10}, "language": {"en": 50, "de": 20, "fr": 20, "es": 10}, "origin": {}}
PERCENT, EPOCHS, SEED = 80, 2, 17


def tree(lang: str = "lang") -> list[tuple[str, Column]]:
    number = F.regexp_extract(F.col("source"), r"(\d+)$", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), (F.coalesce(F.expr(r"try_cast(regexp_extract(source, '(\\d+)$', 1) as bigint)"), F.lit(0)) % 4).cast("string")))
    return [("domain", domain), ("language", F.col(lang)), ("origin", F.col("source"))]


def mixed(docs: DataFrame) -> DataFrame:
    return mix(docs, tree(), WEIGHTS, PERCENT, EPOCHS, SEED)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def mixing_sql(source: str = "documents") -> str:
    """DuckDB SQL for mixed() over a table of documents."""
    names = ["domain", "language", "origin"]

    def weight(n):
        return f"CASE {n} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[n].items()) + " ELSE 1 END" if WEIGHTS[n] else "1"

    ctes = [
        rf"""sized AS (SELECT doc_id, CASE WHEN regexp_extract(source, '(\d+)$', 1) <> '' THEN 'domain' || CAST(coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) AS BIGINT), 0) % 4 AS VARCHAR) ELSE '(none)' END AS domain,
            coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS origin, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens FROM {source})""",
        f"leaf AS (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS BIGINT) * {EPOCHS} AS cap FROM sized GROUP BY ALL)",
        f"b0 AS (SELECT least((SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) * {PERCENT} // 100 FROM sized), (SELECT CAST(coalesce(sum(cap), 0) AS BIGINT) FROM leaf)) AS budget)",
    ]
    for k, n in enumerate(names):
        above = names[:k]
        keys = ", ".join([*above, n])
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        join = f"JOIN b{k} USING ({', '.join(above)})" if above else "CROSS JOIN b0"
        ctes += [
            f"c{k} AS (SELECT {keys}, {weight(n)} AS w, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY {keys})",
            f"d{k} AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM c{k} {join} WHERE w > 0 AND cap > 0 WINDOW o AS ({by} ORDER BY cap / w, {n}))",
            f"e{k} AS (SELECT *, cap * onward <= (budget - before) * w AS saturated FROM d{k})",
            f"f{k} AS (SELECT *, budget - coalesce(sum(cap) FILTER (saturated) OVER (p), 0) AS rest, coalesce(sum(w) FILTER (NOT saturated) OVER (p), 0) AS free FROM e{k} WINDOW p AS ({by}))",
            f"g{k} AS (SELECT *, CASE WHEN saturated THEN cap ELSE (rest * w) // free END AS share FROM f{k})",
            f"h{k} AS (SELECT *, rest - coalesce(sum(share) FILTER (NOT saturated) OVER (p), 0) AS extra, row_number() OVER (p ORDER BY saturated, {n}) AS place FROM g{k} WINDOW p AS ({by}))",
            f"b{k + 1} AS (SELECT {keys}, CAST(share + CASE WHEN NOT saturated AND place <= extra THEN 1 ELSE 0 END AS BIGINT) AS budget FROM h{k})",
        ]
    keys = ", ".join(names)
    ctes += [
        f"plan AS (SELECT {keys}, budget // tokens AS passes, budget % tokens AS due FROM leaf JOIN b3 USING ({keys}))",
        f"placed AS (SELECT * FROM sized JOIN plan USING ({keys}) WHERE tokens > 0)",
        f"part AS (SELECT *, due - coalesce(sum(tokens) OVER (PARTITION BY {keys} ORDER BY md5('{SEED}:' || passes || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM placed WHERE due > 0)",
    ]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, {keys}, tokens, tokens AS taken_tokens FROM (SELECT *, unnest(range(passes)) AS epoch FROM placed WHERE passes > 0)
UNION ALL SELECT doc_id, CAST(passes AS INTEGER), {keys}, tokens, CAST(least(tokens, remaining) AS BIGINT) FROM part WHERE remaining > 0"""
