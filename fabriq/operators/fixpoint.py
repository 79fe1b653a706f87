"""Fixpoints by semi-naive rounds: only what the last round learned is joined again.

A round is one written table, counted as it is written; edges are written once before the first.  What is known is
the union of the rounds' tables, merged into one where they become many.  Null nodes meet nothing and are dropped with the first join.
Searches from many sources over one graph that fits a task go source by source (search.py): their answers are as large as sources times nodes,
and rounds would write them several times.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import search
from .lineage import counted, cut

#: Tables of rounds that are read side by side.
PARTS = 12
#: Rounds after which there should have been a fixpoint; who asks for fewer gets rounds, and an error after them.
ROUNDS = 10_000
#: Edges with a null end lead nowhere.
ENDS = "src is not null and dst is not null"


class Known:
    """The union of the rounds' tables; merge: what becomes of them when they are made one."""

    def __init__(self, first: DataFrame, merge: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.parts, self.merge = [first], merge

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)
        if len(self.parts) > PARTS:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        return self.merge(reduce(DataFrame.unionByName, self.parts))


def _ones(edges: DataFrame) -> DataFrame:
    """edges (src, dst) with weights of 1; written tables stay known as such."""
    out = edges.withColumn("weight", F.lit(1).cast("long"))
    out._rows = edges._rows
    return out


def side_by_side(start: DataFrame, one: DataFrame, two: DataFrame, keep: list[str], state: str = "node") -> DataFrame:
    """(keep..., state, one, two): all that start's rows lead to over one or two (src, dst), with the fewest hops over each; null: none."""
    a, b = (cut(e.where(ENDS).select("src", "dst").distinct()) for e in (one, two))
    if search.small(a, b) and all(search.searchable(start, state, _ones(e)) for e in (a, b)):
        return search.by_source(start, [_ones(a), _ones(b)], keep, state, ["one", "two"], "int")
    got = [reach(start.where(F.col(state).isNotNull()), e, state, keep).withColumnRenamed("hops", c) for e, c in ((a, "one"), (b, "two"))]
    return got[0].join(got[1], [*keep, state], "full")


def reach(start: DataFrame, edges: DataFrame, state: str = "node", keep: list[str] = (), rounds: int = ROUNDS) -> DataFrame:
    """(keep..., state, hops): all that start's rows lead to over edges (src, dst, and keep's columns where edges have them); hops: the fewest."""
    keys = [*keep, state]
    on = [c for c in keep if c in edges.columns]
    edges = cut(edges.where(ENDS).select(*on, "src", "dst").distinct())
    if keep and not on and rounds >= ROUNDS and search.small(edges):
        one = _ones(edges)
        if search.searchable(start, state, one):
            null = start.where(F.col(state).isNull()).select(*keys).distinct().withColumn("hops", F.lit(0))
            return search.by_source(start, [one], list(keep), state, ["hops"], "int").unionByName(null)
    new = cut(start.select(*keys).distinct().withColumn("hops", F.lit(0)))
    known = Known(new)
    for k in range(1, rounds + 1):
        step = new.join(edges.withColumnRenamed("src", state), [*on, state]).select(*keep, F.col("dst").alias(state)).distinct()
        new, n = counted(step.join(known.all().select(*keys), keys, "left_anti").withColumn("hops", F.lit(k)))
        if not n:
            return known.all()
        known.add(new)
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def least_cost(start: DataFrame, edges: DataFrame, source: str = "source", most: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(source, node, cost): least cost from start's (source, node) over edges (src, dst, weight); most: paths dearer than it don't exist."""
    low = lambda df: df.groupBy(source, "node").agg(F.min("cost").alias("cost"))
    edges = cut(edges.where(ENDS).groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    if rounds >= ROUNDS and search.small(edges) and search.searchable(start, "node", edges):
        null = start.where("node is null").select(source, "node").distinct().withColumn("cost", F.lit(0).cast("long"))
        return search.by_source(start, [edges], [source], "node", ["cost"], most=most).unionByName(null)
    new = cut(start.select(source, "node").distinct().withColumn("cost", F.lit(0).cast("long")))
    known = Known(new, low)
    for _ in range(rounds):
        step = new.join(edges.withColumnRenamed("src", "node"), "node").select(source, F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"))
        step = low(step.where(F.col("cost") <= most) if most is not None else step)
        old = known.all().withColumnRenamed("cost", "__old")
        new, n = counted(step.join(old, [source, "node"], "left").where("__old is null or cost < __old").select(source, "node", "cost"))
        if not n:
            return known.all()
        known.add(new)
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def least_state(start: DataFrame, edges: DataFrame, states: int, source: str = "source") -> DataFrame:
    """(source, node, rest, cost): least_cost() between states k * states + rest of nodes k (integers); of each node the state of the least cost, and then of the least rest."""
    own = start.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("weight"))  # starts are in the graph
    edges = cut(edges.select("src", "dst", F.col("weight").cast("long").alias("weight")).unionByName(own).where(ENDS).groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    if search.small(edges) and search.searchable(start, "node", edges) and start.schema["node"].dataType.typeName() == "long":
        null = start.where("node is null").select(source, "node").distinct().select(source, "node", F.lit(None).cast("int").alias("rest"), F.lit(0).cast("long").alias("cost"))
        return search.by_source(start, [edges], [source], "node", ["cost"], states=states).unionByName(null)
    got = least_cost(start, edges, source).withColumn("__rest", F.pmod("node", F.lit(states)).cast("int"))
    got = got.select(source, F.expr(f"(node - __rest) div {states}").alias("node"), F.struct("cost", F.col("__rest").alias("rest")).alias("b"))
    return got.groupBy(source, "node").agg(F.min("b").alias("b")).select(source, "node", "b.rest", "b.cost")


def path_texts(origins: DataFrame, edges: DataFrame) -> DataFrame:
    """(prefix, node, size, path): path_vector() with the path as a text with commas, and how many nodes it has."""
    edges = cut(edges.where(ENDS).select("src", "dst").distinct())
    if search.small(edges) and search.searchable(origins, "node", _ones(edges)):
        null = origins.where("node is null").select("prefix", "node").distinct().withColumns({"size": F.lit(0), "path": F.lit("")})
        return search.by_source(origins, [_ones(edges)], ["prefix"], "node", ["size"], "int", path="path", text=True).unionByName(null)
    got = path_vector(origins, edges)
    return got.select("prefix", "node", F.size("path").alias("size"), F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def path_vector(origins: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Best paths of each (prefix, node): shortest AS path, then the smallest next hop.

    origins: (prefix, node); edges: (src, dst), routes going from src to dst.  The path lists nodes, the nearest first.  As a shortest path
    has no node twice, lengths and next hops decide everything, and paths are put together at the end, by doubling.
    """
    edges = cut(edges.where(ENDS).select("src", "dst").distinct())
    if rounds >= ROUNDS and search.small(edges) and search.searchable(origins, "node", _ones(edges)):
        null = origins.where("node is null").select("prefix", "node").distinct()
        got = search.by_source(origins, [_ones(edges)], ["prefix"], "node", ["hops"], path="path").drop("hops")
        return got.unionByName(null.withColumn("path", F.array().cast(got.schema["path"].dataType)))
    size = cut(reach(origins, edges, keep=["prefix"], rounds=rounds))
    sent = size.join(edges.withColumnRenamed("src", "node"), "node").select("prefix", F.col("dst").alias("to"), F.col("node").alias("via"), (F.col("hops") + 1).alias("hops"))
    via = sent.join(size.withColumnRenamed("node", "to"), ["prefix", "to", "hops"]).groupBy("prefix", F.col("to").alias("node")).agg(F.min("via").alias("at"))
    paths = size.join(via, ["prefix", "node"], "left").select("prefix", "node", F.when(F.col("at").isNull(), F.expr("cast(array() as array<bigint>)")).otherwise(F.array("at")).alias("path"), "at")
    paths = cut(paths)
    for _ in range(64):
        on = paths.select("prefix", F.col("node").alias("at"), F.col("path").alias("more"), F.col("at").alias("next"))
        paths = cut(paths.join(on, ["prefix", "at"], "left").select("prefix", "node", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.col("next").alias("at")), paths)
        if paths.where("at is not null").isEmpty():
            return paths.select("prefix", "node", "path")
    raise RuntimeError("paths do not end")


def can_loop(hops: DataFrame, by: list[str], rounds: int = 100_000) -> DataFrame:
    """(by..., node): the states from which some walk over hops (by..., src, dst) never ends.

    States whose hops all lead to states that end are taken away, round by round; what is left can go on for ever.
    """
    hops = cut(hops.select(*by, "src", "dst").distinct())
    degree = cut(hops.groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("degree")))
    new = cut(hops.select(*by, F.col("dst").alias("node")).distinct().join(degree, [*by, "node"], "left_anti"))
    ended, met = Known(new), None
    for _ in range(rounds):
        step, n = counted(hops.join(new.withColumnRenamed("node", "dst"), [*by, "dst"]).groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("n")))
        if not n:
            return degree.select(*by, "node").join(ended.all(), [*by, "node"], "left_anti")
        if met is None:
            met = Known(step, lambda df: df.groupBy(*by, "node").agg(F.sum("n").alias("n")))
        else:
            met.add(step)
        total = met.all().join(step.select(*by, "node"), [*by, "node"], "left_semi")
        new = cut(total.join(degree, [*by, "node"]).where("n = degree").select(*by, "node"))
        ended.add(new)
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def _hops(goals: DataFrame, edges: DataFrame) -> DataFrame:
    """(goal, src, dst): the graph of each goal (goal, kind): edges (src, dst, kind) of its kind and of none, without those out of the goal."""
    on = goals.withColumnRenamed("kind", "__kind")
    hops = on.join(edges.where("kind is not null").withColumnRenamed("kind", "__kind"), "__kind").select("goal", "src", "dst")
    return hops.unionByName(on.crossJoin(edges.where("kind is null")).select("goal", "src", "dst")).where("src <> goal").distinct()


def walks(goals: DataFrame, edges: DataFrame, what: str) -> DataFrame:
    """(goal, node): looping: nodes from which some walk never ends; divided: those from which some walk ends at the goal and another elsewhere or never.

    goals: (goal, kind); edges: (src, dst, kind).  A goal's walks take the edges of its kind and those of none (null), and end where there is none, and at the goal.
    """
    goals = goals.where(F.col("goal").isNotNull()).distinct()
    edges = cut(edges.where(ENDS).select("src", "dst", "kind").distinct())
    types = {goals.schema["goal"].dataType, edges.schema["src"].dataType, edges.schema["dst"].dataType}
    if search.small(edges) and len(types) == 1 and types.pop().typeName() in ("long", "integer", "string"):
        return search.by_goal(goals, edges, what)
    hops = cut(_hops(goals, edges))
    endless = can_loop(hops, ["goal"])
    if what == "looping":
        return endless
    back = hops.select("goal", F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = hops.select("goal", F.col("dst").alias("node")).distinct().join(hops.select("goal", F.col("src").alias("node")), ["goal", "node"], "left_anti")
    to = lambda start: reach(start, back, keep=["goal"]).select("goal", "node")
    return to(ends.where("node = goal")).join(to(ends.where("node <> goal").unionByName(endless)), ["goal", "node"], "left_semi")


def ways(goals: DataFrame, starts: DataFrame, edges: DataFrame, most: int, first: int | None = None) -> DataFrame:
    """(goal, start, path, disposition, traces): all ways from starts (node) to goals (goal, kind), of at most most hops; first: so many by path; traces: all ways of the pair.

    Graphs as in walks(); a goal has one kind.  A way ends as ACCEPTED at the goal, as a LOOP where a node comes again, as NO_ROUTE where there is no edge, and as
    TTL_EXPIRED after most hops.  path: its nodes as a text, null from a null.  Nulls have no edges; rows that come more than once stay.
    """
    key = ["goal", "start"]
    edges = cut(edges.where(ENDS).select("src", "dst", "kind").distinct())
    types = {goals.schema["goal"].dataType, starts.schema["node"].dataType, edges.schema["src"].dataType, edges.schema["dst"].dataType}
    times = F.count("*").alias("times")
    to, of = cut(goals.groupBy("goal", "kind").agg(times)), cut(starts.groupBy("node").agg(times))
    got = null = None
    if search.small(edges, of, to) and len(types) == 1 and types.pop().typeName() in ("long", "integer", "string"):
        got = search.ways(to.where("goal is not null"), of.where("node is not null"), edges, most, first)
        null = F.col("goal").isNull() | F.col("start").isNull()
    # the rest, by rounds: all pairs, or those with nulls
    on = to.select("goal", "kind", F.col("times").alias("__m")).crossJoin(of.select("node", F.col("node").alias("start"), F.expr("times").alias("__n")))
    on = on.select(*key, "node", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m") * F.col("__n"))).alias("__copy"))
    if got is not None:
        if of.where("node is null").isEmpty() and to.where("goal is null").isEmpty():
            return got
        rest = on.where(null).select(*key, F.col("start").cast("string").alias("path"), F.lit("NO_ROUTE").alias("disposition"))
    else:
        rest = frontier_paths(on, _hops(to, edges), [*key, "__copy"], most=most)
        end = F.when(F.col("disposition") == "LOOP", "LOOP").when(F.col("node") == F.col("goal"), "ACCEPTED").when(F.col("disposition") == "LIMIT", "TTL_EXPIRED").otherwise("NO_ROUTE")
        rest = rest.select(*key, F.when(F.col("start").isNotNull(), F.array_join(F.transform("path", lambda x: x.cast("string")), ">")).alias("path"), end.alias("disposition"))
    if first is not None:
        rest = rest.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy("path")))
    rest = rest.withColumn("traces", F.count("*").over(Window.partitionBy(*key)))
    rest = rest.where(F.col("__k") <= first).drop("__k") if first is not None else rest
    return rest if got is None else got.unionByName(rest)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (src, dst); labels jump to their labels' labels each round."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both)
    label = cut(nodes.select(F.col("node"), F.col("node").alias("component")).distinct())
    for k in range(rounds):
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        nxt = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("was"))
        up = nxt.select(F.col("node").alias("component"), F.col("component").alias("top"))
        nxt = nxt.join(up, "component", "left").select("node", F.least("component", F.coalesce("top", "component")).alias("component"), "was")
        nxt = cut(nxt)
        if nxt.where("component != was").isEmpty():
            return label
        label = nxt.select("node", "component")
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def frontier_paths(start: DataFrame, hops: DataFrame, by: list[str], most: int = 64) -> DataFrame:
    """All paths of concrete probes: start (by..., node), hops (src, dst and those of by that hops depend on).  Ends where there is no hop, or as a loop where a node comes again.

    Returns (by..., node, path, disposition) with disposition DONE, LOOP or, after most hops, LIMIT.
    """
    on = [c for c in by if c in hops.columns]
    hops = cut(hops.select(*on, "src", "dst").distinct())
    live = cut(start.select(*by, "node", F.array("node").alias("path")))
    out = None
    for _ in range(most):
        nxt = live.join(hops.withColumnRenamed("src", "node"), [*on, "node"], "left")
        ended = nxt.where("dst is null").select(*by, "node", "path", F.lit("DONE").alias("disposition"))
        loops = nxt.where("dst is not null").where(F.array_contains("path", F.col("dst"))).select(*by, F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.lit("LOOP").alias("disposition"))
        done = cut(ended.unionByName(loops))
        out = done if out is None else out.unionByName(done)
        live = cut(nxt.where("dst is not null").where(~F.array_contains("path", F.col("dst"))).select(*by, F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        if live.isEmpty():
            return out
    # a probe whose hops are used up at an end has ended
    last = live.join(hops.select(*on, F.col("src").alias("node")).distinct().withColumn("__on", F.lit(True)), [*on, "node"], "left")
    return out.unionByName(last.select(*live.columns, F.when(F.col("__on"), "LIMIT").otherwise("DONE").alias("disposition")))
