"""Least costs source by source: a task holds the whole graph and searches it for its sources, so nothing is written but the answer.
What becomes of walks to goals goes the same way, and so do all ways to goals.  64 sources or goals go at once, in the bits of a word for each
node; answers are made node by node, as columns that hold few values for long are written fast and small.

For graphs of a bounded number of edges, which are sent to the tasks; fixpoint's rounds do the same for all others.  Weights are integers
and not negative.  Nodes that no edge has are reached only where a search starts there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges (of all graphs that are searched side by side) that are sent to tasks, and states (sources times nodes) that are searched at once.
EDGES, STATES = 1_000_000, 1 << 20
FAR = np.iinfo(np.int64).max
#: Sources or goals that are searched at once: the bits of a word; and the largest weight of edges that are searched so.
BITS, LIGHT = 64, 64


def _spread(at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges at[k] to at[k + 1] of each node k given, and where each node's edges begin among them."""
    many = at[node + 1] - at[node]
    first = np.cumsum(many) - many
    return np.repeat(at[node] - first, many) + np.arange(many.sum()), first


def _joined(node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node once, with all bits of its words."""
    if not len(node):
        return node, word
    order = np.argsort(node)
    node = node[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    return node[first], np.bitwise_or.reduceat(word[order], first)


def _unpacked(word: np.ndarray, many: int) -> np.ndarray:
    """The first bits of each word, as a row of truths."""
    return np.unpackbits(word.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, count=many, bitorder="little").view(bool)


class Graph:
    """Edges by their source: those of node k are dst[at[k]:at[k + 1]]; nodes are numbered in their order."""

    def __init__(self, nodes: pa.Array, edges: pa.Table):
        number = lambda c: pc.index_in(edges[c], value_set=nodes).to_numpy()
        src, dst, weight = number("src"), number("dst"), edges["weight"].to_numpy()
        order = np.argsort(src, kind="stable")
        self.src, self.dst, self.weight = src[order], dst[order].astype(np.int64), weight[order].astype(np.int64)
        self.at = np.searchsorted(self.src, np.arange(len(nodes) + 1))
        self.parts = None
        if not len(self.weight) or self.weight.max() <= LIGHT:
            self.parts = [Light(self.src[on], self.dst[on], len(nodes), w) for w in np.unique(self.weight).tolist() for on in [self.weight == w]]

    def together(self, at: np.ndarray, start: np.ndarray, sources: int, n: int, most: int | None) -> np.ndarray:
        """Cost of node k from source s at [k, s], the type's greatest number where there is no way; source at[i] starts at node start[i]."""
        if self.parts is None:
            return self.costs(at, start, sources, n, most).reshape(sources, n).T
        cost, seen, full = np.full((n, sources), 255, np.uint8), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        todo = {0: [_joined(start, np.uint64(1) << at.astype(np.uint64))]}
        while todo:
            c = min(todo)  # LIGHT + 1 at most; edges of weight 0 lead to the same cost
            got = todo.pop(c)
            if len(got) == 1:
                node, word = got[0]
            elif 8 * sum(len(k) for k, _ in got) > n:
                for k, w in got:
                    full[k] |= w
                node = np.flatnonzero(full)
                word = full[node]
                full[node] = 0
            else:
                node, word = _joined(*(np.concatenate(x) for x in zip(*got)))
            word = word & ~seen[node]
            node, word = node[word != 0], word[word != 0]
            if not len(node):
                continue
            seen[node] |= word
            if c >= 255 and cost.dtype == np.uint8:
                cost = np.where(cost == 255, np.iinfo(np.int32).max, cost.astype(np.int32))
            less = cost.dtype.type(np.iinfo(cost.dtype).max - c)  # each is set once; faster than by a choice
            if 3 * len(node) > n:
                full[node] = word
                cost -= _unpacked(full, sources) * less
                full[node] = 0
            else:
                cost[node] -= _unpacked(word, sources) * less
            for part in self.parts:
                if most is None or c + part.weight <= most:
                    to = part.step(node, word, seen, full)
                    if len(to[0]):
                        todo.setdefault(c + part.weight, []).append(to)
        return cost

    def costs(self, at: np.ndarray, start: np.ndarray, sources: int, n: int, most: int | None) -> np.ndarray:
        """Cost of node k from source s at s * n + k, FAR where there is no way; source at[i] starts at node start[i]."""
        cost, mark = np.full(sources * n, FAR), np.empty(sources * n, np.int64)
        todo, heap = {0: [at * n + start]}, [0]
        while heap:
            c = heapq.heappop(heap)
            while c in todo:  # edges of weight 0 lead to the same cost
                got = np.concatenate(todo.pop(c))
                got = got[cost[got] == FAR]
                cost[got] = c
                mark[got] = np.arange(len(got))
                got = got[mark[got] == np.arange(len(got))]  # each once
                node = got % n
                many = self.at[node + 1] - self.at[node]
                edge = np.repeat(self.at[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
                to, w = np.repeat(got - node, many) + self.dst[edge], self.weight[edge]
                on = cost[to] == FAR
                to, w = to[on], w[on]
                order = np.argsort(w, kind="stable")
                to, w = to[order], w[order]
                kinds, first = np.unique(w, return_index=True)
                for k, part in zip(kinds.tolist(), np.split(to, first[1:])):
                    if most is not None and c + k > most:
                        continue
                    if c + k not in todo:
                        todo[c + k] = []
                        if k:
                            heapq.heappush(heap, c + k)
                    todo[c + k].append(part)
        return cost

    def before(self, cost: np.ndarray, sources: int, n: int) -> np.ndarray:
        """The least node that a cheapest way to each node comes from, -1 where there is none, for weights of 1."""
        via = np.full(sources * n, -1)
        for s in range(0, sources * n, n):
            one = cost[s : s + n]
            on = np.flatnonzero((one[self.src] != FAR) & (one[self.src] == one[self.dst] - 1))[::-1]
            via[s + self.dst[on]] = self.src[on]  # edges are in the order of their sources: the least is written last
        return via


class Light:
    """The edges of one weight."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int, weight: int):
        self.weight, self.dst, self.at = weight, dst, np.searchsorted(src, np.arange(n + 1))
        order = np.argsort(dst, kind="stable")
        self.src_in = src[order]
        self.ends, self.first = np.unique(dst[order], return_index=True)

    def step(self, node: np.ndarray, word: np.ndarray, seen: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes after node, each once, with those bits of word that they have not seen; full: zeros."""
        many = self.at[node + 1] - self.at[node]
        if 8 * many.sum() < len(self.dst):
            edge, _ = _spread(self.at, node)
            to = self.dst[edge]
            new = np.repeat(word, many) & ~seen[to]
            return _joined(to[new != 0], new[new != 0])
        full[node] = word
        new = np.bitwise_or.reduceat(full[self.src_in], self.first) & ~seen[self.ends]
        full[node] = 0
        return self.ends[new != 0], new[new != 0]


def small(*graphs: DataFrame) -> bool:
    """Whether written graphs (cut()) can be sent to tasks."""
    return sum(g._rows for g in graphs) <= EDGES


def searchable(start: DataFrame, state: str, edges: DataFrame) -> bool:
    """Whether nodes have one type and weights are integers that are neither null nor negative."""
    kinds = {start.schema[state].dataType, edges.schema["src"].dataType, edges.schema["dst"].dataType}
    if len(kinds) > 1 or kinds.pop().typeName() not in ("long", "integer", "string"):
        return False
    if edges.schema["weight"].dataType.typeName() not in ("long", "integer"):
        return False
    return edges.where("weight is null or weight < 0").isEmpty()


def _paths(via: np.ndarray, nodes: pa.Array, cost: np.ndarray, hit: np.ndarray) -> pa.Array:
    """Nodes before each of hit, the nearest first."""
    n, ends = len(nodes), np.concatenate([[0], np.cumsum(cost[hit])])
    out, at, on = np.empty(ends[-1], np.int64), ends[:-1].copy(), hit
    while len(on):
        go = via[on] >= 0
        on, at = on[go], at[go]
        out[at] = via[on]
        on, at = on - on % n + via[on], at + 1
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes.take(pa.array(out)))


def _least(cost: np.ndarray, nodes: pa.Array, states: int, keep: list[pa.Array], out: list[str], number: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of each node's states, which are side by side, the one of the least cost (a row for each state), node by node; costs of other sources are other columns."""
    node, rest = np.divmod(nodes.to_numpy(zero_copy_only=False), states)
    at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
    many = cost.shape[1]
    for low in range(0, len(at) - 1, step := max(1, STATES // (many * states))):
        ends = at[low : low + step + 1]
        some = cost[ends[0] : ends[-1]]
        key = np.where(some == np.iinfo(some.dtype).max, FAR, some.astype(np.int64) * states + rest[ends[0] : ends[-1], None])
        best = np.minimum.reduceat(key, ends[:-1] - ends[0], axis=0).ravel()
        hit = np.flatnonzero(best != FAR)
        c, r = np.divmod(best[hit], states)
        row = pa.array(hit % many)
        yield pa.RecordBatch.from_arrays([*(k.take(row) for k in keep), pa.array(node[ends[:-1]][hit // many]), pa.array(r.astype(np.int32)), pa.array(c).cast(number)], out)


def by_source(start: DataFrame, graphs: list[DataFrame], keep: list[str], state: str, names: list[str], kind: str = "long", most: int | None = None, path: str | None = None, text: bool = False, states: int = 1) -> DataFrame:
    """(keep..., state, a cost for each graph): all that start's rows (keep..., state) lead to in some graph; null: not in this one.

    graphs: written tables (src, dst, weight); path: a column more, the nodes before state on the first graph's way, the nearest first (weights of 1); text: as a text with commas.
    states: so many numbers from k * states on are states of node k; the answer has the node, its state of the least cost and then number (rest), and that cost
    (one graph, in which starts have edges).
    """
    spark = start.sparkSession
    tables = [g.select("src", "dst", "weight").toArrow() for g in graphs]  # EDGES at most
    nodes = pa.chunked_array([c for t in tables for c in (*t["src"].chunks, *t["dst"].chunks)], type=tables[0].schema.field("src").type).unique()
    nodes = nodes.take(pc.array_sort_indices(nodes))
    sent = spark.sparkContext.broadcast((nodes, [Graph(nodes, t) for t in tables]))
    fields = [start.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{state}` {start.schema[state].dataType.simpleString()}", *(["rest int"] if states > 1 else []), *(f"`{c}` {kind}" for c in names), *([f"`{path}` " + ("string" if text else f"array<{start.schema[state].dataType.simpleString()}>")] if path else [])])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, graphs = sent.value
        n = max(1, len(nodes))
        named = nodes.cast(pa.string()) if text else nodes
        said = (lambda paths: pc.binary_join(paths, ",")) if text else (lambda paths: paths)
        size, number = min(BITS, max(1, 4 * STATES // n)), pa.int64() if kind == "long" else pa.int32()
        out = [*keep, state, *names, *([path] if path else [])]
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                b = batch.slice(k, size)
                starts = b.column("__start")
                at, value = pc.list_parent_indices(starts).to_numpy(), starts.flatten()
                found = pc.index_in(value, value_set=nodes)
                apart = pc.is_null(found)
                alone, zero = value.filter(apart), pa.array(np.zeros(pc.sum(apart).as_py() or 0, np.int64)).cast(number)
                if len(alone):  # no edge has these
                    row = pa.array(at).filter(apart)
                    none = [pa.ListArray.from_arrays(pa.array(np.zeros(len(alone) + 1), pa.int32()), named.slice(0, 0))] if path else []
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in keep), alone, *([zero] * len(names)), *map(said, none)], out)
                known = ~apart.to_numpy(zero_copy_only=False)
                at, first = at[known], found.drop_null().to_numpy()
                if not len(first):
                    continue
                many = b.num_rows
                costs = [g.together(at, first, many, n, most) for g in graphs]
                if path:
                    cost = np.where(costs[0] == np.iinfo(costs[0].dtype).max, FAR, costs[0].astype(np.int64)).T.ravel()
                    hit = np.flatnonzero(cost != FAR)
                    via = graphs[0].before(cost, many, n)
                    # long paths in parts of about STATES nodes
                    for hit in np.split(hit, np.flatnonzero(np.diff(np.cumsum(cost[hit]) // STATES)) + 1):
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(hit // n)) for c in keep), nodes.take(pa.array(hit % n)), pa.array(cost[hit]).cast(number), said(_paths(via, named, cost, hit))], out)
                    continue
                if states > 1:
                    yield from _least(costs[0], nodes, states, [b.column(c) for c in keep], [*keep, state, "rest", *names], number)
                    continue
                for low in range(0, n, max(1, STATES // many)):
                    part = [c[low : low + max(1, STATES // many)].ravel() for c in costs]
                    far = [c == np.iinfo(c.dtype).max for c in part]
                    hit, here = ~np.logical_and.reduce(far), len(part[0]) // many
                    row, node = np.tile(np.arange(many, dtype=np.int32), here), np.repeat(np.arange(low, low + here, dtype=np.int32), many)
                    if not hit.all():
                        row, node, part, far = row[hit], node[hit], [c[hit] for c in part], [f[hit] for f in far]
                    got = [pa.array(c.astype(number.to_pandas_dtype()), mask=f if f.any() else None) for c, f in zip(part, far)]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in keep), nodes.take(pa.array(node)), *got], out)

    # few rows with much work each: dealt out by number, which adaptive plans leave alone
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    sources = start.where(F.col(state).isNotNull()).groupBy(*keep).agg(F.collect_set(state).alias("__start")).repartition(tasks)
    return sources.mapInArrow(rows, schema)


class Walks:
    """A graph of numbered nodes, and the fixpoints of what holds of a node for all or for some of its edges' ends; a word has a bit for each goal."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        by_src, by_dst, ends = np.argsort(src, kind="stable"), np.argsort(dst, kind="stable"), np.arange(n + 1)
        self.n, self.dst, self.at = n, dst[by_src], np.searchsorted(src[by_src], ends)
        self.src_in, self.at_in = src[by_dst], np.searchsorted(dst[by_dst], ends)
        self.inner = np.flatnonzero(np.diff(self.at))  # nodes with edges
        self.endless = self.fixpoint(np.where(np.diff(self.at) > 0, ~np.uint64(0), np.uint64(0)), np.bitwise_or, np.bitwise_and, self.inner)

    def fixpoint(self, value: np.ndarray, of: np.ufunc, with_: np.ufunc, todo: np.ndarray) -> np.ndarray:
        """Joins, with with_, to each node of todo what of makes of its edges' ends, and goes on with those before the nodes that change, to the end."""
        while len(todo):
            edge, first = _spread(self.at, todo)
            new = with_(value[todo], of.reduceat(value[self.dst[edge]], first))
            changed = todo[new != value[todo]]
            value[todo] = new
            if 4 * len(changed) > self.n:
                todo = self.inner
            else:
                todo = np.unique(self.src_in[_spread(self.at_in, changed)[0]]) if len(changed) else changed
        return value

    def bits(self, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A bit for each goal at its node (-1: no edge has it), and the nodes before goals."""
        here, bits = np.flatnonzero(goal >= 0), np.zeros(self.n, np.uint64)
        np.bitwise_or.at(bits, goal[here], np.uint64(1) << here.astype(np.uint64))
        return bits, np.unique(self.src_in[_spread(self.at_in, np.unique(goal[here]))[0]])

    def looping(self, goal: np.ndarray) -> np.ndarray:
        """From which nodes some walk never ends, where walks end at the goal."""
        bits, todo = self.bits(goal)
        return self.fixpoint(self.endless & ~bits, np.bitwise_or, np.bitwise_and, todo)

    def divided(self, goal: np.ndarray) -> np.ndarray:
        """From which nodes some walk ends at the goal and another ends elsewhere or never."""
        bits, todo = self.bits(goal)
        some = self.fixpoint(bits.copy(), np.bitwise_or, np.bitwise_or, todo)
        return some & ~self.fixpoint(bits, np.bitwise_and, np.bitwise_or, todo)


def by_goal(goals: DataFrame, edges: DataFrame, what: str) -> DataFrame:
    """(goal, node): for each row of goals (goal, kind) the nodes that are looping or divided (what; see Walks).

    edges: a written table (src, dst, kind); a goal's graph has the edges of its kind and those of none (null), without those out of the goal.
    """
    spark = goals.sparkSession
    table = edges.select("src", "dst", "kind").toArrow()  # EDGES at most
    nodes = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], type=table.schema.field("src").type).unique()
    nodes = nodes.take(pc.array_sort_indices(nodes))
    number = lambda c: pc.index_in(table[c], value_set=nodes).to_numpy().astype(np.int64)
    sent = spark.sparkContext.broadcast((nodes, number("src"), number("dst"), table["kind"].combine_chunks()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, src, dst, kinds = sent.value
        graphs: dict = {}
        waiting: dict = {}

        def found(kind, goal: pa.Array) -> Iterator[pa.RecordBatch]:
            if kind not in graphs:
                on = _of_kind(kinds, kind)
                graphs[kind] = Walks(src[on], dst[on], len(nodes))
            at = pc.index_in(goal, value_set=nodes).fill_null(-1).to_numpy().astype(np.int64)
            value = getattr(graphs[kind], what)(at)
            for low in range(0, len(nodes), STATES // BITS):
                hit = np.flatnonzero(_unpacked(value[low : low + STATES // BITS], len(goal)))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([goal.take(pa.array(hit % len(goal))), nodes.take(pa.array(low + hit // len(goal)))], ["goal", "node"])

        for batch in batches:
            for goal, kind in zip(batch.column("goal"), batch.column("kind").to_pylist()):
                waiting.setdefault(kind, []).append(goal)
                if len(waiting[kind]) == BITS:
                    yield from found(kind, pa.array([g.as_py() for g in waiting.pop(kind)], goal.type))
        for kind, some in waiting.items():
            yield from found(kind, pa.array([g.as_py() for g in some], some[0].type))

    kind = goals.schema["goal"].dataType.simpleString()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return goals.repartition(tasks).mapInArrow(rows, f"goal {kind}, node {kind}")


#: How ways end, by number.
WAYS = ["LOOP", "ACCEPTED", "TTL_EXPIRED", "NO_ROUTE"]
#: Ways that a task lists, so that a file's dictionary has all their texts (1 MB), and goals for which each is said before the next (a run of packed numbers in a file is 504 long).
WAYS_IN_TASK, TOGETHER = 8192, 504


class Ways:
    """All ways over numbered nodes, of at most so many hops."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int, most: int):
        self.src, self.dst = np.divmod(np.unique(src * n + dst), max(1, n))  # an edge of a kind and of none is one
        self.at, self.most = np.searchsorted(self.src, np.arange(n + 1)), most
        self.ends = np.diff(self.at) == 0

    def bound(self, start: np.ndarray) -> float:
        """No more ways than this lead from start's nodes."""
        many = np.ones(len(self.ends))
        for _ in range(self.most):
            many = np.where(self.ends, 1, np.bincount(self.src, many[self.dst], len(self.ends)))
        return many[start].sum()

    def of(self, start: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k, nodes, number of the end) of each way from start[k], ended at goal[k] if it comes there (-1: no goal); -1 fills nodes up."""
        parts = []
        row, path = np.arange(len(start)), start.astype(np.int32)[:, None]

        def add(on: np.ndarray, end: np.ndarray) -> None:
            full = np.full((int(on.sum()), self.most + 1), -1, np.int32)
            full[:, : path.shape[1]] = path[on]
            parts.append((row[on], full, end[on]))

        for left in range(self.most, -1, -1):
            node = path[:, -1]
            here, ends = node == goal[row], self.ends[node]
            stop = here | ends | (left == 0)
            add(stop, np.where(here, 1, np.where(ends, 3, 2)))
            row, path = row[~stop], path[~stop]
            if not len(row):
                break
            edge, _ = _spread(self.at, path[:, -1])
            k = np.repeat(np.arange(len(row)), self.at[path[:, -1] + 1] - self.at[path[:, -1]])
            to = self.dst[edge].astype(np.int32)
            again = (path[k] == to[:, None]).any(axis=1)
            row, path = row[k], np.column_stack([path[k], to])
            add(again, np.zeros(len(row), np.int64))
            row, path = row[~again], path[~again]
        return tuple(np.concatenate(x) for x in zip(*parts))


def _first(group: np.ndarray, path: pa.Array, times: np.ndarray, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows, each times over, of each group only the first by path (None: all), and how many rows their groups have."""
    order = pc.sort_indices(pa.table({"g": group, "p": path}), [("g", "ascending"), ("p", "ascending")]).to_numpy()
    order = np.repeat(order, times[order])
    by = group[order]
    begin = np.searchsorted(by, by)
    keep = np.arange(len(by)) - begin < (len(by) if first is None else first)
    return order[keep], np.searchsorted(by, by[keep], "right") - begin[keep]


def _graph(edges: DataFrame, starts: DataFrame) -> tuple:
    """(nodes, src, dst, kinds, start, times): edges (src, dst, kind) and starts (node, times) with nodes numbered in their order."""
    table, of = edges.select("src", "dst", "kind").toArrow(), starts.select("node", "times").toArrow()  # EDGES at most
    nodes = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks, *of["node"].chunks], type=table.schema.field("src").type).unique()
    nodes = nodes.take(pc.array_sort_indices(nodes))
    number = lambda c: pc.index_in(c, value_set=nodes).to_numpy().astype(np.int64)
    return nodes, number(table["src"]), number(table["dst"]), table["kind"].combine_chunks(), number(of["node"]), of["times"].to_numpy()


def _of_kind(kinds: pa.Array, kind) -> np.ndarray:
    """Which edges goals of a kind have."""
    return pc.or_kleene(pc.is_null(kinds), pc.equal(kinds, pa.scalar(kind, kinds.type))).fill_null(False).to_numpy(zero_copy_only=False)


def ways(goals: DataFrame, starts: DataFrame, edges: DataFrame, most: int, first: int | None) -> DataFrame | None:
    """(goal, start, path, disposition, traces): for each row of goals (goal, kind, times) all ways from starts (node, times), or the first by path.

    edges: a written table (src, dst, kind); a goal's graph has the edges of its kind and those of none (null), without those out of the goal.
    A task lists the ways of a kind from its starts once, and then for each goal only from those that have it on their way.  Its answer goes way by way, each for TOGETHER goals,
    so that columns hold few values for long.  None: too many for a task.
    """
    spark = goals.sparkSession
    graph = _graph(edges, starts)
    nodes, src, dst, kinds, start, _ = graph
    every = [np.ones(0, bool) if not len(kinds) else _of_kind(kinds, k) for k in (kinds.unique().to_pylist() or [None])]
    if max(Ways(src[on], dst[on], len(nodes), most).bound(start) for on in every) > STATES:
        return None
    to = goals.select("goal", "kind", "times").toArrow()  # EDGES at most
    sent = spark.sparkContext.broadcast((graph, to))
    names = ["goal", "start", "path", "disposition", "traces"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    ways_in_all = sum(Ways(src[on], dst[on], len(nodes), most).bound(start) for on in every)
    tasks = int(max(1, min(len(start), max(tasks, ways_in_all // WAYS_IN_TASK + 1))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (nodes, src, dst, kinds, start, times), goals = sent.value
        n, said, ends = len(nodes), nodes.cast(pa.string()), pa.array(WAYS)
        order = np.argsort(start, kind="stable")

        def text(path: np.ndarray) -> pa.Array:
            return pc.binary_join_element_wise(*(said.take(pa.array(c, mask=c < 0)) for c in path.T), ">", null_handling="skip")

        def found(w: Ways, start: np.ndarray, times: np.ndarray, listed: tuple, goal: pa.Array, m: int, cut: tuple) -> Iterator[pa.RecordBatch]:
            who, by = listed
            from_, path, end, traces = cut
            to = pc.index_in(goal, value_set=nodes).fill_null(-1).to_numpy().astype(np.int64)
            own = [who[by[g] : by[g + 1]] if g >= 0 else who[:0] for g in to]
            of, who_ = np.repeat(np.arange(len(goal)), [len(o) for o in own]), np.concatenate(own)
            rest = np.ones((len(start), len(goal)), bool)
            rest[who_, of] = False
            step = max(1, STATES // len(goal))
            turn = np.argsort(~rest.all(axis=1)[from_], kind="stable")  # ways with fewer goals come last, as the others' rows repeat
            for low in range(0, len(turn), step):
                way, k = np.nonzero(rest[from_[turn[low : low + step]]])
                if len(way):
                    way = pa.array(turn[way + low])
                    yield pa.RecordBatch.from_arrays([goal.take(pa.array(k)), nodes.take(pa.array(start[from_])).take(way), path.take(way), ends.take(pa.array(end)).take(way), pa.array(traces).take(way)], names)
            if len(of):
                row, path, end = w.of(start[who_], to[of])
                path = text(path)
                few, traces = _first(row, path, times[who_[row]] * m, first)
                row = row[few]
                yield pa.RecordBatch.from_arrays([goal.take(pa.array(of[row])), nodes.take(pa.array(start[who_[row]])), path.take(pa.array(few)), ends.take(pa.array(end[few])), pa.array(traces)], names)

        for batch in batches:
            for task in batch.column("id").to_pylist():
                mine = order[len(order) * task // tasks : len(order) * (task + 1) // tasks]
                first_, many = start[mine], times[mine]
                for kind in goals["kind"].unique().to_pylist():
                    of_kind = goals.filter(pc.is_null(goals["kind"]) if kind is None else pc.equal(goals["kind"], pa.scalar(kind, goals["kind"].type)))
                    on = _of_kind(kinds, kind)
                    w = Ways(src[on], dst[on], n, most)
                    at, path, end = w.of(first_, np.full(len(mine), -1))
                    # who has a node on a way: those of node k are who[by[k]:by[k + 1]]
                    met = np.unique(path.ravel().astype(np.int64) * max(1, len(mine)) + np.repeat(at, most + 1))
                    met = met[met >= 0]
                    listed = met % max(1, len(mine)), np.searchsorted(met // max(1, len(mine)), np.arange(n + 1))
                    path = text(path)
                    for m in of_kind["times"].unique().to_pylist():
                        few, traces = _first(at, path, many[at] * m, first)
                        cut = at[few], path.take(pa.array(few)), end[few], traces
                        goal = of_kind.filter(pc.equal(of_kind["times"], m))["goal"].combine_chunks()
                        for low in range(0, len(goal), TOGETHER):
                            yield from found(w, first_, many, listed, goal.slice(low, TOGETHER), m, cut)

    kind = goals.schema["goal"].dataType.simpleString()
    return spark.range(0, tasks, 1, tasks).mapInArrow(rows, f"goal {kind}, start {kind}, path string, disposition string, traces long")
