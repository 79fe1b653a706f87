"""Exact Jaccard links among sets that met in buckets, and their components, without pairing a group with itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, buckets, connected_components
from .words import overlap

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verifier(num: int, den: int):
    def verify(batches):
        for batch in batches:
            good = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = overlap(x, y)
                if den * both >= num * (len(x) + len(y) - both):
                    good.append((a, b))
            yield arrow_rows(EDGE, a=[g[0] for g in good], b=[g[1] for g in good])

    return verify


def linked(pairs: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that pass the exact check; sizes are compared before sets are moved."""
    lens = sets.select("id", (F.octet_length("tokens") / 8).cast("long").alias("n"))
    fit = pairs.join(lens.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(lens.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    fit = fit.where(F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")).select("a", "b")
    both = fit.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    return scratch.save(both.mapInArrow(verifier(num, den), "a long, b long"), tidy=True)


def components(members: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int, also: DataFrame | None = None, block: int = 256) -> DataFrame:
    """(id, component) by the links with 100 * Jaccard >= num * 100 / den among ids that share a sig.

    members: (sig, id), repeats allowed; sets: (id, tokens), sorted distinct 64-bit hashes as bytes; also: more edges (a, b).
    First each sig's members are checked against one centre, the member with the most sigs, as an original has of
    its copies.  Then what still meets across components is checked block by block, so that no link is lost and no list of
    pairs is made; what is in one component already needs no check.
    """
    uses = scratch.save(members.groupBy("id").agg(F.count("*").alias("uses")))
    ranked = members.join(uses, "id").withColumn("rank", F.struct(-F.col("uses"), "id"))
    centre = ranked.groupBy("sig").agg(F.min("rank").getField("id").alias("c"))
    star = members.join(centre, "sig").where("id != c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    star = scratch.save(star)
    edges = linked(star, sets, scratch, num, den)
    if also is not None:
        edges = edges.union(scratch.save(also.select("a", "b")))
    comps = connected_components(edges, scratch)
    placed = members.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("sig")
    open_ = scratch.save(placed.join(mixed, "sig"))
    if open_.isEmpty():
        return comps
    # clusters of documents that still meet, cut into blocks by the hash of the id; each pair of blocks is checked by itself
    low = open_.groupBy("sig").agg(F.min("id").alias("c"))
    cluster = connected_components(open_.join(low, "sig").select(F.col("id").alias("a"), F.col("c").alias("b")).distinct(), scratch)
    docs = open_.select("id", F.col("component").alias("label")).distinct().join(cluster.withColumnRenamed("component", "cluster"), "id")
    size = docs.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    docs = docs.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    docs = docs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # (a block by itself is a task of its own; in the others only pairs across the two blocks are looked at)
    docs = docs.select("id", "label", "own", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    tasks = buckets(scratch.spark, 8)
    got = docs.join(sets, "id").groupBy(F.pmod("task", F.lit(tasks)).alias("bucket")).applyInArrow(checker(num, den), "a long, b long")
    return connected_components(edges.union(scratch.save(got.distinct(), tidy=True)), scratch)


def checker(num: int, den: int):
    """Links of each task's rows (task, id, label, own, tokens)."""

    def check(got: pa.Table) -> pa.Table:
        task, own, label, ids, tokens = (got.column(c).to_pylist() for c in ("task", "own", "label", "id", "tokens"))
        task = np.array(task)
        order = np.argsort(task, kind="stable")
        a, b = [], []
        for group in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            side = np.array([own[k] for k in group])
            if len(group) > 1:
                for i, j in local_links([np.frombuffer(tokens[k], np.uint64) for k in group], num, den, [label[k] for k in group], side if (side != side[0]).any() else None):
                    a.append(ids[group[i]])
                    b.append(ids[group[j]])
        return pa.Table.from_batches([arrow_rows(EDGE, a=a, b=b)], EDGE)

    return check


#: Cells of a table of sets by members that is held at once.
DENSE = 20_000_000


def local_links(sets: list[np.ndarray], num: int, den: int, labels: list | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect what all links with Jaccard >= num / den among some sets connect.

    labels: equal ones are connected already; side: only pairs of different sides are looked at.  Few sets with many members
    in common are compared by one product of a table of sets by members; others by a prefix filter by the sets' own counts: of two linked
    sets, the least frequent members that may be missing and one more meet.
    """
    if len(sets) == 1:
        return []
    size = np.array([len(s) for s in sets])
    own = np.repeat(np.arange(len(sets)), size)
    distinct, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first: dict = {}
    parent = list(range(len(sets))) if labels is None else [first.setdefault(x, k) for k, x in enumerate(labels)]

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    if len(sets) >= 24 and len(sets) * len(distinct) <= DENSE:
        table = np.zeros((len(sets), len(distinct)), np.float32)
        table[own, token] = 1
        both = np.rint(table @ table.T).astype(np.int64)
        ok = den * both >= num * (size[:, None] + size - both)
        if side is not None:
            ok &= side[:, None] != side
        for i, j in zip(*np.nonzero(np.triu(ok, 1))):
            x, y = find(i), find(j)
            if x != y:
                parent[x] = y
                out.append((int(i), int(j)))
        return out
    order = np.lexsort((token, count[token], own))
    own, token = own[order], token[order]
    rank = np.arange(len(own)) - np.r_[0, np.cumsum(size)[:-1]][own]
    need = size + (-size * num // den) + 1  # size - ceil(size * num / den) + 1
    keep = (rank < need[own]) & (count[token] > 1)
    own, token = own[keep], token[keep]
    order = np.argsort(token, kind="stable")
    own, token = own[order], token[order]
    done = set()
    for group in np.split(own, np.flatnonzero(np.diff(token)) + 1):
        group = group.tolist()
        for k, i in enumerate(group):
            for j in group[:k]:
                if (i, j) in done or side is not None and side[i] == side[j] or find(i) == find(j):
                    continue
                done.add((i, j))
                if den * min(size[i], size[j]) >= num * max(size[i], size[j]):
                    both = overlap(sets[i], sets[j])
                    if den * both >= num * (size[i] + size[j] - both):
                        parent[find(i)] = find(j)
                        out.append((i, j))
    return out
