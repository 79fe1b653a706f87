"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors are one first, with their number.  Centroids are fitted on a bounded sample; every vector goes to its ``overlap`` nearest
ones' shards, and a shard too large for one task is cut into blocks, each pair of which is a task.  Each task builds a
graph by insertion, in batches that double: what a greedy search from the medoid finds near a new vector is pruned so that none is
kept that a kept one already leads to (robust pruning, factor ``alpha``), edges back are added, and lists that grow too long are pruned
again.  A vector's adjacency lists of all its tasks are united.  Then each task searches the
united graph, as far as it holds its vectors, for each of its vectors: greedily from the medoid with a beam of ``beam``, then
over everything linked to what is within the range, until nothing new is.  What is found is verified in double precision, after an
exact scaling by a power of two, so that no norm over- or underflows.
A pair in several tasks counts in the first of them.  A bounded set of vectors is compared with all by brute force; while the
share of their links that was found is below ``recall``, the build is repeated with more overlap and a wider beam, and
after ``tries`` builds a recall that is still too low is an error.  The measured recall is logged.

Defined results: a vector that is null, zero, or holds a null, NaN or infinite component links with nothing; vectors of different
lengths don't link.  Rows with one id and different vectors are one vector of several places.  A null id keeps its row, unlinked, with
null component.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, connected_components, table

#: Bounds: vectors that centroids are fitted on, centroids, vectors of a block, and queries of the audit.
SAMPLE, CENTROIDS, BLOCK, AUDIT = 20_000, 4_096, 1_500, 256


def _scaled(x: np.ndarray) -> np.ndarray:
    """x by powers of two, the largest component of each vector in [0.5, 1)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


#: Products or gathered neighbours that are held at once.
CHUNK = 2_000_000


def _dots(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """x[i] . y[j], a bounded part at a time."""
    step = max(1, CHUNK // x.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0, x.dtype)])


def centroids(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, -(-len(x) // 2_000))])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        full = np.linalg.norm(total, axis=1) > 0
        c[full] = _unit(total[full])
    return c


def _prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of rows of candidates (-1: none) of the vectors own: kept ones, -1 beyond."""
    order = np.argsort(-np.where(cand >= 0, sims, -3), axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
    alive = (cand >= 0) & (cand != own[:, None])
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]  # the same candidate twice stands side by side
    every, picked = np.arange(len(own)), np.full((len(own), degree), -1)
    dist = 2 - 2 * sims
    vectors = x[cand]
    for r in range(degree):
        first = alive.argmax(axis=1)
        has = alive[every, first]
        if not has.any():
            break
        star = cand[every, first]
        picked[has, r] = star[has]
        alive[every, first] = False
        # what the kept neighbour leads to well enough is not kept
        near = 2 - 2 * np.einsum("ij,ikj->ik", x[star], vectors)
        alive &= ~(has[:, None] & (alpha**2 * near <= dist))
    return picked


def greedy(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: int, beam: int, reach: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
    """Beam search of the queries q from start over the lists near: the beam's ids (len(x): none) and similarities, what was
    seen, and the queries and ids of all that were seen with similarity >= reach."""
    n, m, width = len(x), len(q), near.shape[1]
    seen = np.zeros((m, n + 1), bool)
    seen[:, start] = True
    ids = np.full((m, beam), n)
    sims = np.full((m, beam), -2.0, x.dtype)
    ids[:, 0], sims[:, 0] = start, q @ x[start]
    open_ = np.zeros((m, beam), bool)
    open_[:, 0] = True
    every = np.arange(m)
    hit = sims[:, 0] >= reach
    found_q, found_i = [every[hit]], [np.full(int(hit.sum()), start)]
    while True:
        best = np.where(open_, sims, -3.0).argmax(axis=1)
        act = np.flatnonzero(open_[every, best])
        if not len(act):
            return ids, sims, seen, found_q, found_i
        node = ids[act, best[act]]
        open_[act, best[act]] = False
        nb = near[node]
        fresh = (nb >= 0) & ~seen[act[:, None], nb]
        r, c = np.nonzero(fresh)
        qi, ni = act[r], nb[r, c]
        seen[qi, ni] = True
        s = _dots(q, x, qi, ni)
        hit = s >= reach
        found_q.append(qi[hit])
        found_i.append(ni[hit])
        grid = np.full((len(act), width), -2.0, x.dtype)
        grid[r, c] = s
        both = np.concatenate([sims[act], grid], axis=1)
        top = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        sims[act] = np.take_along_axis(both, top, axis=1)
        ids[act] = np.take_along_axis(np.concatenate([ids[act], np.where(fresh, nb, n)], axis=1), top, axis=1)
        open_[act] = np.take_along_axis(np.concatenate([open_[act], fresh], axis=1), top, axis=1)


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def build(x: np.ndarray, degree: int, near: int, alpha: float, seed: int) -> list[np.ndarray]:
    """Adjacency lists of unit vectors, by insertion: each batch is as large as what is in already, 256 at most."""
    n = len(x)
    width = degree + degree // 2
    lists, count = np.full((n, width), -1), np.zeros(n, np.int64)
    rnd = np.random.default_rng(seed)
    start = medoid(x)
    rest = rnd.permutation(n)
    rest = rest[rest != start]
    done = 0
    while done < len(rest):
        new = rest[done : done + min(256, done + 1)]
        ids, sims, _, _, _ = greedy(x, lists, x[new], start, min(near, done + 1))
        picked = _prune(x, new, np.where(ids < n, ids, -1), sims, degree, alpha)
        lists[new, :degree] = picked
        count[new] = (picked >= 0).sum(axis=1)
        # edges back; a list without room for all of them is pruned with them
        a, b = np.repeat(new, degree), picked.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        to, first, many = np.unique(b, return_index=True, return_counts=True)
        place = np.arange(len(b)) - np.repeat(first, many)
        fits = np.repeat(count[to] + many <= width, many)
        lists[b[fits], count[b[fits]] + place[fits]] = a[fits]
        ok = count[to] + many <= width
        count[to[ok]] += many[ok]
        for k in np.flatnonzero(~ok).tolist():
            t = to[k]
            cand = np.unique(np.r_[lists[t, : count[t]], a[first[k] : first[k] + many[k]]])[None]
            kept = _prune(x, np.array([t]), cand, _dots(x, x, np.full(cand.shape[1], t), cand[0])[None], degree, alpha)[0]
            lists[t] = -1
            lists[t, :degree] = kept
            count[t] = (kept >= 0).sum()
        done += len(new)
    return [v[v >= 0] for v in lists]


def search(x: np.ndarray, links: list[np.ndarray], reach: float, beam: int, most: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of unit vectors with similarity >= reach; all are queries, in blocks of most."""
    n = len(x)
    width = max(1, max(map(len, links)))
    near = np.full((n, width), -1)
    for k, v in enumerate(links):
        near[k, : len(v)] = v
    start = medoid(x)
    qs, hits = [], []
    for lo in range(0, n, most):
        q = x[lo : lo + most]
        _, _, seen, found_q, found_i = greedy(x, near, q, start, min(beam, n), reach)
        # a query is itself within its range, wherever the greedy search went
        own = np.arange(len(q))
        fresh = ~seen[own, lo + own]
        seen[own, lo + own] = True
        found_q.append(own[fresh])
        found_i.append(lo + own[fresh])
        # the range expands over the links of all that is inside it
        fq, fi = np.concatenate(found_q), np.concatenate(found_i)
        out_q, out_i = [fq], [fi]
        while len(fq):
            step_q, step_i = [], []
            for k in range(0, len(fq), CHUNK // width + 1):  # what is gathered at once is bounded
                nb = near[fi[k : k + CHUNK // width + 1]]
                qi = np.repeat(fq[k : k + CHUNK // width + 1], width)
                ni = nb.ravel()
                ok = (ni >= 0) & ~seen[qi, ni]
                code = np.unique(qi[ok] * (n + 1) + ni[ok])
                qi, ni = code // (n + 1), code % (n + 1)
                seen[qi, ni] = True
                hit = _dots(q, x, qi, ni) >= reach
                step_q.append(qi[hit])
                step_i.append(ni[hit])
            fq, fi = np.concatenate(step_q), np.concatenate(step_i)
            out_q.append(fq)
            out_i.append(fi)
        qs.append(np.concatenate(out_q) + lo)
        hits.append(np.concatenate(out_i))
    return np.concatenate(qs), np.concatenate(hits)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, overlap: int = 2, degree: int = 20, near: int = 64, alpha: float = 1.2, beam: int = 48, recall: float = 0.97, tries: int = 5) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row of vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.col("v"))).withColumn("mark", F.when(F.col("v").isNotNull(), F.md5(F.to_json(F.struct("v")).cast("binary"))))
    classes = scratch.save(rows.where("mark is not null").groupBy("mark").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")))
    n_classes = classes.count()
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    member_schema = pa.schema([("task", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("shards", pa.list_(pa.int32()))])
    share = max(1, n_classes // SAMPLE)
    fitted = {}
    for d, n in sizes.items():
        got = classes.where((F.size("v") == d) & (F.pmod(F.xxhash64("mark"), F.lit(share)) == 0)).select("v").limit(SAMPLE).toArrow()
        x = np.array(got.column("v").to_pylist(), np.float64).reshape(-1, d)
        k = min(CENTROIDS, -(-n // (BLOCK // 2)), max(1, len(x)))
        fitted[d] = centroids(_unit(x), k) if len(x) else np.ones((1, d)) / np.sqrt(d)
    shared = spark.sparkContext.broadcast(fitted)

    def shards(overlap: int):
        def run(batches):
            for batch in batches:
                out = []
                for i, n, v in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "v"))):
                    c = shared.value[len(v)]
                    s = c @ _unit(np.array(v))
                    out.append((i, n, v, sorted(np.argsort(-s, kind="stable")[:overlap].tolist())))
                cols = list(zip(*out)) if out else [[]] * 4
                yield arrow_rows(pa.schema([f for f in member_schema if f.name != "task"]), id=cols[0], n=cols[1], v=cols[2], shards=cols[3])

        return run

    def attempt(overlap: int, beam: int) -> DataFrame:
        placed = scratch.save(classes.select("id", "n", "v").mapInArrow(shards(overlap), "id long, n long, v array<double>, shards array<int>"))
        each = placed.select("*", F.explode("shards").alias("shard"), F.size("v").alias("d"))
        counts = each.groupBy("d", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        # a shard of several blocks is a task for each pair of blocks
        each = each.join(counts, ["d", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        task = F.concat_ws("/", "d", "shard", F.least("block", "other"), F.greatest("block", "other"))
        members = scratch.save(each.select(task.alias("task"), "id", "n", "v", "shards", "shard", "block"))
        near_schema = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int64()))])

        def graph(got: pa.Table) -> pa.Table:
            ids = np.array(got.column("id").to_pylist())
            x = _unit(np.array(got.column("v").to_pylist())).astype(np.float32)
            links = build(x, degree, near, alpha, len(ids))
            return pa.Table.from_arrays([pa.array(ids), pa.array([ids[k] for k in links], pa.list_(pa.int64()))], schema=near_schema)

        lists = members.groupBy("task").applyInArrow(graph, "id long, near array<long>")
        united = scratch.save(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
        found_schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

        def look(got: pa.Table) -> pa.Table:
            ids, n, shard, block = (np.array(got.column(c).to_pylist()) for c in ("id", "n", "shard", "block"))
            exact = np.array(got.column("v").to_pylist())
            order = np.argsort(ids, kind="stable")
            sorted_ids = ids[order]
            links = []
            for other in got.column("near").to_pylist():
                other = np.array(other or [], np.int64)
                at = np.minimum(np.searchsorted(sorted_ids, other), len(ids) - 1)
                links.append(order[at[sorted_ids[at] == other]])
            x = _unit(exact)
            a, b = search(x.astype(np.float32), links, least - 1e-5, beam)
            pairs = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
            a, b = pairs // len(ids), pairs % len(ids)
            ok = ids[a] != ids[b]
            if len(np.unique(block)) > 1:
                ok &= block[a] != block[b]  # a block by itself is another task
            a, b = a[ok], b[ok]
            exact = _scaled(exact)
            dots = _dots(exact, exact, a, b)
            norms = np.linalg.norm(exact, axis=1)
            ok = dots / (norms[a] * norms[b]) >= least
            # a pair counts in the first shard that has both
            sets = [set(s) for s in got.column("shards").to_pylist()]
            ok[ok] = [min(sets[i] & sets[j]) == shard[0] for i, j in zip(a[ok].tolist(), b[ok].tolist())]
            a, b = a[ok], b[ok]
            total = (np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))).astype(np.int64)
            root = np.arange(len(ids))
            while True:  # least place that is reachable
                before = root.copy()
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
                root = root[root]
                if (root == before).all():
                    break
            keep = total > 0
            return pa.Table.from_arrays([pa.array(ids[keep]), pa.array(total[keep]), pa.array(ids[root[keep]])], schema=found_schema)

        return scratch.save(members.join(united, "id").select("task", "id", "n", "v", "shards", "shard", "block", "near").groupBy("task").applyInArrow(look, "id long, links long, root long"))

    def audited(found: DataFrame) -> float:
        """The share of links that was found, of a bounded set of vectors compared with all."""
        some = classes.where(F.pmod(F.xxhash64("mark", F.lit("audit")), F.lit(max(1, n_classes // AUDIT))) == 0).select("mark", "id", "n", "v").limit(2 * AUDIT).collect()
        if not some:
            return 1.0
        asked = spark.sparkContext.broadcast([(r["id"], r["v"]) for r in some])

        def compare(batches):
            total = [0] * len(asked.value)
            for batch in batches:
                ids, n, vs = (batch.column(c).to_pylist() for c in ("id", "n", "v"))
                by: dict[int, list[int]] = {}
                for k, v in enumerate(vs):
                    by.setdefault(len(v), []).append(k)
                for d, at in by.items():
                    x = _unit(np.array([vs[k] for k in at]))
                    own, weight = np.array([ids[k] for k in at]), np.array([n[k] for k in at])
                    for k, (i, q) in enumerate(asked.value):
                        if len(q) == d:
                            total[k] += int(weight[(x @ _unit(np.array(q)) >= least) & (own != i)].sum())
            yield arrow_rows(pa.schema([("id", pa.int64()), ("true", pa.int64())]), id=[i for i, _ in asked.value], true=total)

        true = classes.select("id", "n", "v").mapInArrow(compare, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
        got = found.groupBy("id").agg(F.sum("links").alias("links"))
        sums = true.join(got, "id", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0))))).first()
        return sums[1] / sums[0] if sums[0] else 1.0

    found = None
    for k in range(tries):
        found = attempt(overlap + k, beam * 2**k)
        share_found = audited(found)
        logging.getLogger(__name__).info("recall %.4f with %d shards a vector and a beam of %d", share_found, overlap + k, beam * 2**k)
        if share_found >= recall:
            break
    else:
        raise RuntimeError(f"after {tries} builds the recall is {share_found:.4f}, less than {recall}")
    several = rows.where("mark is not null").join(classes.select("mark", F.col("id").alias("rep")), "mark").where("id != rep")
    edges = found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    edges = edges.union(several.select(F.col("id").alias("a"), F.col("rep").alias("b")).join(classes.select(F.col("id").alias("a")), "a", "left_semi"))
    comps = connected_components(edges, scratch)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = classes.select("mark", F.col("id").alias("rep"), "n").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = by_class.select("mark", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    out = rows.select("id", "mark").join(by_class, "mark", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
