"""Exact substring deduplication by a distributed merge sort of suffixes.

A byte is removed if a string of ``size`` bytes over it also starts in a document with a smaller id.  Suffixes that can't take part are
left out first, by proof: among the ``gram``-byte strings of each window of ``size`` bytes the one with the least hash is an
anchor, so equal windows have equal anchors at equal places, and an anchor whose hash only one document has belongs to
no shared window.  The suffixes at the other anchors, with the bytes before them that a window can reach, are sorted into runs; runs go
front-coded (length of the prefix in common with the one before, then the rest) to the task of their range of
strings, where a loser tree merges them: each loser keeps the length of the prefix that it shares with what beat it, so
no byte known to be equal is compared again.  In the merged order suffixes with one anchor stand together, and each
window over the anchor is judged by the least id that has it.

Equal texts are one first: of copies all but the smallest id lose every byte, if they have ``size`` bytes.

Defined results: null or empty text: no bytes, nothing removed.  Texts shorter than ``size`` stay.  A row without id stays and is no
source.  Rows with one id are never each other's source.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructType

from .common import BROADCAST_KEYS, Scratch, arrow_rows, buckets, slices, table
from .words import mix, powers

_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))


def _zstd(data: bytes) -> bytes:
    return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbours of x (its length less n-1), by doubling."""
    have = 1
    while 2 * have <= n:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    return f(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def anchors(data: np.ndarray, size: int, gram: int, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text's windows, ties included; in pieces, so memory doesn't follow the text."""
    n, w = len(data), size - gram + 1
    at, hs = [], []
    for lo in range(0, max(0, n - size + 1), piece):
        # windows that start in [lo, hi) reach size bytes on; anchors that only windows before lo have are not for this piece
        hi = min(n - size + 1, lo + piece)
        part = data[lo : hi + size - 1]
        p, inv = powers(len(part) + 1)
        c = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * p[: len(part)], out=c[1:])
        h = mix((c[gram:] - c[:-gram]) * inv[: len(part) - gram + 1])
        least = _slide(h, w, np.minimum)
        padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        chosen = np.flatnonzero(_slide(padded, w, np.maximum) == h)
        at.append(chosen + lo)
        hs.append(h[chosen])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hs = np.concatenate(at), np.concatenate(hs)
    _, first = np.unique(at, return_index=True)
    return at[first], hs[first]


def contexts(data: np.ndarray, at: np.ndarray, size: int, gram: int) -> np.ndarray:
    """A row per anchor: the size bytes from it, the bytes before it backwards as far as a window reaches, and how many of both there are."""
    back = size - gram
    padded = np.concatenate([np.zeros(back, np.uint8), data, np.zeros(size, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, back + size)[at]
    out = np.empty((len(at), back + size + 2), np.uint8)
    out[:, :size] = rows[:, back:]
    out[:, size : size + back] = rows[:, :back][:, ::-1]
    out[:, -2] = np.minimum(at, back)
    out[:, -1] = np.minimum(len(data) - at, size)
    return out


def front_code(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct rows: the length in common with the row before, and the other bytes in a row."""
    common = np.zeros(len(keys), np.uint8)
    common[1:] = (keys[1:] != keys[:-1]).argmax(axis=1)
    return common, keys[np.arange(keys.shape[1]) >= common[:, None]]


def front_decode(common: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    keys = np.zeros((len(common), width), np.uint8)
    own = np.arange(width) >= common[:, None]
    keys[own] = rest
    row = np.arange(len(common))
    for j in range(width):
        keys[:, j] = keys[np.maximum.accumulate(np.where(own[:, j], row, 0)), j]
    return keys


def merge(runs: list[list[bytes]], commons: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Sorted order of the runs' strings, as the run of each next one, and the length each has in common with the one before.

    A loser tree.  A contender's known length is what it has in common with the last winner; of two contenders the
    longer wins without a look at bytes, and only equal lengths are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    ends = [len(r) for r in runs] + [0] * (k - len(runs))
    place = [0] * k
    known = [0] * k  # of the run's head with the last winner
    loser = [-1] * k
    width = len(runs[0][0]) if runs and runs[0] else 0
    rows = [c.tolist() for c in commons]

    def play(a: int, b: int) -> tuple[int, int]:
        """The winner and the loser; the loser's known length becomes that with the winner."""
        if a < 0 or place[a] >= ends[a]:
            return b, a
        if b < 0 or place[b] >= ends[b]:
            return a, b
        ha, hb = known[a], known[b]
        if ha > hb:
            return a, b
        if hb > ha:
            return b, a
        x, y = runs[a][place[a]], runs[b][place[b]]
        if x == y:
            known[max(a, b)] = width
            return (a, b) if a < b else (b, a)
        u, v = int.from_bytes(x[ha:], "big"), int.from_bytes(y[ha:], "big")
        h = width - ((u ^ v).bit_length() + 7) // 8
        if u < v:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        w, loser[node] = play(a, b)
        return w

    order, common = [], []
    w = build(1) if k > 1 else 0
    for _ in range(sum(ends)):
        order.append(w)
        common.append(known[w])
        place[w] += 1
        if place[w] < ends[w]:
            known[w] = rows[w][place[w]]
        node = (w + k) // 2
        while node:
            w, loser[node] = play(w, loser[node])
            node //= 2
    return order, common


def covered(keys: np.ndarray, group: np.ndarray, least: np.ndarray, size: int, gram: int) -> np.ndarray:
    """(keys, windows): the least id that has the window over the anchor, by its bytes before the anchor; the largest value where there is none."""
    back = size - gram
    text = np.concatenate([keys[:, size : size + back][:, ::-1], keys[:, :size]], axis=1)
    p, inv = powers(back + size + 1)
    c = np.zeros((len(keys), back + size + 1), np.uint64)
    np.cumsum(_BYTE[text] * p[: back + size], axis=1, out=c[:, 1:])
    salt = mix(group.astype(np.uint64) + np.uint64(1))
    out = np.full((len(keys), back + 1), np.iinfo(np.int64).max)
    for o in range(back + 1):
        ok = np.flatnonzero((keys[:, -2] >= o) & (keys[:, -1] >= size - o))
        if not len(ok):
            continue
        h = mix((c[ok, back - o + size] - c[ok, back - o]) * inv[back - o] + salt[ok])
        order = np.argsort(h, kind="stable")
        h = h[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        low = np.minimum.reduceat(least[ok][order], starts)
        out[ok[order], o] = np.repeat(low, np.diff(np.r_[starts, len(h)]))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, gram: int = 16, keep_text: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of each row, and the remaining text with keep_text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    nb = buckets(spark)
    width = 2 * size - gram + 2
    all_ = docs.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    long_ = F.octet_length("text") >= size
    classes = scratch.save(all_.where(long_ & F.col("id").isNotNull()).groupBy(digest.alias("digest")).agg(F.min("id").alias("rep")))
    n_classes = classes.count()
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")

    def beside(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_KEYS // 4 else df

    texts = all_.where(long_ & F.col("id").isNotNull()).withColumn("digest", digest)
    # one row of each text: copies go before anything is hashed
    texts = texts.join(beside(classes, n_classes), (texts["digest"] == classes["digest"]) & (texts["id"] == classes["rep"]), "left_semi").select("id", key.alias("key"), "text")

    anchor_schema = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary())])

    def found(batches):
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                hs, ids, keys = [], [], []
                for i, k, t in zip(*(part.column(c).to_pylist() for c in ("id", "key", "text"))):
                    h = np.unique(anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), size, gram)[1])
                    hs.append(h)
                    ids.append(np.full(len(h), i, np.int64))
                    keys.append(np.full(len(h), k, np.int64))
                h, i, k = np.concatenate(hs), np.concatenate(ids), np.concatenate(keys)
                where = ((h >> np.uint64(20)) % np.uint64(nb)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                ends = np.searchsorted(where[order], np.arange(nb + 1))
                # a bucket's rows of one document stand together: the documents with their numbers of rows follow
                out = []
                for b in range(nb):
                    o = order[ends[b] : ends[b + 1]]
                    if len(o):
                        starts = np.flatnonzero(np.r_[True, (i[o][1:] != i[o][:-1]) | (k[o][1:] != k[o][:-1])])
                        n = np.diff(np.r_[starts, len(o)])
                        out.append((b, h[o].tobytes(), np.c_[i[o][starts], n].tobytes(), k[o][starts].tobytes()))
                if out:
                    c = list(zip(*out))
                    yield arrow_rows(anchor_schema, bucket=c[0], h=c[1], ids=c[2], keys=c[3])

    shared_schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("h", pa.binary())])

    def shared(got: pa.Table) -> pa.Table:
        """The hashes that documents of different ids have, by document."""
        h = np.concatenate([np.frombuffer(b, np.uint64) for b in got.column("h").to_pylist()])
        pairs = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in got.column("ids").to_pylist()])
        keys = np.concatenate([np.frombuffer(b, np.int64) for b in got.column("keys").to_pylist()])
        own = np.repeat(np.arange(len(pairs)), pairs[:, 1])
        i = pairs[own, 0]
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        many = np.minimum.reduceat(i[order], starts) != np.maximum.reduceat(i[order], starts)
        keep = np.sort(order[np.repeat(many, np.diff(np.r_[starts, len(h)]))])
        h, own = h[keep].astype(np.uint32), own[keep]  # half of a hash: a wrong match lets a suffix in, and is no loss
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(pairs[own[cuts], 0]), pa.array(keys[own[cuts]]), pa.array([x.tobytes() for x in np.split(h, cuts[1:])] if len(cuts) else [], pa.binary())], schema=shared_schema)

    marked = scratch.save(texts.mapInArrow(found, "bucket int, h binary, ids binary, keys binary").groupBy("bucket").applyInArrow(shared, "id long, key long, h binary").groupBy("id", "key").agg(F.collect_list("h").alias("h")), tidy=True)

    def suffixes(part):
        """(keys, id, key, place) of the suffixes at a slice's shared anchors."""
        for i, k, t, hs in zip(*(part.column(c).to_pylist() for c in ("id", "key", "text", "h"))):
            data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            at, h = anchors(data, size, gram)
            ok = np.isin(h.astype(np.uint32), np.concatenate([np.frombuffer(b, np.uint32) for b in hs]))
            if ok.any():
                yield contexts(data, at[ok], size, gram), i, k, at[ok]

    work = texts.join(marked, ["id", "key"])
    # ranges of strings for the exchange, from a sample of at most about 200 documents' suffixes
    share = max(1, n_classes // 200)

    def sampled(batches):
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                got = [c[:: max(1, len(c) // 100), :size] for c, *_ in suffixes(part)]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for c in got for r in c], pa.binary())], names=["k"])

    few = marked.where(F.pmod(F.xxhash64("id", "key"), F.lit(share)) == 0)
    sample = sorted(texts.join(F.broadcast(few), ["id", "key"]).mapInArrow(sampled, "k binary").toArrow().column("k").to_pylist())
    splits = [sample[len(sample) * j // nb] for j in range(1, nb)] if sample else []
    splits = np.array(sorted({s[:gram] for s in splits}), f"S{gram}")

    run_schema = pa.schema([("bucket", pa.int32()), ("common", pa.binary()), ("rest", pa.binary()), ("n", pa.binary()), ("docs", pa.binary()), ("of", pa.binary()), ("places", pa.binary())])

    def runs(batches):
        held, total = [], 0

        def flush():
            keys = np.concatenate([x[0] for x in held])
            ids = np.concatenate([np.full(len(x[0]), x[1], np.int64) for x in held])
            own = np.concatenate([np.full(len(x[0]), x[2], np.int64) for x in held])
            places = np.concatenate([x[3] for x in held]).astype(np.int64)
            order = np.argsort(np.ascontiguousarray(keys).view(f"S{width}").ravel(), kind="stable")
            keys, ids, own, places = keys[order], ids[order], own[order], places[order]
            new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
            starts = np.flatnonzero(new)
            n = np.diff(np.r_[starts, len(keys)])
            single = keys[starts]
            where = np.searchsorted(splits, np.ascontiguousarray(single[:, :gram]).view(f"S{gram}").ravel(), side="right")
            cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                common, rest = front_code(single[a:b])
                lo, hi = starts[a], starts[b] if b < len(starts) else len(keys)
                # the documents of this part once, then which of them each suffix is of
                docs_, of = np.unique(np.c_[ids[lo:hi], own[lo:hi]], axis=0, return_inverse=True)
                parts = (common, rest, n[a:b].astype(np.uint32), docs_, of.ravel().astype(np.uint32), places[lo:hi])
                rows.append((int(where[a]), *(pa.compress(x.tobytes(), "zstd", asbytes=True) for x in parts)))
            c = list(zip(*rows))
            return arrow_rows(run_schema, **dict(zip(run_schema.names, c)))

        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                for x in suffixes(part):
                    held.append(x)
                    total += len(x[0])
                    if total > 300_000:
                        yield flush()
                        held, total = [], 0
        if held:
            yield flush()

    span_schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("spans", pa.binary())])

    def merged(got: pa.Table) -> pa.Table:
        def unpacked(column, kind):
            return [np.frombuffer(_zstd(b), kind) for b in got.column(column).to_pylist()]

        coded = list(zip(unpacked("common", np.uint8), unpacked("rest", np.uint8)))
        decoded = [front_decode(c, r, width) for c, r in coded]
        strings = [np.ascontiguousarray(d).view(f"V{width}").ravel().tolist() for d in decoded]
        order, common = merge(strings, [c for c, _ in coded])
        del strings
        run, common = np.array(order), np.array(common)
        sizes = np.array([len(d) for d in decoded])
        base = np.r_[0, np.cumsum(sizes)[:-1]]
        rank = np.empty(len(run), np.int64)
        for k in range(len(decoded)):
            rank[run == k] = base[k] + np.arange(sizes[k])
        n = np.concatenate(unpacked("n", np.uint32)).astype(np.int64)
        owners = np.concatenate([d.reshape(-1, 2)[of] for d, of in zip(unpacked("docs", np.int64), unpacked("of", np.uint32))])
        ids, keys = owners[:, 0].copy(), owners[:, 1].copy()
        places = np.concatenate(unpacked("places", np.int64))
        first = np.r_[0, np.cumsum(n)[:-1]]
        least = np.minimum.reduceat(ids, first)
        texts_ = np.concatenate(decoded)
        group = np.cumsum(common < gram)
        out = []
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        lo = 0
        while lo < len(run):  # whole groups, some ten thousand suffixes at a time
            k = np.searchsorted(edges, lo + 20_000)
            hi = int(edges[k]) if k < len(edges) else len(run)
            sel = rank[lo:hi]
            low = covered(texts_[sel], group[lo:hi], least[sel], size, gram)
            occ = np.repeat(first[sel] - np.r_[0, np.cumsum(n[sel])[:-1]], n[sel]) + np.arange(n[sel].sum())
            of = np.repeat(np.arange(len(sel)), n[sel])
            hit = low[of] < ids[occ][:, None]
            some = hit.any(axis=1)
            hit, occ = hit[some], occ[some]
            nearest = hit.argmax(axis=1)
            farthest = hit.shape[1] - 1 - hit[:, ::-1].argmax(axis=1)
            out.append(np.c_[ids[occ], keys[occ], places[occ] - farthest, places[occ] - nearest + size])
            lo = hi
        rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        cuts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(rows[cuts, 0]), pa.array(rows[cuts, 1]), pa.array([x[:, 2:].tobytes() for x in np.split(rows, cuts[1:])] if len(cuts) else [], pa.binary())], schema=span_schema)

    spans = scratch.save(work.mapInArrow(runs, "bucket int, common binary, rest binary, n binary, docs binary, of binary, places binary").groupBy("bucket").applyInArrow(merged, "id long, key long, spans binary").groupBy("id", "key").agg(F.collect_list("spans").alias("spans")), tidy=True)

    out_schema = StructType().add(id_col, docs.schema[id_col].dataType)
    for c in ("n_bytes", "n_removed", "n_spans"):
        out_schema = out_schema.add(c, LongType())
    out_schema = out_schema.add("kept_sha256", StringType())
    if keep_text:
        out_schema = out_schema.add("text", StringType())
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out_schema.fields])

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for t, rep, i, spans_ in zip(*(part.column(c).to_pylist() for c in ("text", "rep", "id", "spans"))):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    gone, n = [], len(raw)
                    if rep is not None and i > rep:
                        gone = [(0, n)]
                    elif spans_:
                        s = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in spans_])
                        s = s[np.argsort(s[:, 0], kind="stable")]
                        reach = np.maximum.accumulate(s[:, 1])
                        new = np.flatnonzero(np.r_[True, s[1:, 0] > reach[:-1]])
                        gone = list(zip(s[new, 0].tolist(), reach[np.r_[new[1:] - 1, len(s) - 1]].tolist()))
                    kept, at = [], 0
                    for a, b in gone:
                        kept.append(raw[at:a])
                        at = b
                    rest = b"".join(kept) + raw[at:]
                    rows.append((n, n - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if keep_text else None))
                c = list(zip(*rows)) if rows else [[]] * 5
                cols = [part.column("own"), *(pa.array(c[k], arrow.field(k + 1).type) for k in range(len(arrow) - 1))]
                yield pa.RecordBatch.from_arrays(cols, names=arrow.names)

    final = all_.withColumn("digest", F.when(long_ & F.col("id").isNotNull(), digest))
    final = final.join(beside(classes, n_classes), "digest", "left").withColumn("key", key)
    spans = spans.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "spans")
    final = final.join(spans, (F.col("id") == F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return final.select("own", "id", "text", "rep", "spans").mapInArrow(cut, out_schema)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
