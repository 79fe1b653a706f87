"""Language-model scoring: a gated recurrent network with a class-factored softmax, and the add-one unigram base beside it.

Counts of all tokens of all training rows are gathered by an exchange of packed hashes.  The network knows the
most frequent words; every other word belongs to a tail class by its shape (its last mark, its first letter beyond ASCII), and within
that class has the probability (c + 1) / (sum over the class + 1), the last 1 being that of an unseen word.  So the
score is a proper log10 probability of the whole text and can be compared with the base.

The network is trained by truncated backpropagation on every training document with a text, ``passes`` times at any
size of the corpus: first in one task on about ``first_tokens``, drawn by the hash of the text, then on all others in all
partitions at once, each from that start; the parts' weights are averaged by their tokens.  A document's state is carried
through to its end, however long it is.

Counts of frequent tokens are broadcast (``TOP`` at most); those of the rest are met by hash bucket.

Defined results: null, empty or word-free text: one token, the end.  No training rows: N = V = 0, the base is 0 by
its formula, and the network is as initialised.  Rows that repeat are scored each; a null id is not held out and not trained on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from .common import Scratch, arrow_rows, buckets, slices, table
from .gru import GRU, classes
from .language_id import held_out
from .words import _hash

#: Bound on the counts that are broadcast: 17 bytes each.
TOP = 1_000_000
TAILS = 27
END = np.uint64(0x2545F4914F6CDD1D)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of all tokens, each text's end included, and where each text begins (one entry more than texts)."""
    hashes, tails, at = [], [], [0]
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        n = 0
        lo = 0
        while lo < len(raw):
            hi = min(len(raw), lo + (1 << 22))
            while hi < len(raw) and raw[hi] not in b" \t\n\x0b\x0c\r":
                hi += 1
            data = np.frombuffer(raw, np.uint8)[lo:hi]
            h, s, e = _hash(data)
            if len(h):
                last = data[e - 1]
                mark = np.where(last == 44, 1, np.where(last == 46, 2, 0))
                high = np.flatnonzero(data >= 0xC0)
                letter = np.zeros(len(h), np.int64)
                if len(high):
                    k = np.searchsorted(high, s)
                    p = high[np.minimum(k, len(high) - 1)]
                    inside = (k < len(high)) & (p < e)
                    letter[inside] = 1 + (data[np.minimum(p[inside] + 1, len(data) - 1)] & 7)
                hashes.append(h)
                tails.append((mark * 9 + letter).astype(np.uint8))
                n += len(h)
            lo = hi
        hashes.append(np.array([END]))
        tails.append(np.zeros(1, np.uint8))
        at.append(at[-1] + n + 1)
    return (np.concatenate(hashes), np.concatenate(tails), np.array(at)) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.array(at))


def _deal(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    where = ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(n + 1))


def lm_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", words: int = 4_096, n_classes: int = 64, hidden: int = 24, first_tokens: int = 1_000_000, passes: int = 3) -> DataFrame:
    """(id_col, training, n_tokens, n_known, train_tokens, base_score, score) of each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    nb = buckets(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), training.alias("training")).withColumn("key", F.xxhash64(F.col("id").cast("string"), "text"))
    blob_schema = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("n", pa.binary()), ("g", pa.binary())])

    def count(batches):
        held, size = [], 0

        def merged():
            h, g, n = (np.concatenate(x) for x in zip(*held))
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            return u, g[first], np.bincount(inv, n).astype(np.int64)

        def flush():
            h, g, n = merged()
            order, ends = _deal(h, nb)
            out = [(k, h[o].tobytes(), n[o].astype(np.uint32).tobytes(), g[o].tobytes()) for k in range(nb) if len(o := order[ends[k] : ends[k + 1]])]
            c = list(zip(*out))
            return arrow_rows(blob_schema, bucket=c[0], h=c[1], n=c[2], g=c[3])

        for batch in batches:
            for part in slices(batch, "text"):
                h, g, _ = tokens(part.column("text").to_pylist())
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, g[first], n))
                size += len(u)
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    table_schema = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("n", pa.binary()), ("g", pa.binary()), ("total", pa.int64()), ("types", pa.int64()), ("by", pa.list_(pa.int64()))])

    def add(got: pa.Table) -> pa.Table:
        h, n, g = (np.concatenate([np.frombuffer(b, kind) for b in got.column(c).to_pylist()]) for c, kind in (("h", np.uint64), ("n", np.uint32), ("g", np.uint8)))
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        n, g = np.bincount(inv, n).astype(np.int64), g[first]
        by = np.bincount(g, n + 1, TAILS).astype(np.int64)
        return pa.Table.from_pylist([{"bucket": got.column("bucket")[0].as_py(), "h": u.tobytes(), "n": n.tobytes(), "g": g.tobytes(), "total": int(n.sum()), "types": len(u), "by": by.tolist()}], schema=table_schema)

    blob = "bucket int, h binary, n binary, g binary"
    counts = scratch.save(rows.where("training").select("text").mapInArrow(count, blob).groupBy("bucket").applyInArrow(add, blob + ", total long, types long, by array<long>"), tidy=True)
    sums = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0)), *(F.coalesce(F.sum(F.get("by", F.lit(k))), F.lit(0)) for k in range(TAILS))).first()
    N, V, by = int(sums[0]), int(sums[1]), np.array(sums[2:], np.float64)

    # the most frequent tokens, TOP at most: the least count that leaves so many, found from how many have each power of two
    at_least = [f"{2**k}" for k in range(40)]

    def powers(batches):
        for batch in batches:
            n = np.concatenate([np.frombuffer(b, np.int64) for b in batch.column("n").to_pylist()])
            yield arrow_rows(pa.schema([("n", pa.list_(pa.int64()))]), n=[[int((n >= 2**k).sum()) for k in range(40)]])

    have = counts.select("n").mapInArrow(powers, "n array<long>").agg(*(F.coalesce(F.sum(F.get("n", F.lit(k))), F.lit(0)).alias(f"p{k}") for k in range(len(at_least)))).first()
    least = next(2**k for k in range(40) if have[k] <= TOP)

    def frequent(batches):
        for batch in batches:
            cols = [np.concatenate([np.frombuffer(b, kind) for b in batch.column(c).to_pylist()]) for c, kind in (("h", np.uint64), ("n", np.int64), ("g", np.uint8))]
            ok = cols[1] >= least
            yield arrow_rows(pa.schema([("h", pa.int64()), ("n", pa.int64()), ("g", pa.int32())]), h=cols[0][ok].view(np.int64), n=cols[1][ok], g=cols[2][ok].astype(np.int32))

    got = counts.select("h", "n", "g").mapInArrow(frequent, "h long, n long, g int").toArrow()
    th, tn, tg = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy(), got.column("g").to_numpy()
    order = np.argsort(th)
    th, tn, tg = th[order], tn[order], tg[order].astype(np.uint8)

    # the network's words: the most frequent, the end always among them
    best = np.lexsort((th, -tn))[:words]
    if END not in th[best]:
        spot = np.searchsorted(th, END)
        best = np.r_[best[: words - 1], spot] if spot < len(th) and th[spot] == END else best
    vocab, vcounts, vtails = th[best], tn[best], tg[best]
    if END not in vocab:
        vocab, vcounts, vtails = np.r_[vocab, END], np.r_[vcounts, 0], np.r_[vtails, 0].astype(np.uint8)
    order = np.lexsort((vocab, -vcounts))
    vocab, vcounts, vtails = vocab[order], vcounts[order], vtails[order]
    in_tail = by - np.bincount(vtails, vcounts + (vcounts > 0), TAILS)
    cls, _, sizes = classes(vcounts + 1.0, n_classes)
    end = int(np.flatnonzero(vocab == END)[0])
    model = GRU.init(cls, sizes, TAILS, hidden, np.r_[vcounts, in_tail])
    lex = np.argsort(vocab)
    lookup = (vocab[lex], lex.astype(np.int32))

    def ids_of(h: np.ndarray, g: np.ndarray, lookup) -> np.ndarray:
        keys, ids = lookup
        k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[k] == h, ids[k], len(keys) + g.astype(np.int32)).astype(np.int32)

    # Training: documents by the hash of their text, first those of the start, then all others.
    chance = F.pmod(F.xxhash64("text", F.lit("train")), F.lit(1_000_000)) / 1_000_000
    weights_schema = pa.schema([("part", pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())])
    names = sorted(model.p)
    shapes = {k: model.p[k].shape for k in names}

    def pack(p: dict) -> np.ndarray:
        return np.concatenate([p[k].ravel() for k in names])

    def unpack(flat: np.ndarray) -> dict:
        out, lo = {}, 0
        for k in names:
            size = int(np.prod(shapes[k]))
            out[k] = flat[lo : lo + size].reshape(shapes[k]).astype(np.float32).copy()
            lo += size
        return out

    def trainer(start, rate: float):
        shared = spark.sparkContext.broadcast((pack(start), cls, sizes, lookup))

        def run(batches):
            flat, cls, sizes, lookup = shared.value
            net = GRU(unpack(flat), cls, sizes, TAILS)
            seen, held = 0, []
            for batch in batches:
                for part in slices(batch, "text"):
                    h, g, at = tokens(part.column("text").to_pylist())
                    ids = ids_of(h, g, lookup)
                    held += [ids[a:b] for a, b in zip(at[:-1], at[1:])]
                    if sum(map(len, held)) > 1_000_000:
                        net.train(held, end, passes=passes, rate=rate)
                        seen += sum(map(len, held))
                        held = []
            if held:
                net.train(held, end, passes=passes, rate=rate)
                seen += sum(map(len, held))
            if seen:
                from pyspark import TaskContext

                yield arrow_rows(weights_schema, part=[TaskContext.get().partitionId() % 16], tokens=[seen], weights=[pack(net.p).astype(np.float32).tobytes()])

        return run

    def mean(got: pa.Table) -> pa.Table:
        n = got.column("tokens").to_pylist()
        total = sum(np.frombuffer(w.as_py(), np.float32).astype(np.float64) * k for w, k in zip(got.column("weights"), n)) / sum(n)
        return pa.Table.from_pylist([{"part": got.column("part")[0].as_py(), "tokens": sum(n), "weights": total.astype(np.float32).tobytes()}], schema=weights_schema)

    weights = "part int, tokens long, weights binary"
    learn = rows.where("training and text is not null").select("text", chance.alias("chance"))
    if N:
        first = min(1.0, first_tokens / N)
        small = scratch.save(learn.where(F.col("chance") < first).select("text"))  # read in parallel, then one task learns from what was written
        got = small.coalesce(1).mapInArrow(trainer(model.p, 0.15), weights).collect()
        if got:
            model.p = unpack(np.frombuffer(got[0]["weights"], np.float32))
        if first < 1:
            more = learn.where(F.col("chance") >= first).select("text")
            got = more.mapInArrow(trainer(model.p, 0.04), weights).groupBy("part").applyInArrow(mean, weights).collect()  # 16 rows at most
            if got:
                total = sum(r["tokens"] for r in got)
                model.p = unpack(sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * r["tokens"] for r in got) / total)

    # Scoring: the network and the frequent tokens' counts here, the other tokens' counts by bucket.
    shared = spark.sparkContext.broadcast((pack(model.p), cls, sizes, lookup, th, tn))
    tail_log = np.log10(np.maximum(in_tail + 1, 1))
    scored_schema = pa.schema([("bucket", pa.int32()), ("id", rows_id := _arrow(rows.schema["id"].dataType)), ("key", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("net", pa.float64()), ("h", pa.binary()), ("keys", pa.binary())])
    del rows_id

    def score(batches):
        flat, cls, sizes, lookup, th, tn = shared.value
        net = GRU(unpack(flat), cls, sizes, TAILS)
        logs = np.log10(tn + 1.0)
        buffer, held = [], 0

        def spill():
            h, k = (np.concatenate(x) for x in zip(*buffer))
            order, ends = _deal(h, nb)
            out = [(b, h[o].tobytes(), k[o].tobytes()) for b in range(nb) if len(o := order[ends[b] : ends[b + 1]])]
            none = [None] * len(out)
            return arrow_rows(scored_schema, bucket=[o[0] for o in out], id=none, key=none, held=none, n_tokens=none, n_known=none, logs=none, net=none, h=[o[1] for o in out], keys=[o[2] for o in out])

        for batch in batches:
            for part in slices(batch, "text", 6_000_000):
                h, g, at = tokens(part.column("text").to_pylist())
                n = np.diff(at)
                ids = ids_of(h, g, lookup)
                net_score = net.score(ids, at, end)
                own = np.repeat(np.arange(len(n)), n)
                tail = ids >= len(lookup[0])
                u, inv = np.unique(h, return_inverse=True)
                at_u = np.minimum(np.searchsorted(th, u), max(0, len(th) - 1))
                top = th[at_u] == u if len(th) else np.zeros(len(u), bool)
                lu = np.where(top, logs[at_u], 0.0) if len(th) else np.zeros(len(u))
                known, value = top[inv], lu[inv]
                net_score += np.bincount(own, np.where(tail, value - tail_log[g], 0.0), len(n))
                total = np.bincount(own, value, len(n))
                keys = np.array(part.column("key").to_pylist(), np.int64)
                rare = np.flatnonzero(~known)
                if len(rare):
                    buffer.append((h[rare], keys[own[rare]]))
                    held += len(rare)
                none = [None] * len(n)
                yield arrow_rows(scored_schema, bucket=none, id=part.column("id"), key=keys, held=part.column("held"), n_tokens=n, n_known=np.bincount(own, known, len(n)).astype(np.int64), logs=total, net=net_score, h=none, keys=none)
                if held > 1_000_000:
                    yield spill()
                    buffer, held = [], 0
        if buffer:
            yield spill()

    scored = StructType().add("bucket", "integer").add("id", rows.schema["id"].dataType).add("key", LongType()).add("held", BooleanType()).add("n_tokens", LongType()).add("n_known", LongType()).add("logs", DoubleType()).add("net", DoubleType()).add("h", "binary").add("keys", "binary")
    done = scratch.save(rows.select("id", "key", "text", F.col("training").alias("held")).mapInArrow(score, scored), tidy=True)
    # every rare token with its count: buckets of counts and of tokens meet
    rare = done.where("bucket is not null").select("bucket", "h", F.lit(None).cast("binary").alias("n"), "keys").unionByName(counts.select("bucket", "h", "n", F.lit(None).cast("binary").alias("keys")))
    rare_schema = pa.schema([("key", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64())])

    def look(got: pa.Table) -> pa.Table:
        h, n, keys = (got.column(c).to_pylist() for c in ("h", "n", "keys"))
        of = [k for k in range(len(h)) if n[k] is not None]
        ch, cn = (np.frombuffer(h[of[0]], np.uint64), np.frombuffer(n[of[0]], np.int64)) if of else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        want = [k for k in range(len(h)) if n[k] is None]
        if not want or not len(ch):
            return rare_schema.empty_table()
        rh, rk = np.concatenate([np.frombuffer(h[k], np.uint64) for k in want]), np.concatenate([np.frombuffer(keys[k], np.int64) for k in want])
        at = np.minimum(np.searchsorted(ch, rh), len(ch) - 1)
        ok = ch[at] == rh
        u, inv = np.unique(rk[ok], return_inverse=True)
        return pa.Table.from_arrays([pa.array(u), pa.array(np.bincount(inv, minlength=len(u))), pa.array(np.bincount(inv, np.log10(cn[at[ok]] + 1.0), len(u)))], schema=rare_schema)

    found = rare.groupBy("bucket").applyInArrow(look, "key long, n_known long, logs double").groupBy("key").agg(F.sum("n_known").alias("k2"), F.sum("logs").alias("l2"))
    rows_out = done.where("bucket is null")
    copies = rows_out.groupBy("key").agg(F.count("*").alias("copies"))  # repeated rows share a key, and so its sums
    found = found.join(copies, "key").select("key", (F.col("k2") / F.col("copies")).cast("long").alias("k2"), (F.col("l2") / F.col("copies")).alias("l2"))
    out = rows_out.join(found, "key", "left")
    l2 = F.coalesce("l2", F.lit(0.0))
    base = F.col("logs") + l2 - F.col("n_tokens") * F.lit(math.log10(N + V + 1))
    return out.select(F.col("id").alias(id_col), F.col("held").alias("training"), "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"), F.lit(N).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("net") + l2).alias("score"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = lm_score(docs, ~held_out("doc_id", 7) & F.col("doc_id").isNotNull())
    return got.select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
