"""Substring deduplication by MinHash banding of paragraphs.

Paragraphs are the lines of a text, and, because a repeated passage often stands inside other lines, also pieces whose
ends are set by the words themselves (a word whose hash with its follower is the least within ``reach`` words on
both sides begins a piece), so that one passage is cut alike wherever it stands.  Each line of ``least_words`` words or
more has a MinHash over its five-word shingles, in bands tuned by ``tune`` for the wanted recall; lines that collide are
verified by exact Jaccard >= num/den, and components of them are one repeated passage.  Pieces, which are short, are
one passage where they are equal.  Pieces end at marks, not where a repeat ends, so every run of ``run_words`` words that
a document with a smaller id has is found too: of each such run the least ``least_words``-gram (the last of equal ones) is a
seed, and around seeds that two documents have, all runs are compared by equality.  The document with the smallest (id, position)
keeps a passage; the others lose it to its exact ends, where neighbouring repeats make up at least ``run_words`` words.

Equal texts are one first.  Colliding lines are checked in blocks of ``block`` lines, each pair of blocks by itself, with a
prefix filter inside, so a bucket of any size is spread, and a much changed copy meets no other.

Defined results: null or empty text: no paragraph, nothing removed, text stays null or empty.  A row without id stays
whole.  Rows with one id are never each other's source.  Repeats inside one document stay.  Removed words go with the
white space after them.  A passage is ``run_words`` words or more: a shorter line or run that documents share is no passage and stays.  A column that
is named as an output stays, with a leading underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import BROADCAST_KEYS, Scratch, arrow_rows, buckets, connected_components, fresh_names, release, slices, table
from .jaccard import EDGE, local_links
from .suffix_dedup import _slide
from .words import _SEP, _hash, chain, mix

#: Marks a piece among the numbers of a document's paragraphs.
PIECE = 1 << 30
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def tune(similarity: float, recall: float, rows: int = 3) -> tuple[int, int]:
    """The least number of bands of ``rows`` MinHashes that finds pairs of the similarity with the recall."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands, rows


class Paragraphs:
    """The words of some texts, and the spans of words (a to b) of their paragraphs: lines before pieces in each text."""

    def __init__(self, texts: list[str | None], reach: int, least_words: int, piece: int = 1 << 20):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.begins = np.cumsum([0] + [len(r) + 1 for r in raw])
        data = self.data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        hs, ss, es, lo = [], [], [], 0
        while lo < len(data):
            hi = min(len(data), lo + piece)
            while hi < len(data) and not _SEP[data[hi]]:
                hi += 1
            h, s, e = _hash(data[lo:hi])
            hs.append(h)
            ss.append(s + lo)
            es.append(e + lo)
            lo = hi
        self.h, self.s, self.e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
        n = len(self.h)
        self.at = np.searchsorted(self.s, self.begins)  # words of text k: at[k] to at[k+1]
        cuts = np.unique(np.r_[0, np.searchsorted(self.s, np.flatnonzero(data == 10)), n])
        follow = np.r_[self.h[1:], np.zeros(min(n, 1), np.uint64)]
        ends = self.at[1:][self.at[1:] > self.at[:-1]] - 1
        follow[ends] = 0
        mark = mix(self.h + (follow << np.uint64(1)))
        # texts stand apart by reach places of 0, so that no piece begins so near a text's ends
        text = np.searchsorted(self.at, np.arange(n), side="right") - 1
        place = np.arange(n) + reach * (text + 1)
        spread = np.zeros(n + reach * (len(texts) + 1), np.uint64)
        spread[place] = mark
        near = _slide(spread, reach, np.minimum)
        least = (near[place - reach] > mark) & (near[np.minimum(place + 1, len(near) - 1)] > mark) if n else np.zeros(0, bool)
        edges = np.unique(np.r_[self.at, np.flatnonzero(least), n])
        la, lb = cuts[:-1], cuts[1:]
        pa_, pb = edges[:-1], edges[1:]
        keep = lb - la >= least_words
        la, lb = la[keep], lb[keep]
        keep = (pb - pa_ >= least_words) & ~np.isin(pa_ * (n + 1) + pb, la * (n + 1) + lb)
        pa_, pb = pa_[keep], pb[keep]
        a, b, kind = np.r_[la, pa_], np.r_[lb, pb], np.r_[np.zeros(len(la), np.int64), np.ones(len(pa_), np.int64)]
        text = np.searchsorted(self.at, a, side="right") - 1
        order = np.lexsort((a, kind, text))
        self.a, self.b, self.kind, self.text = a[order], b[order], kind[order], text[order]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def number(self) -> np.ndarray:
        """Each paragraph's number in its text, with PIECE for pieces."""
        return np.arange(len(self.a)) - self.first[self.text] + PIECE * self.kind

    def seeds(self, k: int, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Words at which the least k-gram of any run of words inside one text begins, and these k-grams' hashes."""
        starts = self.starts(run)
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        grams = mix(chain(self.h, k) + np.uint64(k))
        width = run - k + 1
        view = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
        at = np.unique(starts + width - 1 - np.concatenate([view[x].argmin(axis=1) for x in np.array_split(starts, 1 + len(starts) // 100_000)]))
        return at, grams[at]

    def starts(self, run: int) -> np.ndarray:
        """Words at which a run inside one text begins."""
        i = np.arange(max(0, len(self.h) - run + 1))
        return i[i + run <= self.at[self.owner(i) + 1]]

    def owner(self, words: np.ndarray) -> np.ndarray:
        """The text of each of the words."""
        return np.searchsorted(self.at, words, side="right") - 1

    def content(self, pick: np.ndarray) -> np.ndarray:
        """A hash of the whole word sequence of each of the picked paragraphs."""
        p = np.full(len(self.h) + 1, np.uint64(0x9E3779B97F4A7C15))
        p[0] = 1
        p = np.multiply.accumulate(p)
        inv = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        q = np.full(len(self.h) + 1, inv)
        q[0] = 1
        q = np.multiply.accumulate(q)
        c = np.r_[np.uint64(0), np.cumsum(self.h * p[:-1])]
        a, b = self.a[pick], self.b[pick]
        return mix((c[b] - c[a]) * q[a] + (b - a).astype(np.uint64))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, recall: float = 0.98, reach: int = 5, least_words: int = 6, run_words: int = 15, n: int = 5, block: int = 256) -> DataFrame:
    """docs with text_col less what other documents have kept, and n_paragraphs, n_removed (runs of words), removed_words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    own = fresh_names(docs.columns, ["n_paragraphs", "n_removed", "removed_words", "__lost", "__copy", "__id", "__key", "__row"])
    docs, id_col, text_col = docs.withColumnsRenamed(own), own[id_col], own[text_col]
    nb = buckets(spark)
    bands, rows = tune(num / den, recall)
    row_key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key.alias("key")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    # equal texts: the smallest id stands for all, the others lose what they have
    digest = F.md5(F.col("text").cast("binary"))
    texts = scratch.save(plain.select("id", "key", digest.alias("digest")))
    classes = texts.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.save(texts.join(classes, "digest").where("id > rep").select("id", "key").distinct())
    n_copies = copies.count()
    single = plain.join(F.broadcast(copies) if n_copies <= BROADCAST_KEYS else copies, ["id", "key"], "left_anti")
    salts = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(bands * rows)]

    def dealt(sig, text, at, part):
        """Signatures by bucket, with their documents and places."""
        ids, keys = (np.array(part.column(c).to_pylist(), np.int64) for c in ("id", "key"))
        where = ((sig >> np.uint64(20)) % np.uint64(nb)).astype(np.int64)
        order = np.lexsort((at, text, where))
        ends = np.searchsorted(where[order], np.arange(nb + 1))
        out = []
        for k in range(nb):
            o = order[ends[k] : ends[k + 1]]
            if len(o):
                own = text[o]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                count = np.diff(np.r_[starts, len(o)])
                out.append((k, sig[o].tobytes(), np.c_[ids[own[starts]], keys[own[starts]], count].tobytes(), at[o].astype(np.int32).tobytes()))
        if out:
            c = list(zip(*out))
            yield arrow_rows(band_schema, bucket=c[0], sigs=c[1], docs=c[2], at=c[3])

    band_schema = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("docs", pa.binary()), ("at", pa.binary())])

    def banded(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                p = Paragraphs(part.column("text").to_pylist(), reach, least_words)
                number = p.number()
                lines, pieces = np.flatnonzero(p.kind == 0), np.flatnonzero(p.kind == 1)
                sigs, of = [p.content(pieces) if len(pieces) else np.zeros(0, np.uint64)], [pieces]
                if len(lines):
                    sh = chain(p.h, n)
                    pairs = np.c_[p.a[lines], p.b[lines] - n + 1].ravel()  # the even entries of reduceat are the lines
                    for b in range(bands):
                        sig = np.full(len(lines), np.uint64(b + 1))
                        for r in range(rows):
                            v = np.r_[mix(sh ^ salts[b * rows + r]), _MOST]
                            sig = mix(sig + np.minimum.reduceat(v, pairs)[::2])
                        sigs.append(sig)
                        of.append(lines)
                of = np.concatenate(of)
                at, grams = p.seeds(least_words, run_words)
                own = p.owner(at)
                # the places of runs and seeds are below zero
                yield from dealt(np.concatenate([*sigs, grams]), np.r_[p.text[of], own], np.r_[number[of], p.at[own] - at - 1], part)

    met_schema = pa.schema([("sig", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("at", pa.int32())])

    def meet(got: pa.Table, seeds: bool) -> pa.Table:
        """Paragraphs that have a signature in common with another document's; of equal pieces and runs only those that another keeps."""
        release()
        sig = np.concatenate([np.frombuffer(b, np.uint64) for b in got.column("sigs").to_pylist()])
        own = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 3) for b in got.column("docs").to_pylist()])
        at = np.concatenate([np.frombuffer(b, np.int32) for b in got.column("at").to_pylist()])
        own = np.repeat(own[:, :2], own[:, 2], axis=0)
        order = np.argsort(sig, kind="stable")
        sig, own, at = sig[order], own[order], at[order]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[starts, len(sig)])
        keeper = np.minimum.reduceat(own[:, 0], starts)
        keep = np.repeat(keeper != np.maximum.reduceat(own[:, 0], starts), count)
        keep &= ((at < PIECE) & ((at >= 0) | seeds)) | (own[:, 0] != np.repeat(keeper, count))
        return pa.Table.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(own[keep, 0]), pa.array(own[keep, 1]), pa.array(at[keep])], schema=met_schema)

    met = scratch.save(single.mapInArrow(banded, "bucket int, sigs binary, docs binary, at binary").groupBy("bucket").applyInArrow(lambda got: meet(got, seeds=True), "sig long, id long, key long, at int"), tidy=True)
    is_piece, is_line = F.col("at") >= PIECE, (F.col("at") >= 0) & (F.col("at") < PIECE)
    lost_pieces = met.where(is_piece).select("id", "key", (F.col("at") - PIECE).alias("at"))

    # Seeds that met: the runs around them.
    seeded = met.where("at < 0").groupBy("id", "key").agg(F.collect_set("at").alias("ats"))

    def around(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                p = Paragraphs(part.column("text").to_pylist(), reach, least_words)
                near = np.zeros(len(p.h) + 1, bool)
                near[np.concatenate([p.at[k] - 1 - np.array(x, np.int64) for k, x in enumerate(part.column("ats").to_pylist())])] = True
                starts = p.starts(run_words)
                total = np.r_[0, np.cumsum(near)]
                starts = starts[total[starts + run_words - least_words + 1] > total[starts]]
                if len(starts):
                    own = p.owner(starts)
                    yield from dealt(mix(chain(p.h, run_words)[starts]), own, p.at[own] - starts - 1, part)

    runs = single.join(seeded, ["id", "key"]).mapInArrow(around, "bucket int, sigs binary, docs binary, at binary")
    lost_runs = scratch.save(runs.groupBy("bucket").applyInArrow(lambda got: meet(got, seeds=False), "sig long, id long, key long, at int").select("id", "key", "at"), tidy=True)

    # Lines that met: their contents, one row for each different one from here on.
    wanted = met.where(is_line).groupBy("id", "key").agg(F.collect_set("at").alias("ats"))
    part_schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("content", pa.int64()), ("tokens", pa.binary())])

    def contents(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                p = Paragraphs(part.column("text").to_pylist(), reach, least_words)
                sh = chain(p.h, n)
                ats = part.column("ats").to_pylist()
                text = np.repeat(np.arange(len(ats)), [len(x) for x in ats])
                at = np.array([k for x in ats for k in x], np.int64)
                pick = p.first[text] + at
                content = p.content(pick).view(np.int64) if len(pick) else np.zeros(0, np.int64)
                ids, keys = (np.array(part.column(c).to_pylist(), np.int64) for c in ("id", "key"))
                tokens = [np.unique(sh[p.a[k] : p.b[k] - n + 1]).tobytes() for k in pick.tolist()]
                yield arrow_rows(part_schema, id=ids[text], key=keys[text], at=at, content=content, tokens=tokens)

    parts = scratch.save(single.join(wanted, ["id", "key"]).mapInArrow(contents, "id long, key long, at int, content long, tokens binary"), tidy=True)
    lines = scratch.save(parts.groupBy("content").agg(F.first("tokens").alias("tokens"), F.min("id").alias("lo"), F.max("id").alias("hi")))
    members = met.where(is_line).join(parts.select("id", "key", "at", "content"), ["id", "key", "at"]).select("sig", "content").distinct()
    members = scratch.save(members)
    blocks = members.groupBy("sig").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    spread = members.join(blocks, "sig").withColumn("own", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("content", F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("task")).join(lines.select("content", "tokens"), "content")

    def verify(got: pa.Table) -> pa.Table:
        task, content, tokens = (got.column(c).to_pylist() for c in ("task", "content", "tokens"))
        task = np.array(task)
        order = np.argsort(task, kind="stable")
        cuts = np.flatnonzero(np.diff(task[order])) + 1
        a, b = [], []
        for group in np.split(order, cuts):
            for i, j in local_links([np.frombuffer(tokens[k], np.uint64) for k in group], num, den):
                a.append(content[group[i]])
                b.append(content[group[j]])
        return pa.Table.from_batches([arrow_rows(EDGE, a=a, b=b)], EDGE)

    edges = scratch.save(spread.groupBy(F.pmod("task", F.lit(8 * nb)).alias("bucket")).applyInArrow(verify, "a long, b long").distinct(), tidy=True)
    comps = connected_components(edges, scratch).withColumnRenamed("id", "content")
    rooted = lines.join(comps, "content", "left").select("content", "lo", "hi", F.coalesce("component", "content").alias("root"))
    keeper = rooted.groupBy("root").agg(F.min("lo").alias("keeper"), F.max("hi").alias("hi")).where("keeper != hi")
    lost_lines = parts.select("id", "key", "at", "content").join(rooted.select("content", "root"), "content").join(keeper, "root").where("id != keeper").select("id", "key", "at")
    lost = lost_lines.unionByName(lost_pieces).unionByName(lost_runs).groupBy("id", "key").agg(F.collect_set("at").alias("__lost")).withColumn("__copy", F.lit(False))
    lost = lost.unionByName(copies.select("id", "key", F.lit(None).cast("array<int>").alias("__lost"), F.lit(True).alias("__copy")))
    lost = scratch.save(lost.withColumnsRenamed({"id": "__id", "key": "__key"}), tidy=True)

    schema = StructType([*(StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema.fields), StructField("n_paragraphs", IntegerType()), StructField("n_removed", IntegerType()), StructField("removed_words", LongType())])
    names = docs.columns

    def cut(batches):
        for batch in batches:
            for part in slices(batch, text_col, 1_000_000):
                texts = part.column(text_col).to_pylist()
                p = Paragraphs(texts, reach, least_words)
                ats, whole = part.column("__lost").to_pylist(), part.column("__copy").to_pylist()
                text = np.repeat(np.arange(len(texts)), [len(x or ()) for x in ats])
                at = np.array([k for x in ats for k in x or ()], np.int64)
                begin = p.at[text[at < 0]] - 1 - at[at < 0]
                pick = (p.first[text] + at)[at >= 0]
                pick = np.r_[pick, np.flatnonzero(np.array([bool(w) for w in whole], bool)[p.text])] if len(p.text) else pick
                deep = np.zeros(len(p.h) + 1, np.int64)
                np.add.at(deep, p.a[pick], 1)
                np.add.at(deep, p.b[pick], -1)
                np.add.at(deep, begin, 1)
                np.add.at(deep, begin + run_words, -1)
                gone = np.cumsum(deep)[:-1] > 0
                fresh = np.zeros(len(p.h), bool)
                fresh[p.at[:-1][p.at[:-1] < len(p.h)]] = True
                start = np.flatnonzero(gone & (fresh | ~np.r_[False, gone[:-1]]))
                stop = np.flatnonzero(gone & np.r_[~gone[1:] | fresh[1:], np.ones(min(1, len(gone)), bool)]) + 1
                ok = stop - start >= run_words
                start, stop = start[ok], stop[ok]
                of = np.searchsorted(p.at, start, side="right") - 1
                removed, words = np.bincount(of, minlength=len(texts)), np.bincount(of, stop - start, len(texts)).astype(np.int64)
                edge = np.searchsorted(of, np.arange(len(texts) + 1))
                for k in np.flatnonzero(removed):
                    left, at, end = [], int(p.begins[k]), int(p.begins[k + 1]) - 1
                    for a, b in zip(start[edge[k] : edge[k + 1]], stop[edge[k] : edge[k + 1]]):
                        left.append(p.data[at : p.s[a]].tobytes())
                        at = int(p.s[b]) if b < p.at[k + 1] else end
                    texts[k] = (b"".join(left) + p.data[at:end].tobytes()).decode("utf-8", "surrogatepass")
                cols = [pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(p.first), pa.int32()), pa.array(removed, pa.int32()), pa.array(words)], names=[*names, "n_paragraphs", "n_removed", "removed_words"])

    joined = docs.withColumn("__row", row_key).join(lost, (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__row") == F.col("__key")), "left").drop("__id", "__key", "__row")
    return joined.mapInArrow(cut, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_paragraphs", "n_removed", "removed_words", "text")
