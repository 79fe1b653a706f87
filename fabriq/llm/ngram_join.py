"""N-gram Jaccard join: extended prefixes that index single rare shingles and combinations of frequent ones, then exact verification.

A document's set holds its distinct n-word shingles (64-bit hashes).  Equal sets are collapsed first, so copies
are never paired.  Two sets x, y with Jaccard >= t share at least t*|x| members, so at most m = |x| - ceil(t*|x|)
members of x are missing from y.  Members stand in one global order: rare shingles first, then frequent ones
(those in more than ``frequent`` distinct sets), by hash within a class.  The signatures of x's prefix are each
rare shingle by itself, and each pair of frequent shingles of one subclass (the hash of the shingle modulo a count
that goes with the size band of x).  Missing shingles spoil all signatures only if at least
#rare + sum over subclasses of (size - 1) are missing, so the prefix is extended until that is m + 1: whichever of
two linked sets has the shorter prefix, one of its signatures is among the other's as well.

Candidates are verified on the whole sets.  In buckets of up to ``frequent`` documents all pairs meet; where both
prefixes are of rare shingles only, the count of those that are shared plus what lies beyond the prefix bounds the
overlap, and most false pairs end there.  The documents of larger buckets are signed anew by the exact order of
their shingles' counts among them.  What is still a larger bucket then first links its members to one centre, components
are built, and only pairs across components that still meet in a bucket follow.  So a group of thousands of copies costs as many checks as it has members, and no link is lost.

Defined results: null, empty or word-free text: n_shingles 0, linked with nothing, component_id is its own id.  Rows
with one id are one document: of several texts that with the least digest is compared, and all rows have its component.  A null id keeps its row, with a null component.  Other input columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, arrow_rows, buckets, semi, slices, small
from .jaccard import components, linked
from .words import mix, overlap, shingle_sets

#: Bound on the frequent class, which is broadcast: 8 bytes each.  Beyond it the threshold on the count rises;
#: the class is any function of a shingle, so results don't depend on it.
MOST_FREQUENT = 1_000_000


def _digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _missing(n: int, num: int, den: int) -> int:
    """How many members of a set of n a linked set may lack."""
    return n - -(-n * num // den)


def _band(n: int, num: int, den: int) -> int:
    """Sizes of linked sets are in one band or in neighbouring ones."""
    return int(np.floor(np.log(n) / np.log(den / num) + 1e-9))


def split(s: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of s that aren't in hot, and those that are."""
    if not len(hot):
        return s, s[:0]
    at = np.searchsorted(hot, s)
    at[at == len(hot)] = len(hot) - 1
    often = hot[at] == s
    return s[~often], s[often]


def signatures(rare: np.ndarray, often: np.ndarray, num: int, den: int) -> tuple[np.ndarray, bool]:
    """The signatures of a set of rare and frequent members, each in their global order, and whether the rare ones suffice."""
    size = len(rare) + len(often)
    need = _missing(size, num, den) + 1
    if len(rare) >= need:
        return rare[:need], True
    out = [rare]
    for band in (_band(size, num, den), _band(size, num, den) + 1):
        ways = np.uint64(max(1, int((den / num) ** band * (den - num) / den)))
        group = mix(often) % ways
        # the prefix ends where the shingles that don't open a subclass make up what the rare ones lack
        _, opens = np.unique(group, return_index=True)
        adds = np.ones(len(often), np.int64)
        adds[opens] = 0
        end = int(np.searchsorted(np.cumsum(adds), need - len(rare))) + 1
        part, group = often[:end], group[:end]
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for g in np.split(part[order], cuts):
            if len(g) > 1:
                i, j = np.array(list(combinations(range(len(g)), 2))).T
                out.append(mix(mix(g[i] + np.uint64(band)) ^ g[j]))
    return np.concatenate(out), False


#: Added to the count of a pair whose shared signatures don't bound its overlap.
_UNBOUNDED = 1 << 40


def meetings(t: np.ndarray, i: np.ndarray, pure: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(sig, id, 0, 0) for each member of a signature of more than most documents; (0, a, b, shared) for all pairs within the smaller ones."""
    order = np.lexsort((i, t))
    t, i, pure = t[order], i[order], pure[order]
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    sizes = np.diff(np.r_[starts, len(t)])
    large = np.repeat(sizes > most, sizes)
    a, b, ok = [], [], []
    for k in np.unique(sizes[(sizes > 1) & (sizes <= most)]):
        grid = starts[sizes == k][:, None] + np.arange(k)
        x, y = np.triu_indices(k, 1)
        a.append(i[grid[:, x]].ravel())
        b.append(i[grid[:, y]].ravel())
        ok.append((pure[grid[:, x]] & pure[grid[:, y]]).ravel())
    none = np.zeros(int(large.sum()), np.int64)
    if not a:
        return t[large].view(np.int64), i[large], none, none
    a, b, ok = np.concatenate(a), np.concatenate(b), np.concatenate(ok)
    diff = a != b
    a, b, c = a[diff], b[diff], np.where(ok[diff], 1, _UNBOUNDED)
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    c = np.add.reduceat(c, first) if len(a) else c
    a, b = a[first], b[first]
    return np.r_[t[large].view(np.int64), np.zeros(len(a), np.int64)], np.r_[i[large], a], np.r_[none, b], np.r_[none, c]


def _blobs(buffer: list[tuple[np.ndarray, ...]], n: int):
    """Rows (bucket, blob of the first array, of the second, ...) that deal values out by the first array's hash."""
    columns = [np.concatenate(x) for x in zip(*buffer)]
    where = (columns[0] >> np.uint64(20)) % np.uint64(n)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(n + 1, dtype=np.uint64))
    columns = [c[order] for c in columns]
    for k in range(n):
        lo, hi = cuts[k], cuts[k + 1]
        if hi > lo:
            yield k, [c[lo:hi].tobytes() for c in columns]


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, frequent: int = 16) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of docs; see the module's docstring."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    nb = buckets(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    keys_schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary())])

    def keys(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                yield arrow_rows(keys_schema, id=part.column("id"), n_shingles=[len(s) for s in sets], digest=[_digest(s) if len(s) else None for s in sets])

    keyed = scratch.save(docs.mapInArrow(keys, "id long, n_shingles long, digest binary"))
    # one set for each id, and one id for each set
    own = scratch.save(keyed.where("digest is not null and id is not null").groupBy("id").agg(F.min("digest").alias("digest")))
    classes = scratch.save(own.groupBy("digest").agg(F.min("id").alias("rep")))
    keys_ = classes.select(F.col("rep").alias("id"), "digest")
    reps = docs.join(F.broadcast(keys_) if small(keys_, BROADCAST_KEYS // 4) else keys_, "id")

    def sets_of(part):
        """(id, set) of a slice's rows that stand for their class."""
        for i, d, s in zip(part.column("id").to_pylist(), part.column("digest").to_pylist(), shingle_sets(part.column("text").to_pylist(), n)):
            if len(s) and _digest(s) == d:
                yield i, s

    blob = "bucket int, tokens binary"
    blob_schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary())])

    def flush(buffer):
        rows = list(_blobs(buffer, nb))
        return arrow_rows(blob_schema, bucket=[k for k, _ in rows], tokens=[b[0] for _, b in rows])

    def tokens_of(select):
        """A mapInArrow function that deals out, for each set, the shingles that select picks."""

        def run(batches):
            buffer, held = [], 0
            for batch in batches:
                for part in slices(batch, "text"):
                    for _, s in sets_of(part):
                        if len(t := select(s)):
                            buffer.append((t,))
                            held += len(t)
                    if held > 1_000_000:
                        yield flush(buffer)
                        buffer, held = [], 0
            if buffer:
                yield flush(buffer)

        return run

    count_schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(got: pa.Table) -> pa.Table:
        t = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in got.column("tokens").to_pylist()]))
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        sizes = np.diff(np.r_[starts, len(t)])
        keep = sizes > frequent
        return pa.Table.from_arrays([pa.array(t[starts][keep].view(np.int64)), pa.array(sizes[keep])], schema=count_schema)

    def often(sets: DataFrame, select) -> DataFrame:
        return scratch.save(sets.mapInArrow(tokens_of(select), blob).groupBy("bucket").applyInArrow(count, "token long, n long"), tidy=True)

    def within(*tables: DataFrame) -> np.ndarray:
        """The tokens counted most often, MOST_FREQUENT at most: a raised threshold, found from the counts of counts."""
        all_ = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
        all_ = all_.groupBy("token").agg(F.max("n").alias("n"))
        least = frequent
        while all_.where(F.col("n") > least).limit(MOST_FREQUENT + 1).count() > MOST_FREQUENT:
            least *= 2
        got = all_.where(F.col("n") > least).select("token").toArrow().column("token").to_numpy()
        return np.sort(got.view(np.uint64))

    # Shingles that are frequent among prefixes; then, of documents that have such a one, all shingles.
    first = often(reps, lambda s: s[: _missing(len(s), num, den) + 1])
    one = spark.sparkContext.broadcast(within(first))

    def if_hot(s: np.ndarray) -> np.ndarray:
        """What may take the place of frequent shingles in the prefix; all, where most of it is frequent."""
        need = _missing(len(s), num, den) + 1
        often = overlap(s[:need], one.value)
        return s if 2 * often > need else s[: need + 2 * often] if often else s[:0]

    hot = one
    if len(one.value):
        second = often(reps, if_hot)
        hot = spark.sparkContext.broadcast(within(first, second))

    pair_schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("ids", pa.binary()), ("pure", pa.binary())])

    def signed(batches):
        buffer, held = [], 0

        def out():
            rows = list(_blobs(buffer, nb))
            return arrow_rows(pair_schema, bucket=[k for k, _ in rows], tokens=[b[0] for _, b in rows], ids=[b[1] for _, b in rows], pure=[b[2] for _, b in rows])

        for batch in batches:
            for part in slices(batch, "text"):
                for i, s in sets_of(part):
                    sig, pure = signatures(*split(s, hot.value), num, den)
                    buffer.append((sig, np.full(len(sig), i, np.int64), np.full(len(sig), pure)))
                    held += len(sig)
                if held > 500_000:
                    yield out()
                    buffer, held = [], 0
        if buffer:
            yield out()

    met_schema = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64())])

    def meet(got: pa.Table) -> pa.Table:
        t, i, pure = (np.concatenate([np.frombuffer(b, kind) for b in got.column(c).to_pylist()]) for c, kind in (("tokens", np.uint64), ("ids", np.int64), ("pure", bool)))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in meetings(t, i, pure, frequent)], schema=met_schema)

    met = scratch.save(reps.mapInArrow(signed, "bucket int, tokens binary, ids binary, pure binary").groupBy("bucket").applyInArrow(meet, "sig long, a long, b long, shared long"), tidy=True)
    # Pairs of the smaller buckets: all meetings are counted, which bounds the overlap from above.
    lens = scratch.save(keyed.join(own, ["id", "digest"]).groupBy("id").agg(F.max("n_shingles").alias("n")))
    need = lambda c: F.col(c) - F.ceil(F.col(c) * num / den) + 1

    def counted(met: DataFrame) -> DataFrame:
        pairs = met.where("shared > 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        pairs = pairs.join(lens.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(lens.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        pairs = pairs.where(F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb"))
        most = F.col("shared") + F.greatest(F.col("na") - need("na"), F.col("nb") - need("nb"))
        return scratch.save(pairs.where(most * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b"))

    pairs = counted(met)
    crowded = scratch.save(met.where("shared = 0").select(F.col("a").alias("id")).distinct(), tidy=True)
    scratch.drop(met)

    sets_schema = pa.schema([("id", pa.int64()), ("tokens", pa.binary())])

    def whole(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                got = list(sets_of(part))
                yield arrow_rows(sets_schema, id=[i for i, _ in got], tokens=[s.tobytes() for _, s in got])

    wanted = scratch.save(crowded.union(pairs.select(F.col("a").alias("id"))).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = scratch.save(semi(reps, wanted, "id").mapInArrow(whole, "id long, tokens binary").dropDuplicates(["id"]), tidy=True)

    # Documents of larger buckets are signed anew, in the order of how many of them have a shingle: what a copy has
    # by itself comes first, so that a much changed copy, with enough of that, meets no other.
    token_schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("ids", pa.binary()), ("df", pa.binary())])

    def dealt(batches):
        buffer, held = [], 0

        def out():
            rows = list(_blobs(buffer, nb))
            return arrow_rows(token_schema, bucket=[k for k, _ in rows], tokens=[b[0] for _, b in rows], ids=[b[1] for _, b in rows], df=[None] * len(rows))

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("tokens").to_pylist()):
                t = np.frombuffer(t, np.uint64)
                buffer.append((t, np.full(len(t), i, np.int64)))
                held += len(t)
                if held > 500_000:
                    yield out()
                    buffer, held = [], 0
        if buffer:
            yield out()

    def frequency(got: pa.Table) -> pa.Table:
        """The tokens with how many documents have them, dealt out by document."""
        t, i = (np.concatenate([np.frombuffer(b, kind) for b in got.column(c).to_pylist()]) for c, kind in (("tokens", np.uint64), ("ids", np.int64)))
        _, inv, n = np.unique(t, return_inverse=True, return_counts=True)
        rows = list(_blobs([(mix(i.view(np.uint64)), t, i, n[inv])], nb))
        return pa.Table.from_batches([arrow_rows(token_schema, bucket=[k for k, _ in rows], tokens=[b[1] for _, b in rows], ids=[b[2] for _, b in rows], df=[b[3] for _, b in rows])], token_schema)

    def resigned(got: pa.Table) -> pa.Table:
        t, i, n = (np.concatenate([np.frombuffer(b, kind) for b in got.column(c).to_pylist()]) for c, kind in (("tokens", np.uint64), ("ids", np.int64), ("df", np.int64)))
        order = np.lexsort((t, n, i))
        t, i, n = t[order], i[order], n[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        buffer = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(i)]):
            rare = int(np.searchsorted(n[lo:hi], frequent, side="right"))
            sig, pure = signatures(t[lo : lo + rare], t[lo + rare : hi], num, den)
            buffer.append((sig, np.full(len(sig), i[lo]), np.full(len(sig), pure)))
        rows = list(_blobs(buffer, nb))
        return pa.Table.from_batches([arrow_rows(pair_schema, bucket=[k for k, _ in rows], tokens=[b[0] for _, b in rows], ids=[b[1] for _, b in rows], pure=[b[2] for _, b in rows])], pair_schema)

    by_token = "bucket int, tokens binary, ids binary, df binary"
    again = semi(sets, crowded, "id").mapInArrow(dealt, by_token).groupBy("bucket").applyInArrow(frequency, by_token)
    again = again.groupBy("bucket").applyInArrow(resigned, "bucket int, tokens binary, ids binary, pure binary")
    met = scratch.save(again.groupBy("bucket").applyInArrow(meet, "sig long, a long, b long, shared long"), tidy=True)
    pairs = pairs.union(counted(met)).distinct()
    members = scratch.save(met.where("shared = 0").select("sig", F.col("a").alias("id")))
    small_links = linked(pairs, sets, scratch, num, den)
    comps = components(members, sets, scratch, num, den, also=small_links)

    rep_of = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("root"))
    rep_of = own.join(rep_of, "digest").select("id", "root")
    out = keyed.join(rep_of, "id", "left").select("id", "n_shingles", F.coalesce("root", "id").alias("component_id"))
    return out.withColumnRenamed("id", id_col)


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
