"""Benchmark decontamination: CGK embedding and bit sampling over item-sized windows, then exact edit distance.

Texts and items are sequences of words (A-Z lower-cased, split at white space, compared by 64-bit hash).  An item of m words is in a
document where a window of it has word edit distance <= floor(m * (den - num) / den).  A CGK random walk embeds a
sequence into a longer one in which the Hamming distance stays near the edit distance: each step emits the word at the cursor,
which then stays or moves on by a random bit of (step, word), so walks that an edit drove apart soon meet again.
Items longer than ``span`` words are cut into windows of about that size, of which, where the item is within its distance,
at least one has no more than its share of the edits.  ``walks`` walks from every place of every document are sampled in
``samples`` tables each: ``bits`` places within ``near`` steps, whose words make a key; places that share a table's key with an item's
window are candidates and are verified by exact edit distance.  A place is left out before only if no window
of it has enough words that any item has, which no true window lacks.

``tuned`` sets the number of walks: damaged copies of the items themselves (all deletions; and mixed edits), each with all the edits
that are allowed, are looked for until ``recall`` of them is found by the tables.

Items are a stated query set: they are dealt out in blocks of ``block`` items, each broadcast by itself, against all documents.

Defined results: null or word-free text or item: no match.  Rows with one id are judged row by row.  A document
that holds several items has them all, each with its least distance and that window's first word.  A column of docs that is
named matches stays, with a leading underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh_names, slices, small_batches, table
from .words import mix, word_hashes

#: Walks that tuning may take, and items that it damages (chosen evenly).
MOST_WALKS, TRIALS = 48, 400
#: Places whose walks are held at once.
PLACES = 32_768


def allowed(m: int, num: int, den: int) -> int:
    return m * (den - num) // den


def best_window(item: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any window of h, and that window's first word: exact, a row of the table per item word.

    A window may begin and end anywhere, so the first row is 0; each cell carries where its window began.
    """
    n = len(h)
    steps = np.arange(n + 1)
    big = np.int64(n + 2)
    row = steps.astype(np.int64)  # distance * big + begin: the least distance first, then the earliest begin
    for i, w in enumerate(item):
        new = np.empty(n + 1, np.int64)
        new[0] = (i + 1) * big
        new[1:] = np.minimum(row[1:] + big, row[:-1] + big * (h != w))
        row = np.minimum.accumulate(new - steps * big) + steps * big
    best = int(row.min())
    return best // int(big), best % int(big)


_FACTORS = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def emitted(words: np.ndarray, at: np.ndarray, steps: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What the walks from the places at emit at each step, and the cursors there; a word is its 64 random bits, bit j of which moves step j."""
    out, cursors = [], [at]
    for j in range(steps):
        out.append(words[cursors[-1]])
        cursors.append(cursors[-1] + ((out[-1] >> np.uint64(j)) & np.uint64(1)).astype(np.int64))
    return out, cursors


#: Families of windows by their words: from, to, sampled places of a key, steps among which they lie.
FAMILIES = ((1, 1, 1, 1), (2, 2, 2, 2), (3, 4, 3, 4), (5, 8, 4, 9), (9, 1 << 30, 7, 18))


class Windows:
    """Windows of like sizes: their words, and their keys in each table of each walk."""

    def __init__(self, words: list[np.ndarray], own: np.ndarray, offset: np.ndarray, walks: int, samples: int, bits: int, near: int):
        self.own, self.offset = own, offset
        self.size = np.array([len(w) for w in words], np.int64)
        self.sizes = sorted(set(self.size.tolist()))
        self.steps = min(64, 2 * max(self.sizes))
        # each window with room for a walk behind it; where a walk has left its window there is no key
        place = np.cumsum(np.r_[0, self.size + self.steps])[:-1]
        flat = np.zeros(int((self.size + self.steps).sum()), np.uint64)
        for k, w in enumerate(words):
            flat[place[k] : place[k] + len(w)] = w
        self.width = max(16, min(24, len(words).bit_length() + 8))
        self.walks = []
        for r in range(walks):
            seed = mix(np.array([r + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
            out, cursors = emitted(mix(flat ^ seed), place, self.steps)
            rnd, tables = np.random.default_rng(r), []
            for _ in range(samples):
                # the beginning of a window is walked with the fewest edits behind it, and short windows have no other
                start = int(rnd.random() ** 2 * (self.steps - min(near, self.steps) + 1))
                spots = np.sort(start + rnd.choice(min(near, self.steps - start), min(bits, self.steps - start), replace=False)).tolist()
                ok = np.flatnonzero(cursors[spots[-1]] - place < self.size)
                key = self.key(out, spots)[ok]
                order = np.argsort(key, kind="stable")
                there = np.zeros(1 << self.width, bool)
                there[key >> np.uint64(64 - self.width)] = True
                tables.append((spots, key[order], ok[order], there))
            self.walks.append((seed, tables))

    @staticmethod
    def key(out: list[np.ndarray], spots: list[int]) -> np.ndarray:
        """One value of the words emitted at the spots, each times an odd factor of its place."""
        key = out[spots[0]] * _FACTORS[0]
        for k, j in enumerate(spots[1:], 1):
            key += out[j] * _FACTORS[k]
        return key

    def candidates(self, h: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) pairs of the places that agree in a table."""
        at, which = [every[:0]], [every[:0]]
        padded = np.r_[h, np.zeros(self.steps + 1, np.uint64)]
        for seed, tables in self.walks if len(every) else ():
            words = mix(padded ^ seed)
            for lo in range(0, len(every), PLACES):
                some = every[lo : lo + PLACES]
                out, _ = emitted(words, some, self.steps)
                for spots, keys, windows, there in tables:
                    key = self.key(out, spots)
                    hit = np.flatnonzero(there[key >> np.uint64(64 - self.width)])
                    if len(hit):
                        first, last = np.searchsorted(keys, key[hit]), np.searchsorted(keys, key[hit], side="right")
                        n = last - first
                        at.append(np.repeat(some[hit], n))
                        which.append(windows[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        return np.concatenate(at), np.concatenate(which)


class Items:
    """Items, and the windows that stand for them."""

    def __init__(self, ids: list[int], texts: list[str | None], num: int, den: int, walks: int, samples: int, span: int = 12):
        self.num, self.den = num, den
        h, at = word_hashes(texts)
        self.ids, self.words = [], []
        for k, i in enumerate(ids):
            if at[k] < at[k + 1] and i is not None:
                self.ids.append(int(i))
                self.words.append(h[at[k] : at[k + 1]])
        windows = []  # item, first word, words
        for k, w in enumerate(self.words):
            n = max(1, round(len(w) / span))
            cuts = [len(w) * j // n for j in range(n + 1)]
            windows += [(k, a, w[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        self.families = []
        for lo, hi, bits, near in FAMILIES:
            if some := [x for x in windows if lo <= len(x[2]) <= hi]:
                own, offset, words = zip(*some)
                self.families.append(Windows(list(words), np.array(own, np.int64), np.array(offset, np.int64), walks, samples, bits, near))
        self.vocabulary = np.zeros(1 << 22, bool)
        for w in self.words:
            self.vocabulary[w >> np.uint64(42)] = True

    def places(self, h: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Places where a window may begin: as many of the next words are words of items as the least damaged window has."""
        total = np.r_[0, np.cumsum(self.vocabulary[h >> np.uint64(42)], dtype=np.int64)]
        ok = np.zeros(len(h), bool)
        every = np.arange(len(h))
        for s in sizes:
            e = allowed(s, self.num, self.den)
            ok |= total[np.minimum(every + s + e, len(h))] - total[:-1] >= s - e
        return np.flatnonzero(ok)

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Rows (place, item, where the item would begin) of all that agree in a table."""
        out = [np.zeros((0, 3), np.int64)]
        for f in self.families:
            place, window = f.candidates(h, self.places(h, f.sizes))
            out.append(np.c_[place, f.own[window], place - f.offset[window]])
        return np.concatenate(out)

    def find(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, first word) of each text's items: h has all texts' words, text k those from at[k]."""
        got = self.candidates(h)
        text = np.searchsorted(at, got[:, 0], side="right") - 1
        rows = np.unique(np.c_[text, got[:, 1], got[:, 2] - at[text]], axis=0)
        out = []
        for group in np.split(rows, np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(axis=1)) + 1):
            if len(group):
                t, item = int(group[0, 0]), int(group[0, 1])
                if best := self.verified(item, h[at[t] : at[t + 1]], group[:, 2]):
                    out.append((t, item, *best))
        return out

    def verified(self, item: int, h: np.ndarray, begins: np.ndarray) -> tuple[int, int] | None:
        """(distance, first word) of the item's best window near where the candidates would have it begin."""
        w = self.words[item]
        m, n, d = len(w), len(h), allowed(len(w), self.num, self.den)
        spots = np.unique(np.clip(np.add.outer(begins, np.arange(-d, d + 1)).ravel(), 0, max(0, n - 1)))
        # the number of its words that the item has bounds a window's distance from below at little cost
        lo = int(spots[0])
        total = np.r_[0, np.cumsum(np.isin(h[lo : int(spots[-1]) + m + d], w))]
        spots = spots[total[np.minimum(spots - lo + m + d, len(total) - 1)] - total[spots - lo] >= m - d]
        best = None
        # windows apart by more than the item are judged by themselves
        for run in np.split(spots, np.flatnonzero(np.diff(spots) > m + d) + 1):
            for part in np.split(run, np.arange(2048, len(run), 2048)):
                if len(part):
                    lo, hi = int(part[0]), min(n, int(part[-1]) + m + d)
                    e, begin = best_window(w, h[lo:hi])
                    if e <= d and (best is None or (e, lo + begin) < best):
                        best = (e, lo + begin)
            if best and best[0] == 0:
                break
        return best


def damaged(words: np.ndarray, edits: int, rnd: np.random.Generator, kind: str) -> np.ndarray:
    """words after so many edits at different places: deletions, or insertions, deletions and substitutions alike."""
    out = words.tolist()
    for p in sorted(rnd.choice(len(out), edits, replace=False).tolist(), reverse=True):
        how = 2 if kind == "deletions" else int(rnd.integers(3))
        if how == 2:
            del out[p]
        else:
            out[p : p + how] = [int(rnd.integers(1 << 63))]  # an insertion (0) or a substitution (1)
    return np.array(out, np.uint64)


def measured(items: Items, kinds=("deletions", "mixed"), trials: int = TRIALS, seed: int = 5) -> float:
    """The least share, over the kinds of damage, of items that the tables find after all the edits that are allowed."""
    rnd, shares = np.random.default_rng(seed), []
    some = np.unique(np.linspace(0, len(items.words) - 1, min(trials, len(items.words))).astype(int)).tolist()
    for kind in kinds:
        parts, spans, at = [], [], 0
        for i in some * max(1, trials // len(some)):
            w = items.words[i]
            copy = damaged(w, min(allowed(len(w), items.num, items.den), len(w) - 1), rnd, kind)
            parts += [copy, rnd.integers(1, 1 << 63, 128).astype(np.uint64)]
            spans.append((i, at, at + len(copy)))
            at += len(copy) + 128
        got = items.candidates(np.concatenate(parts))
        got = got[np.argsort(got[:, 0], kind="stable")]
        hit = [bool((got[np.searchsorted(got[:, 0], a) : np.searchsorted(got[:, 0], b), 1] == i).any()) for i, a, b in spans]
        shares.append(sum(hit) / len(hit))
    return min(shares)


def tuned(ids: list[int], texts: list[str | None], num: int, den: int, recall: float, samples: int = 8) -> int:
    """The number of walks with which the tables find damaged copies of these items with the recall."""
    walks = 4
    while walks <= MOST_WALKS:
        items = Items(ids, texts, num, den, walks, samples)
        if not items.words or measured(items) >= recall:
            return walks
        walks += 2
    raise RuntimeError(f"{MOST_WALKS} walks do not reach the recall of {recall}")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", num: int = 80, den: int = 100, recall: float = 0.99, samples: int = 8, block: int = 20_000) -> DataFrame:
    """docs with matches: array of (item_id, distance, at), by item; empty where there is none."""
    spark = docs.sparkSession
    listed = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = listed.count()
    blocks = max(1, -(-total // block))
    small_batches(spark)
    names = fresh_names(docs.columns, ["matches"])
    out = docs.withColumnsRenamed(names)
    columns, text_col = out.columns, names[text_col]
    out = out.withColumn("matches", F.expr("cast(array() as array<struct<item_id:bigint,distance:int,at:int>>)"))
    for k in range(blocks):
        own = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        got = own.toArrow()
        own_items = got.column("i").to_pylist(), got.column("t").to_pylist()
        shared = spark.sparkContext.broadcast((*own_items, tuned(*own_items, num, den, recall, samples)))
        schema = out.schema
        arrow = to_arrow_schema(schema)

        def run(batches, shared=shared, arrow=arrow):
            ids, texts, walks = shared.value
            found = Items(ids, texts, num, den, walks, samples)
            for batch in batches:
                for part in slices(batch, text_col):
                    h, at = word_hashes(part.column(text_col).to_pylist())
                    rows = part.column("matches").to_pylist()
                    for r, i, e, begin in found.find(h, at):
                        rows[r].append({"item_id": found.ids[i], "distance": e, "at": begin})
                    for row in rows:
                        row.sort(key=lambda x: x["item_id"])
                    cols = [part.column(c) for c in columns] + [pa.array(rows, arrow.field("matches").type)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*columns, "matches"])

        out = out.mapInArrow(run, schema)
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.transform("matches", lambda m: m["item_id"]).alias("item_ids"), F.transform("matches", lambda m: m["distance"]).alias("distances"))
