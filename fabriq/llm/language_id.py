"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language; an unseen word falls back to its character n-grams,
the longest order first, and the first order of which any n-gram is known decides.  What a language lacks costs a
fixed penalty.  A text's languages are ranked by the mean score of its words.

The classifier is fitted on a bounded sample of the labelled rows, about ``docs_per_language`` of each language by the
hash of their id, with every word and n-gram that the sample holds; everything that is predicted uses the whole text.
A model is one sorted array of 64-bit hashes and one matrix of scores for each order, so that a worker's copy is two
flat buffers.

Defined results: text null or without a letter: lang_pred ``und``, score 0.  Nothing learned: ``und``, score 0.  A text none
of whose words or n-grams are known takes the language with the most training rows, score 1 / languages.  Ties go
to the first language by name.  Rows are judged one by one, so repeated rows repeat; other columns are ignored, and
a column of ``keep`` that is named as an output stays under that name with a leading underscore (two, if that is taken too).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_rows, fresh_names, semi_size, slices, small_batches, table

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII = re.compile(r"[a-z]+")  # the same for lower-cased texts of ASCII
#: Log-frequency loss of a word or n-gram that a language lacks, in powers of ten.
PENALTY = 7.0
ORDERS = (5, 4, 3, 2, 1)
#: Characters of a text that are split into words at once (up to the next white space).
PIECE = 1_000_000
_hash = xxhash.xxh64_intdigest


def grams(word: str, n: int):
    w = f" {word} " if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def words_of(text: str | None):
    """Lists of the lower-cased words of a text, a piece of it at a time."""
    at, text = 0, text or ""
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        part = (text[at:end] if at or end < len(text) else text).lower()
        yield ASCII.findall(part) if part.isascii() else WORD.findall(part)
        at = end


class Model:
    """For each order (0: words) sorted hashes and a row of per-language scores for each; unseen words get a row by backoff.

    What words were looked up is kept as row numbers for ``room`` words, then forgotten.
    """

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]], prior: str, room: int = 100_000):
        self.languages, self.tables, self.prior, self.room = languages, tables, prior, room
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1, len(self.languages)), np.float32)  # row 0 is for words of which nothing is known

    def find(self, order: int, names: list[str]) -> np.ndarray:
        """Rows of the order's table, -1 for what it lacks."""
        if order not in self.tables or not names:
            return np.full(len(names), -1)
        keys, _ = self.tables[order]
        h = np.fromiter(map(_hash, names), np.uint64, len(names))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def learn(self, words: list[str]) -> None:
        """Give rows to words that have none yet."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        known = np.zeros(len(words), bool)
        open_ = np.arange(len(words))
        for order in (0, *ORDERS):
            if order:
                parts = [grams(words[k], order) for k in open_.tolist()]
                own = np.repeat(np.arange(len(open_)), [len(p) for p in parts])
            else:
                parts, own = [[w] for w in words], open_
            at = self.find(order, [g for p in parts for g in p])
            own, at = own[at >= 0], at[at >= 0]
            if len(own):
                n = np.bincount(own, minlength=len(open_))
                total = np.zeros((len(open_), len(self.languages)))
                np.add.at(total, own, self.tables[order][1][at])
                hit = n > 0
                out[open_[hit]] = total[hit] / n[hit, None]
                known[open_[hit]] = True
                open_ = open_[~hit]
            if not len(open_):
                break
        first = len(self.rows) - 1
        self.rows = np.concatenate([self.rows, out[known]])
        number = np.where(known, first + np.cumsum(known), 0)
        self.cache.update(zip(words, number.tolist()))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n_lang = len(self.languages)
        total, known, any_ = np.zeros((len(texts), n_lang)), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        held, owners, size = [], [], 0

        def add():
            nonlocal held, owners, size
            if len(self.cache) > self.room:
                self.forget()
            if fresh := set().union(*held) - self.cache.keys():
                self.learn(sorted(fresh))
            rows = np.fromiter((self.cache[w] for ws in held for w in ws), np.int64, size)
            own = np.repeat(owners, [len(ws) for ws in held])
            own, rows = own[rows > 0], rows[rows > 0]
            if len(rows):
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[starts]] += np.add.reduceat(self.rows[rows].astype(np.float64), starts, axis=0)
                known[own[starts]] += np.diff(np.r_[starts, len(own)])
            held, owners, size = [], [], 0

        for k, text in enumerate(texts):
            for ws in words_of(text):
                if ws:
                    any_[k] = True
                    held.append(ws)
                    owners.append(k)
                    size += len(ws)
                    if size > 200_000:
                        add()
        if held:
            add()
        langs, scores = [], []
        for k in range(len(texts)):
            if not any_[k] or not n_lang:
                langs.append("und")
                scores.append(0.0)
            elif not known[k]:
                langs.append(self.prior)
                scores.append(1 / n_lang)
            else:
                mean = total[k] / known[k]
                best = int(np.argmax(mean))
                # evidence grows with the root of the words, as neighbouring words are not independent
                odds = np.exp((mean - mean[best]) * math.log(10) * math.sqrt(known[k]))
                langs.append(self.languages[best])
                scores.append(float(odds[best] / odds.sum()))
        return langs, scores


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int = 2_000) -> Model:
    """Fit on the rows with a language: at most about docs_per_language of each, chosen by the hash of the id."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    per = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in per.collect()}  # a row for each language
    if not sizes:
        return Model([], {}, "und")
    languages = sorted(sizes)
    number = {name: i for i, name in enumerate(languages)}
    prior = min(languages, key=lambda x: (-sizes[x], x))
    chance = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1_000_000)) / 1_000_000
    sample = rows.join(semi_size(per), "lang").where(chance * F.col("n") < docs_per_language).select("lang", "text")
    schema = pa.schema([("lang", pa.int32()), ("ord", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])

    def count(batches):
        words: dict[int, Counter] = {}

        def flush():
            for lang, c in words.items():
                for order in (0, *ORDERS):
                    g: Counter = Counter()
                    for w, n in c.items():
                        for x in grams(w, order) if order else (w,):
                            g[x] += n
                    h = np.fromiter(map(_hash, g), np.uint64, len(g)).view(np.int64)
                    yield arrow_rows(schema, lang=np.full(len(g), lang, np.int32), ord=np.full(len(g), order, np.int32), h=h, n=np.fromiter(g.values(), np.int64, len(g)))
            words.clear()

        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    own = words.setdefault(number[lang], Counter())
                    for ws in words_of(text):
                        own.update(ws)
                        if sum(map(len, words.values())) > 100_000:
                            yield from flush()
                            own = words.setdefault(number[lang], Counter())
        yield from flush()

    got = sample.mapInArrow(count, "lang int, ord int, h long, n long").groupBy("lang", "ord", "h").agg(F.sum("n").alias("n")).toArrow()
    lang, order, h, n = (got.column(c).to_numpy() for c in ("lang", "ord", "h", "n"))
    tables = {}
    for o in np.unique(order).tolist():
        at = order == o
        keys, row = np.unique(h[at].view(np.uint64), return_inverse=True)
        totals = np.bincount(lang[at], n[at], len(languages))
        scores = np.full((len(keys), len(languages)), -PENALTY, np.float32)
        scores[row, lang[at]] = np.log10(n[at] / totals[lang[at]])
        tables[int(o)] = (keys, scores)
    return Model(languages, tables, prior)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' id (and the columns in keep) with lang_pred and score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables, model.prior))
    keep = [id_col, *(c for c in keep or [] if c != id_col)]
    names = fresh_names(keep, ["lang_pred", "score"])
    own = names.get(text_col) or fresh_names(["text"], [*names.values(), "lang_pred", "score"])["text"]
    picked = docs.select(*(F.col(c).alias(names[c]) for c in keep), *([] if text_col in names else [F.col(text_col).alias(own)]))
    kept = [picked.schema[names[c]] for c in keep]
    out = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, own, 2_000_000):
                langs, scores = model.predict(part.column(own).to_pylist())
                cols = [part.column(names[c]) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return picked.mapInArrow(run, out)


def held_out(id_col: str, folds: int, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id", 4)), "doc_id", "text", "lang")
    return identify(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")
