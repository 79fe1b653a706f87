"""The corpus operators on small tables: brute force, planted cases, nulls, empty tables, ties, clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabriq.llm import decontamination, embedding_dedup, gru, html_text, jaccard, language_id, lm_score, mixing, ngram_join, quotes, substring_dedup, suffix_dedup
from fabriq.llm.common import Scratch, connected_components
from fabriq.llm.words import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [a + b for a in "bcdfgklmnprst" for b in ("a", "eo", "ié", "ou", "um")]


def text(rnd, n):
    return " ".join(rnd.choice(VOCAB) + rnd.choice(VOCAB) for _ in range(n))


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs_of(spark, rows):
    """Extra columns carry the names that operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, key string, bucket int, tokens string")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    base = text(rnd, 120)
    out = [(0, base), (1, base), (2, base.upper()), (3, None), (4, ""), (5, "  \n"), (6, "one two"), (7, "One two"), (8, "... 123"), (9, "w" * 3000)]
    for k in range(10, 40):
        w = base.split()
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
        out.append((k, " ".join(w)))
    out += [(k, text(rnd, rnd.randrange(1, 200))) for k in range(40, 60)]
    return out + [(60, "the " * 400), (61, "the " * 401), (62, text(rnd, 6000)), (0, base), (None, base)]


def groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets.setdefault(i, []).append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_word_hashes_in_pieces(rows):
    texts = [t for _, t in rows]
    whole, at = word_hashes(texts)
    for piece in (1, 50):
        h, a = word_hashes(texts, piece)
        assert (h == whole).all() and (a == at).all()
    assert [len(s) for s in shingle_sets(texts)] == [len({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}) if (w := WORD.findall(low(t))) else 0 for t in texts]


@pytest.mark.parametrize("frequent", [1, 16])
def test_ngram_join(spark, rows, frequent):
    got = ngram_join.ngram_jaccard_join(docs_of(spark, rows), frequent=frequent).collect()
    assert len(got) == len(rows)
    want = groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None][0] in (None, 0)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_join(docs_of(spark, []).limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    edges = spark.createDataFrame(pairs, "a long, b long")
    for one_task in (0, 10_000):  # by rounds over tables, and in one more task
        got = connected_components(edges.repartition(5), Scratch(spark, "t"), one_task=one_task).collect()
        assert {r["id"]: r["component"] for r in got} == root and len(got) == len(root)


def test_local_links():
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 1000, 40)
    sets = [np.unique(np.r_[rnd.choice(base, 36, False), rnd.integers(0, 5000, k % 5)]).astype(np.uint64) for k in range(40)]
    true = [(i, j) for i, j in itertools.combinations(range(40), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]

    def comps(links):
        root = list(range(40))
        for _ in range(40):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    dense = jaccard.local_links(sets, 80, 100)
    assert comps(dense) == comps(true)
    try:
        most, jaccard.DENSE = jaccard.DENSE, 0
        assert comps(jaccard.local_links(sets, 80, 100)) == comps(true)
    finally:
        jaccard.DENSE = most


def test_language_id(spark):
    rnd = random.Random(3)
    a, b = ["ka", "ro", "mi", "lu"], ["sch", "tz", "üf", "en"]
    make = lambda s: " ".join("".join(rnd.choice(s) for _ in range(3)) for _ in range(rnd.randrange(4, 40)))
    rows = [(k, make(a if k % 2 else b), "xx" if k % 2 else "yy") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id < 150"), "doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(got[k]["lang_pred"] == lang and 0.5 < got[k]["score"] <= 1 for k, _, lang in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "世界"), (5, "KAROMI karomi " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4] == (model.prior, 0.5) and got[5][0] == "xx"
    none = language_id.train(df.limit(0), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}


def test_substring_dedup(spark):
    rnd = random.Random(4)
    passages = [text(rnd, rnd.randrange(51, 70)) for _ in range(5)]
    rows, clean = [], {}
    for k in range(60):
        w = text(rnd, 150).split()
        if k < 30:
            at = rnd.randrange(150)
            w[at:at] = passages[k % 5].split()
        rows.append((k, " ".join(w)))
        if k < 5 or k >= 30:
            clean[k] = rows[-1][1]
    line = text(rnd, 60)
    near = line.split()
    near[30] = "other"
    rows += [(100, line + "\nown words here"), (101, "something\n" + " ".join(near)), (102, None), (103, ""), (104, rows[40][1]), (104, rows[40][1]), (None, rows[40][1])]
    got = {}
    out = substring_dedup.substring_dedup(docs_of(spark, rows))
    assert {"key", "bucket", "tokens"} <= set(out.columns)
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert all(got[k][0]["text"] == t for k, t in clean.items())
    for k in range(5, 30):
        assert passages[k % 5] not in got[k][0]["text"] and got[k][0]["removed_words"] >= 15
    assert got[101][0]["text"].strip() == "something" and got[100][0]["text"] == line + "\nown words here"
    assert got[102][0]["text"] is None and got[103][0]["text"] == "" and [r["text"] for r in got[104]] == ["", ""] and got[None][0]["text"] == rows[40][1]
    assert substring_dedup.substring_dedup(docs_of(spark, []).limit(0)).count() == 0
    assert 1 - (1 - 0.8**3) ** substring_dedup.tune(0.8, 0.98)[0] >= 0.98


def test_substring_dedup_of_odd_tables(spark):
    """Columns named as outputs and as the operator's own, very long texts, texts of one word, ties of equal ids."""
    rnd = random.Random(41)
    long = text(rnd, 40_000)
    rows = [(1, long), (2, "intro " + long), (3, "w " * 30_000), (4, "w " * 30_000 + "w"), (5, "\n" * 5_000), (2, "intro " + long)]
    df = spark.createDataFrame([(i, t, "a", 1, 2, 3, True) for i, t in rows], "doc_id long, text string, n_removed string, __copy int, __lost int, __key int, n_paragraphs boolean")
    got = substring_dedup.substring_dedup(df)
    assert {"_n_removed", "_n_paragraphs", "n_removed", "n_paragraphs"} <= set(got.columns)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 6 and by[1]["text"] == long and by[2]["text"] == "" and by[2]["_n_removed"] == "a"
    assert by[3]["text"] == rows[2][1] and by[4]["text"].strip() == "" and by[5]["text"] == rows[4][1]


def test_language_id_of_odd_tables(spark):
    """Clashing names, ties between languages, repeated rows, no rows; scores against the rule by brute force."""
    rows = [(1, "ab ab cd", "xx"), (2, "ab ef", "yy"), (3, "gh", "xx"), (3, "gh", "xx")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(train, "doc_id", "text", "lang")
    counts = {"xx": Counter("ab ab cd gh gh".split()), "yy": Counter("ab ef".split())}
    rule = lambda w: [math.log10(c[w] / sum(c.values())) if c[w] else -language_id.PENALTY for c in counts.values()]
    df = spark.createDataFrame([(k, t, "s", 0.5) for k, t in ((1, "AB"), (2, "ab ef ef"), (2, "ab ef ef"), (3, "zz9"))], "doc_id long, text string, lang_pred string, score double")
    got = language_id.identify(df, model, keep=["lang_pred", "score", "text"])
    assert got.columns == ["doc_id", "_lang_pred", "_score", "text", "lang_pred", "score"] and got.where("doc_id = 2").count() == 2
    for r in got.collect():
        words = [w for w in re.findall("[a-z]+", r["text"].lower()) if any(c[w] for c in counts.values())]
        if words:
            mean = [sum(x) / len(words) for x in zip(*map(rule, words))]
            odds = [10 ** ((m - max(mean)) * math.sqrt(len(words))) for m in mean]
            assert r["lang_pred"] == ("xx", "yy")[mean.index(max(mean))] and abs(r["score"] - max(odds) / sum(odds)) < 1e-5
        else:
            assert (r["lang_pred"], r["score"]) == ("xx", 0.5)  # nothing known: the language with most rows
    even = language_id.train(spark.createDataFrame([(1, "qq", "b"), (2, "qq", "a")], train.schema), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language_id.identify(spark.createDataFrame([(1, "qq")], "doc_id long, text string"), even).collect()} == {"a"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_suffix_dedup(spark, rows):
    rnd = random.Random(5)
    share = text(rnd, 30)
    more = rows + [(k, text(rnd, 20) + share[: rnd.randrange(40, len(share))] + text(rnd, 20)) for k in range(100, 120)] + [(130, "ab\0" * 60), (131, "ab\0" * 61)]
    first = {}
    for i, t in more:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = Counter()
    for i, t in more:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, suffix_dedup.suffix_dedup(docs_of(spark, more)).collect())) == want
    assert suffix_dedup.suffix_dedup(docs_of(spark, []).limit(0)).count() == 0


def test_loser_tree_and_front_coding():
    rnd = np.random.default_rng(1)
    runs = []
    for _ in range(5):
        keys = np.unique(rnd.integers(0, 3, (rnd.integers(1, 50), 6)).astype(np.uint8), axis=0)
        common, rest = suffix_dedup.front_code(keys)
        assert (suffix_dedup.front_decode(common, rest, 6) == keys).all()
        runs.append((keys, common))
    strings = [[bytes(r) for r in k] for k, _ in runs]
    order, common = suffix_dedup.merge(strings, [c for _, c in runs])
    nxt, out = [0] * 5, []
    for k in order:
        out.append(strings[k][nxt[k]])
        nxt[k] += 1
    assert out == sorted(sum(strings, []))
    for x, y, c in zip(out, out[1:], common[1:]):
        assert x[:c] == y[:c] and (c == 6 or x[c] != y[c])


def test_anchors_in_pieces():
    data = np.frombuffer(text(random.Random(6), 400).encode(), np.uint8)
    a, b = suffix_dedup.anchors(data, 50, 16), suffix_dedup.anchors(data, 50, 16, piece=97)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and np.diff(a[0]).max() <= 35


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_best_window():
    rnd = random.Random(7)
    for _ in range(20):
        item, h = [rnd.randrange(5) for _ in range(6)], [rnd.randrange(5) for _ in range(15)]
        e, begin = decontamination.best_window(np.array(item, np.uint64), np.array(h, np.uint64))
        assert e == min(edit(item, h[i:j]) for i in range(16) for j in range(i, 16))
        assert e == min(edit(item, h[begin:j]) for j in range(begin, 16))


def test_decontamination(spark):
    rnd = random.Random(8)
    items = [(k, text(rnd, rnd.randrange(15, 50))) for k in range(20)] + [(90, None), (91, "  "), (92, "short zzz")]
    rows, want = [], {}
    for k in range(60):
        w = text(rnd, 100).split()
        if k < 40:
            v = items[k % 20][1].split()
            for _ in range(0 if k < 20 else len(v) // 8):
                v[rnd.randrange(len(v))] = "changed"
            at = rnd.randrange(100)
            w[at:at] = v
        rows.append((k, " ".join(w).upper().replace("É", "é")))
        want[k] = [k % 20] if k < 40 else []
    rows += [(70, None), (71, ""), (72, "a short zzz b")]
    want |= {70: [], 71: [], 72: [92]}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        got = decontamination.decontaminate(docs_of(spark, rows), bench, block=block).collect()
        assert {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in got} == want
    assert decontamination.decontaminate(docs_of(spark, rows), bench.limit(0)).where("size(matches) > 0").count() == 0


def test_decontamination_against_brute_force(spark):
    """All (document, item) pairs by exact edit distance of whole texts, items damaged up to and beyond what is allowed; repeated rows, a clashing column."""
    rnd = random.Random(21)
    items = [(k, text(rnd, n)) for k, n in enumerate([1, 2, 4, 5, 9, 10, 14, 20, 35, 60, 120, 200] * 3)]
    rows = []
    for k in range(150):
        w, v = text(rnd, 60).split(), items[k % len(items)][1].split()
        for p in sorted(rnd.sample(range(len(v)), min(len(v) - 1, len(v) // 5 + (k % 7 == 0))), reverse=True):
            how = rnd.randrange(3)
            v[p : p + (how > 0)] = ["edited"] if how < 2 else []
        at = rnd.randrange(60)
        w[at:at] = v
        rows.append((k, " ".join(w)))
    rows += [rows[5], rows[5], (900, None), (901, " \n"), (902, "one " * 20_000)]
    hash_ = lambda t: word_hashes([t])[0]
    want = {}
    for k, t in rows:
        h = hash_(t)
        best = {i: decontamination.best_window(hash_(v), h) for i, v in items}
        want[k] = sorted((i, e) for i, (e, _) in best.items() if e <= len(v := items[i][1].split()) // 5 and e < len(v))
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, matches string")
    got = decontamination.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["_matches"] == "mine" for r in got)
    missed = [(k, x) for r in got for k in [r["doc_id"]] for x in set(want[k]) ^ {(m["item_id"], m["distance"]) for m in r["matches"]}]
    assert len(missed) <= 0.01 * sum(map(len, want.values())), missed


@pytest.mark.parametrize("m", [5, 10, 20, 50, 100, 200])
def test_tables_reach_the_recall(m):
    """Tuned on some damage, measured on other: items at exactly the allowed distance."""
    rnd = random.Random(m)
    texts = [text(rnd, m) for _ in range(200)]
    ids = list(range(200))
    found = decontamination.Items(ids, texts, 80, 100, decontamination.tuned(ids, texts, 80, 100, 0.99), 8)
    assert decontamination.measured(found, seed=77) >= 0.97


def test_embedding_dedup(spark):
    rnd = np.random.default_rng(9)
    base = rnd.standard_normal((300, 16))
    x = np.concatenate([base, base[:60] + 0.05 * rnd.standard_normal((60, 16)), base[:5], base[:1] + 0.03 * rnd.standard_normal((80, 16)), 2 * base[7:8]])
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [1.0] * 15 + [None]), (1003, [float("nan")] * 16), (1004, [float("inf")] + [0.0] * 15), (1005, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, task string")
    got = embedding_dedup.embedding_dedup(df).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    n = np.array([by[k]["n_links"] for k in range(len(x))])
    assert (n <= links.sum(1)).all() and n.sum() >= 0.97 * links.sum()
    for i, _ in odd:
        assert by[i]["n_links"] == 0 and by[i]["component_id"] == i
    assert by[0]["kept"] and not by[300]["kept"]
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_of_extreme_norms_and_ties(spark):
    """Tiny and huge vectors by their true cosines; cosine 0.95 exactly, from integers, links; equal vectors of two ids and of one."""
    tie = [19.0, 0.0, math.sqrt(400 - 361)]
    vs = [[1e-200, 1e-200, 0.0], [1.0, 0.2, 0.0], [1e200, 1e200, 0.0], [1e200, 1.0000001e200, 0.0], [0.0, 0.0, 5e-324], [0.0, 0.0, 1e308], [-1.0, 0.0, 0.0], [1.0, -5.0, 0.0], [1.0, -5.0, 0.0]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vs)] + [(8, vs[8])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df).collect()}
    assert [got[k] for k in (0, 2, 3)] == [(2, 0)] * 3 and got[1] == (0, 1) and got[4] == (1, 4) and got[5] == (1, 4) and got[6] == (0, 6)
    assert got[7][1] == got[8][1] == 7 and got[7][0] >= 1
    two = spark.createDataFrame([(0, [20.0, 0.0, 0.0]), (1, tie), (2, [18.9, 0.0, math.sqrt(400 - 18.9**2)])], "vec_id long, embedding array<double>")
    links = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(two).collect()}
    u = np.array([[20.0, 0, 0], tie])
    assert (links[0] >= 1) == (u[0] @ u[1] / np.linalg.norm(u[0]) / np.linalg.norm(u[1]) >= 0.95)


def test_graph_by_insertion_finds_neighbours():
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((700, 12))
    x = np.concatenate([x, x[:200] + 0.1 * rnd.standard_normal((200, 12))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = embedding_dedup.build(x, 20, 64, 1.2, 1)
    assert max(map(len, links)) <= 30 and all(len(set(v.tolist())) == len(v) and k not in v for k, v in enumerate(links))
    a, b = embedding_dedup.search(x, links, 0.9, 48)
    got = {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < j}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)))}
    assert got <= want | got and len(got & want) >= 0.99 * len(want)


def test_low_recall_is_an_error(spark):
    rnd = np.random.default_rng(6)
    x = rnd.standard_normal((50, 8))
    x = np.concatenate([x, x + 0.01])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup.embedding_dedup(df, recall=1.1, tries=1)


def test_shards_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "CENTROIDS", 2)
    rnd = np.random.default_rng(10)
    x = rnd.standard_normal((1, 8)) + 0.02 * rnd.standard_normal((150, 8))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_dedup.embedding_dedup(df).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["n_links"] for r in got) >= 0.97 * 150 * 149


def test_html_extraction(spark):
    page = lambda k, extra="": f'<html><head><title>t</title><script>"</p>"</script></head><body><nav><a>Menu</a></nav><div class="x">Follow us today</div><div class="c"><h1>Title {k}</h1><p>Text {k} &amp; more<br>\n of&nbsp;it<p>Second {k}</p>{extra}</div><footer>f</footer></body>'
    rows = [(k, f"https://a.example/{k}", page(k)) for k in range(8)] + [(20, None, None), (21, "bad", ""), (22, "https://b.example/", "<article><p>a &lt;i&gt;</p><div class='comments'>c</div><form>f</form></article>tail"), (23, "https://b.example/x", "<p>open <b>end <!-- never"), (23, "https://b.example/x", "<p>open <b>end <!-- never")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = html_text.extract(df).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    # the block that all pages of the host have is template though nothing names it so
    assert all(by[k]["text"] == f"Title {k}\n\nText {k} & more of it\n\nSecond {k}" for k in range(8))
    assert by[20]["text"] == by[21]["text"] == "" and by[22]["text"] == "a <i>" and by[23]["text"] == "open end"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ('<div class="content no-sidebar"><p>kept text</p></div>', "kept text"),
    ('<article class="post comments-open"><p>kept text</p></article>', "kept text"),
    ('<article><p data-title="a hidden gem">kept</p><p hidden>gone</p><p hidden="">gone</p></article>', "kept"),
    ("<article><p title=it's>one</p><p>two don't</p></article>", "one\n\ntwo don't"),
    ("<main><h1>Title</h1><article><p>body</p></article><p>after</p></main>", "Title\n\nbody\n\nafter"),
    ("<article><p>area <math><mi>x</mi></math> squared</p></article>", "area x squared"),
    ('<article><p>a</p><div class="site-nav">n</div><div id="cookieBanner">c</div><ul class="comment-list"><li>r</li></ul><div class="comments">r</div></article>', "a"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article><p>" + "long words " * 60_000 + "</p></article>", ("long words " * 60_000).strip()),
    ("<p a='>' b=\">\">quoted</p><p/>x", "quoted\n\nx"),
])
def test_html_of_a_page(page, want):
    root = html_text.parse(page)
    html_text.hashed(root)
    assert html_text.main_text(root, set()) == want


def reference_template(pages, least_pages, share):
    """Brute force of the counted template, by the subtrees' serialised content instead of hashes."""
    def said(n):
        return f"<{n.tag} {n.attrs.get('class', '')}>" + "".join(said(k) if isinstance(k, html_text.Node) else " ".join(k.split()) for k in n.kids) + "</>"

    seen, hosts, trees = {}, Counter(), []
    for url, page in pages:
        host = re.match(r"https?://([^/]*)", url)[1]
        hosts[host] += 1
        root = html_text.parse(page)
        nodes = [(n, said(n)) for n, inside in html_text.hashed(root) if html_text.deletable(n, inside)]
        trees.append((host, root, nodes))
        for x in {t for _, t in nodes}:
            seen[host, x] = seen.get((host, x), 0) + 1
    return [html_text.main_text(root, {n.hash for n, t in nodes if seen[host, t] >= max(least_pages, hosts[host] * share)}) for host, root, nodes in trees]


def test_html_templates_against_brute_force(spark):
    """Unmarked and marked pages of two hosts, blocks that recur at, below and above the threshold, repeated rows."""
    rnd = random.Random(31)
    blocks = [f"<div><p>{text(rnd, 6)}</p></div>" for _ in range(12)]
    pages = []
    for k in range(60):
        some = "".join(b for j, b in enumerate(blocks) if k % (j + 1) == 0)
        body = f"<h1>{text(rnd, 3)}</h1><div><p>{text(rnd, 8)}</p></div>"
        pages.append((f"https://h{k % 2}.example/{k}", f"<body>{some}<article>{body}{blocks[0]}<ul><li><a>all</a></li></ul></article></body>" if k % 3 == 0 else f"<body>{some}{body}</body>"))
    pages += [pages[4], pages[4]]
    df = spark.createDataFrame([(k, u, p) for k, (u, p) in enumerate(pages)], "page_id long, url string, html string")
    for least, share in ((5, 0.02), (5, 0.2), (2, 0.0)):
        got = {r["page_id"]: r["text"] for r in html_text.extract(df, least_pages=least, share=share).collect()}
        assert [got[k] for k in range(len(pages))] == reference_template(pages, least, share)


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "First answer\n\nwith block two"), (1, 2, "user", "> First   answer\n\nwhy?"), (1, 3, "assistant", "On Monday, a wrote:\n> why?\n>> first ANSWER\nbecause"), (1, 4, "user", "> hello there\nbranching"), (1, 5, None, "> with block two\nfoo"), (2, 0, "user", None), (2, 1, "user", ""), (None, 1, "user", "> x\nkeep"), (4, None, "user", "t"), (5, 700, "user", "late"), (5, 2, "user", "early"), (5, 2, "user", "early too")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, hash string")
    got = {(r["conv_id"], r["turn"], r["text"]): (r["parent_turn"], r["branch"], r["n_quoted"], r["n_linked"]) for r in quotes.link_quotes(df).collect()}
    assert len(got) == len(rows)
    assert got[1, 3, "because"] == (2, 0, 2, 2) and got[1, 4, "branching"] == (0, 4, 1, 1) and got[1, 5, "foo"] == (1, 5, 1, 1) and got[1, 2, "why?"] == (1, 0, 1, 1)
    assert got[2, 0, None] == (None, 0, 0, 0) and got[2, 1, ""][0] == 0 and got[None, 1, "keep"] == (None, None, 1, 0) and got[5, 700, "late"] == (2, 2, 0, 0)
    whole = quotes.conversations(quotes.link_quotes(df))
    parts = {(r["branch"]): r["formatted"] for r in whole.where("conv_id = 1").collect()}
    assert whole.agg(F.sum("n_messages")).first()[0] == len(rows)
    by = {(r["branch"], r["part"]): (r["reply_to"], r["turns"], r["formatted"]) for r in quotes.conversations(quotes.link_quotes(df), part=3).where("conv_id = 1").collect()}
    assert by[0, 0][0] is None and by[0, 0][1] == "0,1,2" and by[0, 1] == (2, "3", parts[0][parts[0].index("<|assistant|>\nbecause"):]) and by[4, 0][0] == 0
    assert parts[0].count("<|") == 4 and parts[5] == "<|unknown|>\nfoo\n"
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_passages_inside_lines_go_to_their_exact_ends(spark):
    """Runs of 15 words and more that a smaller id has, against brute force; random, repetitive, and one short of a run."""
    rnd = random.Random(15)
    shared = [text(rnd, n) for n in (14, 15, 16, 20, 50, 50, 50, 80)] + [" ".join(["same"] * 40), " ".join(["to", "and", "fro"] * 10)]
    docs = [(k, " ".join([text(rnd, rnd.randrange(3, 60)), shared[k % len(shared)], text(rnd, rnd.randrange(3, 60))])) for k in range(40)]
    seen, want = set(), {}
    for k, t in docs:
        w = t.split()
        gone = {j for i in range(len(w) - 14) if tuple(w[i : i + 15]) in seen for j in range(i, i + 15)}
        want[k] = " ".join(x for j, x in enumerate(w) if j not in gone)
        seen |= {tuple(w[i : i + 15]) for i in range(len(w) - 14)}
    got = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(docs_of(spark, docs)).collect()}
    assert got == want and sum(want[k] != t for k, t in docs) == 27


def test_partial_quotes(spark):
    """Runs of lines of an original, cut, re-wrapped or between quotes; lines that it has in another order or not whole are none."""
    rows = [
        (1, 0, "one two\nThree four\nfive six"), (1, 1, "first block\nof it\n\nsecond\n\nthird block"), (1, 2, "> other\nyes so\nand so\n> other\nlast words"),
        (1, 3, "plain"), (1, 4, "> one two\n> three four\na"), (1, 5, "> first block\n> of it\n>\n> second\nb"), (1, 6, "> yes so\n> and so\nc"),
        (1, 7, "> Three\n> four five\n> six\nd"), (1, 8, "> three four\n> one two\ne"), (1, 9, "> two\n> three four\nf"), (1, 10, "> three four\n> five\ng"), (1, 11, "> later one\n> later two\nh"), (1, 12, "later one\nlater two\nlater three"),
        (2, 0, "else"), (2, 1, "> one two\n> three four\ni"),
    ]
    df = spark.createDataFrame([(*r[:2], "user", r[2]) for r in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["n_linked"]) for r in quotes.link_quotes(df).collect()}
    assert [got[1, k] for k in (4, 5, 6, 7)] == [(0, 1), (1, 1), (2, 1), (0, 1)]
    assert [got[1, k] for k in (8, 9, 10, 11)] == [(7, 0), (8, 0), (9, 0), (10, 0)] and got[2, 1] == (0, 0)


def test_mixing(spark):
    rnd = random.Random(11)
    rows = [(k, text(rnd, rnd.randrange(0, 30)), rnd.choice(["en", "de", None]), f"src{k % 5}") for k in range(300)] + [(5, "same same", "en", "src0")] * 2 + [(None, "no id", "en", None), (999, None, "en", "src1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, tokens int")
    got = mixing.mixed(df).collect()
    total = sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert sum(r["taken_tokens"] for r in got) == total * mixing.PERCENT // 100
    per = Counter()
    for r in got:
        per[r["doc_id"], r["epoch"]] += 1
        assert 0 < r["taken_tokens"] <= r["tokens"] and r["epoch"] < mixing.EPOCHS
    assert max(n for (i, _), n in per.items() if i != 5) == 1
    assert mixing.mixed(df.limit(0)).count() == 0
    # a target above all that there is takes everything as often as it may
    all_ = mixing.mix(df, mixing.tree(), mixing.WEIGHTS, 1_000, 2, 1).agg(F.sum("taken_tokens")).first()[0]
    assert all_ == 2 * total


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "a " * 100, "en", "src0"), (2, "a " * 10, "en", "src4"), (3, "a " * 100, "de", "src0"), (4, "a " * 100, "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    w = {"domain": {"domain0": 1, "domain1": 1}, "language": {"en": 1, "de": 1}, "origin": {}}
    got = {r["doc_id"]: r["taken_tokens"] for r in mixing.mix(df, mixing.tree(), w, 60, 1, 1).collect()}
    assert got == {1: 36, 2: 10, 3: 47, 4: 93}  # src4 lacks 13 of its 23: its sibling src0 takes them, not the other language or domain


def test_gru_gradient():
    rnd = np.random.default_rng(12)
    cls, _, sizes = gru.classes(np.array([9.0, 5, 4, 3, 2, 1]), 3)
    net = gru.GRU.init(cls, sizes, 2, 4, np.array([9.0, 5, 4, 3, 2, 1, 3, 3]))
    probs = np.exp([net.log_probs(np.ones((1, 4), np.float32), np.array([k]))[0][0] for k in range(8)])
    assert abs(probs.sum() - 1) < 1e-5
    hs, y = rnd.standard_normal((5, 4)).astype(np.float32), np.array([0, 3, 6, 7, 5])
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    _, dh = net.log_probs(hs, y, grads)
    for i, j in ((0, 0), (3, 2), (4, 1)):
        a, b = hs.copy(), hs.copy()
        a[i, j] += 1e-2
        b[i, j] -= 1e-2
        assert abs((net.log_probs(b, y)[0].sum() - net.log_probs(a, y)[0].sum()) / 2e-2 - dh[i, j]) < 1e-2


def tiny_gru(hidden=4):
    counts = np.array([9.0, 5, 4, 3, 2, 1])
    cls, _, sizes = gru.classes(counts, 3)
    net = gru.GRU.init(cls, sizes, 2, hidden, np.r_[counts, 3, 3])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_gru_gradient_through_time():
    """All parameters' gradients over a window against differences, with a document that ends inside it and places that teach nothing."""
    net, rnd, end = tiny_gru(), np.random.default_rng(3), 0
    x = np.array([[0, 3, 1], [2, 5, 7], [4, 0, 2], [6, 1, 1]])
    y = np.array([[2, 5, 7], [4, 0, 2], [6, 1, 1], [1, 2, 0]])
    real = np.ones((4, 3), bool)
    real[3, 2] = False
    start = rnd.standard_normal((3, 4))

    def loss():
        h, out = start, 0.0
        for t in range(4):
            h = net.step(net.p["E"][x[t]] + net.p["b"], h * (x[t] != end)[:, None])
            out -= net.log_probs(h[real[t]], y[t][real[t]])[0].sum()
        return out

    _, g, rows, ge = net.gradients(x, y, real, start, end)
    g["E"] = np.zeros_like(net.p["E"])
    g["E"][rows] = ge
    for name, value in net.p.items():
        for spot in np.ndindex(value.shape):
            was, value[spot] = value[spot], value[spot] + 1e-6
            up = loss()
            value[spot] = was - 1e-6
            down = loss()
            value[spot] = was
            assert abs((up - down) / 2e-6 - g[name][spot]) < 1e-5, (name, spot)


def test_gru_scores_do_not_depend_on_lanes():
    """Documents scored together, in few or many lanes and chunks, against each by itself, word by word."""
    net, rnd = tiny_gru(), np.random.default_rng(4)
    docs = [np.r_[rnd.integers(1, 8, n), 0].astype(np.int32) for n in (0, 1, 5, 30, 200, 3, 7)]
    at = np.cumsum([0] + [len(d) for d in docs])
    want = []
    for d in docs:
        h, last, total = np.zeros((1, 4)), 0, 0.0
        for y in d.tolist():
            h = net.step((net.p["E"] + net.p["b"])[[last]], h * (last != 0))
            total += net.log_probs(h, np.array([y]))[0][0]
            last = y
        want.append(total / np.log(10))
    for lanes, chunk in ((192, 48), (2, 3), (1, 1000)):
        assert np.allclose(net.score(np.concatenate(docs), at, 0, lanes=lanes, chunk=chunk), want, rtol=1e-5)


def test_lm_scores(spark, rows):
    rnd = random.Random(13)
    more = [(i, t) for i, t in rows if i is not None] + [(k, " ".join(rnd.choice(["red", "blue"]) + " fish," for _ in range(40))) for k in range(200, 260)] + [(7, "One two")]
    df = docs_of(spark, more)
    got = lm_score.lm_score(df, F.col("doc_id") % 5 != 2).collect()
    tokens = lambda t: [*WORD.findall(low(t)), None]
    train = Counter(w for i, t in more if i % 5 != 2 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = Counter((i, len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in more)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["doc_id"] % 5 == 2 and r["doc_id"] >= 200]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    none = lm_score.lm_score(df, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in none)
    assert lm_score.lm_score(df.limit(0), F.lit(True)).count() == 0


def test_lm_learns_from_every_training_document(spark):
    """What the start leaves out is learned from too: the order of words, which counts don't tell, is known at any first_tokens."""
    rnd = random.Random(14)
    df = docs_of(spark, [(k, " ".join(f"{a} {a}x {a}y" for a in rnd.choices("bcdfgklm", k=40))) for k in range(400)])
    gain = lambda **how: lm_score.lm_score(df, F.col("doc_id") % 5 != 2, **how).where("not training").agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()[0]
    some, every = gain(first_tokens=400), gain()
    assert some > 0.2 * every > 0


def test_lm_training_uses_every_token():
    ids = np.arange(100, dtype=np.int32)
    cls, _, sizes = gru.classes(np.ones(101), 8)
    net = gru.GRU.init(cls, sizes, 1, 4, np.ones(102))
    was = {k: v.copy() for k, v in net.p.items()}
    net.train([np.r_[ids, 100].astype(np.int32)], 100)
    assert (net.p["w"] != was["w"])[:100].all() and (net.p["E"] != was["E"]).any(axis=1)[:100].all()
