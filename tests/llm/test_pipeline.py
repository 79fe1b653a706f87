import random

import duckdb
import pytest

import corpus_pipeline
from fabriq.llm import queries


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data).cache()
        assert out.columns == docs.columns and 0 < out.count() <= rows, name
        docs, rows = out, out.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert last.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n_removed int"
VOCAB = {"en": "the of and that which house river under great morning".split(), "fr": "le de et que qui maison fleuve sous grand matin".split()}


def prose(rnd, lang, n):
    return " ".join(rnd.choice(VOCAB[lang]) + rnd.choice(("", "", "s", "x" + str(rnd.randrange(50)).translate(str.maketrans("0123456789", "abcdefghij")))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean documents, copies, passages, benchmark items, rows without id, text, language or source, repeated rows, other columns."""
    where, rnd = tmp_path_factory.mktemp("tables"), random.Random(51)
    rows = [(k, prose(rnd, lang := ("en", "fr")[k % 2], 80), lang if k % 5 else None, f"src{k % 7}") for k in range(60)]
    item, passage = prose(rnd, "en", 30), prose(rnd, "fr", 60)
    rows += [(100, rows[3][1], "fr", "src1"), (101, rows[4][1] + " end", "en", "src1"), (102, prose(rnd, "en", 40) + " " + item + " " + prose(rnd, "en", 40), "en", "src2")]
    rows += [(103 + k, prose(rnd, "fr", 50) + " " + passage + " " + prose(rnd, "fr", 50), "fr", "src3") for k in range(3)]
    rows += [(110, None, "en", "src1"), (111, "", "en", "src1"), (112, " 12 !?", None, "src1"), (None, rows[5][1], "fr", "src1"), (113, prose(rnd, "en", 70), "en", None), rows[7], rows[7], (114, prose(rnd, "fr", 20_000), "fr", "src2")]
    docs = [(i, t, lang, source, len(t or ""), "clash", 1) for i, t, lang, source in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{where}/some/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{where}/none/documents.parquet")
    for name, items in (("some", [(1, item), (2, None), (3, "")]), ("none", [])):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/{name}/benchmark.parquet")
    return where


def test_stages_on_odd_rows(spark, tables):
    """Every decision takes effect, clean documents stay, and each stage has documents' columns."""
    docs, got = spark.read.parquet(f"{tables}/some/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tables}/some").cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        got[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = {name: [i for i, _ in rows] for name, rows in got.items()}
    clean = set(range(60)) | {113, 114}
    assert set(ids["language_id"]) == clean | set(range(100, 106)) | {None} and ids["language_id"].count(7) == 3
    assert set(ids["ngram_jaccard_join"]) == clean | set(range(102, 106)) | {None}
    assert dict(got["substring_dedup"])[103] == dict(got["language_id"])[103]
    before = dict(got["language_id"])
    assert all(len(dict(got["substring_dedup"])[k].split()) == len(before[k].split()) - 60 for k in (104, 105))
    assert set(ids["decontamination"]) == clean | {103, 104, 105} | {None}
    assert all(t == before[i] for i, t in got["decontamination"] if i in clean)


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, f"{tables}/some")
    kept = {r["doc_id"] for r in got.collect()}
    assert kept and not kept & {100, 101, 102, 110, 111, 112}
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0


def test_documents_without_id_stay(spark, data):
    same = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(i, same, "en", "s", len(same)) for i in (1, 2, None, None)] + [(3, "other words", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, data)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "None", "None"]
    for name, stage in corpus_pipeline.STAGES[2:4]:
        got = stage(spark, got, data)
        assert got.where("doc_id is null").count() == 2, name


def test_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, data)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key), name
