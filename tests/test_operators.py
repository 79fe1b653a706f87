import pytest
from pyspark.sql import functions as F

from fabriq.functions import ip
from fabriq.operators import fixpoint, intervals, prefixes, tables
from fabriq.plans.policies import Statement, compare, run
from fabriq.plans.specifiers import SpecifierError, compile_nodes


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_diff_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (None, "q"), (4, None)], "k int, v string")
    assert got(tables.table_diff(a, b, ["k"])) == sorted([(None, "In both", "y", "q"), (3, "Only in Snapshot", "z", None), (3, "Only in Snapshot", "z", None), (4, "Only in Reference", None, None)], key=str)
    assert got(tables.table_diff(a.limit(0), b.limit(0), ["k"])) == []


def test_multiset_equality(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert tables.multiset_equal(a, a).first()[0] and not tables.multiset_equal(a, a.distinct()).first()[0]
    assert tables.multiset_equal(a.limit(0), a.limit(0)).first()[0]


def test_unknown_column_and_comparison(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        tables.row_options(a, ["nope"])
    with pytest.raises(ValueError):
        tables.metrics(a, ["nope"])
    with pytest.raises(ValueError):
        tables.predicate("k", "~", 1)


def test_longest_match_skips_what_may_not_forward(spark):
    r = spark.createDataFrame([(1, 0, 0, True), (1, 167772160, 8, True), (1, 167772160, 24, False)], "node int, network long, plen int, forwarding boolean")
    p = spark.createDataFrame([(1, 167772161), (1, 5), (2, 5)], "node int, ip long")
    assert got(prefixes.longest_prefix_match(p, r, ["node"]).select("ip", "plen")) == sorted([(5, 0), (167772161, 8)], key=str)


def test_intervals(spark):
    a = spark.createDataFrame([(1, 0, 9), (1, 5, 20), (2, 3, 3)], "k int, lo long, hi long")
    b = spark.createDataFrame([(1, 8, 12), (1, 21, 30)], "k int, lo long, hi long")
    assert got(intervals.union(a, b, ["k"])) == [(1, 0, 30), (2, 3, 3)]
    assert got(intervals.intersect(a, b, ["k"])) == [(1, 8, 12)]
    assert got(intervals.difference(a, b, ["k"])) == [(1, 0, 7), (1, 13, 20), (2, 3, 3)]
    assert got(intervals.complement(a, ["k"], 0, 30)) == sorted([(1, 21, 30), (2, 0, 2), (2, 4, 30)], key=str)
    assert got(intervals.union(a.limit(0), b.limit(0), ["k"])) == []


def test_addresses(spark):
    d = spark.createDataFrame([("10.0.0.1",), ("255.255.255.255",), ("256.1.1.1",), ("x",), (None,)], "t string")
    assert [r[0] for r in d.select(ip.ip_parse(F.col("t"))).collect()] == [167772161, 4294967295, None, None, None]
    assert d.where("t = '10.0.0.1'").select(ip.ip_str(ip.ip_parse(F.col("t")))).first()[0] == "10.0.0.1"
    m = spark.range(33).select("id", ip.mask(F.col("id")).alias("m"))
    assert all(r[0] == r[1] for r in m.select("id", ip.mask_bits(F.col("m"))).collect())
    assert spark.range(1).select(ip.mask_bits(F.lit(4278255360).cast("long"))).first()[0] is None


def test_fixpoints(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (3, 1, 1), (1, 3, 9), (4, 4, 1)], "src long, dst long, weight long")
    s = spark.createDataFrame([(1, 1)], "source long, node long")
    assert got(fixpoint.least_cost(s, e)) == [(1, 1, 0), (1, 2, 5), (1, 3, 6)]
    assert got(fixpoint.reach(s.select("node"), e.select("src", "dst"))) == [(1, 0), (2, 1), (3, 1)]
    n = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    assert got(fixpoint.components(n, e)) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    paths = fixpoint.frontier_paths(spark.createDataFrame([(0, 1)], "id int, node long"), e.where("src <> 4").select(F.lit(0).alias("id"), "src", "dst"), ["id"])
    assert {r["disposition"] for r in paths.collect()} == {"LOOP"}


def test_policies(spark):
    r = spark.createDataFrame([(1, 10), (2, None)], "id int, metric int")
    p = [Statement(F.col("metric") > 5, {"metric": F.col("metric") + 1}), Statement(F.col("id") == 2, accept=False), Statement(None, accept=True)]
    assert got(run(r, p, False).select("id", "metric", "action")) == [(1, 11, "PERMIT"), (2, None, "DENY")]
    q = [Statement(None, accept=True)]
    assert len(got(compare(r, p, q, ["metric"]))) == 2 and got(compare(r, q, q, ["metric"])) == []


def test_specifiers(spark):
    d = spark.createDataFrame([("a1", "X", True), ("b1", "Y", True), ("b2", "Y", False)], "hostname string, role string, active boolean")
    names = lambda t: [r[0] for r in d.where(compile_nodes(t)).orderBy("hostname").collect()]
    assert names("/^b/ & active(), A1") == ["a1", "b1"] and names(r"all() \ role(y)") == ["a1"] and names(r"(a1, b2) \ a1") == ["b2"]
    for bad in ("", "a &", "(a", "a b", "/x"):
        with pytest.raises(SpecifierError):
            compile_nodes(bad)
