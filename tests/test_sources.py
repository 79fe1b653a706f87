import json

from pyspark.sql import functions as F

from fabriq.sources import snapshots as s
from fabriq.streaming import monitor

TEXT = """hostname r1
!
interface Ethernet1
 ip address 10.0.0.1 255.255.255.0
 ip access-group A in
interface Ethernet2
 shutdown
router bgp 65001
 neighbor 10.0.0.2 remote-as 65002
ip route 192.168.0.0 255.255.0.0 10.0.0.2
"""


def test_snapshot(spark, tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/r1.cfg").write_text(TEXT)
    (tmp_path / "configs/empty.cfg").write_text(" \n")
    (tmp_path / "layer1_topology.json").write_text(json.dumps({"edges": [{"node1": {"hostname": "r1", "interfaceName": "Ethernet1"}, "node2": {"hostname": "r2", "interfaceName": "Ethernet1"}}]}))
    texts = s.read_texts(spark, str(tmp_path))
    assert {(r["file"], r["format"]) for r in s.formats(texts).collect()} == {("r1.cfg", "sections"), ("empty.cfg", "empty")}
    parts = s.sections(texts)
    assert [tuple(r) for r in s.hostnames(parts).collect()] == [("r1.cfg", "r1")]
    assert sorted(tuple(r)[1:] for r in s.interfaces(parts).collect()) == [("Ethernet1", 167772161, 24, True, "A"), ("Ethernet2", None, None, False, None)]
    assert [tuple(r) for r in s.bgp_peers(parts).collect()] == [("r1.cfg", 65001, 167772162, 65002)]
    assert [tuple(r) for r in s.static_routes(parts).collect()] == [("r1.cfg", 3232235520, 16, 167772162)]
    edges = s.layer1(spark, str(tmp_path))
    assert edges.count() == 1 and s.without(edges, edges, ["hostname"]).count() == 0
    s.write_slices(spark.range(4).withColumn("node", F.col("id") % 2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("node = 1").count() == 2
    s.write_answer(spark.range(2), str(tmp_path / "answer"))
    assert spark.read.text(str(tmp_path / "answer")).count() == 2


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = monitor.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert rows(spark.table("seen")) == rows(monitor.windowed(events))
    assert monitor.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def put(path, name, value):
    (path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_runtime_data_and_blacklists(spark, tmp_path):
    put(tmp_path, "runtime_data.json", {"runtimeData": {"r1": {"interfaces": {"e1": {"bandwidth": 1e9, "lineUp": True}, "e2": {}}}, "r2": {}}})
    assert rows(s.runtime_data(spark, str(tmp_path))) == [("r1", "e1", None, 1e9, None, True), ("r1", "e2", None, None, None, None)]
    put(tmp_path, "node_blacklist.json", ["R1", "r1"])
    put(tmp_path, "interface_blacklist.json", [{"hostname": "r2", "interface": "e1"}])
    nodes, interfaces = s.blacklists(spark, str(tmp_path))
    assert rows(nodes) == [("r1",)] and rows(interfaces) == [("r2", "e1")]
    put(tmp_path, "runtime_data.json", "{}")
    assert s.runtime_data(spark, str(tmp_path)).count() == 0


def test_external_announcements(spark, tmp_path):
    put(tmp_path, "external_bgp_announcements.json", {"Announcements": [{"type": "ebgp_sent", "network": "10.0.0.0/8", "dstIp": "1.0.0.1", "asPath": [[65001], [65002, 65003]], "communities": [7]}, {"type": "ibgp_sent", "network": "11.0.0.0/16", "dstNode": "R2"}, {"type": "lost", "network": "12.0.0.0/8", "dstIp": "9.9.9.9"}]})
    got = s.external_announcements(spark, str(tmp_path))
    assert rows(got.select("network", "plen", "as_path", "communities")) == [(167772160, 8, [65001, 65002, 65003], [7]), (184549376, 16, None, []), (201326592, 8, None, [])]
    owners = spark.createDataFrame([(16777217, 1, "r1"), (16777218, 2, "r2")], "ip long, node int, hostname string")
    assert rows(s.injected(got, owners).select("type", "node")) == [("ebgp_sent", 1), ("ibgp_sent", 2)]


SHOWN = """BGP table version is 5
   Network          Next Hop            Metric LocPrf Weight Path
*> 10.0.0.0/8       1.2.3.4                  5    100      0 65001 65002 i
*  i                1.2.3.5                                0 65003 ?
*>i192.168.1.0      2.2.2.2                  0          32768 i
not a line
"""


def test_tables_as_shown(spark):
    texts = spark.createDataFrame([("a", SHOWN), ("b", None), ("c", "")], "file string, text string")
    got = rows(s.bgp_tables(texts))
    assert got[0] == ("a", False, True, 167772160, 8, 16909061, None, None, 0, [65003], "?")
    assert ("a", True, False, 167772160, 8, 16909060, 5, 100, 0, [65001, 65002], "i") in got and len(got) == 3
    shown = "O IA 10.1.0.0/16 [110/20] via 1.1.1.1, 00:01:02, Ethernet1\nC    10.2.0.0/24 is directly connected, Ethernet2\nGateway of last resort\nS* 0.0.0.0/0 [1/0] via 9.9.9.9"
    got = rows(s.routing_tables(spark.createDataFrame([("a", shown)], "file string, text string")))
    assert got == sorted([("a", "O", 167837696, 16, 110, 20, 16843009, "Ethernet1"), ("a", "C", 167903232, 24, 0, 0, None, "Ethernet2"), ("a", "S", 0, 0, 1, 0, 151587081, None)], key=str)


def test_providers(spark, tmp_path):
    put(tmp_path, "isp_config.json", {"borderInterfaces": [{"borderInterface": {"hostname": "R1", "interface": "e1"}}, {"borderInterface": {"hostname": "r2", "interface": "e9"}}], "ispNodeInfo": [{"asn": 100, "name": "Big"}]})
    peers = spark.createDataFrame([("r1", "e1", 1, 2, 100), ("r1", "e1", 1, 3, 200), ("r1", "e2", 5, 6, 300), ("r2", "e9", 7, 8, 100), ("r2", "e9", 7, 9, None)], "hostname string, interface string, local_ip long, remote_ip long, remote_as long")
    nodes, links = s.isp_model(spark, str(tmp_path), peers)
    assert rows(nodes) == [("big", 100, "ISP"), ("internet", 65537, "INTERNET"), ("isp_200", 200, "ISP")]
    assert rows(links) == sorted([("r1", "e1", "big", 2), ("r1", "e1", "isp_200", 3), ("r2", "e9", "big", 8), ("big", "to_internet", "internet", None), ("isp_200", "to_internet", "internet", None)], key=str)


def test_reference_library_and_roles(spark, tmp_path):
    put(tmp_path, "reference_library.json", {"books": [{"name": "b", "addressGroups": [{"name": "x", "addresses": ["1.1.1.1"], "childGroupNames": ["y"]}, {"name": "y", "addresses": ["2.2.2.2"], "childGroupNames": ["x"]}, {"name": "z"}]}]})
    assert rows(s.address_groups(spark, str(tmp_path))) == [("b", "x", "1.1.1.1"), ("b", "x", "2.2.2.2"), ("b", "y", "1.1.1.1"), ("b", "y", "2.2.2.2")]
    put(tmp_path, "node_roles_data.json", {"roleDimensions": [{"name": "kind", "roleDimensionMappings": [{"regex": "([a-z]+)-.*", "canonicalRoleNames": {"br": "border"}}, {"regex": "(.).*"}]}, {"name": "site", "roleDimensionMappings": [{"regex": "([a-z]+)-([0-9]+)", "groups": [2, 1]}]}]})
    nodes = spark.createDataFrame([("BR-1",), ("core-22",), ("x",), (None,)], "hostname string")
    assert rows(s.node_roles(spark, str(tmp_path), nodes)) == sorted([("BR-1", "kind", "border"), ("core-22", "kind", "core"), ("x", "kind", "x"), ("BR-1", "site", "1-br"), ("core-22", "site", "22-core")])


def test_texts_flattened_and_annotated(spark):
    text = "system { host-name r1; /* a; */ login { user x { uid 1; } } }\ninterfaces { ge-0 { description \"a { b; }\"; disable; } } # end }"
    texts = spark.createDataFrame([("f", text), ("e", ""), ("n", None)], "file string, text string")
    assert rows(s.flattened(texts).select("line")) == sorted([("set system host-name r1",), ("set system login user x uid 1",), ('set interfaces ge-0 description "a { b; }"',), ("set interfaces ge-0 disable",)])
    plain = spark.createDataFrame([("f", TEXT), ("e", "! only\n\n")], "file string, text string")
    assert dict(rows(s.preprocessed(plain)))["e"] == "" and "!" not in dict(rows(s.preprocessed(plain)))["f"]
    got = {r["line"]: (r["section"], r["depth"]) for r in s.annotated(plain).collect()}
    assert got["ip access-group A in"] == ("interface Ethernet1", 1) and got["hostname r1"] == ("hostname r1", 0)


def test_fork(spark):
    one = lambda *r: spark.createDataFrame(list(r), "hostname string, interface string, remote_hostname string, remote_interface string")
    links = one(("a", "1", "b", "1"), ("b", "1", "a", "1"), ("a", "2", "c", "1"), ("c", "1", "a", "2"), ("b", "2", "c", "2"))
    ports = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "hostname string, interface string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "hostname string")
    got = s.fork({"links": links, "ports": ports}, names("b", "c"), spark.createDataFrame([("a", "2")], "hostname string, interface string"), restore=names("c"))
    assert rows(got["ports"]) == [("a", "1"), ("c", "1")] and rows(got["links"]) == [("c", "1", "a", "2")]
    assert s.fork({"links": links}, off_links=one(("c", "1", "a", "2")))["links"].count() == 3
    assert rows(s.fork({"ports": ports})["ports"]) == rows(ports)
