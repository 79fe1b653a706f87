"""Snapshot folders: configs/ and hosts/ with a text file per device, and JSON files of facts beside them.

Device texts are parsed for a small router dialect: hostname, interface with ip address, shutdown, access lists, router bgp with
neighbors and networks, static routes.  Each file is one row of Spark; nothing is read on the driver.
JSON files: layer1_topology, runtime_data, external_bgp_announcements, isp_config, reference_library, node_roles_data, node_blacklist,
interface_blacklist, edge_blacklist.  Null behaviour: a key that a file lacks is null; a file without the list asked for gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import ip_parse, mask_bits

#: First pattern that a text matches names its format.
FORMATS = [
    ("empty", r"^\s*$"),
    ("host_json", r"(?s)^\s*\{.*\"hostname\""),
    ("iptables", r"(?m)^\*(filter|nat|mangle)\s*$"),
    ("flat_set", r"(?m)^set (version|system|interfaces|deviceconfig|host-name|vsys) "),
    ("braces", r"(?m)^(system|interfaces|protocols|firewall|policy-options|routing-options) \{"),
    ("load_balancer", r"(?m)^(ltm|net|sys|auth) \S+ .*\{"),
    ("config_edit", r"(?m)^config (system|firewall|router) "),
    ("vdom_sections", r"(?m)^(vdc|feature) \S+"),
    ("bang_exec", r"(?m)^(boot system|switchport|spanning-tree) "),
    ("sections", r"(?m)^(hostname|interface|router|ip route|access-list) "),
]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every file under path/configs."""
    got = spark.read.text(f"{path}/configs", wholetext=True, recursiveFileLookup=True)
    return got.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


def formats(texts: DataFrame) -> DataFrame:
    kind = F.lit("unknown")
    for name, pattern in reversed(FORMATS):
        kind = F.when(F.col("text").rlike(pattern), name).otherwise(kind)
    return texts.select("file", kind.alias("format"))


def lines(texts: DataFrame) -> DataFrame:
    """(file, n, line, section): section is the last line without indentation, at or before."""
    return texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).where("trim(line) <> '' and line not like '!%'")


def sections(texts: DataFrame) -> DataFrame:
    """(file, head, body): a top line with the indented lines under it, in order; one row per section, by array functions alone."""
    parts = F.filter(F.split("text", r"\r?\n(?=[^\s!])"), lambda x: F.trim(x) != "")
    got = texts.select("file", F.explode(parts).alias("part"))
    rows = F.split("part", r"\r?\n")
    body = F.filter(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("!"))
    return got.select("file", F.trim(rows[0]).alias("head"), body.alias("body"))


def hostnames(parts: DataFrame) -> DataFrame:
    return parts.where("head like 'hostname %'").groupBy("file").agg(F.max(F.regexp_extract("head", r"^hostname (\S+)", 1)).alias("hostname"))


def _of(body: str, pattern: str, group: int = 1):
    hit = F.filter(body, lambda x: x.rlike(pattern))
    return F.when(F.size(hit) > 0, F.regexp_extract(F.get(hit, F.lit(0)), pattern, group))


def interfaces(parts: DataFrame) -> DataFrame:
    p = r"^ip address (\S+) (\S+)"
    i = parts.where("head like 'interface %'")
    return i.select("file", F.regexp_extract("head", r"^interface (\S+)", 1).alias("interface"), ip_parse(_of("body", p)).alias("ip"), mask_bits(ip_parse(_of("body", p, 2))).alias("plen"), (~F.exists("body", lambda x: x == "shutdown")).alias("active"), _of("body", r"^ip access-group (\S+) in").alias("acl_in"))


def bgp_peers(parts: DataFrame) -> DataFrame:
    b = parts.where("head like 'router bgp %'").withColumn("asn", F.regexp_extract("head", r"(\d+)$", 1).cast("long")).withColumn("x", F.explode("body"))
    n = r"^neighbor (\S+) remote-as (\d+)"
    return b.where(F.col("x").rlike(n)).select("file", "asn", ip_parse(F.regexp_extract("x", n, 1)).alias("peer_ip"), F.regexp_extract("x", n, 2).cast("long").alias("peer_as"))


def static_routes(parts: DataFrame) -> DataFrame:
    p = r"^ip route (\S+) (\S+) (\S+)"
    s = parts.where(F.col("head").rlike(p))
    return s.select("file", ip_parse(F.regexp_extract("head", p, 1)).alias("network"), mask_bits(ip_parse(F.regexp_extract("head", p, 2))).alias("plen"), ip_parse(F.regexp_extract("head", p, 3)).alias("next_hop"))


def layer1(spark: SparkSession, path: str) -> DataFrame:
    e = spark.read.json(f"{path}/layer1_topology.json", multiLine=True).select(F.explode("edges").alias("e"))
    return e.select("e.node1.hostname", F.col("e.node1.interfaceName").alias("interface"), F.col("e.node2.hostname").alias("remote_hostname"), F.col("e.node2.interfaceName").alias("remote_interface"))


def without(df: DataFrame, blacklist: DataFrame, on: list[str]) -> DataFrame:
    """df less what a blacklist names."""
    return df.join(blacklist.select(*on).distinct(), on, "left_anti")


def runtime_data(spark: SparkSession, path: str) -> DataFrame:
    """(hostname, interface, address, bandwidth, speed, line_up): what devices said at run time."""
    one = "struct<address:string,bandwidth:double,speed:double,lineUp:boolean>"
    got = _json(spark, f"{path}/runtime_data.json", f"struct<runtimeData:map<string,struct<interfaces:map<string,{one}>>>>")
    got = got.select(F.explode("j.runtimeData").alias("hostname", "d")).select("hostname", F.explode("d.interfaces").alias("interface", "i"))
    return got.select("hostname", "interface", "i.address", F.col("i.bandwidth").alias("bandwidth"), F.col("i.speed").alias("speed"), F.col("i.lineUp").alias("line_up"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file as one row with a column j of the schema; null where it is no such JSON."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))


def external_announcements(spark: SparkSession, path: str) -> DataFrame:
    """(type, network, plen, dst_node, dst_ip, src_ip, next_hop, originator, as_path, communities, local_preference, med): adverts from outside."""
    one = "struct<type:string,network:string,nextHopIp:string,srcIp:string,dstIp:string,dstNode:string,originatorIp:string,asPath:array<array<bigint>>,communities:array<bigint>,localPreference:bigint,med:bigint>"
    got = _json(spark, f"{path}/external_bgp_announcements.json", f"struct<Announcements:array<{one}>>").select(F.explode("j.Announcements").alias("a")).select("a.*")
    net = F.split("network", "/")
    return got.select("type", ip_parse(net[0]).alias("network"), F.get(net, F.lit(1)).cast("int").alias("plen"), F.col("dstNode").alias("dst_node"), ip_parse("dstIp").alias("dst_ip"), ip_parse("srcIp").alias("src_ip"), ip_parse("nextHopIp").alias("next_hop"), ip_parse("originatorIp").alias("originator"), F.flatten("asPath").alias("as_path"), F.coalesce("communities", F.expr("cast(array() as array<bigint>)")).alias("communities"), F.col("localPreference").alias("local_preference"), "med")


def injected(adverts: DataFrame, owners: DataFrame) -> DataFrame:
    """Adverts that reach a node: sent to an address (dst_ip) that it owns, or by its name where no address is given; owners: (ip, node, hostname)."""
    by_ip = adverts.join(owners.select(F.col("ip").alias("dst_ip"), "node").distinct(), "dst_ip")
    by_name = adverts.where("dst_ip is null").join(owners.select(F.lower("hostname").alias("__h"), "node").distinct(), F.lower("dst_node") == F.col("__h")).drop("__h")
    return by_ip.unionByName(by_name)


def bgp_tables(texts: DataFrame) -> DataFrame:
    """(file, best, internal, network, plen, next_hop, metric, local_preference, weight, as_path, origin) of tables as routers show them.

    A line: marks (* valid, > best, i internal), prefix, next hop, and numbers; the last are weight and AS path, before them what is there
    of metric and preference; a line without a prefix is another path of the prefix above it.
    """
    rows = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).where(F.col("line").rlike(r"^\s?\*"))
    p = r"^\s?\*([ >=sdhr]*)(i?)\s*(\d+\.\d+\.\d+\.\d+(?:/\d+)?)?\s+(\d+\.\d+\.\d+\.\d+)\s+(.*?)\s*([ie?])?\s*$"
    got = rows.where(F.col("line").rlike(p)).select("file", "n", *(F.regexp_extract("line", p, k + 1).alias(c) for k, c in enumerate(("marks", "inner", "prefix", "hop", "rest", "origin"))))
    from pyspark.sql import Window

    above = F.last(F.when(F.col("prefix") != "", F.col("prefix")), ignorenulls=True).over(Window.partitionBy("file").orderBy("n"))
    got = got.withColumn("net", F.split(above, "/")).withColumn("numbers", F.transform(F.filter(F.split("rest", r"\s+"), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("long")))
    # the columns metric, preference and weight are told apart by how much white space is before them; a zero or 32768 is where the weight stands
    at = F.array_position(F.transform("numbers", lambda x: x.isin(0, 32768)), True)
    last = F.when(at > 0, F.aggregate(F.sequence(F.lit(1), F.least(F.size("numbers"), F.lit(3))), F.lit(0), lambda s, k: F.when(F.element_at("numbers", k).isin(0, 32768), k).otherwise(s)))
    got = got.withColumn("w", last.cast("int"))
    before = F.when(F.col("w") > 1, F.slice("numbers", 1, F.col("w") - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    none = F.lit(None).cast("long")
    path = F.when(F.col("w").isNotNull(), F.slice("numbers", F.col("w") + 1, F.greatest(F.size("numbers") - F.col("w"), F.lit(0)))).otherwise(F.col("numbers"))
    default = F.when(F.get("net", F.lit(0)).startswith("10."), 8).when(F.regexp_extract(F.get("net", F.lit(0)), r"^(\d+)", 1).cast("int") < 128, 8).when(F.regexp_extract(F.get("net", F.lit(0)), r"^(\d+)", 1).cast("int") < 192, 16).otherwise(24)
    return got.select("file", F.col("marks").contains(">").alias("best"), (F.col("inner") == "i").alias("internal"), ip_parse(F.get("net", F.lit(0))).alias("network"), F.coalesce(F.get("net", F.lit(1)).cast("int"), default).alias("plen"), ip_parse("hop").alias("next_hop"), F.when(F.size(before) > 0, F.get(before, F.lit(0))).otherwise(none).alias("metric"), F.when(F.size(before) > 1, F.get(before, F.lit(1))).otherwise(none).alias("local_preference"), F.when(F.col("w").isNotNull(), F.element_at("numbers", F.col("w"))).alias("weight"), path.alias("as_path"), F.when(F.col("origin") != "", F.col("origin")).alias("origin"))


def routing_tables(texts: DataFrame) -> DataFrame:
    """(file, protocol, network, plen, admin, metric, next_hop, interface) of routing tables as routers show them: code, prefix, [admin/metric], via or directly."""
    p = r"^([A-Z])\*?\s*(?:[A-Z0-9]{1,2}\s+)?(\d+\.\d+\.\d+\.\d+)/(\d+)\s*(?:\[(\d+)/(\d+)\])?\s*(?:via (\d+\.\d+\.\d+\.\d+)|is directly connected)(?:,\s*(?:[\d:wdh]+,\s*)?([A-Za-z]\S*))?"
    rows = texts.select("file", F.explode(F.split("text", r"\r?\n")).alias("line")).where(F.col("line").rlike(p))
    g = lambda k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    return rows.select("file", g(1).alias("protocol"), ip_parse(g(2)).alias("network"), g(3).cast("int").alias("plen"), F.coalesce(g(4).cast("int"), F.lit(0)).alias("admin"), F.coalesce(g(5).cast("long"), F.lit(0)).alias("metric"), ip_parse(g(6)).alias("next_hop"), g(7).alias("interface"))


def isp_model(spark: SparkSession, path: str, peers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) that stand for providers: a node for each remote AS of the peers on border interfaces, the internet behind all of them.

    peers: (hostname, interface, local_ip, remote_ip, remote_as).  A provider's name is that of isp_config's ispNodeInfo, else isp_<AS>.
    """
    kind = "struct<borderInterfaces:array<struct<borderInterface:struct<hostname:string,interface:string>>>,ispNodeInfo:array<struct<asn:bigint,name:string>>>"
    j = _json(spark, f"{path}/isp_config.json", kind)
    border = j.select(F.explode("j.borderInterfaces.borderInterface").alias("b")).select(F.lower("b.hostname").alias("__h"), F.lower("b.interface").alias("__i")).distinct()
    names = j.select(F.explode("j.ispNodeInfo").alias("n")).select(F.col("n.asn").alias("remote_as"), "n.name").dropDuplicates(["remote_as"])
    at = peers.where("remote_as is not null").join(border, (F.lower("hostname") == F.col("__h")) & (F.lower("interface") == F.col("__i")), "left_semi").join(names, "remote_as", "left")
    at = at.withColumn("isp", F.coalesce(F.lower("name"), F.concat(F.lit("isp_"), F.col("remote_as").cast("string"))))
    nodes = at.select(F.col("isp").alias("hostname"), F.col("remote_as").alias("asn")).distinct().withColumn("kind", F.lit("ISP"))
    links = at.select("hostname", "interface", F.col("isp").alias("remote_hostname"), F.col("remote_ip").alias("remote_ip")).distinct()
    net = nodes.limit(1).select(F.lit("internet").alias("hostname"), F.lit(65537).cast("long").alias("asn"), F.lit("INTERNET").alias("kind"))
    up = nodes.select("hostname", F.lit("to_internet").alias("interface"), F.lit("internet").alias("remote_hostname"), F.lit(None).cast("long").alias("remote_ip"))
    return nodes.unionByName(net), links.unionByName(up)


def address_groups(spark: SparkSession, path: str) -> DataFrame:
    """(book, name, address): the address groups of the reference library, with the addresses of the groups that they name, however deep."""
    from ..operators import fixpoint

    kind = "struct<books:array<struct<name:string,addressGroups:array<struct<name:string,addresses:array<string>,childGroupNames:array<string>>>>>>"
    g = _json(spark, f"{path}/reference_library.json", kind).select(F.explode("j.books").alias("b")).select(F.col("b.name").alias("book"), F.explode("b.addressGroups").alias("g"))
    own = g.select("book", F.col("g.name").alias("group"), F.explode_outer("g.addresses").alias("address"))
    kids = g.select("book", F.col("g.name").alias("src"), F.explode("g.childGroupNames").alias("dst"))
    start = g.select("book", F.col("g.name").alias("name"), F.col("g.name").alias("group")).distinct()
    into = fixpoint.reach(start, kids, state="group", keep=["book", "name"])
    return into.join(own, ["book", "group"]).where("address is not null").select("book", "name", "address").distinct()


def node_roles(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """(hostname, dimension, role): roles by the first group of each dimension's patterns, lower case, or by a mapping's names."""
    kind = "struct<roleDimensions:array<struct<name:string,roleDimensionMappings:array<struct<regex:string,groups:array<int>,canonicalRoleNames:map<string,string>>>>>>"
    m = _json(spark, f"{path}/node_roles_data.json", kind).select(F.explode("j.roleDimensions").alias("d")).select(F.col("d.name").alias("dimension"), F.posexplode("d.roleDimensionMappings").alias("k", "m"))
    m = m.select("dimension", "k", "m.regex", F.coalesce("m.groups", F.array(F.lit(1))).alias("groups"), F.col("m.canonicalRoleNames").alias("names"))
    hit = nodes.select("hostname").distinct().join(F.broadcast(m), F.expr("hostname rlike concat('(?i)^', regex, '$')"))  # patterns are few: dimensions by mappings
    found = F.array_join(F.expr("transform(groups, g -> regexp_extract(hostname, concat('(?i)^', regex, '$'), g))"), "-")
    hit = hit.withColumn("found", F.lower(found)).withColumn("role", F.coalesce(F.try_element_at("names", F.col("found")), F.col("found")))
    return hit.groupBy("hostname", "dimension").agg(F.min(F.struct("k", "role")).alias("b")).select("hostname", "dimension", "b.role")


def flattened(texts: DataFrame) -> DataFrame:
    """(file, n, line): hierarchical texts as set lines: ``a { b c; d { e; } }`` is ``set a b c`` and ``set a d e``; comments are left out."""
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", " "), r"(?m)#.*$", " ")
    parts = F.regexp_extract_all(bare, F.lit(r"\"[^\"]*\"|[^\s{};]+|[{};]"), F.lit(0))
    state = F.expr("named_struct('stack', cast(array() as array<string>), 'words', cast(array() as array<string>), 'out', cast(array() as array<string>))")
    nothing = F.expr("cast(array() as array<string>)")

    def step(s, x):
        opened = F.struct(F.concat(s["stack"], F.array(F.array_join(s["words"], " "))).alias("stack"), nothing.alias("words"), s["out"].alias("out"))
        line = F.concat_ws(" ", F.lit("set"), F.array_join(F.concat(s["stack"], F.array(F.array_join(s["words"], " "))), " "))
        ended = F.struct(s["stack"].alias("stack"), nothing.alias("words"), F.when(F.size(s["words"]) > 0, F.concat(s["out"], F.array(line))).otherwise(s["out"]).alias("out"))
        closed = F.struct(F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0))).alias("stack"), nothing.alias("words"), s["out"].alias("out"))
        more = F.struct(s["stack"].alias("stack"), F.concat(s["words"], F.array(x)).alias("words"), s["out"].alias("out"))
        return F.when(x == "{", opened).when(x == ";", ended).when(x == "}", closed).otherwise(more)

    return texts.select("file", F.posexplode(F.aggregate(parts, state, step, lambda s: s["out"])).alias("n", "line"))


def preprocessed(texts: DataFrame) -> DataFrame:
    """(file, text) without comment lines, blank lines and white space at the ends of lines."""
    lines_ = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.rtrim(x)), lambda x: ~x.rlike(r"^\s*([!#].*)?$"))
    return texts.select("file", F.array_join(lines_, "\n").alias("text"))


def annotated(texts: DataFrame) -> DataFrame:
    """(file, n, line, section, depth): each line with the top line that it stands under and how far it is indented."""
    from pyspark.sql import Window

    rows = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).where("trim(line) <> ''")
    depth = F.length("line") - F.length(F.ltrim("line"))
    top = F.last(F.when((depth == 0) & ~F.col("line").startswith("!"), F.trim("line")), ignorenulls=True).over(Window.partitionBy("file").orderBy("n"))
    return rows.select("file", "n", F.trim("line").alias("line"), top.alias("section"), depth.alias("depth"))


def blacklists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, interfaces): names of nodes, and (hostname, interface) pairs, that are switched off."""
    nodes = _json(spark, f"{path}/node_blacklist.json", "array<string>").select(F.explode("j").alias("hostname"))
    i = _json(spark, f"{path}/interface_blacklist.json", "array<struct<hostname:string,interface:string>>").select(F.explode("j").alias("i"))
    return nodes.select(F.lower("hostname").alias("hostname")).distinct(), i.select(F.lower("i.hostname").alias("hostname"), F.col("i.interface").alias("interface")).distinct()


def fork(tables: dict[str, DataFrame], off_nodes: DataFrame | None = None, off_interfaces: DataFrame | None = None, off_links: DataFrame | None = None, restore: DataFrame | None = None) -> dict[str, DataFrame]:
    """A snapshot's tables less what is switched off: nodes by hostname, interfaces, links by both ends; restore: hostnames that stay on after all.

    Rows are left out of every table that has the columns; a link goes with either of its nodes.
    """
    out = {}
    if off_nodes is not None and restore is not None:
        off_nodes = without(off_nodes, restore, ["hostname"])
    for name, df in tables.items():
        if off_nodes is not None:
            for c in ("hostname", "remote_hostname"):
                if c in df.columns:
                    df = df.join(off_nodes.select(F.col("hostname").alias(c)).distinct(), c, "left_anti")
        if off_interfaces is not None and {"hostname", "interface"} <= set(df.columns):
            df = without(df, off_interfaces, ["hostname", "interface"])
        ends = ["hostname", "interface", "remote_hostname", "remote_interface"]
        if off_links is not None and set(ends) <= set(df.columns):
            turned = off_links.select(*(F.col(c).alias(d) for c, d in zip(ends, ends[2:] + ends[:2])))
            df = without(df, off_links.select(*ends).unionByName(turned), ends)
        out[name] = df.select(*tables[name].columns)
    return out


def read_slice(spark: SparkSession, path: str, hosts: list | None = None, by: str = "node") -> DataFrame:
    """What write_slices wrote; with hosts only their folders are read."""
    got = spark.read.parquet(path)
    return got.where(F.col(by).isin(hosts)) if hosts is not None else got


def write_slices(df: DataFrame, path: str, by: str = "node") -> None:
    """A folder per value, so that a question on few nodes reads only these."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_answer(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, and path-status beside them with the columns, the status and how many rows there are."""
    from ..operators.answers import status_of

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    head = status_of(df).withColumn("columns", F.array(*(F.struct(F.lit(c).alias("name"), F.lit(t).alias("type")) for c, t in df.dtypes)))
    head.select(F.to_json(F.struct("status", "num_results", "columns")).alias("value")).write.mode("overwrite").text(f"{path.rstrip('/')}-status")
