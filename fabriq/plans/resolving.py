"""Questions on specifiers: what they pick, what is suggested, and headers and routes by named sets."""

from pyspark.sql import functions as F

from ..sources.project import Facts
from . import specifiers
from .registry import question


@question("SELECT hostname, interface FROM device_port WHERE regexp_matches(hostname, '^n[1-4]$') AND (regexp_matches(interface, 'Ethernet[2-5]') OR interface = 'Ethernet7/1') AND NOT vrf = 'blue' OR coalesce(zone = 'inside', false) AND (ip BETWEEN 167772160 AND 167772671) OR type = 'LOOPBACK' AND coalesce(zone = 'outside', false)")
def resolve_interface_specifier(f: Facts):
    text = r"/^n[1-4]$/[(/Ethernet[2-5]/, ethernet7/1) \ vrf(blue)], zone(inside) & connectedTo(10.0.0.0/23), type(loopback) & zone(outside)"
    return specifiers.resolve("interface", f.device_port, text).select("hostname", "interface")


@question("SELECT hostname, interface, filter, direction FROM device_filter WHERE direction = 'in' AND interface = 'Ethernet3/1' OR hostname = 'n2' AND regexp_matches(filter, 'out_[01]') OR filter = 'acl_out_4' AND NOT (direction = 'out' AND vrf = 'blue')")
def resolve_filter_specifier(f: Facts):
    text = r"in(Ethernet3/1), n2[/out_[01]/], acl_out_4 \ out(vrf(blue))"
    return specifiers.resolve("filter", f.device_filter, text).select("hostname", "interface", "filter", "direction")


@question("SELECT hostname, interface, kind FROM (SELECT hostname, role, active, interface, vrf, zone, type, ip, unnest(['INTERFACE', 'ENTER']) AS kind FROM device_port UNION ALL SELECT 'internet', NULL, true, NULL, NULL, NULL, NULL, NULL, 'INTERNET') WHERE kind = 'INTERNET' OR kind = 'ENTER' AND hostname = 'n3' AND interface = 'Ethernet2/1' OR kind = 'INTERFACE' AND role = 'FRANCE' OR kind = 'INTERFACE' AND hostname = 'n1' AND vrf = 'blue'")
def resolve_location_specifier(f: Facts):
    p = f.device_port.withColumn("kind", F.explode(F.array(F.lit("INTERFACE"), F.lit("ENTER"))))
    net = f.spark.createDataFrame([("internet", True, "INTERNET")], "hostname string, active boolean, kind string")
    return specifiers.resolve("location", p.unionByName(net, allowMissingColumns=True), "internet, enter(n3[Ethernet2/1]), role(france), n1[vrf(blue)]").select("hostname", "interface", "kind")


@question("SELECT DISTINCT ip FROM address WHERE ip BETWEEN 167772160 AND 167772415 AND NOT ip BETWEEN 167772162 AND 167772163 OR ip & 255 = 254 AND (ip >> 24) = 10 OR ip = 167772931 OR ip BETWEEN 167773184 AND 167773190")
def resolve_ip_specifier(f: Facts):
    text = r"10.0.0.0/24 \ 10.0.0.2-10.0.0.3, 10.0.0.254:0.255.255.0, ref.addressGroup(servers)"
    return f.address.where(specifiers.compile_ips(text, groups={"servers": ["10.0.3.3", "10.0.4.0-10.0.4.6"]})).select("ip").distinct()


@question("SELECT DISTINCT ip FROM device_port WHERE role = 'FRANCE' AND active")
def ips_of_locations(f: Facts):
    """Addresses of the interfaces that a location specifier picks."""
    p = f.device_port.withColumn("kind", F.lit("INTERFACE"))
    return specifiers.resolve("location", p, "role(france)").where("active").select("ip").distinct()


@question("SELECT flow FROM header WHERE proto = 6 AND (port BETWEEN 22 AND 22 OR port BETWEEN 8000 AND 9000 OR port BETWEEN 80 AND 80 OR port BETWEEN 443 AND 443) OR proto = 17 AND port = 53 OR proto = 1 AND tcp_flags % 16 = 8")
def resolve_application_specifier(f: Facts):
    h = f.header.select("flow", F.col("proto").alias("protocol"), F.col("port").alias("dst_port"), (F.col("tcp_flags") % 16).alias("icmp_type"))
    return specifiers.resolve("application", h, "ssh, tcp/8000-9000, /^https?$/, udp/53, icmp/echo-request").select("flow")


@question("SELECT flow FROM header WHERE proto <> 6 AND proto <> 1")
def resolve_protocol_specifier(f: Facts):
    return f.header.where(specifiers.compile_protocols("!tcp, !1", "proto")).select("flow")


@question("SELECT name, kind FROM structure WHERE (regexp_matches(name, '^s1[0-9]$') OR name = 's7') AND name <> 's13'")
def resolve_name_specifier(f: Facts):
    """Names of structures or policies by names, patterns and sets."""
    return f.structure.where(specifiers.compile_names(r"(/^s1[0-9]$/, S7) \ s13", "name")).select("name", "kind")


@question("SELECT flow, disposition FROM (SELECT event_id AS flow, CASE event_id % 5 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'NO_ROUTE' WHEN 2 THEN 'LOOP' WHEN 3 THEN 'EXITS_NETWORK' ELSE 'DENIED_IN' END AS disposition FROM events) WHERE disposition IN ('NO_ROUTE', 'LOOP', 'EXITS_NETWORK')")
def disposition_sets(f: Facts):
    """Failures but denials, and what exits."""
    names = ["ACCEPTED", "NO_ROUTE", "LOOP", "EXITS_NETWORK", "DENIED_IN"]
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int"))
    picked = specifiers.values("failure, exits_network, !/^denied/", names, specifiers.DISPOSITION_GROUPS)
    return f.table("events").select(F.col("event_id").alias("flow"), kind.alias("disposition")).where(F.col("disposition").isin(picked))


@question("SELECT kind, count(*) AS names FROM names GROUP BY kind")
def completion_metadata(f: Facts):
    return f.names.groupBy("kind").agg(F.count("*").alias("names"))


@question("SELECT text, CAST(CASE WHEN lower(text) = 'n1' THEN 0 WHEN starts_with(lower(text), 'n1') THEN 1 ELSE 2 END AS INTEGER) AS rank FROM names WHERE kind = 'node' AND contains(lower(text), 'n1') ORDER BY rank, text LIMIT 10")
def autocomplete(f: Facts):
    return specifiers.suggestions(f.names, "node", "N1")
