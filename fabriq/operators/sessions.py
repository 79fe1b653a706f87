"""Sessions of routing protocols: which configured ends fit together, and why the others don't.

Null behaviour: a null setting is one that is not configured and leads to the status that says so; rows with a null node meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import network

# Statuses in the order in which they are tried.
BGP_STATUSES = ["LOCAL_IP_UNKNOWN_STATICALLY", "NO_LOCAL_IP", "NO_LOCAL_AS", "NO_REMOTE_IP", "NO_REMOTE_PREFIX", "NO_REMOTE_AS", "INVALID_LOCAL_IP", "UNKNOWN_REMOTE", "HALF_OPEN", "MULTIPLE_REMOTES", "UNIQUE_MATCH", "DYNAMIC_MATCH", "NO_MATCH_FOUND"]
OSPF_STATUSES = ["PROCESS_INVALID", "UNKNOWN_COMPATIBILITY_ISSUE", "AREA_INVALID", "NO_SESSION", "PASSIVE_MISMATCH", "AREA_MISMATCH", "DUPLICATE_ROUTER_ID", "AREA_TYPE_MISMATCH", "NETWORK_TYPE_MISMATCH", "HELLO_INTERVAL_MISMATCH", "DEAD_INTERVAL_MISMATCH", "ESTABLISHED"]
IPSEC_STATUSES = ["MISSING_END_POINT", "IKE_PHASE1_FAILED", "IKE_PHASE1_KEY_MISMATCH", "IPSEC_PHASE2_FAILED", "IPSEC_SESSION_ESTABLISHED"]


def session_type(local_as: Column, remote_as: Column, multihop: Column) -> Column:
    return F.when(local_as == remote_as, "IBGP").when(multihop, "EBGP_MULTIHOP").when(local_as.isNotNull() & remote_as.isNotNull(), "EBGP_SINGLEHOP").otherwise("UNSET")


def bgp_links(peers: DataFrame, owners: DataFrame, links: DataFrame) -> DataFrame:
    """(id, remote_id): each peer with the peers that it fits, in both directions' view.

    peers: (id, node, kind, local_ip, local_as, remote_ip, remote_as, remote_network, remote_plen, num); kind is ACTIVE, PASSIVE or
    UNNUMBERED; owners: (ip, node); links: (node, num, remote_node, remote_num), for peers without addresses.
    Active ends meet by equality of swapped addresses; a passive end meets those of active ends whose local address its prefix
    holds, at an address of its node, by equality on the masked address of each length that occurs.
    """
    full = peers.where("local_as is not null and remote_as is not null")
    a = full.where("kind = 'ACTIVE' and local_ip is not null and remote_ip is not null").select("id", "node", "local_ip", "remote_ip", "local_as", "remote_as")
    b = a.select(F.col("id").alias("remote_id"), F.col("remote_ip").alias("local_ip"), F.col("local_ip").alias("remote_ip"), F.col("remote_as").alias("local_as"), F.col("local_as").alias("remote_as"), F.col("node").alias("other"))
    both = a.join(b, ["local_ip", "remote_ip", "local_as", "remote_as"]).where("node <> other").select("id", "remote_id")
    p = full.where("kind = 'PASSIVE' and remote_network is not null and remote_plen is not null")
    lengths = p.select("remote_plen").distinct()  # 33 at most
    tried = a.crossJoin(F.broadcast(lengths)).withColumn("remote_network", network(F.col("local_ip"), F.col("remote_plen")))
    at = owners.select(F.col("ip").alias("remote_ip"), F.col("node").alias("owner")).distinct()
    p = p.select(F.col("id").alias("remote_id"), F.col("node").alias("owner"), "remote_network", "remote_plen", F.col("local_as").alias("remote_as"), F.col("remote_as").alias("local_as"))
    dynamic = tried.join(at, "remote_ip").join(p, ["owner", "remote_network", "remote_plen", "remote_as", "local_as"]).where("node <> owner").select("id", "remote_id").distinct()
    u = full.where("kind = 'UNNUMBERED'")
    far = u.select(F.col("id").alias("remote_id"), F.col("node").alias("remote_node"), F.col("num").alias("remote_num"), F.col("local_as").alias("remote_as"), F.col("remote_as").alias("local_as"))
    plain = u.select("id", "node", "num", "local_as", "remote_as").join(links, ["node", "num"]).join(far, ["remote_node", "remote_num", "local_as", "remote_as"]).select("id", "remote_id").distinct()
    return both.unionByName(dynamic).unionByName(dynamic.select(F.col("remote_id").alias("id"), F.col("id").alias("remote_id"))).unionByName(plain)


def bgp_compatibility(peers: DataFrame, owners: DataFrame, links: DataFrame) -> DataFrame:
    """peers with session_type, n_remotes and configured status; see bgp_links."""
    n = bgp_links(peers, owners, links).groupBy("id").agg(F.count_distinct("remote_id").alias("n_remotes"))
    mine = owners.select(F.col("ip").alias("local_ip"), "node").distinct().withColumn("__mine", F.lit(True))
    known = owners.select(F.col("ip").alias("remote_ip")).distinct().withColumn("__known", F.lit(True))
    got = peers.join(n, "id", "left").join(mine, ["local_ip", "node"], "left").join(known, "remote_ip", "left")
    got = got.withColumn("n_remotes", F.coalesce("n_remotes", F.lit(0))).withColumn("session_type", session_type(F.col("local_as"), F.col("remote_as"), F.col("multihop")))
    null = lambda c: F.col(c).isNull()
    count = F.when(F.col("n_remotes") == 0, "HALF_OPEN").when(F.col("n_remotes") > 1, "MULTIPLE_REMOTES").otherwise("UNIQUE_MATCH")
    unknown = F.when(F.col("session_type").isin("EBGP_MULTIHOP", "IBGP"), "LOCAL_IP_UNKNOWN_STATICALLY").otherwise("NO_LOCAL_IP")
    active = F.when(null("local_ip"), unknown).when(null("local_as"), "NO_LOCAL_AS").when(null("remote_ip"), "NO_REMOTE_IP").when(null("remote_as"), "NO_REMOTE_AS").when(null("__mine"), "INVALID_LOCAL_IP").when(null("__known"), "UNKNOWN_REMOTE").otherwise(count)
    passive = F.when(null("local_as"), "NO_LOCAL_AS").when(null("remote_network") | null("remote_plen"), "NO_REMOTE_PREFIX").when(null("remote_as"), "NO_REMOTE_AS").when(F.col("n_remotes") > 0, "DYNAMIC_MATCH").otherwise("NO_MATCH_FOUND")
    plain = F.when(null("local_as"), "NO_LOCAL_AS").when(null("remote_as"), "NO_REMOTE_AS").otherwise(count)
    return got.withColumn("status", F.when(F.col("kind") == "ACTIVE", active).when(F.col("kind") == "PASSIVE", passive).otherwise(plain)).drop("__mine", "__known")


def bgp_status(compatible: DataFrame, links: DataFrame, established: DataFrame) -> DataFrame:
    """compatible's rows with established_status: ESTABLISHED if a link of theirs (id, remote_id) is among the established, else NOT_ESTABLISHED, or NOT_COMPATIBLE."""
    up = links.join(established, ["id", "remote_id"], "left_semi").select("id").distinct().withColumn("__up", F.lit(True))
    fits = F.col("status").isin("UNIQUE_MATCH", "DYNAMIC_MATCH", "MULTIPLE_REMOTES")
    status = F.when(fits & F.col("__up").isNotNull(), "ESTABLISHED").when(fits, "NOT_ESTABLISHED").otherwise("NOT_COMPATIBLE")
    return compatible.join(up, "id", "left").withColumn("established_status", status).drop("__up")


def ospf_compatibility(ends: DataFrame, links: DataFrame) -> DataFrame:
    """links (node, num, remote_node, remote_num) with session_status.

    ends: (node, num, process, area, area_valid, passive, router_id, stub_type, network_type, ip, plen, hello, dead, nbma_neighbors);
    a null process has no valid process, a null area no setting; unknown network types are taken to match; prefixes are compared unless the
    type is POINT_TO_POINT; nbma_neighbors: addresses, for NON_BROADCAST_MULTI_ACCESS ends.
    """
    names = [c for c in ends.columns if c not in ("node", "num")]
    near = ends.withColumnsRenamed({c: f"l_{c}" for c in names})
    far = ends.withColumnsRenamed({c: f"r_{c}" for c in names} | {"node": "remote_node", "num": "remote_num"})
    got = links.join(near, ["node", "num"]).join(far, ["remote_node", "remote_num"])
    c = F.col
    differ = lambda x: c(f"l_{x}") != c(f"r_{x}")
    kind = F.coalesce("l_network_type", "r_network_type")
    subnet = lambda s: F.struct(network(c(f"{s}_ip"), c(f"{s}_plen")), c(f"{s}_plen"))
    listed = F.coalesce(F.array_contains("l_nbma_neighbors", c("r_ip")), F.lit(False))
    status = (
        F.when(c("l_process").isNull() | c("r_process").isNull(), "PROCESS_INVALID")
        .when(c("l_area").isNull() | c("r_area").isNull(), "UNKNOWN_COMPATIBILITY_ISSUE")
        .when(~c("l_area_valid") | ~c("r_area_valid"), "AREA_INVALID")
        .when(c("l_passive") & c("r_passive"), "NO_SESSION")
        .when(differ("passive"), "PASSIVE_MISMATCH")
        .when(differ("area"), "AREA_MISMATCH")
        .when(c("l_router_id") == c("r_router_id"), "DUPLICATE_ROUTER_ID")
        .when(differ("stub_type"), "AREA_TYPE_MISMATCH")
        .when(differ("network_type"), "NETWORK_TYPE_MISMATCH")
        .when(kind.isNotNull() & (kind != "POINT_TO_POINT") & (subnet("l") != subnet("r")), "NO_SESSION")
        .when(differ("hello"), "HELLO_INTERVAL_MISMATCH")
        .when(differ("dead"), "DEAD_INTERVAL_MISMATCH")
        .when((c("l_network_type") == "NON_BROADCAST_MULTI_ACCESS") & ~listed, "NO_SESSION")
        .otherwise("ESTABLISHED")
    )
    return got.withColumn("session_status", status).select("node", "num", "remote_node", "remote_num", c("l_area").alias("area"), c("r_area").alias("remote_area"), "session_status")


def ipsec_sessions(peers: DataFrame) -> DataFrame:
    """(id, remote_id, status): ends whose addresses are each other's; proposals and keys are negotiated in phases.

    peers: (id, local_ip, remote_ip, ike_proposals, ike_key, ipsec_proposals).  An end without a counterpart is a row with a null remote_id.
    """
    far = peers.select(F.col("id").alias("remote_id"), F.col("remote_ip").alias("local_ip"), F.col("local_ip").alias("remote_ip"), F.col("ike_proposals").alias("__ike"), F.col("ike_key").alias("__key"), F.col("ipsec_proposals").alias("__ipsec"))
    got = peers.join(far, ["local_ip", "remote_ip"], "left")
    none = lambda a, b: ~F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    status = (
        F.when(F.col("remote_id").isNull(), "MISSING_END_POINT")
        .when(none("ike_proposals", "__ike"), "IKE_PHASE1_FAILED")
        .when(~F.coalesce(F.col("ike_key") == F.col("__key"), F.lit(False)), "IKE_PHASE1_KEY_MISMATCH")
        .when(none("ipsec_proposals", "__ipsec"), "IPSEC_PHASE2_FAILED")
        .otherwise("IPSEC_SESSION_ESTABLISHED")
    )
    return got.select("id", "remote_id", status.alias("status"))
