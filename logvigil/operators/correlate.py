"""Alerts to incidents: shared-key clusters, login pivot, connected components, rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.config import Thresholds
from logvigil.functions.net import subnet
from logvigil.functions.timing import floor_div
from logvigil.operators.intervals import UNBOUNDED, numbered, overlapping, trailing_stats
from logvigil.operators.scoring import entity_rows, scored
from logvigil.session import settled, settled_with

# Kill-chain order.
STAGES = ["Reconnaissance", "Credential Access", "Initial Access", "Privilege Escalation", "Persistence",
          "Exfiltration"]


def memberships(alerts: DataFrame) -> DataFrame:
    """One row per alert and correlation key: its ip, its user and, for R3 only, its subnet."""
    keys = F.array(
        F.struct(F.lit("ip").alias("kind"), F.col("src_ip").alias("value")),
        F.struct(F.lit("user").alias("kind"), F.col("user").alias("value")),
        F.struct(F.lit("subnet").alias("kind"), F.when(F.col("rule_id") == "R3", subnet(F.col("src_ip"))).alias("value")))
    return (alerts.select("alert_key", "first_us", "last_us", F.explode(keys).alias("key"))
            .select("alert_key", "first_us", "last_us", "key.*").filter("coalesce(value, '') != ''"))


def cluster_cells(members: DataFrame, window: int) -> DataFrame:
    """Per (kind, value, cell of first_us) the cluster it falls in, named by the cluster's first instant.

    Alerts whose starts share a cell of ``window`` always join each other, so the running maximum only
    has to look at one row per cell.
    """
    by_cell = Window.partitionBy("kind", "value").orderBy("cell")
    return (
        members.withColumn("cell", floor_div(F.col("first_us"), window))
        .groupBy("kind", "value", "cell").agg(F.min("first_us").alias("lo"), F.max("last_us").alias("hi"))
        .withColumn("reach", F.max("hi").over(by_cell.rowsBetween(UNBOUNDED, -1)))
        .withColumn("cluster_us", F.max(F.when(F.col("reach").isNull() | (F.col("lo") - F.col("reach") > window),
                                               F.col("lo"))).over(by_cell.rowsBetween(UNBOUNDED, 0)))
        .drop("reach"))


def cluster_members(members: DataFrame, cells: DataFrame, window: int) -> DataFrame:
    """``alert_key, kind, value, cluster_us``. Alerts of one cluster belong together."""
    return (members.withColumn("cell", floor_div(F.col("first_us"), window))
            .join(cells.select("kind", "value", "cell", "cluster_us"), ["kind", "value", "cell"])
            .select("alert_key", "first_us", "last_us", "kind", "value", "cluster_us"))


def node(kind: Column, value: Column, cluster_us: Column) -> Column:
    return F.concat_ws("|", kind, value, cluster_us.cast("string"))


def first_logins(events: DataFrame, members: DataFrame) -> DataFrame:
    """Earliest login per (ip, user) where both carry alerts."""
    values = members.select("kind", "value").distinct()
    ips = values.filter("kind = 'ip'").select(F.col("value").alias("src_ip"))
    users = values.filter("kind = 'user'").select(F.col("value").alias("user"))
    return (events.filter("type = 'ssh_success'").select("src_ip", "user", "us")
            .groupBy("src_ip", "user").agg(F.min("us").alias("login_us"))
            .join(ips, "src_ip", "left_semi").join(users, "user", "left_semi"))


def pivot_links(members: DataFrame, cells: DataFrame, logins: DataFrame, window: int) -> DataFrame:
    """Distinct links ``user cluster - ip cluster`` through a login.

    Alerts on the user that start at or after the login are linked to alerts on the address no more
    than ``window`` away. Alerts of one cluster are linked already, and the alerts of a cluster (or of
    a user's starts within one ``window``) leave no gap above ``window``; so an alert pair in reach
    exists exactly where the two hulls are in reach, and clusters are compared instead of alerts.
    """
    hulls = (cells.filter("kind = 'ip'").groupBy("value", "cluster_us").agg(F.min("lo").alias("ip_lo"), F.max("hi").alias("ip_hi"))
             .select(F.col("value").alias("src_ip"), F.col("cluster_us").alias("ip_cluster"), "ip_lo", "ip_hi"))
    pairs = settled(logins, "first-logins").withColumn("login_cell", floor_div(F.col("login_us"), window))
    # Address clusters of each pair that reach beyond its login, widened by the window.
    near = settled(pairs.join(hulls, "src_ip").filter(F.col("ip_hi") + window >= F.col("login_us")).select(
        "user", "src_ip", "login_cell", "ip_cluster", (F.col("ip_lo") - window).alias("left_from"), (F.col("ip_hi") + window).alias("left_to")), "near")
    # Alerts on the user starting within one window after the login.
    points = (members.filter("kind = 'user'").withColumn("cell", floor_div(F.col("first_us"), window))
              .join(cells.filter("kind = 'user'").select("value", "cell", "cluster_us"), ["value", "cell"])
              .select(F.col("value").alias("user"), F.col("first_us").alias("us"), "last_us", "cluster_us"))
    probes = pairs.select("user", (F.col("login_us") + window).alias("us"))
    soon = (trailing_stats(points, probes, ["user"], window,
                           {"right_from": ("min", "us"), "right_to": ("max", "last_us"), "user_cluster": ("min", "cluster_us")})
            .filter("right_from IS NOT NULL").withColumn("login_us", F.col("us") - window).drop("us")
            .join(pairs.drop("login_cell"), ["user", "login_us"]).drop("login_us"))
    # And those in any later cell.
    later = cells.filter("kind = 'user'").select(
        F.col("value").alias("user"), F.col("cell").alias("user_cell"), F.col("cluster_us").alias("user_cluster"),
        F.col("lo").alias("right_from"), F.col("hi").alias("right_to"))
    cols = ["user", "user_cluster", "src_ip", "ip_cluster"]
    at_once = overlapping(near, settled(soon, "soon"), ["user", "src_ip"], window)
    afterwards = overlapping(near, settled(later, "later"), ["user"], window).filter("user_cell > login_cell")
    return at_once.select(*cols).unionByName(afterwards.select(*cols)).distinct()


def alert_nodes(clustered: DataFrame) -> DataFrame:
    """``alert_key, nodes``: the clusters of an alert in the order of their names, at most three."""
    name = node(F.col("kind"), F.col("value"), F.col("cluster_us"))
    return clustered.select("alert_key", name.alias("node")).groupBy("alert_key").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def cluster_links(nodes: DataFrame, pivots: DataFrame) -> DataFrame:
    """Edges between clusters: those one alert belongs to, and those a login pivot ties together."""
    shared = (nodes.select(F.explode(F.transform(F.slice("nodes", 2, 2), lambda n: F.struct(
                  F.col("nodes")[0].alias("a"), n.alias("b")))).alias("edge")).select("edge.*"))
    pivot = pivots.select(node(F.lit("ip"), F.col("src_ip"), F.col("ip_cluster")).alias("a"),
                          node(F.lit("user"), F.col("user"), F.col("user_cluster")).alias("b"))
    return shared.unionByName(pivot).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (least node name) of every node on an edge ``a, b``.

    Alternating star contraction: each round hangs neighbours onto the least node they can see, with
    partial minimum aggregates, so a hub never gathers its neighbours in one place. Each round is
    written out and the loop ends when a round changes nothing, however many that takes.
    """
    oriented = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges, state = settled(oriented, "links"), None
    while True:
        seen = state
        edges, state = settled_with(_small_star(_large_star(edges)), "links", *_fingerprint())
        if state == seen:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _fingerprint() -> list[Column]:
    """Equal before and after a round only if the round changed no edge."""
    return [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    # Each edge gives one row; equal ones are dropped behind the small star.
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).filter("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def assign_components(alerts: DataFrame, events: DataFrame, cfg: Thresholds) -> DataFrame:
    """Alerts with ``component``. An alert without any entity is its own component."""
    window = cfg.correlation_window
    members = settled(memberships(alerts), "members")
    cells = settled(cluster_cells(members, window), "cells")
    nodes = settled(alert_nodes(cluster_members(members, cells, window)), "nodes")
    links = cluster_links(nodes, pivot_links(members, cells, first_logins(events, members), window))
    components = connected_components(links)
    # The keys find their component first, so that whole alerts are moved once.
    own = nodes.select("alert_key", F.col("nodes")[0].alias("node")).join(components, "node", "left").select(
        "alert_key", F.coalesce("component", "node").alias("component"))
    return (alerts.join(own, "alert_key", "left")
            .withColumn("component", F.coalesce("component", F.concat(F.lit("alert|"), F.col("alert_key")))))


def present_stages(stages: Column) -> Column:
    """Kill-chain order of a set of stages."""
    return F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: F.array_contains(stages, s))


def roll_up(alerts: DataFrame, cfg: Thresholds) -> DataFrame:
    """C4: one row per component, ranked into ``incident_no`` and ``incident_id``.

    Lists of unbounded length stay out of this table: see ``incident_entities`` and the alerts themselves.
    """
    first = F.min(F.struct("alert_no", "alert_id")).alias("first")
    incidents = scored(alerts, ["component"], cfg, first, final=[
        F.min("first")["alert_id"].alias("first_alert_id"), present_stages(F.collect_set("stage")).alias("stages"),
        F.array_sort(F.collect_set("rule_id")).alias("rules")])
    ranked = numbered(incidents, [F.desc("risk_score"), "first_us", "first_alert_id"], "incident_no")
    return (ranked.withColumn("incident_id", F.concat(F.lit("inc-"), F.col("incident_no").cast("string")))
            .withColumnRenamed("first_us", "start_us").withColumnRenamed("last_us", "end_us"))


def incident_entities(alerts: DataFrame) -> DataFrame:
    """Distinct ``incident_id, type, value`` of alerts that carry their incident."""
    return entity_rows(alerts).select("incident_id", "type", "value").distinct()
