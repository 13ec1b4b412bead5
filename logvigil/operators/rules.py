"""The eleven detection rules (R1-R11, J1) and their union.

Every rule returns a ``Finding``: its alerts, one row each, and its evidence as a long table, so an
alert over millions of lines is never one giant array. Time order is ``(us, file, line_no)``
throughout and every comparison is inclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logvigil.config import HOUR, Thresholds
from logvigil.functions.net import subnet
from logvigil.functions.text import one_decimal, scanner_tool, shown, signature, url_decoded
from logvigil.functions.timing import cell_of, clock, floor_div, hour_of_day, whole_minutes
from logvigil.operators.baseline import judged_logins, known_addresses, normal_hours
from logvigil.operators.intervals import burst_cells, burst_rows, numbered, pair_in_range, span_ends, trailing_stats
from logvigil.operators.ranks import exact_median
from logvigil.session import counted_small, settled, settled_with, side_by_side

# Rule, name, severity, points, stage, tactic, technique.
RULES = [
    ("R1", "SSH brute force", "high", 35, "Credential Access", "Credential Access", "T1110.001"),
    ("R2", "Password spraying", "high", 35, "Credential Access", "Credential Access", "T1110.003"),
    ("R3", "Low-and-slow brute force", "medium", 20, "Credential Access", "Credential Access", "T1110"),
    ("R4", "Login after failures", "critical", 50, "Initial Access", "Initial Access", "T1078"),
    ("R5", "Off-hours login", "medium", 20, "Initial Access", "Initial Access", "T1078"),
    ("R6", "New source IP", "low", 10, "Initial Access", "Initial Access", "T1078"),
    ("R7", "Privilege use after suspicious login", "high", 35, "Privilege Escalation", "Privilege Escalation",
     "T1548.003"),
    ("R8", "Account created / added to sudo", "critical", 50, "Persistence", "Persistence", "T1136.001"),
    ("R9", "Web scanning", "medium", 20, "Reconnaissance", "Reconnaissance", "T1595"),
    ("R10", "Web attack payload", "high", 35, "Initial Access", "Initial Access", "T1190"),
    ("R11", "Possible large data transfer", "high", 35, "Exfiltration", "Exfiltration", "TA0010"),
]

ALERT = ["alert_key", "rule_id", "src_ip", "user", "technique", "first_us", "last_us", "count", "reason", "first_id",
         "tie"]
EVIDENCE = ["alert_key", "us", "file", "line_no", "event_id"]
NO_USER = "\x00"


# Most lines shown of an alert's evidence from its first and from its last ones.
SHOWN, TAIL = 20, 5


@dataclass(frozen=True)
class Shared:
    """Evidence that alerts of one ``key`` share: the ``points`` from the first to the last instant of each, at most ``width`` apart.

    Its pairs may grow with the square of a key's rows. What is wanted of alerts and events goes to the two sides before they are paired,
    so that no pair is moved. ``rest`` gives, from the alerts, the evidence beside it."""

    points: DataFrame
    alerts: DataFrame
    key: str
    width: int
    rest: Callable[[DataFrame], DataFrame] | None = None

    def pairs(self, facts: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
        """Evidence rows, with the columns of ``facts`` by ``alert_key`` and those of ``lines`` by ``event_id``."""
        points = self.points.select(self.key, "us", "file", "line_no", F.col("id").alias("event_id"))
        spans = self.alerts.select("alert_key", self.key, F.col("first_us").alias("span_from"), F.col("last_us").alias("span_to"))
        points = points if lines is None else points.join(lines, "event_id")
        spans = spans if facts is None else spans.join(facts, "alert_key")
        return pair_in_range(points, spans, [self.key], self.width).drop(self.key, "span_from", "span_to")


@dataclass(frozen=True)
class Finding:
    """``ends`` gives, where alerts share their evidence, its first and last rows per alert, and ``held`` SQL for their number in all
    on an alert's row; ``mentions`` gives each event once per incident, with the first alert that names it. They are read from the
    evidence itself where they are none. ``shared`` is the evidence that alerts share, before it is paired with them."""

    alerts: DataFrame
    evidence: DataFrame
    ends: Callable[[], DataFrame] | None = None
    held: str | None = None
    mentions: Callable[[], DataFrame] | None = None
    shared: Shared | None = None


def rule_table(spark: SparkSession) -> DataFrame:
    """The 11-row rule dimension; ``rule_order`` is its position."""
    rows = ", ".join("({}, {}, {}, {}, {}, {}, {}, {})".format(
        f"'{rid}'", i, f"'{name}'", f"'{sev}'", f"{pts}L", f"'{stage}'", f"'{tactic}'", f"'{tech}'")
        for i, (rid, name, sev, pts, stage, tactic, tech) in enumerate(RULES))
    return spark.sql("SELECT * FROM VALUES " + rows + " AS t(rule_id, rule_order, rule_name, severity, points, "
                     "stage, tactic, default_technique)")


# Sortable reference to an event; its minimum is the first event in time order.
EVENT_REF = "struct(us, file, line_no, id AS event_id)"


def event_ref() -> Column:
    return F.expr(EVENT_REF)


def _alerts(df: DataFrame, rule: str, reason: Column, ip: Column | None = None, user: Column | None = None,
            technique: Column | None = None, keep: tuple[str, ...] = (), tie: Column | None = None) -> DataFrame:
    """Common alert columns from an aggregate with ``first_us, last_us, count, first_id``.

    ``tie`` is the login an alert is about where two alerts can share their first evidence; it then
    orders them and is part of the key.
    """
    none = F.lit(None).cast("string")
    tie = F.lit(None).cast("struct<us:bigint,file:string,line_no:bigint,event_id:string>") if tie is None else tie
    ip, user = none if ip is None else ip, none if user is None else user
    key = F.concat_ws("|", F.lit(rule), F.coalesce(ip, F.lit("")), F.coalesce(user, F.lit("")), F.col("first_id"),
                      tie["event_id"])
    return df.select(key.alias("alert_key"), F.lit(rule).alias("rule_id"), ip.alias("src_ip"), user.alias("user"),
                     (none if technique is None else technique).alias("technique"), "first_us", "last_us",
                     F.col("count").cast("bigint").alias("count"), reason.alias("reason"), "first_id",
                     tie.alias("tie"), *keep)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _refs(rows: DataFrame, alerts: DataFrame, on: list[str]) -> DataFrame:
    """Evidence rows of alerts that share unique columns with them."""
    return (rows.join(alerts.select("alert_key", *on), on)
            .select("alert_key", "us", "file", "line_no", F.col("id").alias("event_id")))


def _ends(rows: DataFrame, alerts: DataFrame, key: str, n: str) -> DataFrame:
    """First and last evidence rows of alerts that hold the ``n`` rows of their key from their first instant on."""
    spans = alerts.select("alert_key", key, F.col("first_us").alias("span_from"), F.expr(n).alias("n"))
    return span_ends(rows.select(key, "us", "file", "line_no", F.col("id").alias("event_id")), spans, key, f"{key}-ranks", SHOWN, TAIL).select(*EVIDENCE)


def _mentions(rows: DataFrame, alerts: DataFrame, key: str, ahead: int, width: int) -> DataFrame:
    """Evidence rows with the first alert, in the order of numbers, whose login lies in ``[us + ahead - width, us + ahead]``.

    All alerts that share a row have its key and overlap, so they are of one cluster and one incident; only an empty key ties nothing
    together, and its rows are paired with their alerts.
    """
    order = "struct(first_us, coalesce(src_ip, '') AS ip, coalesce(user, '') AS who, first_id, tie, alert_key)"
    cols = ["alert_key", "us", "file", "line_no", F.col("id").alias("event_id")]
    named = rows.filter(F.col(key) != "").withColumn("probe", F.col("us") + ahead)
    first = (trailing_stats(alerts.withColumn("us", F.col("tie.us")), named.select(key, F.col("probe").alias("us")), [key], width, {"first": ("min", order)})
             .filter("first IS NOT NULL").select(key, F.col("us").alias("probe"), F.col("first.alert_key").alias("alert_key")))
    spans = alerts.filter(F.col(key) == "").select("alert_key", key, F.col("tie.us").alias("login"))
    spans = spans.select("alert_key", key, (F.col("login") - ahead).alias("span_from"), (F.col("login") - ahead + width).alias("span_to"))
    unnamed = pair_in_range(rows.filter(F.col(key) == ""), spans, [key], width)
    return named.join(first, [key, "probe"]).select(*cols).unionByName(unnamed.select(*cols))


def _self_refs(rows: DataFrame) -> DataFrame:
    """Evidence of rules with one event per alert."""
    return rows.select("alert_key", F.col("first_us").alias("us"), "file", "line_no",
                       F.col("first_id").alias("event_id"))


def _typed(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("type").isin(*types)).select("id", "us", "file", "line_no", "type", "src_ip", "user")


def ssh_failures(events: DataFrame) -> DataFrame:
    return _typed(events, "ssh_fail").filter("src_ip IS NOT NULL").drop("type")


def _span() -> list[Column]:
    return [F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("count")]


def _span_of_refs() -> list[Column]:
    return [*_span(), F.min(event_ref())["event_id"].alias("first_id")]


def _named_users(rows: DataFrame, on: list[str]) -> DataFrame:
    """Count and first eight of the distinct non-empty users per burst."""
    users = rows.filter(F.coalesce(F.col("user"), F.lit("")) != "").select(*on, "user").distinct()
    rank = F.row_number().over(Window.partitionBy(*on).orderBy("user"))
    first = (users.withColumn("rank", rank).filter(F.col("rank") <= 8)
             .groupBy(*on).agg(F.array_sort(F.collect_list("user")).alias("first_users")))
    return users.groupBy(*on).agg(F.count("*").alias("n_users")).join(first, on)


# --- R1-R3: failed logins -------------------------------------------------------------------------


def r1_brute_force(events: DataFrame, cfg: Thresholds) -> Finding:
    on = ["src_ip", "burst"]
    rows = burst_rows(ssh_failures(events), "src_ip", cfg.r1_window, cfg.r1_threshold)
    # Distinct users need their own pass: one distinct aggregate splits per value before it counts.
    per_user = rows.groupBy(*on, "user").agg(*_span_of_refs_partial())
    spans = per_user.groupBy(*on).agg(
        F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.sum("n").alias("count"),
        F.min("ref")["event_id"].alias("first_id"),
        F.count(F.when(F.coalesce(F.col("user"), F.lit("")) != "", 1)).alias("n_users"))
    reason = _text(F.col("count"), " failed SSH logins from ", F.col("src_ip"), " against ", F.col("n_users"),
                   " account(s) in ", whole_minutes(F.col("first_us"), F.col("last_us")),
                   f" min (threshold: {cfg.r1_threshold} in {cfg.r1_window // 60_000_000} min)")
    alerts = _alerts(spans, "R1", reason, ip=F.col("src_ip"), keep=("burst",))
    return Finding(alerts, _refs(rows, alerts, on))


def _span_of_refs_partial() -> list[Column]:
    return [F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n"), F.min(event_ref()).alias("ref")]


def r2_password_spraying(events: DataFrame, cfg: Thresholds) -> Finding:
    on = ["src_ip", "burst"]
    tried = ssh_failures(events).withColumn("tried", F.coalesce(F.col("user"), F.lit(NO_USER)))
    rows = burst_rows(tried, "src_ip", cfg.r2_window, cfg.r2_distinct_users, distinct="tried")
    spans = rows.groupBy(*on).agg(*_span_of_refs()).join(_named_users(rows, on), on, "left")
    n_users = F.coalesce(F.col("n_users"), F.lit(0).cast("bigint"))
    names = F.concat(F.array_join(F.coalesce("first_users", F.array().cast("array<string>")), ", "),
                     F.when(n_users > 8, "…").otherwise(""))
    reason = _text(F.col("src_ip"), " failed logins for ", n_users, " distinct usernames (", names, ") with ",
                   F.col("count"), " attempts in ", whole_minutes(F.col("first_us"), F.col("last_us")), " min")
    alerts = _alerts(spans, "R2", reason, ip=F.col("src_ip"), keep=("burst",))
    return Finding(alerts, _refs(rows, alerts, on))


def with_typo_flag(events: DataFrame, cfg: Thresholds) -> DataFrame:
    """SSH failures with ``next_success_us`` of the same (ip, user) within the typo window (J1), else null."""
    fails = ssh_failures(events).withColumn("who", F.coalesce(F.col("user"), F.lit(NO_USER)))
    logins = (_typed(events, "ssh_success").filter("src_ip IS NOT NULL")
              .withColumn("who", F.coalesce(F.col("user"), F.lit(NO_USER))))
    keys = ["src_ip", "who"]
    ahead = fails.select(*keys, (F.col("us") + cfg.r3_typo_window).alias("us"))
    found = (trailing_stats(logins, ahead, keys, cfg.r3_typo_window, {"next_success_us": ("min", "us")})
             .filter("next_success_us IS NOT NULL").withColumn("us", F.col("us") - cfg.r3_typo_window))
    return fails.join(found, [*keys, "us"], "left").drop("who")


def r3_low_and_slow(events: DataFrame, cfg: Thresholds, loud: DataFrame) -> Finding:
    """``loud`` holds the R1 alerts; their addresses are left out."""
    quiet = (with_typo_flag(events, cfg).filter("next_success_us IS NULL").drop("next_success_us")
             .join(loud.select("src_ip").distinct(), "src_ip", "left_anti")
             .withColumn("subnet", subnet(F.col("src_ip"))))
    quiet = settled(quiet, "quiet-failures")
    rows = burst_rows(quiet, "subnet", cfg.r3_window, cfg.r3_threshold)
    per_ip = rows.groupBy("subnet", "burst", "src_ip").agg(*_span_of_refs())
    total = per_ip.groupBy("subnet", "burst").agg(
        F.count("*").alias("n_ips"), F.sum("count").alias("n_all"), F.min("first_us").alias("lo"),
        F.max("last_us").alias("hi"))
    hours = one_decimal((F.col("hi") - F.col("lo")) / F.lit(float(HOUR)))
    reason = _text(F.col("src_ip"), " is one of ", F.col("n_ips"), " IP(s) in ", F.col("subnet"),
                   " that together made ", F.col("n_all"), " failed SSH logins over ", hours, " h (", F.col("count"),
                   " from this IP) – below the per-IP brute-force threshold")
    alerts = _alerts(per_ip.join(total, ["subnet", "burst"]), "R3", reason, ip=F.col("src_ip"),
                     keep=("subnet", "burst"))
    return Finding(alerts, _refs(rows, alerts, ["subnet", "burst", "src_ip"]))


# --- R4-R8: logins and what follows them ----------------------------------------------------------

LOGIN = ("login_id", "file", "line_no")


def r4_login_after_failures(events: DataFrame, cfg: Thresholds) -> Finding:
    fails = ssh_failures(events)
    logins = _typed(events, "ssh_success").filter("src_ip IS NOT NULL")
    prior = trailing_stats(fails, logins, ["src_ip"], cfg.r4_lookback,
                           {"prior": ("sum", "1L"), "first": ("min", EVENT_REF)})
    hits = (logins.join(prior.filter(F.col("prior") >= cfg.r4_fail_threshold), ["src_ip", "us"])
            .select("src_ip", "user", "file", "line_no", "prior", F.col("id").alias("login_id"),
                    F.col("us").alias("last_us"), (F.col("prior") + 1).alias("count"),
                    F.col("first.us").alias("first_us"), F.col("first.event_id").alias("first_id")))
    reason = _text("Successful login as ", shown(F.col("user")), " from ", F.col("src_ip"), " after ", F.col("prior"),
                   f" failed logins from that IP in the previous {cfg.r4_lookback // 60_000_000} min")
    login = F.struct(F.col("last_us").alias("us"), "file", "line_no", F.col("login_id").alias("event_id"))
    alerts = _alerts(hits, "R4", reason, ip=F.col("src_ip"), user=F.col("user"), keep=LOGIN, tie=login)
    login = alerts.select("alert_key", "tie.*")
    failures = Shared(fails, alerts, "src_ip", cfg.r4_lookback, lambda stored: stored.select("alert_key", "tie.*"))
    # The last row counted is the login itself.
    return Finding(alerts, failures.pairs().unionByName(login), lambda: _ends(fails, alerts, "src_ip", "count - 1").unionByName(login), "count",
                   lambda: _mentions(fails, alerts, "src_ip", cfg.r4_lookback, cfg.r4_lookback).unionByName(login), failures)


def _one_login(df: DataFrame) -> DataFrame:
    return (df.withColumn("first_us", F.col("us")).withColumn("last_us", F.col("us"))
            .withColumn("count", F.lit(1)).withColumn("first_id", F.col("id")).withColumn("login_id", F.col("id")))


def r5_off_hours(events: DataFrame, cfg: Thresholds) -> Finding:
    odd = (judged_logins(events, cfg).withColumn("normal", normal_hours(F.col("hours"), cfg))
           .filter(~F.array_contains("normal", hour_of_day(F.col("us")))))
    span = F.format_string("%02d:00–%02d:00", F.array_min("normal"), F.array_max("normal") + 1)
    reason = _text(F.col("user"), " logged in at ", clock(F.col("us")), " UTC, outside their normal hours (", span,
                   ", learned from ", F.col("login_count"), " baseline logins)")
    alerts = _alerts(_one_login(odd), "R5", reason, ip=F.col("src_ip"), user=F.col("user"), keep=LOGIN)
    return Finding(alerts, _self_refs(alerts))


def r6_new_source(events: DataFrame, cfg: Thresholds) -> Finding:
    known = known_addresses(events, cfg)
    unseen = (judged_logins(events, cfg).filter("src_ip IS NOT NULL").join(known, ["user", "src_ip"], "left_anti"))
    # Only the users that raise an alert get their known addresses listed.
    listed = (known.join(unseen.select("user").distinct(), "user", "left_semi")
              .groupBy("user").agg(F.array_join(F.array_sort(F.collect_list("src_ip")), ", ").alias("known")))
    reason = _text(F.col("user"), " logged in from ", F.col("src_ip"),
                   ", never seen for this user in the baseline (known: ", shown(F.col("known"), "none"), ")")
    alerts = _alerts(_one_login(unseen.join(listed, "user", "left")), "R6", reason, ip=F.col("src_ip"),
                     user=F.col("user"), keep=LOGIN)
    return Finding(alerts, _self_refs(alerts))


def suspicious_logins(r4: DataFrame, r5: DataFrame, r6: DataFrame) -> DataFrame:
    """Distinct logins behind R4, R5 and R6 with the earliest of the three rules that saw each."""
    cols = [F.col("login_id"), F.col("user"), F.col("src_ip"), F.col("last_us").alias("login_us"), F.col("file"),
            F.col("line_no")]
    seen = reduce(DataFrame.unionByName, [df.filter(F.coalesce(F.col("user"), F.lit("")) != "")
                                          .select(*cols, F.lit(i).alias("seen_by")) for i, df in ((4, r4), (5, r5), (6, r6))])
    return seen.groupBy("login_id", "user", "src_ip", "login_us", "file", "line_no").agg(
        F.min("seen_by").alias("seen_by"))


def r7_privilege_use(events: DataFrame, cfg: Thresholds, logins: DataFrame) -> Finding:
    sudo = _typed(events, "sudo").filter(F.coalesce(F.col("user"), F.lit("")) != "")
    ahead = logins.select("user", (F.col("login_us") + cfg.r7_window).alias("us"))
    used = (trailing_stats(sudo, ahead, ["user"], cfg.r7_window,
                           {"count": ("sum", "1L"), "first": ("min", EVENT_REF), "last_us": ("max", "us")})
            .filter("count IS NOT NULL").withColumn("login_us", F.col("us") - cfg.r7_window)
            .select("user", "login_us", "count", "last_us", F.col("first.us").alias("first_us"),
                    F.col("first.event_id").alias("first_id")))
    hits = logins.join(used, ["user", "login_us"])
    reason = _text(F.col("user"), " used sudo/su ", F.col("count"), " time(s), first ",
                   whole_minutes(F.col("login_us"), F.col("first_us")), " min after a suspicious login from ",
                   shown(F.col("src_ip"), "unknown IP"))
    alerts = _alerts(hits, "R7", reason, ip=F.col("src_ip"), user=F.col("user"),
                     keep=("login_us", "seen_by", "file", "line_no"),
                     tie=F.struct(F.col("login_us").alias("us"), "file", "line_no", F.col("login_id").alias("event_id")))
    uses = Shared(sudo, alerts, "user", cfg.r7_window)
    return Finding(alerts, uses.pairs(), lambda: _ends(sudo, alerts, "user", "count"), "count",
                   lambda: _mentions(sudo, alerts, "user", 0, cfg.r7_window), uses)


def r8_account_change(events: DataFrame, cfg: Thresholds, sessions: DataFrame) -> Finding:
    """``sessions`` holds the R7 alerts. The band join has no key, so only time cells bind the two sides."""
    changes = _typed(events, "user_add", "group_add")
    latest = "struct(login_us, seen_by, file, line_no, user, src_ip, first_us AS root_us)"
    points = sessions.withColumn("us", F.col("first_us"))
    near = (trailing_stats(points, changes, [], cfg.r7_window, {"session": ("max", latest)})
            .filter("session IS NOT NULL"))
    rows = changes.drop("src_ip").join(near, "us", "left").withColumn("src_ip", F.col("session.src_ip"))
    what = F.when(F.col("type") == "user_add", "New account created").otherwise("Account added to sudo/wheel group")
    who = _text(", ", whole_minutes(F.col("session.root_us"), F.col("us")), " min after ", F.col("session.user"),
                " gained root from ", shown(F.col("src_ip"), "unknown IP"))
    reason = _text(what, ": ", shown(F.col("user")), F.coalesce(who, F.lit("")))
    technique = F.when(F.col("type") == "user_add", "T1136.001").otherwise("T1098")
    alerts = _alerts(_one_login(rows), "R8", reason, ip=F.col("src_ip"), user=F.col("user"), technique=technique,
                     keep=("file", "line_no"))
    return Finding(alerts, _self_refs(alerts))


# --- R9-R11: web requests -------------------------------------------------------------------------


def requests(events: DataFrame) -> DataFrame:
    return events.filter((F.col("type") == "http_request") & F.col("http").isNotNull())


def r9_web_scanning(events: DataFrame, cfg: Thresholds) -> Finding:
    web = requests(events).filter("src_ip IS NOT NULL").select(
        "id", "us", "file", "line_no", "src_ip", F.col("http.status").alias("status"),
        scanner_tool(F.col("http.ua")).alias("tool"))
    cells = counted_small(settled(burst_cells(web.filter("status = 404"), "src_ip", cfg.r9_window, cfg.r9_threshold).drop("burst"), "flood-cells"))
    rows = (web.filter("status = 404 OR tool IS NOT NULL").withColumn("cell", floor_div(F.col("us"), cfg.r9_window))
            .join(cells, ["src_ip", "cell"], "left")
            .withColumn("flood", F.coalesce((F.col("status") == 404) & (F.col("us") >= F.col("burst_from")), F.lit(False)))
            .filter("flood OR tool IS NOT NULL"))
    spans = rows.groupBy("src_ip").agg(
        *_span(), F.min(F.struct("us", "id"))["id"].alias("first_id"),
        F.count(F.when(F.col("flood"), 1)).alias("n_flood"), F.count("tool").alias("n_scanner"),
        F.min(F.when(F.col("flood"), F.col("us"))).alias("flood_from"),
        F.max(F.when(F.col("flood"), F.col("us"))).alias("flood_to"),
        F.array_sort(F.collect_set("tool")).alias("tools"))
    floods = F.when(F.col("n_flood") > 0, _text(F.col("n_flood"), " HTTP 404 responses in ", whole_minutes(
        F.col("flood_from"), F.col("flood_to")), " min"))
    scans = F.when(F.col("n_scanner") > 0, _text("scanner user-agent (", F.array_join("tools", ", "), ") on ",
                                                 F.col("n_scanner"), " request(s)"))
    reason = _text(F.col("src_ip"), ": ", F.concat_ws("; ", floods, scans))
    alerts = _alerts(spans, "R9", reason, ip=F.col("src_ip"))
    return Finding(alerts, _refs(rows, alerts, ["src_ip"]))


def payload_hits(events: DataFrame) -> DataFrame:
    """Requests whose decoded path matches a signature, with ``label`` and ``decoded``.

    As one-row generators the two are computed once per row; the filter would repeat a plain projection for every pattern.
    """
    cols = ["id", "us", "file", "line_no", "src_ip"]
    decoded = F.inline(F.array(F.struct(url_decoded(F.col("http.path")).alias("decoded"))))
    label = F.inline(F.array(F.struct(signature(F.col("decoded")).alias("label"))))
    return (requests(events).filter("coalesce(http.path, '') != ''").select(*cols, decoded)
            .select(*cols, "decoded", label).filter("label IS NOT NULL"))


def r10_attack_payload(events: DataFrame, cfg: Thresholds) -> Finding:
    rows = payload_hits(events)
    sample = F.struct("us", "file", "line_no", F.col("id").alias("event_id"),
                      F.substring("decoded", 1, 200).alias("request"))
    spans = rows.groupBy("src_ip", "label").agg(*_span(), F.min(sample).alias("first")).withColumn(
        "first_id", F.col("first.event_id"))
    reason = _text("Matched signature: ", F.col("label"), " in ", F.col("count"), " request(s) from ",
                   shown(F.col("src_ip")), "; e.g. decoded request: ", F.col("first.request"))
    alerts = _alerts(spans, "R10", reason, ip=F.col("src_ip"), keep=("label",))
    ids = alerts.select("alert_key", "label", F.col("src_ip").alias("ip"))
    evidence = (rows.join(ids, (rows["label"] == ids["label"]) & rows["src_ip"].eqNullSafe(ids["ip"]))
                .select("alert_key", "us", "file", "line_no", F.col("id").alias("event_id")))
    return Finding(alerts, evidence)


def transfers(events: DataFrame) -> DataFrame:
    return (requests(events).filter("src_ip IS NOT NULL AND coalesce(http.bytes, 0) != 0")
            # Decimal, because two sizes near 2^63 in a log must not end the run.
            .select("id", "us", "file", "line_no", "src_ip", F.col("http.bytes").cast("decimal(20,0)").alias("bytes")))


def transfer_threshold(web: DataFrame, cfg: Thresholds) -> tuple[float, float]:
    """Exact median of the per-address totals, and the byte threshold it implies. Totals beyond 64 bits count as the largest."""
    total = F.least(F.sum("bytes"), F.lit(2**63 - 1).cast("decimal(20,0)"))
    median = exact_median(web.groupBy("src_ip").agg(total.alias("total")), "total") or 0.0
    return median, float(min(cfg.r11_abs_bytes, max(cfg.r11_median_multiplier * median, cfg.r11_min_bytes)))


def _stored_transfers(events: DataFrame) -> DataFrame:
    """The transfers, written once; sizes as 64-bit numbers where their sum fits, as it does but for damaged logs."""
    web, seen = settled_with(transfers(events), "transfers", F.sum(F.abs(F.col("bytes").cast("decimal(38,0)"))).alias("total"))
    return web.withColumn("bytes", F.col("bytes").cast("bigint")) if (seen["total"] or 0) < 2**62 else web


def separated(starts: DataFrame, key: str, width: int) -> DataFrame:
    """Of distinct instants per key: the first, then each next one more than ``width`` after the last kept; ``key, us``.

    The one kept after an instant would be the first beyond its window. Instants at most a window apart from the one before reach it
    within two windows, so a minimum per probe finds it without ordering a key; all others have a pause before them and are kept in any
    case. What is kept are these and all that links lead to from them; links are doubled until none is left, in as many rounds as the
    longest chain has binary digits.
    """
    ahead, near = width - 1, [key, "us"]
    links = (trailing_stats(starts, starts.selectExpr(key, f"us + {2 * width}L AS us"), [key], ahead, {"next": ("min", "us")})
             .filter("next IS NOT NULL").selectExpr(key, f"us - {2 * width}L AS us", "next"))
    close = (trailing_stats(starts, starts.selectExpr(key, "us - 1 AS us"), [key], ahead, {"n": ("sum", "1L")})
             .filter("n IS NOT NULL").selectExpr(key, "us + 1 AS us"))
    kept = starts.select(*near).join(close, near, "left_anti")
    count = F.count("*").alias("n")
    links, seen = settled_with(links, "transfer-links", count)
    while seen["n"]:
        kept = settled(kept.unionByName(kept.join(links, near).select(key, F.col("next").alias("us"))).distinct(), "transfer-kept")
        onward = links.select(key, F.col("us").alias("next"), F.col("next").alias("after"))
        links, seen = settled_with(links.join(onward, [key, "next"]).select(key, "us", F.col("after").alias("next")), "transfer-links", count)
    return kept


def r11_large_transfer(events: DataFrame, cfg: Thresholds) -> Finding:
    """Greedy bursts above the byte threshold, without replaying each address row by row.

    For every row j that closes a window above the threshold let i(j) be the latest row with
    ``sum(i..j) > threshold``. A burst always starts at such a row and lasts one window from there, and
    the scan restarts right behind it. So the bursts are: the earliest start, then again the earliest
    start more than a window after the last one. Prefix sums per (address, window cell) find the starts;
    links between their distinct instants make the choice.
    """
    width, spark = cfg.r11_window, events.sparkSession
    web = _stored_transfers(events)
    median, limit = transfer_threshold(web, cfg)
    threshold = f"{limit!r}D"
    starts = settled(spark.sql(f"""
        WITH rows AS (SELECT *, {cell_of('us', width)} AS cell FROM {{web}}),
        -- A window spans at most two cells, so pairs of quiet cells need no look at their rows.
        loud AS (
            SELECT src_ip, cell AS block FROM (
                SELECT src_ip, cell, sum(sum(bytes)) OVER (
                    PARTITION BY src_ip ORDER BY cell RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS volume
                FROM rows GROUP BY src_ip, cell) WHERE volume > {threshold}),
        parts AS (SELECT src_ip, block, explode(array(block - 1, block)) AS cell FROM loud),
        summed AS (
            SELECT src_ip, block, cell, us, bytes, struct(us, file, line_no, id AS event_id) AS row,
                   sum(bytes) OVER (PARTITION BY src_ip, block ORDER BY us, file, line_no ROWS UNBOUNDED PRECEDING) AS upto
            FROM rows JOIN parts USING (src_ip, cell)),
        -- i(j) is the last row whose preceding total is below total(j) - threshold: look it up by total.
        totals AS (
            SELECT src_ip, block, CAST(upto - bytes AS DOUBLE) AS total, 1 AS mark, CAST(NULL AS BIGINT) AS end_us, row
            FROM summed
            UNION ALL SELECT src_ip, block, upto - {threshold}, 0, us, NULL FROM summed WHERE cell = block),
        found AS (
            SELECT src_ip, mark, end_us, last(row, true) OVER (
                PARTITION BY src_ip, block ORDER BY total, mark ROWS UNBOUNDED PRECEDING) AS start FROM totals)
        SELECT src_ip, start.us AS us, min(start) AS start FROM found
        WHERE mark = 0 AND end_us - start.us <= {width}L GROUP BY src_ip, start.us""", web=web), "transfer-starts")
    bursts = settled(starts.join(separated(starts, "src_ip", width), ["src_ip", "us"]).selectExpr(
        "src_ip", "start", "us AS span_from", f"us + {width}L AS span_to"), "transfer-bursts")
    inside = (pair_in_range(web, bursts, ["src_ip"], width)
              .filter("struct(us, file, line_no) >= struct(start.us, start.file, start.line_no)"))
    spans = (inside.groupBy("src_ip", "start").agg(*_span(), F.sum("bytes").alias("sent"))
             .withColumn("first_id", F.col("start.event_id")).withColumn("median", F.lit(median)))
    reason = _text("Possible data exfiltration indicated by unusually large HTTP response volume: ",
                   one_decimal(F.col("sent") / F.lit(1e6)), " MB sent to ", F.col("src_ip"), " in ", F.col("count"),
                   f" response(s) within {width // 60_000_000} min (median per-IP total: ",
                   F.format_string("%.2f", F.bround(F.col("median") / F.lit(1e6), 2)), " MB)")
    alerts = _alerts(spans, "R11", reason, ip=F.col("src_ip"), keep=("start",))
    return Finding(alerts, _refs(inside, alerts, ["src_ip", "start"]))


# --- U1: all rules --------------------------------------------------------------------------------


def _written(found: Finding, rule: str) -> Finding:
    """A finding with its alerts stored: later rules and the union read them instead of deriving them again."""
    alerts = settled(found.alerts, rule)
    return replace(found, alerts=alerts, shared=found.shared and replace(found.shared, alerts=alerts))


def login_rules(events: DataFrame, cfg: Thresholds) -> dict[str, Finding]:
    """R4, R5, R6 and R7, which builds on the other three."""
    r4, r5, r6 = side_by_side(lambda: _written(r4_login_after_failures(events, cfg), "r4"),
                              lambda: _written(r5_off_hours(events, cfg), "r5"),
                              lambda: _written(r6_new_source(events, cfg), "r6"))
    r7 = _written(r7_privilege_use(events, cfg, suspicious_logins(r4.alerts, r5.alerts, r6.alerts)), "r7")
    return {"R4": r4, "R5": r5, "R6": r6, "R7": r7}


def run_rules(events: DataFrame, cfg: Thresholds) -> dict[str, Finding]:
    """All findings of R1 to R11. Rules that need no other rule's alerts are submitted side by side."""
    def failures() -> dict[str, Finding]:
        r1 = _written(r1_brute_force(events, cfg), "r1")
        return {"R1": r1, "R3": _written(r3_low_and_slow(events, cfg, r1.alerts), "r3")}

    def logins() -> dict[str, Finding]:
        found = login_rules(events, cfg)
        return {**found, "R8": _written(r8_account_change(events, cfg, found["R7"].alerts), "r8")}

    def alone(rule: str, run: Callable[[DataFrame, Thresholds], Finding]) -> Callable[[], dict[str, Finding]]:
        return lambda: {rule: _written(run(events, cfg), rule.lower())}

    found = {}
    for part in side_by_side(logins, failures, alone("R11", r11_large_transfer), alone("R2", r2_password_spraying),
                             alone("R9", r9_web_scanning), alone("R10", r10_attack_payload)):
        found.update(part)
    return found


def with_rule_facts(alerts: DataFrame) -> DataFrame:
    """Adds name, severity, points, stage, tactic and technique from the 11-row dimension."""
    dim = F.broadcast(rule_table(alerts.sparkSession))
    return (alerts.join(dim, "rule_id")
            .withColumn("technique", F.coalesce("technique", "default_technique")).drop("default_technique"))


def union_alerts(found: dict[str, Finding]) -> DataFrame:
    return with_rule_facts(reduce(DataFrame.unionByName, [f.alerts.select(*ALERT) for f in found.values()]))


def own_evidence(found: dict[str, Finding]) -> DataFrame:
    """Evidence that is not shared; linear in alerts and events."""
    own = [f.shared.rest(f.shared.alerts) if f.shared and f.shared.rest else f.evidence for f in found.values() if not f.shared or f.shared.rest]
    return reduce(DataFrame.unionByName, [refs.select(*EVIDENCE) for refs in own])


def shared_evidence(found: dict[str, Finding]) -> list[Shared]:
    return [f.shared for f in found.values() if f.shared]


def evidence_ends(found: dict[str, Finding]) -> DataFrame:
    """Of the evidence the rows that can be among the first 20 or the last 5 of their alert, and some more; linear in alerts and events."""
    return reduce(DataFrame.unionByName, [(f.ends() if f.ends else f.evidence).select(*EVIDENCE) for f in found.values()])


def first_mentions(found: dict[str, Finding]) -> DataFrame:
    """Of the evidence at least the rows that name an event first in its incident; linear in alerts and events."""
    return reduce(DataFrame.unionByName, [(f.mentions() if f.mentions else f.evidence).select(*EVIDENCE) for f in found.values()])


def evidence_sizes(found: dict[str, Finding]) -> DataFrame:
    """``alert_key, n``: rows of evidence, in parts that add up where keys repeat."""
    return reduce(DataFrame.unionByName, [
        f.alerts.select("alert_key", F.expr(f.held).cast("bigint").alias("n")) if f.held
        else f.evidence.groupBy("alert_key").agg(F.count("*").alias("n")) for f in found.values()])


def number_alerts(alerts: DataFrame) -> DataFrame:
    """Adds ``alert_no`` and ``alert_id`` (a1, a2, ...) in time order. The key, not the number, is the identity."""
    order = ["first_us", "rule_order", F.coalesce(F.col("src_ip"), F.lit("")), F.coalesce(F.col("user"), F.lit("")),
             "first_id", "tie", "alert_key"]
    return (numbered(alerts, order, "alert_no")
            .withColumn("alert_id", F.concat(F.lit("a"), F.col("alert_no").cast("string"))))
