"""Every operator as a query over the given tables. Keys start with the operator's id."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logvigil.config import DEFAULT
from logvigil.functions import net, text
from logvigil.functions.timing import clock, iso, micros, utc, whole_minutes
from logvigil.operators import baseline, correlate, evaluate, reports, rules, scoring, story
from logvigil.operators.intervals import burst_rows
from logvigil.plans.adapter import SCALED, sec_events, table
from logvigil.plans.analysis import Analysis, analyse
from logvigil.plans import samples
from logvigil.plans.run import Run, run, totals
from logvigil.session import ensure_checkpoint_dir, settled
from logvigil.sources import formats, store, text as raw_text

Query = Callable[[SparkSession, str], DataFrame]
_runs: dict[tuple[str, str], Analysis] = {}


def analysis_of(spark: SparkSession, sf_dir: str) -> Analysis:
    """The finished analysis of the tables; run once per session, later reads use its written tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        _runs[key] = analyse(sec_events(spark, sf_dir), SCALED)
    return _runs[key]


def shown_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select("rule_id", "src_ip", "user", "technique", utc("first_us").alias("first_seen"),
                         utc("last_us").alias("last_seen"), "count", "reason", "first_id")


def _lines(array: str) -> Column:
    return F.array_join(array, "|")


def _event_columns(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", "line_no", "parsed", utc("us").alias("ts"), "source", "type", "src_ip", "user", "host",
                         F.col("http.method").alias("method"), F.col("http.path").alias("path"),
                         F.col("http.status").cast("bigint").alias("status"), F.col("http.bytes").alias("bytes"),
                         F.col("http.ua").alias("ua"))


# --- Sources and sinks ----------------------------------------------------------------------------


def s1(spark, sf):
    split = table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"),
        F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "value"))
    return (raw_text.number_lines(split.withColumn("block", F.expr("pos div 10")))
            .select("file", "line_no", F.length("raw").cast("bigint").alias("n_chars")))


def s2(spark, sf):
    lines = samples.all_lines(spark, sf)
    parsed = formats.parse_lines(lines, formats.detect_formats(lines), DEFAULT)
    return formats.events_of(parsed).groupBy("file", "source", "type").agg(
        F.count("*").alias("events"), utc("min(us)").alias("first_ts"), utc("max(us)").alias("last_ts"))


def s3(spark, sf):
    paths = table(spark, sf, "events").select(F.col("event_id").alias("position"), F.expr(
        "'/var/log/h' || user_id || '/' || CASE user_id % 4 WHEN 0 THEN 'auth.log' WHEN 1 THEN 'access.log' "
        "WHEN 2 THEN '.profile' ELSE 'noext' END").alias("path"))
    return raw_text.unique_names(paths).select("position", "name")


def s4(spark, sf):
    return formats.detect_formats(samples.all_lines(spark, sf))


def s9(spark, sf):
    lines = samples.all_lines(spark, sf)
    return formats.accounting(formats.parse_lines(lines, formats.detect_formats(lines), DEFAULT), "file")


def s10(spark, sf):
    uploads = table(spark, sf, "documents").select("doc_id", F.concat(
        F.expr("CASE doc_id % 10 WHEN 0 THEN X'89504E470D0A' WHEN 1 THEN CAST(repeat(chr(1), 1000) AS BINARY) "
               "WHEN 2 THEN X'41004200' ELSE X'' END"), F.col("text").cast("binary")).alias("content"))
    return raw_text.judge_uploads(uploads).select("doc_id", "is_binary", F.length("text").cast("bigint").alias("kept_chars"))


EVENT_CODES = ["ssh_fail", "SSH_Failure", " failed ", "ssh_success", "Accepted", "ssh_accepted", "invalid_user", "invalid",
               "sudo", "sudo_command", "user_add", "useradd", "new_user", "group_add", "groupadd", "new_group", "http_request",
               "http", "request", "GET", "post", "put", "delete", "reboot", ""]


def s11(spark, sf):
    codes = "array(" + ", ".join(f"'{c}'" for c in EVENT_CODES) + ")"
    named = table(spark, sf, "events").select("event_id", F.expr(f"{codes}[event_id % {len(EVENT_CODES)}]").alias("code"))
    kind = formats.event_type(F.col("code"))
    return named.select("event_id", kind.alias("type"), F.when(kind == "http_request", "web").when(
        kind.isNotNull(), "auth").alias("source"))


def store_root(spark: SparkSession) -> str:
    """A run store of its own for each use."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/logvigil/store-{uuid.uuid4().hex}"


def s12(spark, sf):
    root, found = store_root(spark), analysis_of(spark, sf)
    report = formats.accounting(found.events.withColumn("parsed", F.lit(True)), "file").withColumnRenamed("file", "name")
    store.save(Run(report, found, totals(report, found)), root, "run-1", "upload", 0)
    names = ["events", "alerts", "evidence", "incidents", "incident_entities", "entities", "story"]
    counts = [store.child(spark, root, n, "run-1").agg(F.count("*").alias("rows_stored")).select(F.lit(n).alias("table_name"), "rows_stored")
              for n in names]
    return reduce(DataFrame.unionByName, counts)


def daily_store(spark, sf):
    """A store with one run per day of the table; each run's events are that day's."""
    root = store_root(spark)
    days = table(spark, sf, "events").select("event_id", micros("ts").alias("us"), F.expr("'run-' || date(ts)").alias("analysis_id"))
    days.write.partitionBy("analysis_id").parquet(f"{root}/events")
    none = F.lit(None).cast(store.RUN_STATS)
    store.log_rows(days.groupBy("analysis_id").agg(F.max("us").alias("created_us")).select(
        "analysis_id", "created_us", F.lit("upload").alias("source"), F.lit(1).cast("bigint").alias("files"), none.alias("stats"),
        F.lit(False).alias("has_ground_truth"), F.lit(False).alias("deleted")), root)
    return root


def s13(spark, sf):
    root = daily_store(spark, sf)
    store.apply_retention(spark, root, 10)
    return store.runs(spark, root).select("analysis_id", utc("created_us").alias("created_at"))


def s14(spark, sf):
    root = daily_store(spark, sf)
    store.delete(spark, root, "run-2024-01-10")
    return spark.read.parquet(f"{root}/events").groupBy(F.col("analysis_id").cast("string").alias("analysis_id")).agg(F.count("*").alias("events"))


def s15(spark, sf):
    found = analysis_of(spark, sf)
    sample = settled(found.evidence_sample(), "sample")
    return reports.report_lines(found.cards(), found.story(), found.alerts, sample, found.events, "run-1")


def s15_json(spark, sf):
    found = analysis_of(spark, sf)
    sample = settled(found.evidence_sample(), "sample")
    return reports.incident_documents(found.cards(), found.story(), found.alerts, sample, found.events)


def s15_sample(spark, sf):
    found = analysis_of(spark, sf)
    return found.evidence_sample().select("alert_id", "event_id", "place", "total")


def truth(spark, sf):
    """Ground truth, one object per user: every tenth user is malicious, in five scenarios."""
    users = table(spark, sf, "events").select("user_id").distinct().filter("user_id % 10 = 0").selectExpr(
        "array('user' || user_id) AS users",
        "array('10.' || (user_id div 4 div 65536 % 256) || '.' || (user_id div 16 % 256) || '.' || (user_id div 4 % 4 + 1)) AS ips",
        "'S' || (user_id div 10 % 5 + 1) AS sid")
    return users.selectExpr("ips AS malicious_ips", "users AS malicious_users",
                            "map(sid, named_struct('ips', ips, 'users', users, 'stages', array('Initial Access'))) AS scenarios")


def labels_of(spark, sf):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logvigil/labels-{uuid.uuid4().hex}"
    truth(spark, sf).write.json(path)
    return evaluate.load_labels(spark, path, one_document=False)


def s16(spark, sf):
    labels = labels_of(spark, sf)
    return evaluate.malicious_values(labels).select(F.lit("all").alias("scenario_id"), "value").unionByName(
        evaluate.scenario_values(labels))


# --- Scalar functions -----------------------------------------------------------------------------


def address_texts(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr("""CASE event_id % 8
        WHEN 0 THEN '10.0.0.' || user_id % 300 WHEN 1 THEN '[192.168.1.' || user_id % 256 || ']' WHEN 2 THEN '010.1.1.1'
        WHEN 3 THEN '2001:DB8:0:0:0:0:0:' || hex(user_id % 4096) WHEN 4 THEN '[fe80::1:' || (user_id % 10) || ']' WHEN 5 THEN 'host' || user_id
        WHEN 6 THEN '::ffff:10.0.0.' || user_id % 256 ELSE '1:2::3::4' END""").alias("text"))


def f1(spark, sf):
    return address_texts(spark, sf).select("event_id", net.clean_ip(F.col("text")).alias("ip"))


def f2(spark, sf):
    return address_texts(spark, sf).withColumn("ip", net.clean_ip(F.col("text"))).filter("ip IS NOT NULL").select(
        "event_id", net.subnet(F.col("ip")).alias("subnet"))


def f3(spark, sf):
    return formats.parse_auth(samples.auth_lines(spark, sf), DEFAULT).filter("parsed").select(
        "file", "line_no", F.expr("CAST(year(timestamp_micros(us)) AS BIGINT)").alias("year"))


def f4(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr("""CASE event_id % 4
        WHEN 0 THEN '04/Oct/2026:14:02:' || lpad(event_id % 60, 2, '0') || ' +0530'
        WHEN 1 THEN '29/Feb/2026:14:02:10 +0000' WHEN 2 THEN '31/Dec/2025:23:' || lpad(event_id % 60, 2, '0') || ':59 -0130'
        ELSE '01/Xyz/2026:00:00:00 +0000' END""").alias("text"))
    rows = formats.staged(rows, ["event_id"], t=formats.time_fields("text"))
    return rows.select("event_id", F.expr(formats.time_of_fields("t")).alias("us")).select("event_id", utc("us").alias("ts"))


def json_values(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.expr("""CASE event_id % 8
        WHEN 0 THEN '{"ip": "a", "src_ip": null, "size": 12.7, "ts": 1700000000}'
        WHEN 1 THEN '{"client_ip": "b", "bytes": 0, "response_size": "' || event_id || '", "ts": 1700000000123}'
        WHEN 2 THEN '{"bytes": "-", "size": 5, "path": "", "url": "/x", "ts": "2026-10-04T14:02:10+05:30"}'
        WHEN 3 THEN '{"bytes": -3.9, "path": "/y", "url": "/x", "ts": "2026-10-04 14:02:10.25"}'
        WHEN 4 THEN '{"size": true, "ua": "z", "ts": "2026-10-04"}'
        WHEN 5 THEN '{"bytes": "12.7", "ts": "yesterday"}'
        WHEN 6 THEN '{"response_size": ' || event_id || ', "user_agent": "", "ua": "w", "ts": "2026-02-30T00:00:00Z"}'
        ELSE '{"remote_addr": "' || user_id || '", "ts": null}' END""").alias("raw"))
    return formats.with_members(rows, ["event_id", "user_id"])


def f5(spark, sf):
    return json_values(spark, sf).selectExpr(
        "event_id", f"{formats._text_of(formats.first_present(formats.IP_KEYS))} AS ip",
        f"{formats._text_of(formats.first_truthy(('path', 'url')))} AS path",
        f"{formats._text_of(formats.first_truthy(('user_agent', 'ua')))} AS ua")


def f6(spark, sf):
    return json_values(spark, sf).selectExpr(
        "event_id", f"{formats.first_truthy(('bytes', 'size', 'response_size'))} AS s").selectExpr(
        "event_id", f"{formats.lenient_int('s')} AS size")


def f7(spark, sf):
    rows = formats.staged(json_values(spark, sf), ["event_id"], t=formats.member("ts"))
    rows = formats.staged(rows, ["event_id"], **formats.time_parts("t"))
    return rows.selectExpr("event_id", f"{formats.time_of_parts('iso', 'epoch')} AS us").select("event_id", utc("us").alias("ts"))


def web(spark, sf):
    return sec_events(spark, sf).filter("type = 'http_request'")


def f8(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("path"))
    both = web(spark, sf).select("id", F.col("http.path").alias("path")).unionByName(pages)
    return both.select("id", text.url_decoded(F.col("path")).alias("decoded"))


def f9(spark, sf):
    return rules.payload_hits(sec_events(spark, sf)).select("id", "label")


def f10(spark, sf):
    return web(spark, sf).select("id", text.scanner_tool(F.col("http.ua")).alias("tool")).filter("tool IS NOT NULL")


def f11(spark, sf):
    users = baseline.user_baseline(sec_events(spark, sf), SCALED)
    normal = F.array_sort(baseline.normal_hours(F.col("hours"), SCALED))
    return users.select("user", F.array_join(F.transform(normal, lambda h: h.cast("string")), ",").alias("normal_hours"))


def f12(spark, sf):
    return table(spark, sf, "events").select("event_id", whole_minutes(F.lit(1704067200000000), micros("ts")).alias("minutes"))


def f13(spark, sf):
    return analysis_of(spark, sf).alerts.select("alert_id", "rule_id", "rule_name", "severity", "points", "stage", "tactic", "technique",
                                                utc("first_us").alias("first_seen"), utc("last_us").alias("last_seen"))


def f14(spark, sf):
    return analysis_of(spark, sf).alerts.select("alert_id", "reason")


def f15(spark, sf):
    people = table(spark, sf, "events").groupBy("user_id").agg((F.sum("event_id") % 101).alias("score"), (F.count("*") % 4).alias("stages"))
    return people.select("user_id", text.risk_level(F.col("score")).alias("level"),
                         text.chain_multiplier(F.col("stages")).cast("double").alias("multiplier"))


def f16(spark, sf):
    return table(spark, sf, "events").select("event_id", micros("ts").alias("us")).withColumn(
        "hour_us", reports.hour_start(F.col("us"))).select(
        "event_id", iso(F.col("us")).alias("iso"), iso(F.col("hour_us")).alias("hour"),
        F.concat(F.substring(F.regexp_replace(iso(F.col("hour_us")), "T", " "), 1, 13), F.lit(":00")).alias("label"))


def f17(spark, sf):
    return reports.search(reports.with_level(analysis_of(spark, sf).entities, "medium"), "USER1").select("type", "value", "risk_score", "level")


def f18(spark, sf):
    people = sec_events(spark, sf).filter("user IS NOT NULL AND src_ip IS NOT NULL").groupBy("src_ip").agg(
        F.array_sort(F.collect_set("user")).alias("users"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    return people.select("src_ip", text.english_list(F.col("users")).alias("names"),
                         text.time_span(clock(F.col("lo")), clock(F.col("hi"))).alias("span"))


# --- Rules ----------------------------------------------------------------------------------------


def w1(spark, sf):
    rows = burst_rows(rules.ssh_failures(sec_events(spark, sf)), "src_ip", SCALED.r1_window, SCALED.r1_threshold)
    return rows.select("src_ip", utc("burst").alias("session_start"), "id")


def j1(spark, sf):
    return rules.with_typo_flag(sec_events(spark, sf), SCALED).select("id", utc("next_success_us").alias("next_success"))


def b1(spark, sf):
    events = sec_events(spark, sf)
    users = baseline.user_baseline(events, SCALED)
    known = baseline.known_addresses(events, SCALED).groupBy("user").agg(F.array_sort(F.collect_list("src_ip")).alias("ips"))
    return users.join(known, "user", "left").select(
        "user", "login_count", F.array_join(F.transform("hours", lambda h: h.cast("string")), ",").alias("hours"), _lines("ips").alias("ips"))


def rule(number: int) -> Query:
    def run(spark, sf):
        events = sec_events(spark, sf)
        if number == 3:
            found = rules.r3_low_and_slow(events, SCALED, rules.r1_brute_force(events, SCALED).alerts)
        elif number == 7:
            found = rules.login_rules(events, SCALED)["R7"]
        elif number == 8:
            found = rules.r8_account_change(events, SCALED, rules.login_rules(events, SCALED)["R7"].alerts)
        else:
            found = {1: rules.r1_brute_force, 2: rules.r2_password_spraying, 4: rules.r4_login_after_failures, 5: rules.r5_off_hours,
                     6: rules.r6_new_source, 9: rules.r9_web_scanning, 10: rules.r10_attack_payload,
                     11: rules.r11_large_transfer}[number](events, SCALED)
        return shown_alerts(found.alerts)
    return run


def u1(spark, sf):
    return shown_alerts(analysis_of(spark, sf).alerts.select("*").withColumn("reason", F.col("alert_id")))


def alert_evidence(spark, sf):
    found = analysis_of(spark, sf)
    return reports.incident_evidence(found.alerts, found.own_evidence, found.shared).select("alert_id", "event_id")


# --- Scores, incidents, story ---------------------------------------------------------------------


def _scores(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "risk_score", "level", "alert_count", utc("first_us").alias("first_seen"), utc("last_us").alias("last_seen"))


def g1(spark, sf):
    return _scores(scoring.scored(analysis_of(spark, sf).alerts.filter("src_ip IS NOT NULL"), ["src_ip"], SCALED), "src_ip")


def g2(spark, sf):
    return _scores(analysis_of(spark, sf).entities, "type", "value")


def _clusters(spark, sf):
    found = analysis_of(spark, sf)
    members = correlate.memberships(found.alerts)
    return found, members, correlate.cluster_cells(members, SCALED.correlation_window)


def c1(spark, sf):
    found, members, cells = _clusters(spark, sf)
    return correlate.cluster_members(members, cells, SCALED.correlation_window).join(
        found.alerts.select("alert_key", "alert_id"), "alert_key").select("alert_id", "kind", "value", utc("cluster_us").alias("cluster_start"))


def c2(spark, sf):
    found, members, cells = _clusters(spark, sf)
    links = correlate.pivot_links(members, cells, correlate.first_logins(found.events, members), SCALED.correlation_window)
    return links.select("user", utc("user_cluster").alias("user_cluster"), "src_ip", utc("ip_cluster").alias("ip_cluster"))


def c3(spark, sf):
    alerts = analysis_of(spark, sf).alerts.select("incident_id", "alert_no")
    first = alerts.groupBy("incident_id").agg(F.min("alert_no").alias("component"))
    return alerts.join(first, "incident_id").select("alert_no", "component")


def c4(spark, sf):
    found = analysis_of(spark, sf)
    return found.cards().select(
        "incident_id", "risk_score", "level", _lines("ips").alias("ips"), _lines("users").alias("users"), utc("start_us").alias("start_ts"),
        utc("end_us").alias("end_ts"), _lines("stages").alias("stages"), "alert_count", "first_alert_id")


def n1(spark, sf):
    return story.with_step(analysis_of(spark, sf).alerts).select("incident_id", "alert_id", "step_no", utc("moment").alias("moment"))


def n1_text(spark, sf):
    return analysis_of(spark, sf).story().select("incident_id", "step_no", utc("us").alias("ts"), "stage", "text", "alert_id")


def n2(spark, sf):
    return story.with_title(analysis_of(spark, sf).incidents).select("incident_id", "title", "assessment")


def n3(spark, sf):
    return analysis_of(spark, sf).cards().select("incident_id", "summary", "recommendation")


def v1(spark, sf):
    found = analysis_of(spark, sf)
    return evaluate.entity_quality(found.incidents, found.incident_entities, evaluate.malicious_values(labels_of(spark, sf)), SCALED)


def v2(spark, sf):
    found = analysis_of(spark, sf)
    labels = labels_of(spark, sf)
    out = evaluate.scenario_matches(found.incidents, found.incident_entities, evaluate.scenario_values(labels), SCALED,
                                    evaluate.scenario_stages(labels))
    return out.select("scenario_id", "detected", _lines("expected_entities").alias("expected_entities"),
                      _lines("found_entities").alias("found_entities"), "incident_id", _lines("expected_stages").alias("expected_stages"),
                      _lines("found_stages").alias("found_stages"))


def v3(spark, sf):
    found = analysis_of(spark, sf)
    false_alarms = evaluate.critical_false_positives(found.incidents, found.incident_entities, evaluate.malicious_values(labels_of(spark, sf)))
    levels = evaluate.level_counts(found.incidents).select(*[F.struct("incidents", *evaluate.LEVELS).alias("levels")]).scalar()
    return false_alarms.withColumn("levels", levels).select(
        "critical_false_positives", "source", "levels.incidents", *[f"levels.{level}" for level in evaluate.LEVELS])


# --- Result queries -------------------------------------------------------------------------------


def q1(spark, sf):
    return reports.events_per_hour(sec_events(spark, sf)).select(utc("hour_us").alias("hour"), "count").orderBy("hour")


def q2(spark, sf):
    return reports.incidents_by_level(analysis_of(spark, sf).incidents)


def q3(spark, sf):
    return reports.top_entities(analysis_of(spark, sf).entities).select("type", "value", "risk_score", "level", "alert_count")


def q4(spark, sf):
    """Totals of the run next to its level counts, its peak hour and its top entity, in one row."""
    found = analysis_of(spark, sf)
    peak = reports.peak_hour(reports.events_per_hour(found.events)).select(F.struct("hour_us", "count")).scalar()
    top = reports.top_entities(found.entities, 1).select("value").scalar()
    alerts = found.alerts.agg(F.count("*")).scalar()
    events = found.events.agg(F.count("*")).scalar()
    return evaluate.level_counts(found.incidents).select(
        events.alias("events"), alerts.alias("alerts"), "incidents", *evaluate.LEVELS, peak.alias("peak"), top.alias("top_entity")).select(
        "events", "alerts", "incidents", *evaluate.LEVELS, utc("peak.hour_us").alias("peak_hour"), F.col("peak.count").alias("peak_count"), "top_entity")


def q4_full(spark, sf):
    """From log files to the summary of their run."""
    folder = samples.security_log(spark, sf, f"{ensure_checkpoint_dir(spark).rstrip('/')}/logvigil/log-{uuid.uuid4().hex}")
    found = run(spark, [folder], SCALED)
    return reports.run_summary(found.stats, found.analysis.events, found.analysis.incidents, found.analysis.entities)


def q5(spark, sf):
    return analysis_of(spark, sf).cards().orderBy("incident_no").select("incident_id", "title", "risk_score", "level", utc("start_us").alias("start_ts"),
                                                  utc("end_us").alias("end_ts"), _lines("stages").alias("stages"), "summary")


def q6(spark, sf):
    found = analysis_of(spark, sf)
    alerts = found.alerts.join(found.incidents.select("incident_id", "risk_score"), "incident_id")
    known = alerts.drop("rule_id", "risk_score").join(alerts.select("alert_key", "rule_id", "risk_score"), "alert_key")
    lines = found.events.select(F.col("id").alias("event_id"), "raw", "type")
    refs = reports.incident_evidence(known, found.own_evidence, found.shared, lines, ("rule_id", "risk_score"))
    return refs.select("incident_id", "risk_score", "alert_id", "rule_id", "event_id", utc("us").alias("ts"), "type", "raw")


def q7(spark, sf):
    found = analysis_of(spark, sf)
    return reports.evidence_lines(found.alerts, found.first_mentions, found.events).select(
        "incident_id", "event_id", "alert_no", utc("us").alias("ts"), "line_no", "raw")


def q8(spark, sf):
    return store.latest_runs(store.runs(spark, daily_store(spark, sf))).select("analysis_id", utc("created_us").alias("created_at"))


def q9(spark, sf):
    return reports.peak_hour(reports.events_per_hour(sec_events(spark, sf))).select(utc("hour_us").alias("hour"), "count")


def q10(spark, sf):
    return reports.techniques(analysis_of(spark, sf).alerts)


def q10_rules(spark, sf):
    return reports.rules_triggered(analysis_of(spark, sf).alerts)


QUERIES: dict[str, Query] = {
    "S1_numbered_lines": s1, "S2_multi_file_union": s2, "S3_unique_names": s3, "S4_format_detection": s4,
    "S5_auth_lines": lambda s, d: _event_columns(formats.parse_auth(samples.auth_lines(s, d), DEFAULT)),
    "S6_access_lines": lambda s, d: _event_columns(formats.parse_access(samples.access_lines(s, d))),
    "S7_json_lines": lambda s, d: _event_columns(formats.parse_jsonl(samples.json_lines(s, d))),
    "S8_auth_classification": lambda s, d: formats.events_of(formats.parse_auth(samples.auth_lines(s, d), DEFAULT)).groupBy(
        "type", "user").agg(F.count("*").alias("events")),
    "S9_parse_accounting": s9, "S10_binary_quarantine": s10, "S11_event_codes": s11, "S12_persist_run": s12,
    "S13_retention": s13, "S14_delete_run": s14, "S15_report_lines": s15, "S15_incident_json": s15_json, "S15_evidence_sample": s15_sample, "S16_ground_truth": s16,
    "F1_clean_ip": f1, "F2_subnet": f2, "F3_year_rollover": f3, "F4_offset_time": f4, "F5_key_alias": f5, "F6_lenient_int": f6,
    "F7_flexible_time": f7, "F8_url_decode": f8, "F9_attack_signature": f9, "F10_scanner_agent": f10, "F11_normal_hours": f11,
    "F12_whole_minutes": f12, "F13_rule_facts": f13, "F14_reasons": f14, "F15_risk_level": f15, "F16_hour_labels": f16,
    "F17_entity_search": f17, "F18_english_list": f18,
    "W1_threshold_burst": w1, "J1_typo_test": j1, "B1_user_baseline": b1,
    "R1_brute_force": rule(1), "R2_password_spraying": rule(2), "R3_low_and_slow": rule(3), "R4_login_after_failures": rule(4),
    "R5_off_hours": rule(5), "R6_new_source": rule(6), "R7_privilege_use": rule(7), "R8_account_change": rule(8),
    "R9_web_scanning": rule(9), "R10_attack_payload": rule(10), "R11_large_transfer": rule(11),
    "U1_all_alerts": u1, "U1_alert_evidence": alert_evidence,
    "G1_risk_score": g1, "G2_entity_scores": g2, "C1_shared_key_clusters": c1, "C2_login_pivot": c2, "C3_components": c3,
    "C4_incidents": c4, "N1_story_steps": n1, "N1_story_text": n1_text, "N2_titles": n2, "N3_summaries": n3,
    "V1_entity_quality": v1, "V2_scenario_matches": v2, "V3_false_positives": v3,
    "Q1_events_per_hour": q1, "Q2_incidents_by_level": q2, "Q3_top_entities": q3, "Q4_run_summary": q4, "Q4_full_summary": q4_full, "Q5_incident_list": q5,
    "Q6_incident_detail": q6, "Q7_evidence_lines": q7, "Q8_run_list": q8, "Q9_peak_hour": q9, "Q10_techniques": q10,
    "Q10_rules_triggered": q10_rules,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top risk-scored addresses from brute-force bursts."""
    alerts = rules.with_rule_facts(rules.r1_brute_force(sec_events(spark, sf_dir), SCALED).alerts)
    return reports.top_entities(scoring.score_entities(alerts, SCALED)).select(
        "type", "value", "risk_score", "level", "alert_count", utc("first_us").alias("first_seen"), utc("last_us").alias("last_seen"))
