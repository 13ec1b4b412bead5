"""Incident narrative from fixed templates: steps, title, summary, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.config import HOUR
from logvigil.functions.net import subnet
from logvigil.functions.text import english_list, shown, time_span
from logvigil.functions.timing import clock, floor_div
from logvigil.operators.correlate import STAGES
from logvigil.operators.intervals import with_previous, with_running_sum

# Required stages, title, assessment; larger sets first, the first match wins.
TITLES = [
    (("Credential Access", "Initial Access", "Privilege Escalation", "Persistence"),
     "SSH compromise with persistence", "likely successful SSH compromise with a backdoor account"),
    (("Initial Access", "Privilege Escalation", "Persistence"),
     "Account takeover with persistence", "a compromised account gained root and created a backdoor"),
    (("Reconnaissance", "Initial Access", "Exfiltration"),
     "Web reconnaissance to possible exfiltration",
     "web attack chain: scanning, exploit attempts and an unusually large download"),
    (("Initial Access", "Privilege Escalation", "Exfiltration"),
     "Suspicious off-hours access with possible exfiltration",
     "an account was used at an unusual time or place, escalated to root and moved a large amount of data"),
    (("Credential Access", "Initial Access", "Privilege Escalation"),
     "SSH compromise with privilege escalation", "likely successful SSH compromise followed by root access"),
    (("Initial Access", "Privilege Escalation"),
     "Suspicious login with privilege escalation", "an unusual login was immediately followed by root access"),
    (("Credential Access", "Initial Access"),
     "Successful credential attack", "an attacker guessed a valid password and logged in"),
    (("Reconnaissance", "Initial Access"),
     "Web reconnaissance with attack payloads", "web scanning followed by exploit attempts (not confirmed)"),
    (("Persistence",), "Account created / added to sudo", "a new or newly privileged account needs verification"),
    (("Exfiltration",), "Possible large data transfer", "unusually large HTTP response volume to one client"),
    (("Reconnaissance",), "Web scanning", "automated scanning of the web server"),
    (("Initial Access",), "Suspicious login", "a login that does not match the account's normal behaviour"),
    (("Credential Access",), "Credential attack", "repeated failed logins without a confirmed success"),
]
# Sharper title and assessment where a rule is present, tried in this order.
SHARPER = [
    ("Successful credential attack", "R2", "Password spray with successful login",
     "a password-spraying attack found a valid account and logged in"),
    ("Credential attack", "R2", "Password spraying", "one IP tried a few passwords across many accounts"),
    ("Credential attack", "R3", "Low-and-slow brute force", "a distributed, slow brute force from one subnet"),
    ("Credential attack", "R1", "SSH brute force", "a loud brute-force attack with no successful login"),
]
DEFAULT_TITLE = ("Suspicious activity", "suspicious activity")


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _by_rule(cases: dict[str, Column]) -> Column:
    out = F
    for rule, text in cases.items():
        out = out.when(F.col("rule_id") == rule, text)
    return out


def with_moment(alerts: DataFrame) -> DataFrame:
    """Adds the instant an alert is told at (the login for login rules) and its kill-chain position."""
    position = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    moment = F.when(F.col("rule_id").isin("R4", "R5", "R6"), F.col("last_us")).otherwise(F.col("first_us"))
    return alerts.withColumn("moment", moment).withColumn("stage_order", position)


ORDER = ["moment", "stage_order", "alert_no"]


def with_step(alerts: DataFrame) -> DataFrame:
    """Numbers runs of consecutive alerts of the same rule within an incident (``step_no`` from 1)."""
    rows = with_moment(alerts).withColumn("chunk", floor_div(F.col("moment"), HOUR))
    rows = with_previous(rows, ["incident_id"], "chunk", ORDER, "rule_id", "rule_before")
    starts = F.when(F.col("rule_before").eqNullSafe(F.col("rule_id")), 0).otherwise(1).cast("bigint")
    return with_running_sum(rows.withColumn("starts", starts), ["incident_id"], "chunk", ORDER, "starts",
                            "step_no").drop("chunk", "rule_before", "starts")


def story_steps(alerts: DataFrame) -> DataFrame:
    """``incident_id, step_no, us, stage, text, alert_id``, one sentence per step."""
    head = F.min(F.struct(*ORDER, "alert_id", "first_us", "last_us", "reason", "src_ip", "stage", "technique")).alias("g")
    tail = F.max(F.struct(*ORDER, F.col("last_us").alias("end_us")))["end_us"].alias("end_us")
    # Only three rules quote every reason of a step.
    quoted = F.when(F.col("rule_id").isin("R8", "R9", "R10"), F.struct(*ORDER, "reason"))
    steps = with_step(alerts).groupBy("incident_id", "step_no", "rule_id").agg(
        head, tail, F.count("*").alias("n"), F.sum("count").alias("total"),
        F.array_sort(F.collect_set(F.nullif(F.col("src_ip"), F.lit("")))).alias("ips"),
        F.array_sort(F.collect_set(F.nullif(F.col("user"), F.lit("")))).alias("users"),
        F.transform(F.array_sort(F.collect_list(quoted)), lambda q: q["reason"]).alias("reasons"))
    span = _cat(time_span(clock(F.col("g.first_us")), clock(F.col("end_us"))), ", ")
    at_first, at_last = _cat("At ", clock(F.col("g.first_us")), " UTC, "), _cat("At ", clock(F.col("g.last_us")), " UTC, ")
    ips = F.when(F.size("ips") == 0, "an unknown IP").otherwise(english_list(F.col("ips")))
    users, total, n, reason = english_list(F.col("users")), F.col("total"), F.col("n"), F.col("g.reason")
    mitre = _cat("(", F.col("g.stage"), ", ", F.col("g.technique"), ")")

    def number(pattern: str) -> Column:
        found = F.regexp_extract(reason, pattern, 1)
        return F.when(found == "", "several").otherwise(found)

    def after_colon(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)^.*?: (.*)$", "$1")

    lowered = F.filter(F.transform("reasons", lambda r: F.concat(F.lower(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))),
                       lambda r: r != "")
    text = _by_rule({
        "R1": _cat(span, "IP ", ips, " made ", total, " failed SSH logins against ", number(r"against (\d+) account"),
                   " account(s) ", mitre, "."),
        "R2": _cat(span, "IP ", ips, " tried ", total, " logins across ", number(r"for (\d+) distinct"),
                   " different accounts – a password-spraying pattern that stays under per-account lockouts ", mitre, "."),
        "R3": _cat(span, n, " IP(s) in ", subnet(F.col("g.src_ip")), " (", ips, ") made ", total,
                   " failed SSH logins slowly enough that no single IP crosses the brute-force threshold – a low-and-slow "
                   "attack ", mitre, "."),
        "R4": _cat(at_last, ips, " logged in successfully as ", users, " right after ", total - n,
                   " failed attempts – the password was likely guessed ", mitre, "."),
        "R5": _cat(reason, " ", mitre, "."),
        "R6": _cat(at_last, users, " logged in from ", ips, ", an address never seen for this account in the baseline ",
                   mitre, "."),
        "R7": _cat(at_first, users, " ran sudo/su as root ", number(r"first (\d+) min"), " min after the suspicious login ",
                   mitre, "."),
        "R8": _cat(at_first, english_list(lowered), " – a likely backdoor for persistence ", mitre, "."),
        "R9": _cat(span, ips, " probed the web server for hidden pages: ",
                   F.array_join(F.transform("reasons", after_colon), "; "), " ", mitre, "."),
        "R10": _cat(span, ips, " sent requests containing attack payloads ", mitre, ". ",
                    F.array_join(F.transform("reasons", lambda r: F.concat(r, F.lit("."))), " "),
                    " This is a matched signature, not a confirmed exploit."),
        "R11": _cat(span, "possible data exfiltration indicated by unusually large HTTP response volume: ", after_colon(reason),
                    " (Exfiltration (possible), ", F.col("g.technique"), ")."),
    })
    return steps.select("incident_id", "step_no", F.col("g.moment").alias("us"), F.col("g.stage").alias("stage"),
                        text.alias("text"), F.col("g.alert_id").alias("alert_id"))


def with_title(incidents: DataFrame) -> DataFrame:
    """Adds ``title`` and ``assessment`` from the stages and rules present."""
    def pick(part: int, base: Column | None = None) -> Column:
        out = F
        if base is not None:
            for title, rule, *texts in SHARPER:
                out = out.when((base == title) & F.array_contains("rules", rule), F.lit(texts[part]))
        for needed, *texts in TITLES:
            held = F.size(F.array_except(F.array(*[F.lit(s) for s in needed]), F.col("stages"))) == 0
            out = out.when(held, F.lit(texts[part]))
        return out.otherwise(F.lit(DEFAULT_TITLE[part]))

    return (incidents.withColumn("base_title", pick(0)).withColumn("title", pick(0, F.col("base_title")))
            .withColumn("assessment", pick(1, F.col("base_title"))).drop("base_title"))


def recommendations(alerts: DataFrame) -> DataFrame:
    """``incident_id, recommendation``: one advice per alert, each distinct advice once, in story order."""
    ip, user = shown(F.col("src_ip")), shown(F.col("user"))
    advice = _by_rule({
        "R1": _cat("Block ", ip, " at the firewall"),
        "R2": _cat("Block ", ip, " and enforce MFA / account lockout for SSH"),
        "R3": _cat("Block ", subnet(F.col("src_ip")), " and alert on slow, distributed failures"),
        "R4": _cat("Disable ", user, " and rotate its credentials"),
        "R5": _cat("Confirm with ", user, " whether the off-hours login was theirs"),
        "R6": _cat("Verify the new source IP ", ip, " for ", user),
        "R7": _cat("Audit every command ", user, " ran as root"),
        "R8": _cat("Disable and investigate account ", user),
        "R9": _cat("Block ", ip, " at the web firewall"),
        "R10": _cat("Review application logs for requests from ", ip, " and patch the targeted endpoint"),
        "R11": _cat("Find out what ", ip, " downloaded and whether it contained sensitive data"),
    })
    distinct = (with_moment(alerts).withColumn("advice", advice).groupBy("incident_id", "advice")
                .agg(F.min(F.struct(*ORDER)).alias("place")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "advice"))), lambda a: a["advice"])
    return distinct.groupBy("incident_id").agg(F.concat(F.array_join(listed, ". "), F.lit(".")).alias("recommendation"))


def entity_lists(entities: DataFrame) -> DataFrame:
    """``incident_id, ips, users`` as sorted arrays, from distinct long rows."""
    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("value"))))
    return entities.groupBy("incident_id").agg(of("ip").alias("ips"), of("user").alias("users"))


def with_summary(incidents: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds the entity lists and the one-sentence ``summary``."""
    none = F.array().cast("array<string>")
    rows = with_title(incidents).join(entity_lists(entities), "incident_id", "left")
    rows = rows.withColumn("ips", F.coalesce("ips", none)).withColumn("users", F.coalesce("users", none))
    who = F.filter(F.array(
        F.when(F.size("ips") > 0, _cat("IP(s) ", F.array_join("ips", ", "))).otherwise(""),
        F.when(F.size("users") > 0, _cat("account(s) ", F.array_join("users", ", "))).otherwise("")), lambda w: w != "")
    return rows.withColumn("summary", _cat(
        "Assessment: ", F.col("assessment"), ". ", F.col("alert_count"), " alert(s) across ", F.size("stages"),
        " kill-chain stage(s) involving ", english_list(who), "."))
