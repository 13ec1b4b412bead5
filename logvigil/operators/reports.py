"""Dashboard reads and the incident report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.config import HOUR
from logvigil.functions.timing import floor_div, iso
from logvigil.operators.evaluate import LEVELS
from logvigil.operators.rules import SHOWN, TAIL, Shared

HEAD = SHOWN - TAIL  # of longer evidence, lines shown from its first part


def hour_start(us: Column) -> Column:
    return floor_div(us, HOUR) * HOUR


def events_per_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(hour_start(F.col("us")).alias("hour_us")).agg(F.count("*").alias("count"))


def peak_hour(hours: DataFrame) -> DataFrame:
    """The earliest hour with the highest count."""
    return hours.agg(F.max(F.struct("count", (-F.col("hour_us")).alias("early"))).alias("m")).filter(
        "m IS NOT NULL").select((-F.col("m.early")).alias("hour_us"), F.col("m.count").alias("count"))


def incidents_by_level(incidents: DataFrame) -> DataFrame:
    levels = incidents.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(
        f"({i}, '{level}')" for i, level in enumerate(LEVELS)) + " AS t(position, level)")
    counts = incidents.groupBy("level").agg(F.count("*").alias("n"))
    return levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0).cast("bigint")).alias("incidents"))


def run_summary(stats: DataFrame, events: DataFrame, incidents: DataFrame, entities: DataFrame) -> DataFrame:
    """Everything a dashboard shows of a run (Q4): its six totals, incidents by level, events over time and the five top entities.

    ``part, position, item, label, count, risk_score, level``: totals are named, levels stand in falling order, hours carry
    their chart label and no position, entities their type as label and their alerts as count.
    """
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def rows(df: DataFrame, part: str, position, item, label, count, risk=no_number, level=no_text) -> DataFrame:
        return df.select(F.lit(part).alias("part"), position.alias("position"), item.alias("item"), label.alias("label"),
                         count.cast("bigint").alias("count"), risk.alias("risk_score"), level.alias("level"))

    each = F.posexplode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in stats.columns])).alias("at", "total")
    totals = rows(stats.select(each), "total", (F.col("at") + 1).cast("bigint"), F.col("total.item"), no_text, F.col("total.n"))
    by_level = incidents_by_level(incidents).withColumn("at", F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")))
    levels = rows(by_level, "level", F.col("at").cast("bigint"), F.col("level"), no_text, F.col("incidents"))
    hour = iso(F.col("hour_us"))
    label = F.concat(F.substring(hour, 1, 10), F.lit(" "), F.substring(hour, 12, 2), F.lit(":00"))
    hours = rows(events_per_hour(events), "hour", no_number, hour, label, F.col("count"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("risk_score"), "type", "value"))  # five rows
    top = rows(top_entities(entities).withColumn("place", place.cast("bigint")), "entity", F.col("place"), F.col("value"), F.col("type"),
               F.col("alert_count"), F.col("risk_score").cast("bigint"), F.col("level"))
    return totals.unionByName(levels).unionByName(hours).unionByName(top)


def top_entities(entities: DataFrame, n: int = 5) -> DataFrame:
    return entities.orderBy(F.desc("risk_score"), "type", "value").limit(n)


def with_level(df: DataFrame, level: str) -> DataFrame:
    return df if level == "all" else df.filter(F.lower("level") == level)


def search(entities: DataFrame, text: str) -> DataFrame:
    return entities.filter(F.contains(F.lower("value"), F.lower(F.lit(text)))) if text else entities


def incident_evidence(alerts: DataFrame, evidence: DataFrame, shared: Sequence[Shared] = (), lines: DataFrame | None = None,
                      more: Sequence[str] = ()) -> DataFrame:
    """Evidence references of the given alerts, with their incident and number and ``more`` columns of theirs.

    ``lines`` adds columns by ``event_id``. Evidence that alerts share comes as ``shared`` and is paired last: it may grow with the
    square of a key's rows, and no pair is joined with anything.
    """
    facts = alerts.select("alert_key", "alert_no", "alert_id", "incident_id", *more)
    refs = evidence.join(facts, "alert_key")
    refs = refs if lines is None else refs.join(lines, "event_id")
    return reduce(DataFrame.unionByName, [part.pairs(facts, lines) for part in shared], refs)


def evidence_lines(alerts: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct events per incident at their first mention (Q7), with raw text.

    The first mention is a minimum per (incident, event), so no incident is sorted as a whole. ``evidence`` may lack later mentions.
    """
    first = (incident_evidence(alerts, evidence).groupBy("incident_id", "event_id")
             .agg(F.min(F.struct("alert_no", "us", "file", "line_no")).alias("place")))
    return first.join(events.select(F.col("id").alias("event_id"), "raw", "type", "src_ip", "user"), "event_id").select(
        "incident_id", "event_id", F.col("place.alert_no").alias("alert_no"), F.col("place.us").alias("us"),
        F.col("place.file").alias("file"), F.col("place.line_no").alias("line_no"), "raw", "type", "src_ip", "user")


def techniques(alerts: DataFrame) -> DataFrame:
    """Distinct MITRE techniques per incident; stage and tactic come from the first alert (Q10)."""
    return alerts.groupBy("incident_id", "technique").agg(
        F.min(F.struct("alert_no", "stage", "tactic")).alias("first")).select(
            "incident_id", "technique", F.concat_ws(" · ", "first.stage", "first.tactic").alias("name"))


def rules_triggered(alerts: DataFrame) -> DataFrame:
    return alerts.select("incident_id", "alert_id", "rule_id", "rule_name", F.col("points").alias("score_contribution"),
                         "severity", "reason")


def evidence_sample(alerts: DataFrame, evidence: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Evidence shown per alert: all of up to 20 lines, else the first 15 and the last 5.

    Both ends are top-k ranks, which Spark trims in each map task before the shuffle. With ``sizes`` (``alert_key, n``) the
    evidence may lack rows that are not among the first 20 and the last 5 of their alert: alerts that overlap share rows, and
    pairing all of them would grow with the square of a key's rows.
    """
    refs = evidence.join(alerts.select("alert_key", "alert_id", "incident_id"), "alert_key")
    if sizes is None:
        sizes = refs.groupBy("alert_key").agg(F.count("*").alias("total"))
    else:
        sizes = sizes.join(alerts.select("alert_key"), "alert_key").groupBy("alert_key").agg(F.sum("n").alias("total"))
    order = ["us", "file", "line_no"]

    def end(directions: list, keep: int, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("alert_key").orderBy(*directions))
        return refs.withColumn(name, rank).filter(F.col(name) <= keep)

    head = end(order, SHOWN, "place").join(sizes, "alert_key").filter(
        (F.col("total") <= SHOWN) | (F.col("place") <= HEAD))
    tail = (end([F.desc(c) for c in order], TAIL, "back").join(sizes, "alert_key").filter(F.col("total") > SHOWN)
            .withColumn("place", F.col("total") - F.col("back") + 1).drop("back"))
    return head.unionByName(tail.select(head.columns))


def report_lines(cards: DataFrame, story: DataFrame, alerts: DataFrame, sample: DataFrame, events: DataFrame,
                 analysis_id: str) -> DataFrame:
    """Markdown report as ``incident_id, section, a, b, text`` lines ordered by (section, a, b)."""
    def when(us: str) -> Column:
        return F.regexp_replace(F.regexp_replace(iso(F.col(us)), "T", " "), "Z$", " UTC")

    def texts(section: int, *lines: Column | str) -> Column:
        return F.posexplode(F.array(*[F.lit(t) if isinstance(t, str) else t for t in lines])).alias("b", "text")

    def out(df: DataFrame, section: int, a: Column | int, *lines: Column | str) -> DataFrame:
        at = F.lit(a) if isinstance(a, int) else a
        return df.select("incident_id", F.lit(section).alias("section"), at.cast("bigint").alias("a"), texts(section, *lines)
                         ).select("incident_id", "section", "a", F.col("b").cast("bigint").alias("b"), "text")

    def names(column: str) -> Column:
        return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise("-")

    head = out(cards, 0, 0, F.concat(F.lit("# Incident "), F.col("incident_id"), F.lit(": "), F.col("title")), "",
               F.concat(F.lit("- **Level:** "), F.upper("level"), F.lit(" (risk "), F.col("risk_score").cast("string"), F.lit("/100)")),
               F.concat(F.lit("- **Time span:** "), when("start_us"), F.lit(" → "), when("end_us")),
               F.concat(F.lit("- **IPs:** "), names("ips")), F.concat(F.lit("- **Users:** "), names("users")),
               F.concat(F.lit("- **Kill-chain stages:** "), F.array_join("stages", " → ")),
               F.lit(f"- **Analysis:** {analysis_id}"), "", "## Assessment", "",
               F.regexp_replace("summary", "^Assessment: ", ""), "", "## Attack story", "")
    steps = out(story, 1, F.col("step_no"), F.concat(F.col("step_no").cast("string"), F.lit(". **"), when("us"), F.lit("** ["),
                                                     F.col("stage"), F.lit("] "), F.col("text")))
    advice_head = out(cards, 2, 0, "", "## Recommended response", "")
    advice = F.filter(F.transform(F.split(F.regexp_replace("recommendation", r"\.+$", ""), r"\. "), lambda t: F.trim(t)), lambda t: t != "")
    advices = cards.select("incident_id", F.posexplode(advice).alias("a", "text")).select(
        "incident_id", F.lit(3).alias("section"), F.col("a").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"),
        F.concat(F.lit("- "), F.col("text")).alias("text"))
    alert_head = out(cards, 4, 0, "", "## Alerts and evidence", "")
    sized = alerts.join(sample.select("alert_key", "total").distinct(), "alert_key")
    total = F.col("total").cast("string")
    opening = out(sized, 5, F.col("alert_no") * 4, F.concat(
        F.lit("### "), F.col("alert_id"), F.lit(" · "), F.col("rule_id"), F.lit(" "), F.col("rule_name"), F.lit(" ("),
        F.col("severity"), F.lit(", "), F.col("technique"), F.lit(")")), "", F.col("reason"), "",
        F.concat(F.lit("Evidence: "), total, F.lit(" log line(s)"), F.when(
            F.col("total") > SHOWN, F.lit(f", first {HEAD} and last {TAIL} shown")).otherwise("")), "", "```")
    lines = (sample.join(alerts.select("alert_key", "alert_no"), "alert_key")
             .join(events.select(F.col("id").alias("event_id"), "raw"), "event_id")
             .select("incident_id", F.lit(5).alias("section"), (F.col("alert_no") * 4 + 1).alias("a"), F.col("place").cast("bigint").alias("b"),
                     F.concat("file", F.lit(":"), F.col("line_no").cast("string"), F.lit("  "), "raw").alias("text")))
    omitted = sized.filter(F.col("total") > SHOWN).select(
        "incident_id", F.lit(5).alias("section"), (F.col("alert_no") * 4 + 1).alias("a"), F.lit(HEAD + 1).cast("bigint").alias("b"),
        F.concat(F.lit("... "), (F.col("total") - SHOWN).cast("string"), F.lit(" more line(s) omitted ...")).alias("text"))
    closing = out(sized, 5, F.col("alert_no") * 4 + 2, "```", "")
    footer = out(cards, 6, 0, "_Each alert above comes from a fixed rule and cites the lines it rests on. "
                 "Look into payload and transfer alerts before treating them as a break-in._")
    parts = [head, steps, advice_head, advices, alert_head, opening, lines, omitted, closing, footer]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def incident_documents(cards: DataFrame, story: DataFrame, alerts: DataFrame, sample: DataFrame, events: DataFrame) -> DataFrame:
    """The JSON form of the report as ``incident_id, section, position, json`` (S15): per incident its card, story steps and alerts.

    Each alert holds the evidence shown of it, at most 20 lines, with the number of all. An incident may have any number of
    alerts, so a document is a run of JSON lines in the order of (section, position), and no row grows with the incident.
    """
    def out(df: DataFrame, section: int, position: Column, **fields: Column) -> DataFrame:
        record = F.struct(*[value.alias(name) for name, value in fields.items()])
        return df.select("incident_id", F.lit(section).cast("bigint").alias("section"), position.cast("bigint").alias("position"),
                         F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))

    c = F.col
    head = out(cards, 0, F.lit(0), id=c("incident_id"), title=c("title"), risk_score=c("risk_score").cast("bigint"), level=c("level"),
               entities=F.struct("ips", "users"), start=iso(c("start_us")), end=iso(c("end_us")), stages=c("stages"),
               summary=c("summary"), recommendation=c("recommendation"))
    steps = out(story, 1, c("step_no"), ts=iso(c("us")), stage=c("stage"), text=c("text"), alert_id=c("alert_id"))
    place = F.struct("place", c("event_id").alias("id"), c("sample.file").alias("file"), c("sample.line_no").alias("line_no"), "raw",
                     iso(c("sample.us")).alias("ts"), c("event.type").alias("type"), c("event.src_ip").alias("src_ip"), c("event.user").alias("user"))
    shown = (sample.alias("sample").join(events.select(c("id").alias("event_id"), "raw", "type", "src_ip", "user").alias("event"), "event_id")
             .groupBy("alert_key").agg(F.max("total").alias("evidence_total"), F.array_sort(F.collect_list(place)).alias("shown")))
    lines = F.transform("shown", lambda e: e.dropFields("place"))
    told = out(alerts.join(shown, "alert_key", "left"), 2, c("alert_no"), id=c("alert_id"), rule_id=c("rule_id"), rule_name=c("rule_name"),
               severity=c("severity"), points=c("points").cast("bigint"), stage=c("stage"),
               mitre=F.struct("tactic", "technique"), entity=F.struct(c("src_ip").alias("ip"), c("user").alias("user")),
               first_seen=iso(c("first_us")), last_seen=iso(c("last_us")), count=c("count").cast("bigint"), reason=c("reason"),
               evidence_total=F.coalesce("evidence_total", F.lit(0).cast("bigint")), evidence=lines)
    return head.unionByName(steps).unionByName(told)


def export_documents(documents: DataFrame, folder: str) -> None:
    """Writes one folder of JSON lines per incident; part files follow the order, and a large incident is cut into several."""
    (documents.repartitionByRange("incident_id", "section", "position").sortWithinPartitions("incident_id", "section", "position")
     .select("incident_id", F.col("json").alias("value")).write.partitionBy("incident_id").text(folder))
