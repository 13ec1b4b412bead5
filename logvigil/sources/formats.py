"""Line formats: detection by vote and the three parsers.

Every parser maps ``file, line_no, raw`` to one row per line with ``parsed`` and the event fields;
``type`` is null for lines without a security event.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from logvigil import session
from logvigil.config import MINUTE, Thresholds
from logvigil.functions.net import clean_ip
from logvigil.functions.timing import EPOCH_NTZ
from logvigil.operators.intervals import UNBOUNDED, with_running_sum
from logvigil.session import counted_small, settled, settled_with
from logvigil.sources.text import VOTING_LINES, cut_lines, file_heads, head_lines, is_binary_head, list_files, numbered_lines, scan_lines, unique_names

# The line patterns, in the notation of Spark's regex engine.
AUTH_LINE = (r"(?U)^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\s+(\S+)\s+([^\s:\[]+)(?:\[\d+\])?:\s?"
             r"([^\n]*)$")
ACCESS_LINE = (r'(?U)^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+([^\n]+?)(?:\s+(HTTP/[\d.]+))?"\s+(\d{3})\s+(\d+|-)'
               r'(?:\s+"[^"\\]*+(?:\\[^\n][^"\\]*+)*+")?(?:\s+"([^"\\]*+(?:\\[^\n][^"\\]*+)*+)")?')
ACCESS_TIME = r"^(\d{2})[^\s]([A-Z][a-z]{2})[^\s](\d{4})[^\s](\d{2})[^\s](\d{2})[^\s](\d{2})\S* ([+-])(\d{2})(\d{2})$"
SSH_FAIL = (r"(?U)Failed (?:password|publickey|keyboard-interactive/pam) for (?:invalid user )?(\S*) from (\S+) "
            r"port \d+")
SSH_SUCCESS = r"(?U)Accepted \S+ for (\S+) from (\S+) port \d+"
INVALID_USER = r"(?U)Invalid user (\S*) from (\S+)"
SUDO = r"(?U)^\s*(\S+)\s*:.*?USER=(\S+)\s*;.*?COMMAND=(.*)$"
SU = r"(?U)session opened for user (\S+?)(?:\(uid=\d+\))? by (\S+?)(?:\(uid=\d+\))?\s*$"
USER_ADD = r"(?U)new user: name=([^,\s]+)"
GROUP_ADD = r"(?iuU)add(?:ing)? (?:user )?'?([^'\s]+)'? to (?:shadow )?group '?(sudo|wheel|admin)'?"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Accepted JSON keys in order, and event names to event types.
TIME_KEYS = ("timestamp", "ts", "time", "@timestamp")
IP_KEYS = ("src_ip", "ip", "client_ip", "remote_addr")
USER_KEYS = ("user", "username")
EVENT_KEYS = ("event", "type", "action")
EVENT_NAMES = {
    "ssh_fail": ["ssh_fail", "ssh_failure", "failed"],
    "ssh_success": ["ssh_success", "accepted", "ssh_accepted"],
    "invalid_user": ["invalid_user", "invalid"],
    "sudo": ["sudo", "sudo_command"],
    "user_add": ["user_add", "useradd", "new_user"],
    "group_add": ["group_add", "groupadd", "new_group"],
    "http_request": ["http_request", "http", "request", "get", "post", "put", "delete"],
}
SUPPORTED = "syslog lines of authentication services; access logs in the combined format; one JSON object per line with a time, an address, a user or an event"
HTTP = "struct<method:string,path:string,status:int,bytes:bigint,ua:string>"
YEAR_CHUNK = 65_536
HALF_YEAR = 181 * 24 * 60 * MINUTE


def _month(name: str) -> str:
    return "array_position(array(" + ", ".join(f"'{m}'" for m in MONTHS) + f"), {name})"


def staged(rows: DataFrame, keep: list[str], **columns: Column | str) -> DataFrame:
    """Adds columns that later steps use many times.

    As a one-row generator they are computed once per row; a plain projection would be merged into every
    later use, and filters on later columns would repeat it.
    """
    values = [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return rows.select(*keep, F.inline(F.array(F.struct(*values))))


LINE = ["file", "line_no", "raw"]


def _fields(pattern: str, groups: int) -> Column:
    """All groups of one match as an array, or null. Lines hold no line feed, so it can separate."""
    joined = F.regexp_replace("raw", pattern + r"[^\n]*", "\n".join(f"${i}" for i in range(1, groups + 1)))
    return F.when(F.col("raw").rlike(pattern), F.split(joined, "\n", groups))


def _line(parsed: Column, us: Column, kind: Column, ip: Column, user: Column, host: Column, http: Column) -> list[Column]:
    source = F.when(kind == "http_request", "web").when(kind.isNotNull(), "auth")
    return [F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("id"), us.alias("us"), source.alias("source"),
            kind.alias("type"), ip.alias("src_ip"), user.alias("user"), host.alias("host"), http.alias("http"), F.col("file"),
            F.col("line_no"), F.col("raw"), parsed.alias("parsed")]


# --- Format detection (S4) ------------------------------------------------------------------------


def detect_formats(lines: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """``file, format`` by vote over the first 50 non-blank lines; null where nothing matched.

    Any columns in line order do, so files need not be numbered first.
    """
    rank = F.row_number().over(Window.partitionBy("file").orderBy(*order))
    head = with_members(lines.withColumn("rank", rank).filter(F.col("rank") <= VOTING_LINES), ["file", "raw"])
    is_object = F.col("m").isNotNull()
    vote = (F.when(F.col("raw").rlike(AUTH_LINE), "auth").when(F.col("raw").rlike(ACCESS_LINE), "access")
            .when(is_object, "jsonl"))
    counts = head.withColumn("vote", vote).groupBy("file").agg(
        *[F.count(F.when(F.col("vote") == f, 1)).alias(f) for f in ("auth", "access", "jsonl")])
    return counts.selectExpr("file", """CASE WHEN auth + access + jsonl = 0 THEN NULL
        WHEN jsonl > auth AND jsonl > access THEN 'jsonl' WHEN auth >= access THEN 'auth' ELSE 'access' END AS format""")


# --- Syslog authentication lines (S5, S8, F3) -----------------------------------------------------


def year_turns(times: DataFrame) -> DataFrame:
    """``file, line_no`` of the lines where a year begins, among ``file, line_no, year_us`` of all good lines.

    A year begins where time falls back more than 180 whole days behind the last good line. Chunks of lines are folded to their
    first, last, lowest and highest time before anything is moved. A turn between chunks follows from these; inside a chunk
    there can only be one if its times lie half a year apart, and only such chunks' times are ordered.
    """
    chunked = times.withColumn("chunk", F.expr(f"line_no div {YEAR_CHUNK}"))
    spans = chunked.groupBy("file", "chunk").agg(
        F.min("line_no").alias("line_no"), F.min_by("year_us", "line_no").alias("first_us"), F.max_by("year_us", "line_no").alias("last_us"),
        (F.max("year_us") - F.min("year_us") >= HALF_YEAR).alias("wide"))
    before = F.lag("last_us").over(Window.partitionBy("file").orderBy("chunk"))
    between = spans.withColumn("before", before).filter(F.col("before") - F.col("first_us") >= HALF_YEAR).select("file", "line_no")
    wide = spans.filter("wide").select("file", "chunk")
    above = F.lag("year_us").over(Window.partitionBy("file", "chunk").orderBy("line_no"))
    inside = (chunked.join(wide, ["file", "chunk"]).withColumn("above", above)
              .filter(F.col("above") - F.col("year_us") >= HALF_YEAR).select("file", "line_no"))
    return between.unionByName(inside)


def turn_bins(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, first_turn, width, bins`` and ``file, bin, before, turns``: the turns of a file in as many bins of equal width as it has turns.

    A line looks at the turns of its own bin and adds the number ``before`` it. Bins times width is the distance from the first turn to
    the last, so all lines together look at about one turn each, however many turns there are and wherever they lie.
    """
    files = turns.groupBy("file").agg(F.min("line_no").alias("first_turn"), F.expr("(max(line_no) - min(line_no)) div count(*) + 1").alias("width"),
                                      F.count("*").alias("bins"))
    held = (turns.join(files, "file").withColumn("bin", F.expr("(line_no - first_turn) div width"))
            .groupBy("file", "bin").agg(F.sort_array(F.collect_list("line_no")).alias("turns")))
    every = files.select("file", F.explode(F.expr("sequence(0, bins - 1)")).alias("bin")).join(held, ["file", "bin"], "left")
    earlier = Window.partitionBy("file").orderBy("bin").rowsBetween(UNBOUNDED, -1)
    listed = every.withColumn("turns", F.coalesce("turns", F.array().cast("array<bigint>")))
    return files, listed.withColumn("before", F.coalesce(F.sum(F.size("turns")).over(earlier), F.lit(0)))


def with_year(lines: DataFrame, cfg: Thresholds) -> DataFrame:
    """Adds ``turned`` and ``year`` to rows with ``file, line_no, year_us`` (time within a common year, null if malformed).

    Rows stay where they are and find the number of turns up to their line in ``turn_bins``. Only where damaged files hold more
    turns than may be sent to every task are all times ordered, and joined to the rows.
    """
    times = settled(lines.filter("year_us IS NOT NULL").select("file", "line_no", "year_us"), "year-times")
    turns, counted = settled_with(year_turns(times), "year-turns", F.count("*").alias("n"))
    found = counted["n"]
    if not found:
        return lines.withColumn("turned", F.lit(0)).withColumn("year", F.lit(cfg.default_year))
    if found <= session.SMALL_ROWS:
        files, bins = turn_bins(turns)
        rows = (lines.join(F.broadcast(files), "file", "left").withColumn("bin", F.expr("least((line_no - first_turn) div width, bins - 1)"))
                .join(F.broadcast(bins), ["file", "bin"], "left"))
        return (rows.withColumn("turned", F.expr("CAST(coalesce(array_contains(turns, line_no), false) AS INT)"))
                .withColumn("year", F.expr(f"CAST({cfg.default_year} + coalesce(before + size(filter(turns, t -> t <= line_no)), 0) AS INT)"))
                .select(*lines.columns, "turned", "year"))
    marked = times.join(turns.withColumn("turned", F.lit(1).cast("bigint")), ["file", "line_no"], "left").na.fill(0, ["turned"])
    summed = with_running_sum(marked.withColumn("chunk", F.expr(f"line_no div {YEAR_CHUNK}")), ["file"], "chunk", ["line_no"], "turned", "turns")
    return (lines.join(summed.select("file", "line_no", "turned", "turns"), ["file", "line_no"], "left")
            .withColumn("year", (F.col("turns") + cfg.default_year).cast("int")).drop("turns"))


def parse_auth(lines: DataFrame, cfg: Thresholds) -> DataFrame:
    fields = staged(lines, LINE, f=_fields(AUTH_LINE, 8))
    numbers = fields.select(*LINE, "f", F.expr(_month("f[0]")).alias("month"), *[
        F.expr(f"try_cast(f[{i}] AS INT)").alias(n) for i, n in ((1, "day"), (2, "hh"), (3, "mm"), (4, "ss"))])
    # Day numbers of a common year; 29 February stands in for 1 March until the year is known.
    good = "month > 0 AND day BETWEEN 1 AND get(array(31,29,31,30,31,30,31,31,30,31,30,31), month - 1) AND hh < 24 AND mm < 60 AND ss < 60"
    days = "get(array(0,31,59,90,120,151,181,212,243,273,304,334), month - 1) + day - 1"
    placed = numbers.withColumn("year_us", F.expr(
        f"CASE WHEN {good} THEN (({days}) * 86400L + hh * 3600 + mm * 60 + ss) * 1000000L END"))
    dated = with_year(placed, cfg).withColumn("us", F.expr(f"""
        CASE WHEN year_us IS NOT NULL AND NOT (month = 2 AND day = 29 AND turned = 1) THEN
            timestampdiff(MICROSECOND, {EPOCH_NTZ}, try_make_timestamp_ntz(year, month, day, hh, mm, ss))
            - {cfg.auth_utc_offset_minutes * MINUTE}L END"""))
    proc, msg = F.lower(F.col("f")[6]), F.col("f")[7]
    kinds = [("ssh_fail", proc.startswith("sshd"), SSH_FAIL, 1, 2), ("ssh_success", proc.startswith("sshd"), SSH_SUCCESS, 1, 2),
             ("invalid_user", proc.startswith("sshd"), INVALID_USER, 1, 2), ("sudo", proc == "sudo", SUDO, 1, 0),
             ("sudo", proc == "su", SU, 2, 0), ("user_add", proc == "useradd", USER_ADD, 1, 0),
             ("group_add", proc.isin("usermod", "gpasswd"), GROUP_ADD, 1, 0)]
    found = F
    for kind, applies, pattern, user_group, ip_group in kinds:
        ip = F.regexp_extract(msg, pattern, ip_group) if ip_group else F.lit(None).cast("string")
        found = found.when(applies & msg.rlike(pattern), F.struct(
            F.lit(kind).alias("type"), F.nullif(F.regexp_extract(msg, pattern, user_group), F.lit("")).alias("user"), ip.alias("ip")))
    rows = staged(dated, [*LINE, "us", "f"], e=F.when(F.col("us").isNotNull(), found))
    return rows.select(*_line(F.col("us").isNotNull(), F.col("us"), F.col("e.type"), clean_ip(F.col("e.ip")), F.col("e.user"),
                              F.when(F.col("us").isNotNull(), F.col("f")[5]), F.lit(None).cast(HTTP)))


# --- Combined access lines (S6, F4) ---------------------------------------------------------------


def time_fields(text: str) -> str:
    """SQL for the nine parts of ``04/Oct/2026:14:02:10 +0530`` as an array, null where it has another form."""
    pattern = ACCESS_TIME.replace("\\", "\\\\")
    return f"CASE WHEN {text} RLIKE '{pattern}' THEN split(regexp_replace({text}, '{pattern}', '$1,$2,$3,$4,$5,$6,$7,$8,$9'), ',') END"


def time_of_fields(t: str) -> str:
    """SQL for epoch microseconds of those parts, null where they are no time."""
    part = [f"CAST({t}[{i}] AS INT)" if i not in (1, 6) else f"{t}[{i}]" for i in range(9)]
    local = f"try_make_timestamp_ntz({part[2]}, {_month(part[1])}, {part[0]}, {part[3]}, {part[4]}, {part[5]})"
    offset = f"({part[7]} * 60L + {part[8]}) * CASE WHEN {part[6]} = '-' THEN -1 ELSE 1 END"
    return (f"CASE WHEN {part[5]} < 60 AND {part[7]} * 60 + {part[8]} < 1440 AND {_month(part[1])} > 0 THEN "
            f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {local}) - {offset} * {MINUTE}L END")


def parse_access(lines: DataFrame) -> DataFrame:
    rows = staged(lines, LINE, f=_fields(ACCESS_LINE, 8))
    rows = staged(rows, [*LINE, "f"], ip=clean_ip(F.col("f")[0]), t=time_fields("f[1]"))
    rows = staged(rows, [*LINE, "f", "ip"], us=F.when(F.col("ip").isNotNull(), F.expr(time_of_fields("t"))))
    http = F.struct(F.col("f")[2].alias("method"), F.col("f")[3].alias("path"), F.expr("try_cast(f[5] AS INT)").alias("status"),
                    F.expr("CASE WHEN f[6] = '-' THEN 0L ELSE try_cast(f[6] AS BIGINT) END").alias("bytes"),
                    F.nullif(F.col("f")[7], F.lit("")).alias("ua"))
    good, none = F.col("us").isNotNull(), F.lit(None).cast("string")
    return rows.select(*_line(good, F.col("us"), F.when(good, "http_request"), F.when(good, F.col("ip")), none, none,
                              F.when(good, http)))


# --- JSON lines (S7, S11, F5-F7) ------------------------------------------------------------------


EMPTY = r'^(""|false|null|\\[\\]|\\{\\}|-?0(\\.0*)?([eE].*)?)$'


class _Literal(str):
    """A number as it is written."""


def _last_members(text: str) -> str | None:
    """The same JSON text with the last of repeated members, at every depth; null where it is no JSON."""
    def no_number(word: str):
        raise ValueError(word)

    def written(value) -> str:
        if isinstance(value, _Literal):
            return value
        if isinstance(value, dict):
            return "{" + ",".join(f"{json.dumps(k)}:{written(v)}" for k, v in value.items()) + "}"
        return "[" + ",".join(map(written, value)) + "]" if isinstance(value, list) else json.dumps(value)

    try:
        return written(json.loads(text, parse_int=_Literal, parse_float=_Literal, parse_constant=no_number))
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(StringType())
def last_members(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else _last_members(t) for t in texts.to_pylist()], "string")


def with_members(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``m``, the members of the JSON object ``raw``, or null; of repeated members the last one counts.

    A member that is null stays distinct from an absent one.
    Whether Spark's parser takes repeated members is up to the session. Lines that it refuses, and no others, are read again
    without the earlier ones, so that the result is the same in every session.
    """
    parsed = staged(rows, list(dict.fromkeys([*keep, "raw"])), strict="try_parse_json(raw)")
    again = parsed.withColumn("again", last_members(F.when(F.col("strict").isNull(), F.col("raw"))))
    return staged(again, keep, m="try_variant_get(coalesce(strict, try_parse_json(again)), '$', 'map<string,variant>')")


def member(key: str) -> str:
    return f"try_element_at(m, '{key}')"


def first_present(keys: tuple[str, ...]) -> str:
    """First key that exists, even where its value is null."""
    return "coalesce(" + ", ".join(member(k) for k in keys) + ")"


def _type(value: str) -> str:
    return f"schema_of_variant({value})"


def _truthy(value: str) -> str:
    return f"coalesce(NOT to_json({value}) RLIKE '{EMPTY}', false)"


def first_truthy(keys: tuple[str, ...]) -> str:
    """First non-empty, non-zero value; failing that the last key's value."""
    whens = " ".join(f"WHEN {_truthy(member(k))} THEN {member(k)}" for k in keys[:-1])
    return f"CASE {whens} ELSE {member(keys[-1])} END"


def _text_of(value: str) -> str:
    return (f"CASE WHEN {value} IS NULL OR is_variant_null({value}) THEN NULL "
            f"WHEN {_type(value)} = 'BOOLEAN' THEN initcap(try_variant_get({value}, '$', 'string')) "
            f"ELSE try_variant_get({value}, '$', 'string') END")


def lenient_int(value: str) -> str:
    """Numeric strings parse, numbers truncate, booleans count, anything else, and what does not fit 64 bits, is null."""
    text, number = f"try_variant_get({value}, '$', 'string')", f"try_variant_get({value}, '$', 'double')"
    return (f"CASE WHEN {_type(value)} = 'STRING' THEN CASE WHEN trim({text}) RLIKE '^[+-]?[0-9]+$' THEN try_cast({text} AS BIGINT) END "
            f"WHEN {_type(value)} = 'BOOLEAN' THEN CAST(try_variant_get({value}, '$', 'boolean') AS BIGINT) "
            f"WHEN {_type(value)} = 'BIGINT' THEN try_variant_get({value}, '$', 'bigint') "
            f"WHEN {_type(value)} RLIKE '^(DECIMAL|DOUBLE|FLOAT)' THEN CASE "
            f"WHEN abs({number}) >= 9.2233720368547758E18D THEN NULL WHEN {number} < 0 THEN ceil({number}) ELSE floor({number}) END END")


ISO = r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})(?:[^0-9]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?(?:([+-])([0-9]{2}):?([0-9]{2})?)?)?$"


def time_parts(value: str) -> dict[str, str]:
    """SQL for what a JSON time may be: its kind, its number, and the parts of an ISO-8601 text."""
    text = f"replace(trim(try_variant_get({value}, '$', 'string')), 'Z', '+00:00')"
    groups = ",".join(f"${i}" for i in range(1, 11))
    iso = f"CASE WHEN {_type(value)} = 'STRING' AND {text} RLIKE '{ISO}' THEN split(regexp_replace({text}, '{ISO}', '{groups}'), ',') END"
    number = f"try_variant_get({value}, '$', 'double')"
    epoch = (f"CASE WHEN {_type(value)} = 'BOOLEAN' THEN CAST(CAST(try_variant_get({value}, '$', 'boolean') AS INT) AS DOUBLE) "
             f"WHEN {_type(value)} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' THEN CASE WHEN {number} > 1e12 THEN {number} / 1000 ELSE {number} END END")
    return {"iso": iso, "epoch": epoch}


def time_of_parts(iso: str, epoch: str) -> str:
    """SQL for epoch microseconds: epoch seconds, epoch milliseconds above 1e12, or ISO-8601 with naive times as UTC."""
    whole = [f"CAST(coalesce(nullif({iso}[{i}], ''), '0') AS INT)" for i in range(10)]
    local = f"try_make_timestamp_ntz({whole[0]}, {whole[1]}, {whole[2]}, {whole[3]}, {whole[4]}, {whole[5]})"
    micro = f"CAST(rpad(substring({iso}[6], 1, 6), 6, '0') AS BIGINT)"
    offset = f"({whole[8]} * 60L + {whole[9]}) * CASE WHEN {iso}[7] = '-' THEN -1 ELSE 1 END"
    return (f"CASE WHEN {epoch} BETWEEN -62135596800 AND 253402300799 THEN CAST(bround({epoch} * 1000000) AS BIGINT) "
            f"WHEN {iso} IS NOT NULL AND {whole[5]} < 60 AND {whole[8]} < 24 THEN "
            f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {local}) + {micro} - {offset} * {MINUTE}L END")


def event_type(name: Column) -> Column:
    """Normalised event type of an event name or null."""
    plain, kind = F.btrim(F.lower(name)), F
    for target, aliases in EVENT_NAMES.items():
        kind = kind.when(plain.isin(*aliases), F.lit(target))
    return kind


def parse_jsonl(lines: DataFrame) -> DataFrame:
    rows = with_members(lines, LINE)
    values = dict(time=first_present(TIME_KEYS), event=first_present(EVENT_KEYS), ip=first_present(IP_KEYS), who=first_present(USER_KEYS),
                  place=first_truthy(("host", "hostname")), method=member("method"), path=first_truthy(("path", "url")), status=member("status"),
                  size=first_truthy(("bytes", "size", "response_size")), ua=first_truthy(("user_agent", "ua")))
    rows = staged(rows, LINE, **values)
    rows = staged(rows, [*LINE, *values], name=_text_of("event"), **time_parts("time"))
    rows = staged(rows, [*LINE, *values], us=time_of_parts("iso", "epoch"), kind=event_type(F.col("name")))
    good = F.col("us").isNotNull() & F.col("kind").isNotNull()

    def text(name: str) -> Column:
        return F.nullif(F.expr(f"CASE WHEN {_truthy(name)} THEN {_text_of(name)} END"), F.lit(""))

    http = F.struct(text("method").alias("method"), text("path").alias("path"),
                    F.expr(f"try_cast({lenient_int('status')} AS INT)").alias("status"), F.expr(lenient_int("size")).alias("bytes"),
                    text("ua").alias("ua"))
    return rows.select(*_line(
        good, F.when(good, F.col("us")), F.when(good, F.col("kind")), F.when(good, clean_ip(F.expr(_text_of("ip")))),
        F.when(good, F.expr(_text_of("who"))), F.when(good, text("place")),
        F.when(good & (F.col("kind") == "http_request"), http)))


# --- All formats (S2, S9) -------------------------------------------------------------------------


def parse_lines(lines: DataFrame, formats: DataFrame, cfg: Thresholds) -> DataFrame:
    """Parses numbered lines, each file by its format. Lines of files whose format is null are kept as not parsed.

    The lines are stored by format once, so each parser reads its own lines and nothing else. The formats come to the lines, within
    a counted bound, so a long file is not gathered in one task.
    """
    known = counted_small(settled(formats, "formats"))
    return _parse_stored(settled(lines.join(known, "file"), "lines", "format"), cfg)


def _parse_stored(known: DataFrame, cfg: Thresholds) -> DataFrame:
    each = [parser(known.filter(F.col("format") == f).drop("format")) for f, parser in (
        ("auth", lambda d: parse_auth(d, cfg)), ("access", parse_access), ("jsonl", parse_jsonl))]
    none = F.lit(None).cast("string")
    rest = known.filter("format IS NULL").select(*_line(
        F.lit(False), F.lit(None).cast("bigint"), none, none, none, none, F.lit(None).cast(HTTP)))
    return reduce(DataFrame.unionByName, [*each, rest])


def known_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, name, size, is_binary, format`` per file: unique name, judgement of its head, vote (S3, S4, S10). Reads heads only."""
    files = settled(list_files(spark, paths), "files-listed")
    heads = file_heads(spark, files)
    judged = heads.select("file", is_binary_head(F.col("head")).alias("is_binary")).join(detect_formats(head_lines(heads), ("n",)), "file", "left")
    return (unique_names(files).join(judged, "file", "left")
            .select("file", "name", "size", F.coalesce("is_binary", F.lit(False)).alias("is_binary"),
                    F.when(~F.coalesce("is_binary", F.lit(False)), F.col("format")).alias("format")))


def ingest(spark: SparkSession, paths: list[str], cfg: Thresholds, files: DataFrame | None = None) -> DataFrame:
    """Parsed lines of text files under their unique names; lines of binary files are left out.

    ``files`` are those of ``known_files``, for callers that have written them already. The lines are written by format where they
    are read, and numbered and parsed from there; no text is shuffled.
    """
    files = settled(known_files(spark, paths), "files") if files is None else files
    text_files = counted_small(files.filter("NOT is_binary").select("file", "name", "format"))
    cut = cut_lines(scan_lines(spark, paths)).join(text_files, "file").select(F.col("name").alias("file"), "block", "pos", "raw", "format")
    return _parse_stored(numbered_lines(settled(cut, "lines", "format")), cfg)


def events_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("type IS NOT NULL").drop("parsed")


def accounting(parsed: DataFrame, *keys: str) -> DataFrame:
    """``lines_total, parsed, skipped, events`` per keys, or over everything."""
    return parsed.groupBy(*keys).agg(
        F.count("*").alias("lines_total"), F.count(F.when(F.col("parsed"), 1)).alias("parsed"),
        F.count(F.when(~F.col("parsed"), 1)).alias("skipped"), F.count("type").alias("events"))


def file_report(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """``name, size, format, lines_total, parsed, skipped, events, problem`` per file; the problem is null where lines parsed."""
    counts = accounting(parsed, "file").withColumnRenamed("file", "name")
    known = files.join(counts, "name", "left").na.fill(0, ["lines_total", "parsed", "skipped", "events"])
    problem = (F.when(F.col("is_binary"), "is a binary file").when(F.col("lines_total") == 0, "is empty")
               .when(F.col("format").isNull(), "has no known format").when(F.col("parsed") == 0, "has no valid line"))
    return known.select("name", "size", "format", "lines_total", "parsed", "skipped", "events", problem.alias("problem"))


def require_parsed(report: DataFrame, shown: int = 20) -> None:
    """Fails where no line at all could be parsed, naming the first files and what is wrong with each."""
    if report.filter("parsed > 0").isEmpty():
        reasons = [f"'{r.name}' {r.problem}" for r in report.orderBy("name").limit(shown).select("name", "problem").collect()]
        raise ValueError(f"No parsable lines: {'; '.join(reasons) or 'no file has content'}. Supported formats: {SUPPORTED}.")
