"""Line numbering, detection and the three parsers on literal lines."""

import random
import re

import pytest

from helpers import lines, micros, ssh_failures
from datetime import datetime
from logvigil import session
from logvigil.config import DEFAULT
from logvigil.sources import formats, text

AUTH = ssh_failures(datetime(2026, 11, 17, 22, 16, 40), "198.51.100.23", 13, 17, "invalid user builder") + [
    "Nov 17 22:52:31 gate3 sshd[7716]: Accepted publickey for builder from 198.51.100.23 port 38114 ssh2",
    "Nov 17 22:56:31 gate3 sudo: builder : TTY=pts/4 ; PWD=/srv/build ; USER=root ; COMMAND=/usr/bin/vi /etc/group",
    "Nov 17 23:03:31 gate3 useradd[7802]: new user: name=svcbackup, UID=1417, GID=1390",
    "this is no log line"]
ACCESS = [
    '192.0.2.140 - alice [19/Mar/2026:23:50:07 -0330] "POST /cart/add?note=a b HTTP/2.0" 201 734 "https://shop.example/" "probe/0.3"',
    '192.0.2.141 - - [20/Mar/2026:00:01:55 -0330] "HEAD /media/big.iso HTTP/1.1" 304 - "-" "a \\"quoted\\" agent"',
    '192.0.2.300 - - [20/Mar/2026:00:02:10 -0330] "GET /media/a.png HTTP/1.1" 200 81 "-" "Browser"',
    '192.0.2.142 - - [31/Apr/2026:08:00:00 +0000] "GET / HTTP/1.1" 200 17',
    '192.0.2.142 - - [30/Apr/2026:08:00:60 +0000] "GET / HTTP/1.1" 200 17',
    "rotated at midnight"]


def parsed_auth(spark, texts, cfg=DEFAULT):
    return {r.line_no: r for r in formats.parse_auth(lines(spark, texts), cfg).collect()}


def test_auth_types_and_accounting(spark):
    rows = parsed_auth(spark, AUTH)
    assert [rows[n].type for n in (1, 14, 15, 16, 17)] == ["ssh_fail", "ssh_success", "sudo", "user_add", None]
    assert rows[1].user == "builder" and rows[15].user == "builder" and rows[16].user == "svcbackup"
    assert rows[1].us == micros(2026, 11, 17, 22, 16, 40) and rows[1].id == "auth.log:1" and rows[1].host == "gate3"
    count = formats.accounting(formats.parse_auth(lines(spark, AUTH), DEFAULT)).first()
    assert (count.lines_total, count.parsed, count.skipped, count.events) == (17, 16, 1, 16)


def test_su_groups_and_informational_lines(spark):
    rows = parsed_auth(spark, [
        "Oct  4 02:46:00 gate3 usermod[2400]: add 'svcbackup' to group 'sudo'",
        "Oct  4 02:46:01 gate3 usermod[2400]: add 'svcbackup' to group 'users'",
        "Oct  4 02:47:00 gate3 su: pam_unix(su:session): session opened for user root by builder(uid=1000)",
        "Oct  4 02:47:00 gate3 su: pam_unix(su:session): session opened for user root by (uid=0)",
        "May 23 17:08:12 relay7 sshd[815]: Connection closed by 192.0.2.61 [preauth]",
        "May 23 17:08:30 relay7 sshd[815]: Invalid user  from 192.0.2.61",
        "May 23 17:09:03 relay7 sshd[815]: Failed password for root from 2001:DB8::0:1 port 1 ssh2",
        "May 23 17:09:03 relay7 sshd[815]: Failed password for root from UNKNOWN port 1 ssh2",
        "Xyz 23 17:09:03 relay7 sshd[815]: x", "May 23 17:09:60 relay7 sshd[815]: x", "May 32 17:09:10 relay7 sshd[815]: x"])
    assert [(rows[n].type, rows[n].user) for n in range(1, 7)] == [
        ("group_add", "svcbackup"), (None, None), ("sudo", "builder"), ("sudo", "(uid=0)"), (None, None), ("invalid_user", None)]
    assert rows[7].src_ip == "2001:db8::1" and rows[8].type == "ssh_fail" and rows[8].src_ip is None
    assert [rows[n].parsed for n in range(1, 12)] == [True] * 8 + [False] * 3


def moving_exchanges(df):
    """Inputs of the plan's exchanges, other than broadcasts, that hold whole lines."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = plan.split("\n\n")
    return [node for node in nodes if re.match(r"\(\d+\) Exchange", node.strip()) and "raw#" in node]


def test_text_is_not_shuffled(spark, tmp_path):
    stamps = ["Dec 28 11:00:00", "Jan  2 17:30:00", "Jul  9 00:00:00"] * 2
    (tmp_path / "auth.log").write_text("\n".join(f"{s} w sshd[1]: Invalid user a from 10.0.0.1" for s in stamps))
    (tmp_path / "access.log").write_text("\n".join(ACCESS))
    parsed = formats.ingest(spark, [str(tmp_path)], DEFAULT)
    assert {datetime.fromtimestamp(r.us / 1e6).year for r in parsed.filter("file = 'auth.log'").collect()} == {2026, 2027, 2028}
    assert "raw" in parsed.columns and moving_exchanges(parsed) == []


def test_many_blocks_and_turns_are_joined_by_shuffles(spark, monkeypatch):
    """Beyond the bound of what is sent to every task, the same rows come by the other way."""
    rng = random.Random(11)
    texts = [f"{m} {d:2d} 00:00:0{rng.randrange(10)} w sshd[1]: x" if rng.random() < 0.9 else "garbage" for m, d in zip(
        rng.choices(["Jan", "Feb", "Jul", "Dec"], k=400), rng.choices(range(1, 32), k=400))]
    monkeypatch.setattr(formats, "YEAR_CHUNK", 16)
    near = parsed_auth(spark, texts)
    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    far = formats.parse_auth(lines(spark, texts), DEFAULT)
    assert moving_exchanges(far) and {r.line_no: r for r in far.collect()} == near
    year, last = DEFAULT.default_year, None
    for n, line in enumerate(texts, start=1):
        month, day = line[:3], int(line[4:6]) if line != "garbage" else 0
        if line == "garbage" or (month == "Feb" and day > 29):
            assert near[n].us is None
            continue
        at = micros(2023, ["Jan", "Feb", "", "", "", "", "Jul", "", "", "", "", "Dec"].index(month) + 1, min(day, 28) if month == "Feb" else day)
        at += (int(line[14]) + (86400 if month == "Feb" and day == 29 else 0)) * 1_000_000
        year += last is not None and last - at >= 181 * 86400 * 1_000_000
        last = at
        if near[n].us is not None:
            assert datetime.fromtimestamp(near[n].us / 1e6).year == year


@pytest.mark.parametrize("gap", [2, 40])
def test_many_turns_cost_a_line_about_one(spark, gap):
    """Lines look at one turn each on average, whether the turns are spread or stand close together at the end."""
    marks = sorted({1500 - k * k % 97 for k in range(0, 2 * gap)} | set(range(1000 // gap, 1500, gap * 10)))
    turns = spark.createDataFrame([("a", n) for n in marks] + [("b", 7)], "file string, line_no bigint")
    files, bins = formats.turn_bins(turns)
    rows = (spark.range(1, 2001).selectExpr("id AS line_no", "'a' AS file").join(files, "file").selectExpr(
        "file", "line_no", "least((line_no - first_turn) div width, bins - 1) AS bin").join(bins, ["file", "bin"], "left").collect())
    assert all((r.before or 0) + sum(t <= r.line_no for t in r.turns or []) == sum(t <= r.line_no for t in marks) for r in rows)
    assert len(rows) == 2000 and sum(len(r.turns or []) for r in rows if r.line_no <= marks[-1]) <= 2 * 2000
    late = [("Jul  1" if n % 2 else "Jan  1") + " 00:00:00 w sshd[1]: x" for n in range(600)]
    assert {n: datetime.fromtimestamp(r.us / 1e6).year for n, r in parsed_auth(spark, late).items()} == {
        n: 2026 + (n - 1) // 2 for n in range(1, 601)}


def test_heads_do_not_read_whole_files(spark, tmp_path):
    (tmp_path / "long.log").write_text("\n".join(AUTH * 10) + "\n" + "x y z\n" * 4_000_000)
    (tmp_path / "short.log").write_text("\n".join(ACCESS))
    (tmp_path / "odd [1] {a}* +%41.log").write_text("\n" * 1_500_000 + "\n".join(AUTH) + "\n" + "x\n" * 1_000_000)
    context = spark.sparkContext
    context.setJobGroup("heads", "heads")
    try:
        heads = text.file_heads(spark, text.list_files(spark, [str(tmp_path)]))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    store = context._jsc.sc().statusStore()
    stages = [s for job in context.statusTracker().getJobIdsForGroup("heads") for s in context.statusTracker().getJobInfo(job).stageIds]
    assert 0 < sum(store.lastStageAttempt(s).inputBytes() for s in stages) < 4 << 20 < (tmp_path / "long.log").stat().st_size // 4
    votes = {r.file.rsplit("/", 1)[1][:4]: r.format for r in formats.detect_formats(text.head_lines(heads), ("n",)).collect()}
    assert votes == {"long": "auth", "shor": "access", "odd%": "auth"}
    assert all(len(r.lines) <= 50 and len(r.head) <= 8192 for r in heads.collect())


def test_year_rolls_over_and_chunks_do_not_matter(spark, monkeypatch):
    texts = ["Dec 29 21:14:00 w sshd[1]: a", "garbage", "Jan  3 06:30:45 w sshd[2]: b", "Jun 30 00:00:00 w sshd[2]: b",
             "Dec 31 00:00:05 w sshd[2]: b", "Feb 28 00:00:00 w sshd[2]: c", "Feb 29 00:00:00 w sshd[2]: c", "Dec 30 00:00:00 w sshd[2]: c",
             "Dec 29 00:00:00 w sshd[2]: c"]
    expected = [2026, None, 2027, 2027, 2027, 2028, 2028, 2028, 2028]
    for chunk in (1_000_000, 2):
        monkeypatch.setattr(formats, "YEAR_CHUNK", chunk)
        rows = parsed_auth(spark, texts)
        assert [None if rows[n].us is None else datetime.fromtimestamp(rows[n].us / 1e6).year for n in range(1, 10)] == expected


def test_access_lines(spark):
    rows = {r.line_no: r for r in formats.parse_access(lines(spark, ACCESS, "access.log")).collect()}
    assert [rows[n].parsed for n in range(1, 7)] == [True, True, False, False, False, False]
    first = rows[1]
    assert first.us == micros(2026, 3, 20, 3, 20, 7) and first.http.path == "/cart/add?note=a b"
    assert (first.http.status, first.http.bytes, first.http.ua, first.source) == (201, 734, "probe/0.3", "web")
    assert rows[2].http.bytes == 0 and rows[2].http.ua == 'a \\"quoted\\" agent'


def test_json_lines(spark):
    texts = ['{"timestamp": "2026-10-04T02:03:11Z", "src_ip": "10.0.0.5", "user": "bob", "event": "ssh_failure"}',
             '{"ts": 1759543391, "ip": "10.0.0.5", "username": "bob", "type": " Accepted "}',
             '{"time": 1759543391123, "client_ip": "::1", "action": "GET", "path": "/a", "status": "404", "bytes": "-", "ua": "x"}',
             '{"@timestamp": "2026-10-04T07:33:11+05:30", "src_ip": null, "ip": "10.0.0.5", "event": "sudo"}',
             '{"timestamp": "yesterday", "event": "sudo"}', '{"timestamp": 1, "event": "reboot"}', '[1, 2]', '{"a": ', '{"event": "sudo"}',
             '{"timestamp": null, "ts": 5, "event": "sudo"}']
    rows = {r.line_no: r for r in formats.parse_jsonl(lines(spark, texts, "a.jsonl")).collect()}
    assert [rows[n].parsed for n in range(1, 11)] == [True] * 4 + [False] * 6
    assert rows[1].us == rows[4].us == micros(2026, 10, 4, 2, 3, 11) and rows[4].src_ip is None
    assert rows[2].us == 1759543391_000_000 and rows[2].type == "ssh_success"
    assert rows[3].us == 1759543391_123_000 and rows[3].http.status == 404 and rows[3].http.bytes is None and rows[3].src_ip == "::1"


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_the_last_of_repeated_members_counts_in_any_session(spark, allowed):
    texts = ['{"event": "reboot", "ts": 1767225601, "event": "sudo", "user": "first", "user": "last"}',
             '{"ts": 1767225602, "event": "sudo", "user": {"a": 1, "b": [{"c": 1.50, "c": 2.50}], "a": "x"}}',
             '{"event": "http", "ts": 1767225603.123456, "size": "7", "size": 12345678901234567, "status": 404, "status": null}',
             '{"ts": 1767225604, "ts": NaN, "event": "sudo"}', '{"ts": 1, "ts": 2, "event": "sudo"', '{"ts": 9, "event": "sudo", "user": "\\u00e9", "user": "\\u00df\\n"}']
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
    try:
        rows = {r.line_no: r for r in formats.parse_jsonl(lines(spark, texts, "a.jsonl")).collect()}
        assert formats.detect_formats(lines(spark, texts[:1] * 2 + ["no"], "a.jsonl")).first().format == "jsonl"
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)
    assert [rows[n].parsed for n in range(1, 7)] == [True, True, True, False, False, True]
    assert (rows[1].type, rows[1].user, rows[6].user) == ("sudo", "last", "ß\n")
    assert rows[2].user.replace(" ", "") == '{"a":"x","b":[{"c":2.5}]}'
    assert (rows[3].us, rows[3].http.bytes, rows[3].http.status) == (1767225603_123456, 12345678901234567, None)


def test_detection(spark):
    df = lines(spark, ["junk", *AUTH], "a").union(lines(spark, ACCESS, "b")).union(
        lines(spark, ['{"x": 1}', "{bad"], "c")).union(lines(spark, ["hello", "[1]"], "d"))
    assert {r.file: r.format for r in formats.detect_formats(df).collect()} == {"a": "auth", "b": "access", "c": "jsonl", "d": None}


def test_files_are_numbered_over_block_borders(spark, tmp_path):
    rng = random.Random(3)
    content = "".join(rng.choice(["", "  ", "x" * rng.randrange(1, 40), "a\x0bb", "é\x85z"]) + rng.choice(["\n", "\r\n"]) for _ in range(3000))
    path = tmp_path / "big.log"
    path.write_bytes(content.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.read_lines(spark, [str(path)])
        rows = sorted((r.line_no, r.raw) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(n, line.strip()) for n, line in enumerate(content.splitlines(), start=1) if line.strip()]


def test_ingest_mixed_files(spark, tmp_path):
    for sub in ("a", "b"):
        (tmp_path / sub).mkdir()
    (tmp_path / "a" / "auth.log").write_text("\n".join(AUTH) + "\n\n")
    (tmp_path / "b" / "auth.log").write_text("\n".join(AUTH[:5]))
    (tmp_path / "access.log").write_text("\n".join(ACCESS))
    (tmp_path / "odd one.txt").write_text("hello\nworld\n")
    (tmp_path / "empty.log").write_text(" \n\n")
    (tmp_path / "tool.log").write_bytes(b"\x7fELF\x02\n" + "\n".join(AUTH[:2]).encode())
    (tmp_path / "damaged.log").write_bytes("\n".join(AUTH).encode().replace(b"gate3", b"ga\x00te3"))
    paths = [str(tmp_path / "b" / "auth.log"), str(tmp_path / "a"), str(tmp_path / "[deot]*")]
    paths += [str(tmp_path / "access.log")]
    files = formats.known_files(spark, paths)
    parsed = formats.ingest(spark, paths, DEFAULT, files)
    report = formats.file_report(files, parsed)
    counts = {r.name: (r.format, r.lines_total, r.parsed, r.events, r.problem) for r in report.collect()}
    assert counts == {
        "auth.log": ("auth", 5, 5, 5, None), "auth_2.log": ("auth", 17, 16, 16, None), "access.log": ("access", 6, 2, 2, None),
        "odd one.txt": (None, 2, 0, 0, "has no known format"), "empty.log": (None, 0, 0, 0, "is empty"),
        "tool.log": (None, 0, 0, 0, "is a binary file"), "damaged.log": ("auth", 17, 16, 16, None)}
    ids = {r.id for r in formats.events_of(parsed).select("id").collect()}
    assert {"auth.log:3", "auth_2.log:3", "access.log:1"} <= ids and not any("/" in i or i.startswith("tool") for i in ids)
    formats.require_parsed(report)
    with pytest.raises(ValueError, match="reach .*access.log"):
        formats.known_files(spark, [str(tmp_path / "*.log"), str(tmp_path / "access.log")])
    with pytest.raises(ValueError, match="'empty.log' is empty; 'odd one.txt' has no known format; 'tool.log' is a binary file. Supported"):
        formats.require_parsed(report.filter("parsed = 0"))


def test_heads_of_files(spark, tmp_path):
    cases = {"gif": b"GIF89a", "controls": b"\x01" * 20 + b"a\n" * 50, "few": b"\x01" * 10 + b"a\n" * 50, "nul": b"ab\x00c\r\n" * 9,
             "late": b"ok line\n" * 1024 + b"\x02" * 9000, "long": b"x" * 8192 + b"\x02" * 9000, "early": b"y" * 7000 + b"\n" + b"\x02" * 9000,
             "windows": b"MZ\n\nabc", "second": b"a\nMZ", "empty": b""}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    got = {r.name for r in formats.known_files(spark, [str(tmp_path)]).collect() if r.is_binary}
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in cases.items()], "file string, content binary")
    assert got == {r.file for r in text.judge_uploads(rows).collect() if r.is_binary} == {"gif", "controls", "nul", "early", "windows"}


def test_uploads(spark):
    rows = [("png", bytearray(b"\x89PNG....")), ("ctl", bytearray(b"\x01" * 20 + b"a" * 100)), ("ok", bytearray(b"a\x00b\xffc and more text\n")), ("empty", bytearray())]
    got = {r.file: r for r in text.judge_uploads(spark.createDataFrame(rows, "file string, content binary")).collect()}
    assert got["png"].is_binary and got["ctl"].is_binary and not got["ok"].is_binary and not got["empty"].is_binary
    assert got["ok"].text == "ab\ufffdc and more text\n" and got["png"].text is None


def test_unique_names(spark):
    paths = ["a/auth.log", "b/auth.log", "auth.log", None, ".profile", "x/.profile", "noext", "noext", "..a", "..a", "x.tar.gz", "x.tar.gz"]
    df = spark.createDataFrame(list(enumerate(paths)), "position int, path string")
    assert [r.name for r in text.unique_names(df).orderBy("position").collect()] == [
        "auth.log", "auth_2.log", "auth_3.log", "upload.log", ".profile", ".profile_2", "noext", "noext_2", "..a", "..a_2", "x.tar.gz", "x.tar_2.gz"]
