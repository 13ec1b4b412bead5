"""The same results in plain SQL for another engine, written from the definitions and not from the plans.

Windows run over raw rows, interval joins compare all pairs and components walk every path: simple and
only fit for small tables.
"""

from __future__ import annotations

import re

from logvigil.config import HOUR
from logvigil.operators.correlate import STAGES
from logvigil.operators.rules import RULES
from logvigil.operators.story import DEFAULT_TITLE, SHARPER, TITLES
from logvigil.plans.adapter import ATTACKS, BROWSERS, PAGES, SCALED as C, SCANNERS
from logvigil.plans.catalog import EVENT_CODES
from logvigil.plans.samples import START_2026, STEP
from logvigil.sources.formats import EVENT_NAMES
from logvigil.sources.text import SPACES


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _minutes(a: str, b: str) -> str:
    return f"greatest(1, CAST(round_even(({b} - {a}) / 6e7, 0) AS BIGINT))"


def _bursts(src: str, key: str, window: int, threshold: int, distinct: str | None = None) -> str:
    measure = f"count(DISTINCT coalesce({distinct}, ''))" if distinct else "count(*)"
    return f"""SELECT * FROM (SELECT *, min(CASE WHEN trail >= {threshold} THEN us END) OVER (PARTITION BY {key}, sess) AS trig FROM (
        SELECT *, max(CASE WHEN gap IS NULL OR gap > {window} THEN us END) OVER (
            PARTITION BY {key} ORDER BY us, line_no ROWS UNBOUNDED PRECEDING) AS sess FROM (
            SELECT *, us - lag(us) OVER (PARTITION BY {key} ORDER BY us, line_no) AS gap,
                   {measure} OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN {window} PRECEDING AND CURRENT ROW) AS trail
            FROM {src}))) WHERE us >= trig - {window}"""


PATTERNS = {
    "SQL injection pattern": r"'\s*or\s*'|union\s+select|select\s.+\sfrom|sleep\(|--\s*(&|$)",
    "XSS pattern": r"<script|javascript:|onerror\s*=|onload\s*=",
    "path traversal pattern": r"\.\./|\.\.\\|/etc/passwd",
    "command injection pattern": r";\s*cat\s|\|\s*cat\s|&&|\$\(|`",
}
DECODED = ("url_decode(regexp_replace(replace({0}, '+', ' '), '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|$)', '%25\\1', 'g'))")
LABEL = "CASE " + " ".join("WHEN regexp_matches(decoded, '{}', 'i') THEN '{}'".format(p.replace("'", "''"), name)
                           for name, p in PATTERNS.items()) + " END"

CTES: list[tuple[str, str]] = []


def _cte(name: str, sql: str) -> None:
    CTES.append((name, sql))


_cte("sec", f"""SELECT 'events:' || event_id AS id, us, typ AS type, event_type,
    CASE WHEN typ = 'http_request' THEN 'web' ELSE 'auth' END AS source,
    CASE WHEN event_type = 'purchase' OR (event_type = 'view' AND k = 97) THEN NULL
         WHEN typ = 'ssh_success' AND k % 10 = 5 THEN '10.200.' || ((user_id // 256) % 256) || '.' || (user_id % 256)
         ELSE '10.' || ((g // 65536) % 256) || '.' || ((g // 4) % 256) || '.' || (g % 4 + 1) END AS ip,
    CASE WHEN typ != 'http_request' THEN 'user' || user_id END AS usr,
    CASE WHEN typ = 'http_request' THEN CASE WHEN g % 8 = 3 AND k % 4 = 0 THEN ({_list(ATTACKS)})[(k // 4) % {len(ATTACKS)} + 1]
         ELSE ({_list(PAGES)})[k % {len(PAGES)} + 1] END END AS path,
    CASE WHEN k % 3 = 0 THEN 404 ELSE 200 END AS status, CAST(trunc(value * 100000) AS BIGINT) AS bytes,
    CASE WHEN g % 8 = 5 AND k % 10 = 0 THEN ({_list(SCANNERS)})[(k // 10) % {len(SCANNERS)} + 1]
         ELSE ({_list(BROWSERS)})[k % {len(BROWSERS)} + 1] END AS ua, event_id AS line_no
    FROM (SELECT *, user_id // 4 AS g, CASE event_type WHEN 'error' THEN 'ssh_fail' WHEN 'signup' THEN 'ssh_success'
            WHEN 'purchase' THEN CASE WHEN k % 10 = 0 THEN 'user_add' WHEN k % 10 = 1 THEN 'group_add' ELSE 'sudo' END
            ELSE 'http_request' END AS typ
          FROM (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""")
_cte("fails", "SELECT * FROM sec WHERE type = 'ssh_fail' AND ip IS NOT NULL")
_cte("r1_rows", _bursts("fails", "ip", C.r1_window, C.r1_threshold))
_cte("r1", f"""SELECT 'R1' AS rule_id, ip, NULL::VARCHAR AS usr, NULL::VARCHAR AS technique, min(us) AS first_us, max(us) AS last_us,
    count(*) AS n, count(*) || ' failed SSH logins from ' || ip || ' against ' || count(DISTINCT usr) || ' account(s) in '
    || {_minutes('min(us)', 'max(us)')} || ' min (threshold: {C.r1_threshold} in {C.r1_window // 60_000_000} min)' AS reason,
    arg_min(id, (us, line_no)) AS first_id, NULL::BIGINT AS tie_us, NULL::BIGINT AS tie_line, sess AS burst FROM r1_rows GROUP BY ip, sess""")
_cte("r2_rows", _bursts("fails", "ip", C.r2_window, C.r2_distinct_users, "usr"))
_cte("r2", f"""SELECT 'R2', ip, NULL::VARCHAR, NULL::VARCHAR, min(us) AS first_us, max(us), count(*), ip || ' failed logins for ' || count(DISTINCT usr)
    || ' distinct usernames (' || array_to_string(list_sort(list(DISTINCT usr))[1:8], ', ') || CASE WHEN count(DISTINCT usr) > 8 THEN '…' ELSE '' END
    || ') with ' || count(*) || ' attempts in ' || {_minutes('min(us)', 'max(us)')} || ' min', arg_min(id, (us, line_no)), NULL::BIGINT, NULL::BIGINT,
    sess AS burst FROM r2_rows GROUP BY ip, sess""")
_cte("typos", f"""SELECT f.id, min(s.us) AS next_us FROM fails f LEFT JOIN (SELECT * FROM sec WHERE type = 'ssh_success' AND ip IS NOT NULL) s
    ON s.ip = f.ip AND s.usr IS NOT DISTINCT FROM f.usr AND s.us BETWEEN f.us AND f.us + {C.r3_typo_window} GROUP BY f.id""")
_cte("quiet", """SELECT f.*, regexp_replace(f.ip, '[0-9]+$', '0/24') AS subnet FROM fails f JOIN typos t ON t.id = f.id
    WHERE t.next_us IS NULL AND f.ip NOT IN (SELECT ip FROM r1)""")
_cte("r3_rows", _bursts("quiet", "subnet", C.r3_window, C.r3_threshold))
_cte("r3", f"""SELECT 'R3', ip, NULL::VARCHAR, NULL::VARCHAR, first_us, last_us, n, ip || ' is one of ' || n_ips || ' IP(s) in ' || subnet
    || ' that together made ' || n_all || ' failed SSH logins over ' || printf('%.1f', round_even((hi - lo) / {float(HOUR)}, 1)) || ' h (' || n
    || ' from this IP) – below the per-IP brute-force threshold', first_id, NULL::BIGINT, NULL::BIGINT, burst FROM (
      SELECT *, count(*) OVER w AS n_ips, CAST(sum(n) OVER w AS BIGINT) AS n_all, min(first_us) OVER w AS lo, max(last_us) OVER w AS hi FROM (
        SELECT subnet, sess AS burst, ip, min(us) AS first_us, max(us) AS last_us, count(*) AS n, arg_min(id, (us, line_no)) AS first_id
        FROM r3_rows GROUP BY ALL) WINDOW w AS (PARTITION BY subnet, burst))""")
_cte("logins", "SELECT * FROM sec WHERE type = 'ssh_success' AND ip IS NOT NULL")
_cte("r4_rows", f"""SELECT l.id AS login_id, l.us AS login_us, l.line_no AS login_line, l.ip, l.usr, f.id, f.us, f.line_no FROM logins l
    JOIN fails f ON f.ip = l.ip AND f.us BETWEEN l.us - {C.r4_lookback} AND l.us""")
_cte("r4", f"""SELECT 'R4', ip, usr, NULL::VARCHAR, min(us) AS first_us, login_us AS last_us, count(*) + 1, 'Successful login as ' || usr || ' from ' || ip
    || ' after ' || count(*) || ' failed logins from that IP in the previous {C.r4_lookback // 60_000_000} min',
    arg_min(id, (us, line_no)), login_us, login_line, NULL::BIGINT, login_id FROM r4_rows
    GROUP BY login_id, login_us, login_line, ip, usr HAVING count(*) >= {C.r4_fail_threshold}""")
_cte("cutoff", f"SELECT min(us) + CAST(round_even((max(us) - min(us)) * {C.baseline_fraction}, 0) AS BIGINT) AS c FROM logins")
_cte("base", """SELECT usr, count(*) AS n, min(us // 3600000000 % 24) AS lo, max(us // 3600000000 % 24) AS hi,
    array_to_string(list_sort(list(DISTINCT us // 3600000000 % 24)), ',') AS hours, array_to_string(list_sort(list(DISTINCT ip)), '|') AS ips,
    array_to_string(list_sort(list(DISTINCT ip)), ', ') AS known FROM logins WHERE us <= (SELECT c FROM cutoff) GROUP BY usr""")
_cte("normal", """SELECT usr, h FROM base, range(24) t(h) WHERE h BETWEEN 8 AND 19 OR h BETWEEN lo - 1 AND hi + 1 OR (lo = 0 AND h = 23)
    OR (hi = 23 AND h = 0)""")
_cte("judged", f"""SELECT l.*, b.n AS n_base, b.known FROM logins l JOIN base b USING (usr) WHERE l.us > (SELECT c FROM cutoff)
    AND b.n >= {C.baseline_min_logins}""")
_cte("r5", """SELECT 'R5', ip, usr, NULL::VARCHAR, us AS first_us, us AS last_us, 1, usr || ' logged in at ' || strftime(make_timestamp(us), '%H:%M')
    || ' UTC, outside their normal hours (' || printf('%02d:00–%02d:00', (SELECT min(h) FROM normal n WHERE n.usr = j.usr),
       (SELECT max(h) + 1 FROM normal n WHERE n.usr = j.usr)) || ', learned from ' || n_base || ' baseline logins)', id, NULL::BIGINT, NULL::BIGINT,
    NULL::BIGINT, id AS login_id, line_no FROM judged j WHERE NOT EXISTS (SELECT 1 FROM normal n WHERE n.usr = j.usr AND n.h = j.us // 3600000000 % 24)""")
_cte("r6", """SELECT 'R6', ip, usr, NULL::VARCHAR, us AS first_us, us AS last_us, 1, usr || ' logged in from ' || ip
    || ', never seen for this user in the baseline (known: ' || known || ')', id, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, id AS login_id, line_no
    FROM judged j WHERE NOT EXISTS (SELECT 1 FROM logins b WHERE b.usr = j.usr AND b.ip = j.ip AND b.us <= (SELECT c FROM cutoff))""")
_cte("sessions", """SELECT login_id, usr, ip, login_us, login_line, min(seen_by) AS seen_by FROM (
    SELECT login_id, usr, ip, login_us, login_line, 4 AS seen_by FROM (SELECT * FROM r4_rows WHERE login_id IN (SELECT login_id FROM r4))
    UNION ALL SELECT login_id, usr, ip, last_us, line_no, 5 FROM r5 UNION ALL SELECT login_id, usr, ip, last_us, line_no, 6 FROM r6) GROUP BY ALL""")
_cte("r7_rows", f"""SELECT l.*, s.id, s.us, s.line_no FROM sessions l JOIN sec s ON s.type = 'sudo' AND s.usr = l.usr
    AND s.us BETWEEN l.login_us AND l.login_us + {C.r7_window}""")
_cte("r7", f"""SELECT 'R7', ip, usr, NULL::VARCHAR, min(us) AS first_us, max(us) AS last_us, count(*), usr || ' used sudo/su ' || count(*)
    || ' time(s), first ' || {_minutes('login_us', 'min(us)')} || ' min after a suspicious login from ' || coalesce(ip, 'unknown IP'),
    arg_min(id, (us, line_no)), login_us AS tie_us, login_line AS tie_line, NULL::BIGINT, login_id, seen_by FROM r7_rows
    GROUP BY login_id, login_us, login_line, seen_by, ip, usr""")
_cte("r8", f"""SELECT 'R8', sip, usr, CASE WHEN type = 'user_add' THEN 'T1136.001' ELSE 'T1098' END, us AS first_us, us AS last_us, 1,
    CASE WHEN type = 'user_add' THEN 'New account created' ELSE 'Account added to sudo/wheel group' END || ': ' || usr
    || CASE WHEN susr IS NULL THEN '' ELSE ', ' || {_minutes('root_us', 'us')} || ' min after ' || susr || ' gained root from ' || coalesce(sip, 'unknown IP') END,
    id, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (
      SELECT e.*, s.ip AS sip, s.usr AS susr, s.first_us AS root_us,
             row_number() OVER (PARTITION BY e.id ORDER BY s.tie_us DESC NULLS LAST, s.seen_by DESC, s.tie_line DESC) AS rn
      FROM sec e LEFT JOIN r7 s ON s.first_us BETWEEN e.us - {C.r7_window} AND e.us WHERE e.type IN ('user_add', 'group_add')) WHERE rn = 1""")
_cte("web", "SELECT *, nullif(lower(regexp_extract(ua, '(?i)(sqlmap|nikto|gobuster|dirbuster|nmap)', 1)), '') AS tool, "
     f"{DECODED.format('path')} AS decoded FROM sec WHERE type = 'http_request'")
_cte("not_found", "SELECT * FROM web WHERE status = 404 AND ip IS NOT NULL")
_cte("flood", _bursts("not_found", "ip", C.r9_window, C.r9_threshold))
_cte("r9_rows", """SELECT w.*, w.id IN (SELECT id FROM flood) AS in_flood FROM web w WHERE ip IS NOT NULL AND (tool IS NOT NULL OR w.id IN (SELECT id FROM flood))""")
_cte("r9", f"""SELECT 'R9', ip, NULL::VARCHAR, NULL::VARCHAR, min(us) AS first_us, max(us) AS last_us, count(*), ip || ': ' || concat_ws('; ',
    CASE WHEN count(*) FILTER (in_flood) > 0 THEN count(*) FILTER (in_flood) || ' HTTP 404 responses in '
         || {_minutes('min(us) FILTER (in_flood)', 'max(us) FILTER (in_flood)')} || ' min' END,
    CASE WHEN count(tool) > 0 THEN 'scanner user-agent (' || array_to_string(list_sort(list(DISTINCT tool)), ', ') || ') on ' || count(tool) || ' request(s)' END),
    arg_min(id, (us, id)), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM r9_rows GROUP BY ip""")
_cte("hits", f"SELECT * FROM (SELECT *, {LABEL} AS label FROM web) WHERE label IS NOT NULL")
_cte("r10", """SELECT 'R10', ip, NULL::VARCHAR, NULL::VARCHAR, min(us) AS first_us, max(us) AS last_us, count(*), 'Matched signature: ' || label || ' in '
    || count(*) || ' request(s) from ' || coalesce(ip, 'None') || '; e.g. decoded request: ' || substring(arg_min(decoded, (us, line_no)), 1, 200),
    arg_min(id, (us, line_no)), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, label FROM hits GROUP BY ip, label""")
_cte("sent", """SELECT *, CAST(sum(bytes) OVER (PARTITION BY ip ORDER BY us, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM web
    WHERE ip IS NOT NULL AND bytes != 0""")
_cte("median", f"""SELECT m, least({C.r11_abs_bytes}, greatest({C.r11_median_multiplier} * m, {C.r11_min_bytes})) AS t
    FROM (SELECT median(total) AS m FROM (SELECT sum(bytes)::BIGINT AS total FROM sent GROUP BY ip))""")
_cte("starts", f"""SELECT ip, us, arg_min(line_no, line_no) AS line_no, arg_min(id, line_no) AS id FROM (
    SELECT j.ip, j.line_no AS j, arg_max(i.us, i.upto) AS us, arg_max(i.line_no, i.upto) AS line_no, arg_max(i.id, i.upto) AS id
    FROM sent j JOIN sent i ON i.ip = j.ip AND i.upto <= j.upto AND j.us - i.us <= {C.r11_window}
    WHERE j.upto - i.upto + i.bytes > (SELECT t FROM median) GROUP BY j.ip, j.line_no) GROUP BY ip, us""")
_cte("picked", f"""SELECT ip, min(us) AS us FROM starts GROUP BY ip
    UNION ALL SELECT p.ip, min(s.us) FROM picked p JOIN starts s ON s.ip = p.ip AND s.us > p.us + {C.r11_window} GROUP BY p.ip""")
_cte("r11_rows", f"""SELECT s.id AS start_id, e.* FROM picked p JOIN starts s USING (ip, us) JOIN sent e ON e.ip = p.ip
    AND (e.us > s.us OR (e.us = s.us AND e.line_no >= s.line_no)) AND e.us <= s.us + {C.r11_window}""")
_cte("r11", f"""SELECT 'R11', ip, NULL::VARCHAR, NULL::VARCHAR, min(us) AS first_us, max(us) AS last_us, count(*),
    'Possible data exfiltration indicated by unusually large HTTP response volume: ' || printf('%.1f', round_even(sum(bytes) / 1e6, 1)) || ' MB sent to ' || ip
    || ' in ' || count(*) || ' response(s) within {C.r11_window // 60_000_000} min (median per-IP total: '
    || printf('%.2f', round_even((SELECT m FROM median) / 1e6, 2)) || ' MB)', start_id, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT
    FROM r11_rows GROUP BY ip, start_id""")
_cte("rule_dim", "SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', {i}, '{n}', '{sv}', {p}, '{st}', '{ta}', '{te}')" for i, (r, n, sv, p, st, ta, te) in enumerate(RULES))
    + ") t(rule_id, rule_order, rule_name, severity, points, stage, tactic, default_technique)")
COLS = "rule_id, ip, usr, technique, first_us, last_us, n, reason, first_id, tie_us, tie_line"
_cte("found(" + COLS + ")", " UNION ALL ".join(
    f"SELECT {sql} FROM (SELECT * FROM {r}) t(rule_id, ip, usr, technique, first_us, last_us, n, reason, first_id, tie_us, tie_line{rest})".format()
    for r, sql, rest in [(f"r{i}", COLS, {1: ", a", 2: ", a", 3: ", a", 4: ", a, b", 5: ", a, b, c", 6: ", a, b, c", 7: ", a, b, c", 8: ", a",
                                            9: ", a", 10: ", a, b", 11: ", a"}[i]) for i in range(1, 12)]))
_cte("alerts0", """SELECT f.* EXCLUDE (technique), coalesce(technique, default_technique) AS technique, d.* EXCLUDE (rule_id, default_technique),
    row_number() OVER (ORDER BY first_us, rule_order, coalesce(ip, ''), coalesce(usr, ''), first_id, tie_us, tie_line) AS no
    FROM found f JOIN rule_dim d USING (rule_id)""")
_cte("members", """SELECT no, 'ip' AS kind, ip AS value, first_us, last_us FROM alerts0 WHERE coalesce(ip, '') != ''
    UNION ALL SELECT no, 'user', usr, first_us, last_us FROM alerts0 WHERE coalesce(usr, '') != ''
    UNION ALL SELECT no, 'subnet', regexp_replace(ip, '[0-9]+$', '0/24'), first_us, last_us FROM alerts0 WHERE rule_id = 'R3'""")
_cte("clusters", f"""SELECT *, max(CASE WHEN reach IS NULL OR first_us - reach > {C.correlation_window} THEN first_us END) OVER (
        PARTITION BY kind, value ORDER BY first_us, no ROWS UNBOUNDED PRECEDING) AS head FROM (
    SELECT *, max(last_us) OVER (PARTITION BY kind, value ORDER BY first_us, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM members)""")
_cte("first_login", "SELECT ip, usr, min(us) AS login_us FROM sec WHERE type = 'ssh_success' GROUP BY ip, usr")
_cte("pivots", f"""SELECT u.no AS u_no, x.no AS x_no, u.value AS usr, u.head AS u_head, x.value AS ip, x.head AS x_head FROM first_login l
    JOIN clusters u ON u.kind = 'user' AND u.value = l.usr AND u.first_us >= l.login_us JOIN clusters x ON x.kind = 'ip' AND x.value = l.ip
    WHERE greatest(0, u.first_us - x.last_us, x.first_us - u.last_us) <= {C.correlation_window}""")
_cte("edges", """SELECT DISTINCT a, b FROM (SELECT a.no AS a, b.no AS b FROM (SELECT kind, value, head, min(no) AS no FROM clusters GROUP BY ALL) a
    JOIN clusters b USING (kind, value, head) UNION ALL SELECT u_no, x_no FROM pivots) WHERE a != b""")
_cte("both_ways", "SELECT a, b FROM edges UNION SELECT b, a FROM edges")
_cte("reach", "SELECT no AS a, no AS b FROM alerts0 UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b")
_cte("comp", "SELECT a AS no, min(b) AS component FROM reach GROUP BY a")


def _score(src: str, keys: str) -> str:
    return f"""SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END AS level
      FROM (SELECT {keys}, least(100, CAST(round_even(CAST(sum(points * least(n, {C.rule_repeat_cap})) AS DOUBLE) * CASE WHEN count(DISTINCT stage) >= 3 THEN 1.6::DOUBLE
              WHEN count(DISTINCT stage) = 2 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END, 0) AS BIGINT)) AS risk_score, CAST(sum(n) AS BIGINT) AS alert_count,
            min(first_us) AS first_us, max(last_us) AS last_us FROM (
              SELECT {keys}, rule_id, stage, points, count(*) AS n, min(first_us) AS first_us, max(last_us) AS last_us FROM {src} GROUP BY ALL) GROUP BY {keys})"""


_cte("ent_rows", """SELECT 'ip' AS type, ip AS value, * FROM alerts0 WHERE coalesce(ip, '') != '' UNION ALL
    SELECT 'user', usr, * FROM alerts0 WHERE coalesce(usr, '') != ''""")
_cte("ents", _score("ent_rows", "type, value"))
_cte("placed0", "SELECT a.*, c.component FROM alerts0 a JOIN comp c USING (no)")
_cte("incs", f"""SELECT s.*, 'a' || s.component AS first_alert_id, 'inc-' || row_number() OVER (ORDER BY risk_score DESC, first_us, 'a' || s.component) AS incident_id,
    row_number() OVER (ORDER BY risk_score DESC, first_us, 'a' || s.component) AS incident_no, x.stages, x.rules, x.ips, x.users
    FROM ({_score('placed0', 'component')}) s JOIN (
      SELECT component, list_filter({_list(STAGES)}, lambda s: list_contains(list(DISTINCT stage), s)) AS stages, list(DISTINCT rule_id) AS rules,
             list_sort(coalesce(list(DISTINCT ip) FILTER (coalesce(ip, '') != ''), [])) AS ips,
             list_sort(coalesce(list(DISTINCT usr) FILTER (coalesce(usr, '') != ''), [])) AS users FROM placed0 GROUP BY component) x USING (component)""")
_cte("alerts", f"""SELECT p.*, i.incident_id, CASE WHEN rule_id IN ('R4', 'R5', 'R6') THEN p.last_us ELSE p.first_us END AS moment,
    list_position({_list(STAGES)}, stage) AS stage_order FROM placed0 p JOIN incs i USING (component)""")
_cte("steps", """SELECT *, CAST(sum(new) OVER (PARTITION BY incident_id ORDER BY moment, stage_order, no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step_no FROM (
    SELECT *, CASE WHEN lag(rule_id) OVER (PARTITION BY incident_id ORDER BY moment, stage_order, no) = rule_id THEN 0 ELSE 1 END AS new FROM alerts)""")
_cte("evidence", """SELECT DISTINCT no, e.id, e.us, e.line_no FROM (
    SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN r1_rows r ON a.rule_id = 'R1' AND r.ip = a.ip AND r.us BETWEEN a.first_us AND a.last_us
    UNION ALL SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN r2_rows r ON a.rule_id = 'R2' AND r.ip = a.ip AND r.us BETWEEN a.first_us AND a.last_us
    UNION ALL SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN r3_rows r ON a.rule_id = 'R3' AND r.ip = a.ip AND r.us BETWEEN a.first_us AND a.last_us
    UNION ALL SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN r4_rows r ON a.rule_id = 'R4' AND r.login_us = a.tie_us AND r.login_line = a.tie_line
    UNION ALL SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN sec r ON a.rule_id = 'R4' AND r.line_no = a.tie_line
    UNION ALL SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN sec r ON a.rule_id IN ('R5', 'R6', 'R8') AND r.id = a.first_id
    UNION ALL SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN r7_rows r ON a.rule_id = 'R7' AND r.login_us = a.tie_us AND r.login_line = a.tie_line
    UNION ALL SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN r9_rows r ON a.rule_id = 'R9' AND r.ip = a.ip
    UNION ALL SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN hits r ON a.rule_id = 'R10' AND r.ip IS NOT DISTINCT FROM a.ip
         AND a.reason LIKE 'Matched signature: ' || r.label || ' in %'
    UNION ALL SELECT a.no, r.id, r.us, r.line_no FROM alerts a JOIN r11_rows r ON a.rule_id = 'R11' AND r.start_id = a.first_id) e""")
_cte("truth", """SELECT DISTINCT 'S' || ((user_id // 10) % 5 + 1) AS sid, 'user' || user_id AS usr, '10.' || ((user_id // 4 // 65536) % 256) || '.'
    || ((user_id // 16) % 256) || '.' || ((user_id // 4) % 4 + 1) AS ip FROM events WHERE user_id % 10 = 0""")
_cte("bad", "SELECT usr AS value FROM truth UNION SELECT ip FROM truth")
_cte("wanted", "SELECT sid, usr AS value FROM truth UNION SELECT sid, ip FROM truth")
_cte("inc_ents", "SELECT incident_id, incident_no, risk_score, level, stages, unnest(list_concat(ips, users)) AS value FROM incs")
_cte("flagged", f"SELECT DISTINCT value FROM inc_ents WHERE risk_score >= {C.evaluation_min_risk}")
_cte("lines_auth", f"""SELECT event_id, 'auth' || (event_id % 3) || '.log' AS file, event_id // 3 + 1 AS line_no, event_id % 13 != 0 AS parsed,
    CAST({START_2026} + event_id * {STEP} AS BIGINT) AS us, CASE event_type WHEN 'error' THEN 'ssh_fail' WHEN 'signup' THEN 'ssh_success' WHEN 'view' THEN 'invalid_user'
        WHEN 'click' THEN NULL ELSE CASE WHEN k % 4 = 0 OR k % 4 = 1 THEN 'sudo' WHEN k % 4 = 2 THEN 'user_add' WHEN k % 8 = 3 THEN NULL ELSE 'group_add' END END AS typ,
    CASE WHEN event_type IN ('error', 'signup', 'view') THEN '10.1.0.' || (user_id % 250) END AS ip,
    CASE WHEN event_type = 'error' AND k % 20 = 3 THEN NULL ELSE 'user' || user_id END AS usr
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
_cte("lines_access", """SELECT event_id, 'access.log' AS file, event_id + 1 AS line_no, event_id % 13 != 0 AND event_id % 17 != 0 AS parsed,
    epoch_us(ts) // 1000000 * 1000000 AS us, '10.2.' || (user_id // 250) || '.' || (user_id % 250) AS ip, '/p' || k || '?q=a b' AS path,
    CASE WHEN k % 3 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN k % 7 = 0 THEN 0 ELSE event_id * 10 END AS bytes,
    CASE WHEN k % 5 = 0 THEN NULL ELSE 'agent/' || k END AS ua FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
_cte("lines_json", """SELECT event_id, 'app.jsonl' AS file, event_id + 1 AS line_no, event_id % 13 != 0 AND NOT (event_id % 4 = 3 AND event_id % 11 = 0) AS parsed,
    CASE m WHEN 0 THEN us WHEN 1 THEN us // 1000 * 1000 WHEN 2 THEN us // 1000000 * 1000000 ELSE us - 19800000000 END AS us,
    CASE m WHEN 0 THEN 'ssh_fail' WHEN 1 THEN 'ssh_success' WHEN 2 THEN 'http_request' ELSE 'sudo' END AS typ,
    CASE m WHEN 0 THEN '10.3.0.' || (user_id % 250) WHEN 2 THEN CASE WHEN user_id % 10 = 0 THEN '2001:db8::' ELSE '2001:db8::' || (user_id % 10) END END AS ip,
    CASE m WHEN 0 THEN 'user' || user_id WHEN 1 THEN '' || user_id WHEN 3 THEN 'user' || user_id END AS usr, CASE WHEN m = 0 THEN 'h' || k END AS host,
    CASE WHEN m = 2 THEN '/u' || k END AS path, CASE WHEN m = 2 AND k % 9 != 0 THEN 404 END AS status, CASE WHEN m = 2 THEN k END AS bytes,
    CASE WHEN m = 2 THEN 'agent' || k END AS ua
    FROM (SELECT *, epoch_us(ts) AS us, event_id % 4 AS m, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
_cte("parsed", """SELECT file, line_no, parsed, us, CASE WHEN parsed THEN typ END AS typ FROM lines_auth
    UNION ALL SELECT file, line_no, parsed, us, CASE WHEN parsed THEN 'http_request' END FROM lines_access
    UNION ALL SELECT file, line_no, parsed, us, CASE WHEN parsed THEN typ END FROM lines_json
    UNION ALL SELECT 'notes.txt', doc_id + 1, false, NULL, NULL FROM documents""")
_cte("runs", "SELECT 'run-' || CAST(ts AS DATE) AS analysis_id, max(ts) AS created_at, count(*) AS events FROM events GROUP BY 1")

PLAIN = {"reach", "picked"}


def sql(select: str) -> str:
    """The definitions a query needs, found through the names it mentions, followed by the query."""
    needed, text = [], select
    for name, body in reversed(CTES):
        bare = name.split("(")[0]
        if _mentions(text, bare):
            needed.append(f"{name} AS {'' if bare in PLAIN else 'MATERIALIZED '}({body})")
            text += " " + body
    return ("WITH RECURSIVE " + ",\n".join(reversed(needed)) + "\n" if needed else "") + select


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"(FROM|JOIN|,)\s+\(?{name}\b", text) is not None


def _rule(name: str, extra: int) -> str:
    names = "rule_id, ip, usr, technique, first_us, last_us, n, reason, first_id" + "".join(f", x{i}" for i in range(extra))
    return sql(f"""SELECT rule_id, ip AS src_ip, usr AS "user", technique, make_timestamp(first_us) AS first_seen, make_timestamp(last_us) AS last_seen,
        CAST(n AS BIGINT) AS count, reason, first_id FROM (SELECT * FROM {name}) t({names})""")


def _score_out(src: str, keys: str) -> str:
    return f"SELECT {keys}, risk_score, level, alert_count, make_timestamp(first_us) AS first_seen, make_timestamp(last_us) AS last_seen FROM {src}"


def _title(part: int) -> str:
    def held(stages):
        return " AND ".join(f"list_contains(stages, '{s}')" for s in stages)
    base = "CASE " + " ".join(f"WHEN {held(st)} THEN '{t}'" for st, t, _ in TITLES) + f" ELSE '{DEFAULT_TITLE[0]}' END"
    plain = "CASE " + " ".join("WHEN {} THEN '{}'".format(held(st), (t, a)[part].replace("'", "''")) for st, t, a in TITLES) + f" ELSE '{DEFAULT_TITLE[part]}' END"
    sharp = " ".join(f"WHEN {base} = '{t}' AND list_contains(rules, '{r}') THEN '{(a, b)[part]}'" for t, r, a, b in SHARPER)
    return f"CASE {sharp} ELSE {plain} END"


def _english(items: str) -> str:
    return (f"CASE WHEN len({items}) = 0 THEN '' WHEN len({items}) = 1 THEN {items}[1] "
            f"ELSE array_to_string({items}[1:-2], ', ') || ' and ' || {items}[-1] END")


SUBNET = "regexp_replace(ip, '[0-9]+$', '0/24')"
ADVICE = f"""CASE rule_id WHEN 'R1' THEN 'Block ' || ip || ' at the firewall' WHEN 'R2' THEN 'Block ' || ip || ' and enforce MFA / account lockout for SSH'
    WHEN 'R3' THEN 'Block ' || {SUBNET} || ' and alert on slow, distributed failures' WHEN 'R4' THEN 'Disable ' || usr || ' and rotate its credentials'
    WHEN 'R5' THEN 'Confirm with ' || usr || ' whether the off-hours login was theirs' WHEN 'R6' THEN 'Verify the new source IP ' || ip || ' for ' || usr
    WHEN 'R7' THEN 'Audit every command ' || usr || ' ran as root' WHEN 'R8' THEN 'Disable and investigate account ' || usr
    WHEN 'R9' THEN 'Block ' || ip || ' at the web firewall'
    WHEN 'R10' THEN 'Review application logs for requests from ' || coalesce(ip, 'None') || ' and patch the targeted endpoint'
    ELSE 'Find out what ' || ip || ' downloaded and whether it contained sensitive data' END"""
WHO = (f"list_filter([CASE WHEN len(ips) > 0 THEN 'IP(s) ' || array_to_string(ips, ', ') ELSE '' END, "
       f"CASE WHEN len(users) > 0 THEN 'account(s) ' || array_to_string(users, ', ') ELSE '' END], lambda w: w != '')")
SUMMARY = (f"'Assessment: ' || {_title(1)} || '. ' || alert_count || ' alert(s) across ' || len(stages) || ' kill-chain stage(s) involving ' || {_english(WHO)} || '.'")
SPAN = ("CASE WHEN strftime(make_timestamp(f), '%H:%M') = strftime(make_timestamp(l), '%H:%M') THEN 'At ' || strftime(make_timestamp(f), '%H:%M') || ' UTC' "
        "ELSE 'Between ' || strftime(make_timestamp(f), '%H:%M') || ' and ' || strftime(make_timestamp(l), '%H:%M') || ' UTC' END || ', '")
STORY = f"""SELECT incident_id, step_no, make_timestamp(moment) AS ts, stage, CASE rule_id
    WHEN 'R1' THEN {SPAN} || 'IP ' || ips || ' made ' || total || ' failed SSH logins against ' || regexp_extract(reason, 'against (\\d+) account', 1) || ' account(s) ' || m || '.'
    WHEN 'R2' THEN {SPAN} || 'IP ' || ips || ' tried ' || total || ' logins across ' || regexp_extract(reason, 'for (\\d+) distinct', 1)
        || ' different accounts – a password-spraying pattern that stays under per-account lockouts ' || m || '.'
    WHEN 'R3' THEN {SPAN} || k || ' IP(s) in ' || {SUBNET} || ' (' || ips || ') made ' || total
        || ' failed SSH logins slowly enough that no single IP crosses the brute-force threshold – a low-and-slow attack ' || m || '.'
    WHEN 'R4' THEN 'At ' || strftime(make_timestamp(l0), '%H:%M') || ' UTC, ' || ips || ' logged in successfully as ' || users || ' right after ' || (total - k)
        || ' failed attempts – the password was likely guessed ' || m || '.'
    WHEN 'R5' THEN reason || ' ' || m || '.'
    WHEN 'R6' THEN 'At ' || strftime(make_timestamp(l0), '%H:%M') || ' UTC, ' || users || ' logged in from ' || ips || ', an address never seen for this account in the baseline ' || m || '.'
    WHEN 'R7' THEN 'At ' || strftime(make_timestamp(f), '%H:%M') || ' UTC, ' || users || ' ran sudo/su as root ' || regexp_extract(reason, 'first (\\d+) min', 1)
        || ' min after the suspicious login ' || m || '.'
    WHEN 'R8' THEN 'At ' || strftime(make_timestamp(f), '%H:%M') || ' UTC, ' || {_english("list_transform(reasons, lambda r: lower(r[1]) || r[2:])")}
        || ' – a likely backdoor for persistence ' || m || '.'
    WHEN 'R9' THEN {SPAN} || ips || ' probed the web server for hidden pages: ' || array_to_string(list_transform(reasons, lambda r: regexp_replace(r, '^.*?: ', '')), '; ') || ' ' || m || '.'
    WHEN 'R10' THEN {SPAN} || ips || ' sent requests containing attack payloads ' || m || '. ' || array_to_string(list_transform(reasons, lambda r: r || '.'), ' ')
        || ' This is a matched signature, not a confirmed exploit.'
    ELSE {SPAN} || 'possible data exfiltration indicated by unusually large HTTP response volume: ' || regexp_replace(reason, '^.*?: ', '')
        || ' (Exfiltration (possible), ' || technique || ').' END AS text, alert_id FROM (
  SELECT *, CASE WHEN len(ipl) = 0 THEN 'an unknown IP' ELSE {_english('ipl')} END AS ips, {_english('usl')} AS users, '(' || stage || ', ' || technique || ')' AS m FROM (
    SELECT incident_id, step_no, rule_id, min(moment) AS moment, first(stage ORDER BY moment, stage_order, no) AS stage, first(ip ORDER BY moment, stage_order, no) AS ip,
      first(technique ORDER BY moment, stage_order, no) AS technique, first(reason ORDER BY moment, stage_order, no) AS reason,
      'a' || first(no ORDER BY moment, stage_order, no) AS alert_id, first(first_us ORDER BY moment, stage_order, no) AS f, last(last_us ORDER BY moment, stage_order, no) AS l,
      first(last_us ORDER BY moment, stage_order, no) AS l0, count(*) AS k, CAST(sum(n) AS BIGINT) AS total, list(reason ORDER BY moment, stage_order, no) AS reasons,
      list_sort(coalesce(list(DISTINCT ip) FILTER (coalesce(ip, '') != ''), [])) AS ipl, list_sort(coalesce(list(DISTINCT usr) FILTER (coalesce(usr, '') != ''), [])) AS usl
    FROM steps GROUP BY incident_id, step_no, rule_id))"""

ADVISED = f"""SELECT incident_id, advice, moment, stage_order, no FROM (SELECT *, {ADVICE} AS advice FROM alerts)
          QUALIFY row_number() OVER (PARTITION BY incident_id, advice ORDER BY moment, stage_order, no) = 1"""
ADVICES = f"SELECT incident_id, string_agg(advice, '. ' ORDER BY moment, stage_order, no) || '.' AS recommendation FROM ({ADVISED}) GROUP BY incident_id"
SHOWN = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY us, line_no) AS place,
        count(*) OVER (PARTITION BY no) AS total FROM evidence) WHERE total <= 20 OR place <= 15 OR place > total - 5"""


def _iso(us: str) -> str:
    return (f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN '' "
            f"ELSE strftime(make_timestamp({us}), '.%f') END || 'Z'")


def _spoken(us: str) -> str:
    return f"replace(replace({_iso(us)}, 'T', ' '), 'Z', ' UTC')"


def _or_dash(values: str) -> str:
    return f"CASE WHEN len({values}) > 0 THEN array_to_string({values}, ', ') ELSE '-' END"


_CODES = "CASE trim(lower(code)) " + " ".join(f"WHEN '{a}' THEN '{t}'" for t, aliases in EVENT_NAMES.items() for a in aliases) + " END"
_ADDR = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN CASE WHEN user_id % 300 < 256 THEN '10.0.0.' || (user_id % 300) END WHEN 1 THEN '192.168.1.' || (user_id % 256)
    WHEN 3 THEN '2001:db8::' || CASE WHEN user_id % 4096 = 0 THEN '' ELSE lower(to_hex(user_id % 4096)) END WHEN 4 THEN 'fe80::1:' || (user_id % 10)
    WHEN 6 THEN '::ffff:10.0.0.' || (user_id % 256) END AS ip FROM events"""
_LINE = """file, line_no, parsed, CASE WHEN parsed THEN make_timestamp(us) END AS ts"""
_NULL = "NULL::VARCHAR"

ORACLES: dict[str, str] = {
    "S1_numbered_lines": f"""SELECT * FROM (SELECT 'doc' || doc_id AS file, CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS line_no,
        length(trim(replace(unnest(parts), chr(0), ''), '{SPACES}')) AS n_chars FROM (
          SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS parts FROM documents)) WHERE n_chars > 0""",
    "S2_multi_file_union": sql("""SELECT file, CASE WHEN typ = 'http_request' THEN 'web' ELSE 'auth' END AS source, typ AS type, count(*) AS events,
        make_timestamp(min(us)) AS first_ts, make_timestamp(max(us)) AS last_ts FROM parsed WHERE typ IS NOT NULL GROUP BY ALL"""),
    "S3_unique_names": """SELECT position, CASE WHEN n = 1 THEN base WHEN base IN ('auth.log', 'access.log') THEN replace(base, '.log', '') || '_' || n || '.log'
        ELSE base || '_' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY position) AS n FROM (SELECT event_id AS position,
        CASE user_id % 4 WHEN 0 THEN 'auth.log' WHEN 1 THEN 'access.log' WHEN 2 THEN '.profile' ELSE 'noext' END AS base FROM events))""",
    "S4_format_detection": "SELECT * FROM (VALUES ('auth0.log', 'auth'), ('auth1.log', 'auth'), ('auth2.log', 'auth'), ('access.log', 'access'), "
                           "('app.jsonl', 'jsonl'), ('notes.txt', NULL)) t(file, format)",
    "S5_auth_lines": sql(f"""SELECT {_LINE}, CASE WHEN parsed AND typ IS NOT NULL THEN 'auth' END AS source, CASE WHEN parsed THEN typ END AS type,
        CASE WHEN parsed AND typ IS NOT NULL THEN ip END AS src_ip, CASE WHEN parsed AND typ IS NOT NULL THEN usr END AS "user", CASE WHEN parsed THEN 'web01' END AS host, {_NULL} AS method, {_NULL} AS path,
        NULL::BIGINT AS status, NULL::BIGINT AS bytes, {_NULL} AS ua FROM lines_auth"""),
    "S6_access_lines": sql(f"""SELECT {_LINE}, CASE WHEN parsed THEN 'web' END AS source, CASE WHEN parsed THEN 'http_request' END AS type,
        CASE WHEN parsed THEN ip END AS src_ip, {_NULL} AS "user", {_NULL} AS host, CASE WHEN parsed THEN 'GET' END AS method, CASE WHEN parsed THEN path END AS path,
        CAST(CASE WHEN parsed THEN status END AS BIGINT) AS status, CASE WHEN parsed THEN bytes END AS bytes, CASE WHEN parsed THEN ua END AS ua FROM lines_access"""),
    "S7_json_lines": sql(f"""SELECT {_LINE}, CASE WHEN parsed THEN CASE WHEN typ = 'http_request' THEN 'web' ELSE 'auth' END END AS source, CASE WHEN parsed THEN typ END AS type,
        CASE WHEN parsed THEN ip END AS src_ip, CASE WHEN parsed THEN usr END AS "user", CASE WHEN parsed THEN host END AS host, {_NULL} AS method,
        CASE WHEN parsed THEN path END AS path, CAST(CASE WHEN parsed THEN status END AS BIGINT) AS status, CAST(CASE WHEN parsed THEN bytes END AS BIGINT) AS bytes,
        CASE WHEN parsed THEN ua END AS ua FROM lines_json"""),
    "S8_auth_classification": sql("""SELECT typ AS type, usr AS "user", count(*) AS events FROM lines_auth WHERE parsed AND typ IS NOT NULL GROUP BY ALL"""),
    "S9_parse_accounting": sql("""SELECT file, count(*) AS lines_total, count(*) FILTER (parsed) AS parsed, count(*) FILTER (NOT parsed) AS skipped,
        count(typ) AS events FROM parsed GROUP BY file"""),
    "S10_binary_quarantine": """SELECT doc_id, doc_id % 10 IN (0, 1) AS is_binary, CASE WHEN doc_id % 10 = 2 THEN length(text) + 2 WHEN doc_id % 10 > 2 THEN length(text) END AS kept_chars
        FROM documents""",
    "S11_event_codes": f"""SELECT event_id, {_CODES} AS type, CASE WHEN {_CODES} = 'http_request' THEN 'web' WHEN {_CODES} IS NOT NULL THEN 'auth' END AS source
        FROM (SELECT event_id, ({_list(EVENT_CODES)})[event_id % {len(EVENT_CODES)} + 1] AS code FROM events)""",
    "S12_persist_run": sql("""SELECT 'events' AS table_name, count(*) AS rows_stored FROM sec UNION ALL SELECT 'alerts', count(*) FROM alerts
        UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'incidents', count(*) FROM incs
        UNION ALL SELECT 'incident_entities', count(*) FROM inc_ents UNION ALL SELECT 'entities', count(*) FROM ents
        UNION ALL SELECT 'story', count(*) FROM (SELECT DISTINCT incident_id, step_no FROM steps)"""),
    "S13_retention": sql("SELECT analysis_id, created_at FROM runs ORDER BY created_at DESC, analysis_id LIMIT 10"),
    "S14_delete_run": sql("SELECT analysis_id, events FROM runs WHERE analysis_id != 'run-2024-01-10'"),
    "S15_evidence_sample": sql(f"SELECT 'a' || no AS alert_id, id AS event_id, place, total FROM ({SHOWN})"),
    "S15_incident_json": sql(f"""SELECT incident_id, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS position, CAST(to_json({{'id': incident_id, 'title': {_title(0)}, 'risk_score': risk_score, 'level': level,
          'entities': {{'ips': ips, 'users': users}}, 'start': {_iso('first_us')}, 'end': {_iso('last_us')}, 'stages': stages, 'summary': {SUMMARY}, 'recommendation': recommendation}}) AS VARCHAR) AS json
          FROM incs JOIN ({ADVICES}) USING (incident_id)
        UNION ALL SELECT incident_id, 1, step_no, CAST(to_json({{'ts': {_iso('epoch_us(ts)')}, 'stage': stage, 'text': text, 'alert_id': alert_id}}) AS VARCHAR) FROM ({STORY})
        UNION ALL SELECT incident_id, 2, no, CAST(to_json({{'id': 'a' || no, 'rule_id': rule_id, 'rule_name': rule_name, 'severity': severity, 'points': CAST(points AS BIGINT), 'stage': stage,
            'mitre': {{'tactic': tactic, 'technique': technique}}, 'entity': {{'ip': ip, 'user': usr}}, 'first_seen': {_iso('first_us')}, 'last_seen': {_iso('last_us')}, 'count': CAST(n AS BIGINT),
            'reason': reason, 'evidence_total': total, 'evidence': evidence}}) AS VARCHAR) FROM alerts JOIN (
          SELECT no, total, list({{'id': id, 'file': 'events', 'line_no': line_no, 'raw': 'event ' || line_no || ' ' || event_type, 'ts': {_iso('us')}, 'type': type, 'src_ip': ip, 'user': usr}}
            ORDER BY place) AS evidence FROM ({SHOWN}) s JOIN (SELECT id, event_type, type, ip, usr FROM sec) USING (id) GROUP BY no, total) USING (no)"""),
    "S15_report_lines": sql(f"""SELECT incident_id, section, a, CAST(generate_subscripts(lines, 1) - 1 + b AS BIGINT) AS b, unnest(lines) AS text FROM (
        SELECT incident_id, 0 AS section, CAST(0 AS BIGINT) AS a, 0 AS b, ['# Incident ' || incident_id || ': ' || {_title(0)}, '', '- **Level:** ' || upper(level) || ' (risk ' || risk_score || '/100)',
            '- **Time span:** ' || {_spoken('first_us')} || ' → ' || {_spoken('last_us')}, '- **IPs:** ' || {_or_dash('ips')}, '- **Users:** ' || {_or_dash('users')},
            '- **Kill-chain stages:** ' || array_to_string(stages, ' → '), '- **Analysis:** run-1', '', '## Assessment', '', substr(({SUMMARY}), 13), '', '## Attack story', ''] AS lines FROM incs
        UNION ALL SELECT incident_id, 1, step_no, 0, [step_no || '. **' || {_spoken('epoch_us(ts)')} || '** [' || stage || '] ' || text] FROM ({STORY})
        UNION ALL SELECT incident_id, 2, 0, 0, ['', '## Recommended response', ''] FROM incs
        UNION ALL SELECT incident_id, 3, row_number() OVER (PARTITION BY incident_id ORDER BY moment, stage_order, no) - 1, 0, ['- ' || advice] FROM ({ADVISED})
        UNION ALL SELECT incident_id, 4, 0, 0, ['', '## Alerts and evidence', ''] FROM incs
        UNION ALL SELECT incident_id, 5, no * 4, 0, ['### a' || no || ' · ' || rule_id || ' ' || rule_name || ' (' || severity || ', ' || technique || ')', '', reason, '',
            'Evidence: ' || total || ' log line(s)' || CASE WHEN total > 20 THEN ', first 15 and last 5 shown' ELSE '' END, '', '```'] FROM alerts JOIN (
              SELECT no, count(*) AS total FROM evidence GROUP BY no) USING (no)
        UNION ALL SELECT incident_id, 5, no * 4 + 1, place, ['events:' || line_no || '  event ' || line_no || ' ' || event_type] FROM ({SHOWN}) s JOIN (SELECT id, event_type FROM sec) USING (id)
            JOIN (SELECT no, incident_id FROM alerts) USING (no)
        UNION ALL SELECT incident_id, 5, no * 4 + 1, 16, ['... ' || (total - 20) || ' more line(s) omitted ...'] FROM alerts JOIN (SELECT no, count(*) AS total FROM evidence GROUP BY no) USING (no) WHERE total > 20
        UNION ALL SELECT incident_id, 5, no * 4 + 2, 0, ['```', ''] FROM alerts
        UNION ALL SELECT incident_id, 6, 0, 0, ['_Each alert above comes from a fixed rule and cites the lines it rests on. Look into payload and transfer alerts before treating them as a break-in._'] FROM incs)"""),
    "S16_ground_truth": sql("SELECT 'all' AS scenario_id, value FROM bad UNION ALL SELECT sid, value FROM wanted"),
    "F1_clean_ip": f"SELECT event_id, ip FROM ({_ADDR})",
    "F2_subnet": f"""SELECT event_id, CASE WHEN ip LIKE '::ffff:%' THEN '::/64' WHEN ip LIKE '2001:%' THEN '2001:db8::/64' WHEN ip LIKE 'fe80:%' THEN 'fe80::/64'
        ELSE regexp_replace(ip, '[0-9]+$', '0/24') END AS subnet FROM ({_ADDR}) WHERE ip IS NOT NULL""",
    "F3_year_rollover": sql("SELECT file, line_no, CAST(year(make_timestamp(us)) AS BIGINT) AS year FROM lines_auth WHERE parsed"),
    "F4_offset_time": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2026-10-04 08:32:00' + to_seconds(event_id % 60)
        WHEN 2 THEN TIMESTAMP '2026-01-01 00:30:59' + to_minutes(event_id % 60) END AS ts FROM events""",
    "F5_key_alias": """SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'b' WHEN 7 THEN '' || user_id END AS ip, CASE event_id % 8 WHEN 2 THEN '/x' WHEN 3 THEN '/y' END AS path,
        CASE event_id % 8 WHEN 4 THEN 'z' WHEN 6 THEN 'w' END AS ua FROM events""",
    "F6_lenient_int": """SELECT event_id, CAST(CASE event_id % 8 WHEN 0 THEN 12 WHEN 1 THEN event_id WHEN 3 THEN -3 WHEN 4 THEN 1 WHEN 6 THEN event_id END AS BIGINT) AS size FROM events""",
    "F7_flexible_time": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN TIMESTAMP '2023-11-14 22:13:20' WHEN 1 THEN TIMESTAMP '2023-11-14 22:13:20.123'
        WHEN 2 THEN TIMESTAMP '2026-10-04 08:32:10' WHEN 3 THEN TIMESTAMP '2026-10-04 14:02:10.25' WHEN 4 THEN TIMESTAMP '2026-10-04 00:00:00' END AS ts FROM events""",
    "F8_url_decode": sql(f"SELECT id, decoded FROM web UNION ALL SELECT 'page' || page_id, {DECODED.format('url')} FROM pages"),
    "F9_attack_signature": sql("SELECT id, label FROM hits"),
    "F10_scanner_agent": sql("SELECT id, tool FROM web WHERE tool IS NOT NULL"),
    "F11_normal_hours": sql("SELECT usr AS \"user\", array_to_string(list(h ORDER BY h), ',') AS normal_hours FROM normal GROUP BY usr"),
    "F12_whole_minutes": f"SELECT event_id, {_minutes('1704067200000000', 'epoch_us(ts)')} AS minutes FROM events",
    "F13_rule_facts": sql("""SELECT 'a' || no AS alert_id, rule_id, rule_name, severity, CAST(points AS BIGINT) AS points, stage, tactic, technique,
        make_timestamp(first_us) AS first_seen, make_timestamp(last_us) AS last_seen FROM alerts"""),
    "F14_reasons": sql("SELECT 'a' || no AS alert_id, reason FROM alerts"),
    "F15_risk_level": """SELECT user_id, CASE WHEN s >= 80 THEN 'critical' WHEN s >= 60 THEN 'high' WHEN s >= 30 THEN 'medium' ELSE 'low' END AS level,
        CAST(CASE WHEN n >= 3 THEN 1.6 WHEN n = 2 THEN 1.3 ELSE 1.0 END AS DOUBLE) AS multiplier FROM (SELECT user_id, sum(event_id) % 101 AS s, count(*) % 4 AS n FROM events GROUP BY user_id)""",
    "F16_hour_labels": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS iso,
        strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS hour, strftime(ts, '%Y-%m-%d %H') || ':00' AS label FROM events""",
    "F17_entity_search": sql("SELECT type, value, risk_score, level FROM ents WHERE level = 'medium' AND lower(value) LIKE '%user1%'"),
    "F18_english_list": sql(f"""SELECT ip AS src_ip, {_english('users')} AS names, replace({SPAN}, ', ', '') AS span FROM (
        SELECT ip, list_sort(list(DISTINCT usr)) AS users, min(us) AS f, max(us) AS l FROM sec WHERE usr IS NOT NULL AND ip IS NOT NULL GROUP BY ip)"""),
    "W1_threshold_burst": sql("SELECT ip AS src_ip, make_timestamp(sess) AS session_start, id FROM r1_rows"),
    "J1_typo_test": sql("SELECT id, make_timestamp(next_us) AS next_success FROM typos"),
    "B1_user_baseline": sql("SELECT usr AS \"user\", n AS login_count, hours, ips FROM base"),
    "R1_brute_force": _rule("r1", 3), "R2_password_spraying": _rule("r2", 3), "R3_low_and_slow": _rule("r3", 3),
    "R4_login_after_failures": _rule("r4", 4), "R5_off_hours": _rule("r5", 5), "R6_new_source": _rule("r6", 5),
    "R7_privilege_use": _rule("r7", 5), "R8_account_change": _rule("r8", 3), "R9_web_scanning": _rule("r9", 3),
    "R10_attack_payload": _rule("r10", 4), "R11_large_transfer": _rule("r11", 3),
    "U1_all_alerts": sql("""SELECT rule_id, ip AS src_ip, usr AS "user", technique, make_timestamp(first_us) AS first_seen, make_timestamp(last_us) AS last_seen,
        CAST(n AS BIGINT) AS count, 'a' || no AS reason, first_id FROM alerts"""),
    "U1_alert_evidence": sql("SELECT 'a' || no AS alert_id, id AS event_id FROM evidence"),
    "G1_risk_score": sql(_score_out("(" + _score("(SELECT ip AS src_ip, * FROM alerts0 WHERE ip IS NOT NULL)", "src_ip") + ")", "src_ip")),
    "G2_entity_scores": sql(_score_out("ents", "type, value")),
    "C1_shared_key_clusters": sql("SELECT 'a' || no AS alert_id, kind, value, make_timestamp(head) AS cluster_start FROM clusters"),
    "C2_login_pivot": sql("""SELECT DISTINCT usr AS "user", make_timestamp(u_head) AS user_cluster, ip AS src_ip, make_timestamp(x_head) AS ip_cluster FROM pivots"""),
    "C3_components": sql("SELECT no AS alert_no, component FROM comp"),
    "C4_incidents": sql("""SELECT incident_id, risk_score, level, array_to_string(ips, '|') AS ips, array_to_string(users, '|') AS users, make_timestamp(first_us) AS start_ts,
        make_timestamp(last_us) AS end_ts, array_to_string(stages, '|') AS stages, alert_count, first_alert_id FROM incs"""),
    "N1_story_steps": sql("SELECT incident_id, 'a' || no AS alert_id, step_no, make_timestamp(moment) AS moment FROM steps"),
    "N1_story_text": sql(STORY),
    "N2_titles": sql(f"SELECT incident_id, {_title(0)} AS title, {_title(1)} AS assessment FROM incs"),
    "N3_summaries": sql(f"""SELECT incident_id, {SUMMARY} AS summary, recommendation FROM incs JOIN ({ADVICES}) USING (incident_id)"""),
    "V1_entity_quality": sql("""SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 3) WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 3) ELSE 1.0 END AS recall FROM (SELECT (SELECT count(*) FROM flagged WHERE value IN (SELECT value FROM bad)) AS tp,
        (SELECT count(*) FROM flagged WHERE value NOT IN (SELECT value FROM bad)) AS fp, (SELECT count(*) FROM bad WHERE value NOT IN (SELECT value FROM flagged)) AS fn)"""),
    "V2_scenario_matches": sql(f"""SELECT e.scenario_id, b.incident_id IS NOT NULL AS detected, e.expected_entities, coalesce(b.found, '') AS found_entities, b.incident_id, 'Initial Access' AS expected_stages,
        coalesce(b.stages, '') AS found_stages FROM (SELECT sid AS scenario_id, string_agg(value, '|' ORDER BY value) AS expected_entities FROM wanted GROUP BY sid) e LEFT JOIN (
          SELECT sid, incident_id, string_agg(value, '|' ORDER BY value) AS found, array_to_string(first(stages), '|') AS stages, row_number() OVER (
            PARTITION BY sid ORDER BY count(*) DESC, incident_no) AS rn FROM wanted JOIN (SELECT DISTINCT incident_id, incident_no, stages, value FROM inc_ents
            WHERE risk_score >= {C.evaluation_min_risk}) USING (value) GROUP BY sid, incident_id, incident_no) b ON b.sid = e.scenario_id AND b.rn = 1"""),
    "V3_false_positives": sql("""SELECT (SELECT count(*) FROM incs WHERE level = 'critical' AND incident_id NOT IN (SELECT incident_id FROM inc_ents WHERE value IN (SELECT value FROM bad)))
        AS critical_false_positives, 'attack_run' AS source, count(*) AS incidents, count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'high') AS high,
        count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low FROM incs"""),
    "Q1_events_per_hour": "SELECT date_trunc('hour', ts) AS hour, count(*) AS count FROM events GROUP BY 1",
    "Q2_incidents_by_level": sql("""SELECT level, (SELECT count(*) FROM incs i WHERE i.level = l.level) AS incidents
        FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) l(level)"""),
    "Q3_top_entities": sql("SELECT type, value, risk_score, level, alert_count FROM ents ORDER BY risk_score DESC, type, value LIMIT 5"),
    "Q4_run_summary": sql("""SELECT (SELECT count(*) FROM sec) AS events, (SELECT count(*) FROM alerts) AS alerts, count(*) AS incidents, count(*) FILTER (level = 'critical') AS critical,
        count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low,
        (SELECT make_timestamp(us // 3600000000 * 3600000000) FROM sec GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour,
        (SELECT count(*) FROM sec GROUP BY us // 3600000000 ORDER BY 1 DESC LIMIT 1) AS peak_count,
        (SELECT value FROM ents ORDER BY risk_score DESC, type, value LIMIT 1) AS top_entity FROM incs"""),
    "Q4_full_summary": sql("""SELECT 'total' AS part, CAST(position AS BIGINT) AS position, item, NULL::VARCHAR AS label, CAST(n AS BIGINT) AS count, NULL::BIGINT AS risk_score, NULL::VARCHAR AS level FROM (
          SELECT 1 AS position, 'lines_total' AS item, count(*) + count(*) FILTER (line_no % 13 = 0) AS n FROM sec UNION ALL SELECT 2, 'parsed', count(*) FROM sec
          UNION ALL SELECT 3, 'skipped', count(*) FILTER (line_no % 13 = 0) FROM sec UNION ALL SELECT 4, 'events', count(*) FROM sec
          UNION ALL SELECT 5, 'alerts', count(*) FROM alerts UNION ALL SELECT 6, 'incidents', count(*) FROM incs)
        UNION ALL SELECT 'level', CAST(position AS BIGINT), l.level, NULL, (SELECT count(*) FROM incs i WHERE i.level = l.level), NULL, NULL
          FROM (VALUES ('critical', 1), ('high', 2), ('medium', 3), ('low', 4)) l(level, position)
        UNION ALL SELECT 'hour', NULL, strftime(h, '%Y-%m-%dT%H:00:00Z'), strftime(h, '%Y-%m-%d %H:00'), count(*), NULL, NULL
          FROM (SELECT date_trunc('hour', make_timestamp(us)) AS h FROM sec) GROUP BY h
        UNION ALL (SELECT 'entity', row_number() OVER (ORDER BY risk_score DESC, type, value), value, type, alert_count, risk_score, level FROM ents
          ORDER BY risk_score DESC, type, value LIMIT 5)"""),
    "Q5_incident_list": sql(f"""SELECT incident_id, {_title(0)} AS title, risk_score, level, make_timestamp(first_us) AS start_ts, make_timestamp(last_us) AS end_ts,
        array_to_string(stages, '|') AS stages, {SUMMARY} AS summary FROM incs"""),
    "Q6_incident_detail": sql("""SELECT a.incident_id, i.risk_score, 'a' || a.no AS alert_id, a.rule_id, e.id AS event_id, make_timestamp(e.us) AS ts, s.type,
        'event ' || s.line_no || ' ' || s.event_type AS raw FROM alerts a JOIN incs i ON i.incident_id = a.incident_id JOIN evidence e ON e.no = a.no JOIN sec s ON s.id = e.id"""),
    "Q7_evidence_lines": sql("""SELECT incident_id, id AS event_id, alert_no, make_timestamp(us) AS ts, line_no, 'event ' || line_no || ' ' || event_type AS raw FROM (
        SELECT a.incident_id, e.id, min(a.no) AS alert_no FROM alerts a JOIN evidence e ON e.no = a.no GROUP BY ALL) JOIN sec USING (id)"""),
    "Q8_run_list": sql("SELECT analysis_id, created_at FROM runs ORDER BY created_at DESC LIMIT 100"),
    "Q9_peak_hour": "SELECT date_trunc('hour', ts) AS hour, count(*) AS count FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
    "Q10_techniques": sql("""SELECT incident_id, technique, name FROM (SELECT incident_id, technique, stage || ' · ' || tactic AS name, row_number() OVER (
        PARTITION BY incident_id, technique ORDER BY no) AS rn FROM alerts) WHERE rn = 1"""),
    "Q10_rules_triggered": sql("SELECT incident_id, 'a' || no AS alert_id, rule_id, rule_name, CAST(points AS BIGINT) AS score_contribution, severity, reason FROM alerts"),
}
