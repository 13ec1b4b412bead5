"""Small frames for tests, and direct definitions the operators are compared with."""

from datetime import datetime, timedelta, timezone

EVENT = ("id string, us bigint, source string, type string, src_ip string, user string, host string, "
         "http struct<method:string,path:string,status:int,bytes:bigint,ua:string>, file string, line_no bigint, raw string")
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE


def micros(*when):
    return int(datetime(*when, tzinfo=timezone.utc).timestamp()) * SECOND


def events(spark, rows):
    """Rows of (us, type, ip, user[, http]) in line order of one file."""
    out = []
    for n, row in enumerate(rows, start=1):
        us, kind, ip, user, http = (*row, None)[:5]
        out.append((f"f:{n}", us, "web" if kind == "http_request" else "auth", kind, ip, user, "h", http, "f", n, f"line {n}"))
    return spark.createDataFrame(out, EVENT)


def lines(spark, texts, file="auth.log"):
    return spark.createDataFrame([(file, n, t) for n, t in enumerate(texts, start=1)], "file string, line_no bigint, raw string")


def ssh_failures(start, ip, n, gap_s, user="root"):
    """Syslog text of n failures gap_s seconds apart."""
    times = [start + timedelta(seconds=gap_s * k) for k in range(n)]
    return [f"{t:%b} {t.day:2d} {t:%H:%M:%S} gate3 sshd[{1000 + k}]: Failed password for {user} from {ip} port {40000 + k} ssh2"
            for k, t in enumerate(times)]


def bursts(times, window, threshold, values=None):
    """Definition of threshold bursts as index lists: of each session without a longer gap than the window, all from one window
    before the first instant whose trailing window is full."""
    cuts = [i for i in range(1, len(times)) if times[i] - times[i - 1] > window]
    found = []
    for session in (range(a, b) for a, b in zip([0, *cuts], [*cuts, len(times)])):
        full = [times[j] for j in session
                if len({values[i] if values else i for i in session if 0 <= times[j] - times[i] <= window}) >= threshold]
        if full:
            found.append([i for i in session if times[i] >= min(full) - window])
    return found


def transfers(rows, window, threshold):
    """Definition of the transfer rule on (us, bytes): a burst may start at the last row from which some row's sum, within a window,
    exceeds the threshold; bursts last a window, and one counts if it starts beyond the window of the last that counts."""
    def heavy(i, j):
        return rows[j][0] - rows[i][0] <= window and sum(size for _, size in rows[i:j + 1]) > threshold

    starts = {max(from_) for j in range(len(rows)) if (from_ := [i for i in range(j + 1) if heavy(i, j)])}
    found = []
    for i in sorted(starts):
        if not found or rows[i][0] > rows[found[-1][0]][0] + window:
            found.append([k for k in range(i, len(rows)) if rows[k][0] <= rows[i][0] + window])
    return found
