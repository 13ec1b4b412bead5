"""Text expressions: URL decoding, signatures, lists and risk buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels and patterns must equal the documented signature set, tried in this order.
SIGNATURES = {
    "SQL injection pattern": [r"'\s*or\s*'", r"union\s+select", r"select\s.+\sfrom", r"sleep\(", r"--\s*(?:&|$)"],
    "XSS pattern": [r"<script", r"javascript:", r"onerror\s*=", r"onload\s*="],
    "path traversal pattern": [r"\.\./", r"\.\.\\", r"/etc/passwd"],
    "command injection pattern": [r";\s*cat\s", r"\|\s*cat\s", r"&&", r"\$\(", r"`"],
}
SCANNERS = "sqlmap|nikto|gobuster|dirbuster|nmap"

# Java needs these to match as the patterns do on Unicode text: case, classes, and only \n as a line end.
UNICODE = "(?iuUd)"


def url_decoded(path: Column) -> Column:
    """Decode once; ``+`` is a space and a malformed percent sign stays as it is."""
    return F.url_decode(F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25"))


def signature(decoded: Column) -> Column:
    """First label with a matching pattern, or null."""
    label = F
    for name, patterns in SIGNATURES.items():
        label = label.when(decoded.rlike(UNICODE + "|".join(patterns)), F.lit(name))
    return label


def scanner_tool(ua: Column) -> Column:
    """Name of the scanning tool in a user agent, or null."""
    return F.nullif(F.lower(F.regexp_extract(ua, f"(?iu)({SCANNERS})", 1)), F.lit(""))


def shown(value: Column, otherwise: str = "None") -> Column:
    return F.coalesce(value, F.lit(otherwise))


def english_list(items: Column) -> Column:
    """a, b and c."""
    last = F.element_at(items, -1)
    return (F.when(F.size(items) == 0, F.lit("")).when(F.size(items) == 1, last)
            .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.size(items) - 1), ", "), F.lit(" and "), last)))


def time_span(first_clock: Column, last_clock: Column) -> Column:
    return (F.when(first_clock == last_clock, F.concat(F.lit("At "), first_clock, F.lit(" UTC")))
            .otherwise(F.concat(F.lit("Between "), first_clock, F.lit(" and "), last_clock, F.lit(" UTC"))))


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1))


def risk_level(score: Column) -> Column:
    return (F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 30, "medium").otherwise("low"))


def chain_multiplier(stages: Column) -> Column:
    return F.when(stages >= 3, F.lit(1.6)).when(stages == 2, F.lit(1.3)).otherwise(F.lit(1.0))
