"""Conversation repair against a search over all edit strings."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from logvigil.llm import dialogue
from logvigil.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, part int, cost string, times long"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digest_key(turn, role, text):
    return (turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: digest_key(*r))


def plain(rows):
    """All nine values of one conversation, by comparing (cost, audit) of every way to go on."""
    rows = damaged(rows)
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))

    def grows(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def way(cost, edit, line, at, to, n):
            c, audit, lines = best(at, to, n)
            ways.append((cost + c, edit + audit, ((line,) if line is not None else ()) + lines))

        if inserted < 3:
            for name in ("user", "assistant"):
                if to := grows(state, name[0]):
                    way(3, "I", f"{name}:", i, to, inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            way(4, "D", None, i + 1, state, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if to := grows(state, role[:1]):
                    way(more, "K", f"{role}:{text}", i + 1, to, 0)
                for name in ("user", "assistant"):
                    if to := grows(state, name[0]):
                        way(3 + more, "R", f"{name}:{text}", i + 1, to, 0)
        return min(ways) if ways else (10 ** 9, "", ())

    for i in range(len(rows), 0, -1):       # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, lines = best(0, "", 0)
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row[:4])
    return {conv: plain(found) for conv, found in by.items()}


def found(df):
    rows = dialogue.digests(dialogue.repair(df)).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def random_rows(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None])
            text = rng.choice(["Yes.", "No", "Go!  \n", " ", "", None, "Why?", f"Line {rng.randrange(9)}.", "é…", "\x1c"])
            turn = rng.choice([turn, turn, turn, turn + 3, None])
            rows += [(conv, turn, role, text, 1, "x", 9)] * rng.choice([1, 1, 1, 1, 2, 4])
    return rows


@pytest.mark.parametrize("seed, limit", [(1, 50_000), (2, 3), (3, 1)])
def test_random_conversations(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(dialogue, "SEGMENT_ROWS", limit)
    rows = random_rows(seed, 40, 14)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """A long conversation over many segments and tasks, with one row repeated for a third of the table and a very long text."""
    monkeypatch.setattr(dialogue, "SEGMENT_ROWS", 16)
    rng = random.Random(7)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"{t}.", f"{t}"]), 0, "", 0) for t in range(400)]
    rows += [(5, 900, "user", "Again.", 0, "", 0)] * 200 + [(6, 1, "user", "long " * 300_000 + ".", 0, "", 0), (6, 2, "assistant", "Ok.", 0, "", 0)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(6)) == expected(rows)


def test_empty(spark):
    assert dialogue.digests(dialogue.repair(spark.createDataFrame([], SCHEMA))).count() == 0


def test_everything_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    assert found(spark.createDataFrame([(8, turn, "user", "Hi.", 0, "", 0)], SCHEMA)) == {
        8: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_walk_stores_square_root_of_vectors():
    codes, times = bytes([2, 3] * 5000), [1] * 10_000
    assert "".join(e for e, _, _ in dialogue.walk(codes, times, list(dialogue.CLOSE), 0)) == "K" * 10_000


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_conversation_repair"](spark, sf_dir).collect()}
    assert got == expected(rows)
