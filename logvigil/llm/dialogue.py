"""Conversation repair: cheapest edits that give alternating turns, by dynamic programming with square-root checkpoints."""

from __future__ import annotations

import hashlib
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from logvigil.session import settled

#: A segment ends after so many different rows or bytes of text; longer conversations are several segments.
SEGMENT_ROWS = 50_000
SEGMENT_BYTES = 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. NEXT is the state after an inserted or reroled row.
NEXT = (2, 2, 3, 2)
#: What the end of a conversation costs in each state: a user row is missing its answer, a system row a whole exchange.
CLOSE = (0, 6, 3, 0)
FAR = 1 << 60
#: Codes of a row: 0 other, 1 system, 2 user, 3 assistant initial; plus 4 truncated; plus 8 blank or duplicate.
CUT, GONE = 4, 8
KEEP = {(1, 0): 1, (2, 0): 2, (2, 1): 2, (2, 3): 2, (3, 2): 3}
WHITE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with their planned damage: conv_id, turn, role, text, times (0 dropped, 2 repeated)."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = (F.when(fate.isin(0, 1), F.lit("")).when(fate == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text")))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fate == 0, F.lit("")).when(fate == 4, F.lit("user")).otherwise(shown("role")).alias("role"), text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("times"))


def _collapse(batches):
    """Equal rows of a batch become one with their number, so that copies are not moved one by one."""
    for batch in batches:
        keys = ["conv_id", "turn", "role", "text", "digest"]
        table = pa.Table.from_batches([batch]).group_by(keys).aggregate([("times", "sum")])
        yield from table.select([*keys, "times_sum"]).rename_columns([*keys, "times"]).to_batches()


# --- The programme over one stretch of rows -------------------------------------------------------------------------


def _relaxed(base: list[int]) -> list[int]:
    """Costs at a place, with up to two rows inserted there first; a third would bring back the state after the first."""
    out = []
    for s in range(4):
        one = NEXT[s]
        out.append(min(base[s], INSERT + base[one], 2 * INSERT + base[NEXT[one]]))
    return out


def _before(code: int, times: int, after: list[int]) -> list[int]:
    """Costs before a row (that stands ``times`` times in a row) from those after it."""
    if code & GONE:
        return _relaxed([DELETE * times + c for c in after])
    more = DELETE * (times - 1)
    cut = TRUNCATED if code & CUT else 0
    base = []
    for s in range(4):
        kept = KEEP.get((code & 3, s))
        base.append(more + min(DELETE + after[s], REROLE + cut + after[NEXT[s]], FAR if kept is None else cut + after[kept]))
    return _relaxed(base)


def costs_before(codes: bytes, times: list[int], end: list[int]) -> list[int]:
    for i in range(len(codes) - 1, -1, -1):
        end = _before(codes[i], times[i], end)
    return end


def transfer(codes: bytes, times: list[int]) -> list[int]:
    """Cheapest way over the stretch from each state to each state, row by row: 16 numbers."""
    columns = [costs_before(codes, times, [0 if s == to else FAR for s in range(4)]) for to in range(4)]
    return [min(columns[to][s], FAR) for s in range(4) for to in range(4)]


def walk(codes: bytes, times: list[int], end: list[int], state: int):
    """Yields the ASCII-least of the cheapest edits over the stretch as (edit, row or None, state after), then nothing.

    Going backwards, only the cost vectors at every square root of n-th row are stored; going forwards, the vectors of one
    block at a time are computed again from the checkpoint behind it. An edit is tight if its cost and the cost from where it leads
    add up to the cost from here; among tight ones D comes before I before K before R. A copy of a row that is to
    go anyway can always go at once, since an insertion costs the same before and after it.
    """
    n = len(codes)
    step = isqrt(n) + 1
    saved, vector = {n: end}, end
    for i in range(n - 1, -1, -1):
        vector = _before(codes[i], times[i], vector)
        if i % step == 0:
            saved[i] = vector
    for start in range(0, n, step):
        stop = min(start + step, n)
        block = [saved[stop]]
        for i in range(stop - 1, start - 1, -1):
            block.append(_before(codes[i], times[i], block[-1]))
        block.reverse()
        for i in range(start, stop):
            here, after, code = block[i - start], block[i - start + 1], codes[i]
            more = 0 if code & GONE else DELETE * (times[i] - 1)
            cut = TRUNCATED if code & CUT else 0
            gone = DELETE * times[i] + after[state]
            while here[state] != gone and here[state] == INSERT + here[NEXT[state]]:
                state = NEXT[state]
                yield "I", None, state
                gone = DELETE * times[i] + after[state]
            if here[state] == gone:
                yield "D" * times[i], None, state
                continue
            kept = KEEP.get((code & 3, state))
            if kept is not None and here[state] == more + cut + after[kept]:
                state = kept
                yield "K" + "D" * (times[i] - 1), i, state
            else:
                state = NEXT[state]
                yield "R" + "D" * (times[i] - 1), i, state


def mend(codes: bytes, times: list[int], roles: list[str], texts: list[str], end: list[int], state: int, last: bool) -> tuple[str, list[str]]:
    """(audit, repaired lines) of a stretch; the last one of a conversation also gets what is missing at its end."""
    audit, lines = [], []

    def put(edit: str, row: int | None) -> None:
        audit.append(edit)
        if edit[0] == "K":
            lines.append(f"{roles[row]}:{texts[row]}")
        elif edit[0] in "IR":
            lines.append(f"{'user' if state == 2 else 'assistant'}:{texts[row] if edit[0] == 'R' else ''}")

    for edit, row, state in walk(codes, times, end, state):
        put(edit, row)
    while last and CLOSE[state]:
        state = NEXT[state]
        put("I", None)
    return "".join(audit), lines


# --- Segments -------------------------------------------------------------------------------------------------------

STATS = ["blank", "duplicate", "truncated", "illegal"]
SEGMENT = ("conv_id long, part long, whole boolean, codes binary, times array<long>, roles array<string>, texts array<string>, "
           "blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long, "
           "first_turn long, last_turn long, matrix array<long>, cost long, audit string, repaired string")


class _Segment:
    """Rows of one conversation in order, and what is counted about them."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.times, self.roles, self.texts = conv_id, bytearray(), [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.size = 0
        self.head = self.tail = self.low = self.high = self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str, times: int, seen: bool) -> None:
        if not times:
            return
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low, self.high = turn if self.low is None else self.low, turn
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        initial = role[:1]
        self.illegal += (self.tail is not None and self.tail + initial not in ("su", "ua", "au")) + times - 1
        self.head, self.tail = initial if self.head is None else self.head, initial
        code, ending = "sua".find(initial) + 1 if initial else 0, text.rstrip(WHITE)[-1:]
        if not ending:
            code |= GONE
            self.blank += times
        elif seen:
            code |= GONE
            self.duplicate += times
        else:
            self.duplicate += times - 1
            if ending not in ".!?":
                code |= CUT
                self.truncated += 1
        self.codes.append(code)
        self.times.append(times)
        self.roles.append(role)
        self.texts.append("" if code & GONE else text)
        self.size += len(text) + len(role) + 40

    def row(self, part: int, whole: bool) -> tuple:
        codes = bytes(self.codes)
        counted = (self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.low, self.high, self.turns,
                   self.first_turn, self.last_turn)
        if not whole:
            return (self.conv_id, part, False, codes, self.times, self.roles, self.texts, *counted, transfer(codes, self.times), None, None, None)
        audit, lines = mend(codes, self.times, self.roles, self.texts, list(CLOSE), 0, True)
        cost = costs_before(codes, self.times, list(CLOSE))[0]
        return (self.conv_id, part, True, None, None, None, None, *counted, None, cost, audit, "\n".join(lines))


def _schema(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split(" ")[0], types[f.split(" ")[1]]) for f in ddl.split(", ")])


def _frame(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def segments(conversations: DataFrame) -> DataFrame:
    """Conversations as segments of bounded size, in order of ``part``; those known to be whole are repaired already.

    Rows are placed by ranges of (conversation, turn, role, digest), so that a conversation of any share of the table is dealt over many
    tasks. A row is a duplicate if its role and text stand at an earlier turn; such turns are found on digests and
    travel to the rows as marks that sort right before them, so texts are moved once. A conversation that neither starts nor ends a
    task's range, and did not fill a segment, is whole.
    """
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    rows = damage(conversations).withColumn("digest", digest)
    order = ["conv_id", "turn", "role", "digest"]
    # Nulls first, in one number that sorts like the turn.
    seen = rows.filter("times > 0").groupBy(*order).agg(F.lit(1).alias("one"))
    early = (seen.groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.count_if(F.col("turn").isNull()).alias("none"))
             .filter("n > 1").withColumnRenamed("conv_id", "c").withColumnRenamed("digest", "d"))
    marks = (seen.join(early, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
             .filter("turn IS NOT NULL AND (none > 0 OR turn > low)").select(*order, F.lit("").alias("text"), F.lit(-1).cast("long").alias("times")))
    collapsed = rows.select("conv_id", "turn", "role", "text", "digest", "times").mapInArrow(
        _collapse, "conv_id long, turn long, role string, text string, digest binary, times long")
    placed = (collapsed.unionByName(marks).repartitionByRange(*order)
              .sortWithinPartitions(*order, "times"))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        segment, first, key, held = None, True, None, None
        ready, size = [], 0

        def close(whole: bool):
            nonlocal number, size
            ready.append(segment.row(number, whole))
            size += segment.size
            number += 1

        opened = True
        for batch in batches:
            for conv_id, turn, role, text, mark, times in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (conv_id, turn, role, mark) == key:
                    if held[3] >= 0 and times >= 0:
                        held[3] += times
                    else:
                        held[2], held[3] = text, times
                    continue
                if held is not None:
                    segment.add(*held)
                if segment is None or segment.conv_id != conv_id or key is None:
                    if segment is not None:
                        close(not first and opened)
                        first = False
                    segment, opened = _Segment(conv_id), True
                elif len(segment.codes) >= SEGMENT_ROWS or segment.size >= SEGMENT_BYTES:
                    close(False)
                    segment, opened = _Segment(conv_id), False
                key, held = (conv_id, turn, role, mark), [turn, role, text, times, times < 0]
                if size >= SEGMENT_BYTES:
                    yield _frame(ready, SEGMENT)
                    ready, size = [], 0
        if segment is not None:
            segment.add(*held)
            close(False)
        yield _frame(ready, SEGMENT)

    return placed.select("conv_id", "turn", "role", "text", "digest", "times").mapInArrow(run, SEGMENT)


# --- Conversations of several segments ------------------------------------------------------------------------------

ENDS = ("conv_id long, part long, piece long, pieces long, last boolean, end array<long>, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long")


def _ends(table: pa.Table) -> pa.Table:
    """The checkpoint vector behind each segment of a conversation, and its totals; one small row a segment."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    ends, vector = [], list(CLOSE)
    for r in reversed(rows):
        ends.append(vector)
        vector = [min(min(r["matrix"][4 * s + to] + vector[to] for to in range(4)), FAR) for s in range(4)]
    turned = [r for r in rows if r["first_turn"] is not None]
    met = [r for r in rows if r["head"] is not None]
    turns = sum(r["turns"] for r in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
    gaps = turned[-1]["high"] - turned[0]["low"] + 1 - turns if turned else 0
    illegal = sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(met, met[1:]))
    totals = [sum(r[s] for r in rows) for s in STATS]
    totals[3] += illegal
    return pa.Table.from_batches([_frame([(r["conv_id"], r["part"], i, len(rows), i == len(rows) - 1, end, gaps, *totals, vector[0])
                                          for i, (r, end) in enumerate(zip(rows, reversed(ends)))], ENDS)])


def _exits(batches):
    """For each state a segment can be entered in, the state it is left in."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            out = []
            for state in range(4):
                for _, _, state in walk(r["codes"], r["times"], r["end"], state):
                    pass
                out.append(state)
            rows.append((r["conv_id"], r["part"], out))
        yield _frame(rows, "conv_id long, part long, exits array<long>")


def _entries(table: pa.Table) -> pa.Table:
    """The state each segment of a conversation is entered in."""
    state, rows = 0, []
    for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
        rows.append((r["part"], state))
        state = r["exits"][state]
    return pa.Table.from_batches([_frame(rows, "part long, state long")])


def _mended(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            audit, lines = mend(r["codes"], r["times"], r["roles"], r["texts"], r["end"], r["state"], r["last"])
            yield _frame([(r["part"], audit, "\n".join(lines) if lines else None)], "part long, audit string, repaired string")


def repair(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), one per conversation but for very long ones.

    Of a conversation of several pieces each row has the same numbers, and the piece's part of the audit and of the repaired lines (null if it
    has none). Its segments are first passed over side by side, as tables of costs from state to state; these give the cost
    vector behind each segment, which is the checkpoint that a segment's edits are computed from, again side by side.

    Null roles and texts are one space, null turns come first, null conv_ids are one conversation. Rows of one turn are in
    order of role, then of a digest of role and text; repeated rows are neighbours, of which the first counts. Empty texts are blank. A conversation without
    rows after damage has zeros and an empty audit. An empty table gives no rows. Columns other than the four are not read.
    """
    made = settled(segments(conversations), "dialogue-segments")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    whole = made.filter("whole").select("conv_id", zero.alias("piece"), one.alias("pieces"), gaps, *STATS, "cost", "audit", "repaired")
    parted = made.filter("NOT whole")
    ends = settled(parted.select("conv_id", "part", *STATS, "head", "tail", "low", "high", "turns", "first_turn", "last_turn", "matrix")
                   .groupBy("conv_id").applyInArrow(_ends, ENDS), "dialogue-ends")
    exits = (parted.select("conv_id", "part", "codes", "times").join(ends.select("part", "end"), "part")
             .select("conv_id", "part", "codes", "times", "end").mapInArrow(_exits, "conv_id long, part long, exits array<long>"))
    entries = settled(exits.groupBy("conv_id").applyInArrow(_entries, "part long, state long"), "dialogue-entries")
    lines = (parted.select("part", "codes", "times", "roles", "texts").join(ends.select("part", "end", "last").join(entries, "part"), "part")
             .mapInArrow(_mended, "part long, audit string, repaired string"))
    rest = lines.join(ends, "part").select("conv_id", "piece", "pieces", "gaps", *STATS, "cost", "audit", "repaired")
    return whole.unionByName(rest)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation with its whole audit and the SHA-256 of its repaired lines.

    A hash runs over its text from front to back, so the pieces of one conversation pass through one task; it holds one piece at a
    time, and of the conversation only the audit.
    """
    numbers = ["gaps", *STATS, "cost"]
    single = repaired.filter("pieces = 1").select("conv_id", *numbers, "audit", F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))
    ddl = "conv_id long, " + ", ".join(f"{n} long" for n in numbers) + ", audit string, repaired_sha256 string"

    def run(batches):
        state, audit, count = hashlib.sha256(), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                audit.append(r["audit"])
                if r["repaired"] is not None:
                    state.update(("\n" if count else "").encode() + r["repaired"].encode())
                    count += 1
                if r["piece"] == r["pieces"] - 1:
                    yield _frame([(r["conv_id"], *(r[n] for n in numbers), "".join(audit), state.hexdigest())], ddl)
                    state, audit, count = hashlib.sha256(), [], 0

    parted = repaired.filter("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return single.unionByName(parted.mapInArrow(run, ddl))
