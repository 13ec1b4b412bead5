"""Best-fit packing: token pieces into as few fixed-size sequences as possible, by bin completion on the length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logvigil.llm.bpe import byte_sizes, encoder, slices
from logvigil.llm.common import shuffle_width
from logvigil.session import settled

CAPACITY = 4096
END_ID = 1
#: Bytes of text that are encoded together: the more, the fewer strings are looked up twice.
BATCH = 8 << 20
#: Bins that the search may try beyond the first solution.
NODES = 2000


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null text gives the end id alone."""
    def cut(batches):
        to_ids = encoder(tokenizer_path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = []
            for a, b in slices(byte_sizes(texts), BATCH):
                for doc_id, found in zip(names[a:b], to_ids.encode_array(texts.slice(a, b - a))):
                    ids = found.as_py() + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _layers(room: int, lengths: list[int], counts: dict[int, int]) -> tuple[int, list[tuple[int, int, int]]]:
    """Reachable sums up to ``room`` as the bits of one integer, and (length, copies, sums before) for each step to it.

    Lengths are added from large to small until ``room`` is reached. A length that fits n times is added as 1, 2, 4, ...
    copies and the rest, whose sums give every number up to n.
    """
    mask = (1 << (room + 1)) - 1
    reached, seen = 1, []
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        size = lengths[at]
        left, copies = min(counts[size], room // size), 1
        while left:
            copies = min(copies, left)
            seen.append((size, copies, reached))
            reached |= (reached << (size * copies)) & mask
            left -= copies
            copies *= 2
        if reached >> room & 1:
            break
    return reached, seen


def _filling(total: int, seen: list[tuple[int, int, int]]) -> tuple[int, ...]:
    """Lengths that add up to a reachable sum, large ones rather than small ones."""
    filling = []
    for size, copies, before in reversed(seen):
        if not before >> total & 1:
            filling += [size] * copies
            total -= size * copies
    return tuple(filling)


def _fullest(room: int, lengths: list[int], counts: dict[int, int]) -> tuple[int, ...]:
    """The filling of ``room`` with the largest sum, each length used as often as it occurs."""
    reached, seen = _layers(room, lengths, counts)
    return _filling(reached.bit_length() - 1, seen)


def _dominated(filling: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether every piece of a filling surely fits into the pieces of another, so that the other leaves what is easier to pack."""
    rooms = sorted(by)
    for size in sorted(filling, reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= size), None)
        if at is None:
            return False
        room = rooms.pop(at) - size
        rooms.insert(bisect_right(rooms, room), room)
    return True


def _completions(room: int, lengths: list[int], counts: dict[int, int], most: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` around the length already placed, fullest first: of the ``most`` largest sums and,
    since a long piece is worth more than its sum, around each of the ``most`` largest lengths that fit."""
    reached, seen = _layers(room, lengths, counts)
    found, sums = [], reached
    while sums and len(found) < most:
        total = sums.bit_length() - 1
        found.append(_filling(total, seen))
        sums ^= 1 << total
    top = bisect_right(lengths, room)
    for large in lengths[max(0, top - most):top]:
        counts[large] -= 1
        rest = [size for size in lengths[:bisect_right(lengths, room - large)] if counts[size]]
        found.append((large, *_fullest(room - large, rest, counts)))
        counts[large] += 1
    found.sort(key=lambda f: (-sum(f), len(f), f[::-1]))
    kept: list[tuple[int, ...]] = []
    for filling in found:
        if not any(_dominated(filling, other) for other in kept):
            kept.append(filling)
    return kept


class _Open:
    """What is still to be packed; bins are filled and emptied again in place."""

    def __init__(self, histogram: dict[int, int]):
        self.counts, self.lengths = dict(histogram), sorted(histogram)
        self.left, self.used = sum(size * n for size, n in histogram.items()), 0

    def times(self, filling: tuple[int, ...]) -> int:
        return min(self.counts[size] // n for size, n in Counter(filling).items())

    def fill(self, filling: tuple[int, ...], times: int) -> None:
        """Uses a filling so often; a negative number takes it back."""
        for size, n in Counter(filling).items():
            before = self.counts.get(size, 0)
            after = self.counts[size] = before - n * times
            if not after:
                del self.counts[size]
                self.lengths.pop(bisect_left(self.lengths, size))
            elif not before:
                insort(self.lengths, size)
        self.used += times
        self.left -= sum(filling) * times

    def around_largest(self, choose):
        """The largest length left, with what ``choose`` makes of the room beside it and the other pieces."""
        large = self.lengths[-1]
        self.fill((large,), 1)
        out = choose(large)
        self.fill((large,), -1)
        return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, most: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, so that every length of the histogram is used as often as it occurs.

    Bin completion: the largest length left opens a bin, its undominated fillings are the branches, fullest first; a
    filling is repeated as often as the counts allow, or half as often on another branch. The first dive takes the fullest
    filling every time, which is best fit and the first incumbent. The search then goes back from the last bin, where waste
    arises, to ever earlier ones: it empties bins, tries the other fillings there and dives again from that state.
    A branch is cut when its bins and the lower bound of what is left leave more waste than the incumbent; a better
    solution becomes the incumbent and the search goes back from its last bin. It ends at the lower bound (also bins for
    lengths above half) or after ``nodes`` bins tried beyond the first dive; the incumbent is complete in either case.
    """
    total = sum(size * n for size, n in histogram.items())
    bound = max(-(-total // capacity), sum(n for size, n in histogram.items() if 2 * size > capacity))
    state, spent = _Open(histogram), 0

    def dive(limit: float) -> list[tuple[tuple[int, ...], int]]:
        """Fills bins best fit until nothing is left, or until fewer than ``limit`` bins cannot be kept to."""
        nonlocal spent
        made = []
        while state.lengths and state.used - (-state.left // capacity) < limit and spent <= nodes:
            filling = state.around_largest(lambda large: (large, *_fullest(capacity - large, state.lengths, state.counts)))
            made.append((filling, state.times(filling)))
            state.fill(*made[-1])
            spent += limit < inf
        return made

    best = dive(inf)
    fewest, depth, back = state.used, len(best), 1
    while depth and fewest > bound and spent <= nodes:
        # Emptying goes on in growing strides, so that early bins come into reach.
        stride = max(1, back // 8)
        for filling, times in reversed(best[max(0, depth - stride):depth]):
            state.fill(filling, -times)
        depth, back = max(0, depth - stride), back + stride
        chosen, usual = best[depth]
        options = state.around_largest(lambda large: [(large, *f) for f in _completions(capacity - large, state.lengths, state.counts, most)])
        branches = [(f, n) for f in options for n in sorted({state.times(f), -(-state.times(f) // 2)}, reverse=True)]
        for branch in branches:
            if branch == (chosen, usual) or spent > nodes:
                continue
            state.fill(*branch)
            made = dive(fewest)
            if not state.lengths and state.used < fewest:
                best, fewest = [*best[:depth], branch, *made], state.used
                depth, back = len(best), 1
                break
            for filling, times in [*reversed(made), branch]:
                state.fill(filling, -times)
    return best


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, per bin, first sequence, offset of the first): where the pieces of each length go, by rank."""
    out, used, sequence = [], {}, 0
    for filling, times in patterns:
        offset = 0
        for size in sorted(set(filling), reverse=True):
            per = filling.count(size)
            start = used.get(size, 0)
            out.append((size, start, per, start + per * times, sequence, offset))
            used[size] = start + per * times
            offset += per * size
        sequence += times
    return out


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and offset.

    Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver, where the packing is planned as
    patterns of lengths. Pieces take their places by their rank among pieces of equal length, found by binary search. Ranks are
    counted in hash cells and shifted by the cells before, so a length that most pieces share is spread over all tasks.

    Null or empty text: one piece, the end id. A very long text is cut into as many pieces as it takes. Repeated rows and null doc_ids are packed like any other. Empty table:
    no rows. Columns other than doc_id and text are not read.
    """
    spark = documents.sparkSession
    cells = 4 * shuffle_width(spark)
    made = settled(pieces(documents, tokenizer_path, capacity).withColumn(
        "_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)).cast("int")), "pack-pieces")
    sizes = settled(made.groupBy("length", "_cell").agg(F.count("*").alias("_n")), "pack-sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = sizes.select("length", "_cell", (F.sum("_n").over(Window.partitionBy("length").orderBy("_cell")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_cell", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (made.repartition(shuffle_width(spark), "_cell").withColumn("_rank", F.row_number().over(within) - 1)
              .join(before.hint("shuffle_hash"), ["_cell", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before")))
    # The plan has a bounded number of rows: every pattern leaves less of some length than it holds of it, so less than half.
    shipped = spark.sparkContext.broadcast(np.array(sorted(placements(plan(histogram, capacity))), np.int64).reshape(-1, 6).T)

    def place(batches):
        length, start, per, _, sequence, offset = shipped.value
        firsts = (length << 42) + start
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            at = np.searchsorted(firsts, (size << 42) + rank, side="right") - 1
            nth = rank - start[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + nth // per[at]), pa.array(offset[at] + nth % per[at] * size)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.select(*names[:5], F.col("_rank").cast("long")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
