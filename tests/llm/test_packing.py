"""Packing where one length holds most pieces: the number of sequences against the total and the capacity."""

import random

from logvigil.llm import packing
from logvigil.llm.queries import tokenizer_file


def bins(histogram, capacity=4096, nodes=packing.NODES):
    used, n = {}, 0
    for filling, times in packing.plan(dict(histogram), capacity, nodes):
        assert sum(filling) <= capacity and times > 0
        n += times
        for size in filling:
            used[size] = used.get(size, 0) + times
    assert used == histogram
    return n


def test_one_length_only():
    assert bins({1: 9}) == 1 and bins({1: 300_000}) == 74
    assert bins({50: 300_000}) == -(-300_000 // 81)


def test_a_third_of_one_short_length():
    rnd = random.Random(5)
    histogram = {50: 10_000}
    for _ in range(20_000):
        size = rnd.randrange(100, 1500)
        histogram[size] = histogram.get(size, 0) + 1
    assert bins(histogram) <= -(-sum(s * n for s, n in histogram.items()) // 4096) * 1.005 + 1


def test_empty_texts_share_a_sequence(make):
    got = packing.pack(make([None, ""] * 20), tokenizer_file()).collect()
    assert {r.sequence_id for r in got} == {0} and sorted(r.offset for r in got) == list(range(40))


def test_search_beats_the_first_dive():
    rnd, gained, gaps = random.Random(1), 0, 0
    for _ in range(40):
        capacity, low, high = rnd.choice([100, 150, 1000]), rnd.choice([0.05, 0.15, 0.25]), rnd.choice([0.5, 0.7, 0.95])
        histogram = {}
        for _ in range(rnd.choice([30, 60, 200])):
            size = int(rnd.uniform(low, high) * capacity)
            histogram[size] = histogram.get(size, 0) + rnd.choice([1, 1, 1, 5])
        first, searched = bins(histogram, capacity, 0), bins(histogram, capacity)
        bound = max(-(-sum(s * n for s, n in histogram.items()) // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))
        assert bound <= searched <= first
        gained, gaps = gained + first - searched, gaps + first - bound
    assert gained >= 4 and gained <= gaps


def test_search_finds_the_best_packing_of_few_pieces():
    def least(sizes, capacity):
        """Fewest bins by trying every open bin for every piece."""
        best = len(sizes)

        def put(at, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if at == len(sizes):
                best = len(rooms)
                return
            for i, room in enumerate(rooms):
                if room >= sizes[at] and room not in rooms[:i]:
                    put(at + 1, [*rooms[:i], room - sizes[at], *rooms[i + 1:]])
            put(at + 1, [*rooms, capacity - sizes[at]])
        put(0, [])
        return best

    rnd, missed = random.Random(4), 0
    for _ in range(150):
        sizes = sorted((rnd.randrange(15, 60) for _ in range(11)), reverse=True)
        histogram = {}
        for size in sizes:
            histogram[size] = histogram.get(size, 0) + 1
        missed += bins(histogram, 100) - least(sizes, 100)
    assert missed <= 1


def test_fillings_are_undominated():
    counts = {10: 1, 20: 2, 30: 1, 45: 1, 70: 1}
    found = packing._completions(75, sorted(counts), counts, 3)
    assert found[0] == (45, 30) and (70,) in found and counts == {10: 1, 20: 2, 30: 1, 45: 1, 70: 1}
    assert not any(packing._dominated(a, b) for a in found for b in found if a != b)
    assert packing._dominated((20, 20, 30), (45, 30)) and not packing._dominated((45, 30), (20, 20, 30))


def test_a_third_of_one_length_takes_places_once(make):
    rnd = random.Random(8)
    texts = ["one length only"] * 60 + [" ".join(rnd.choice(["ab", "cd efg", "hij"]) for _ in range(rnd.randrange(1, 40))) for _ in range(120)]
    got = packing.pack(make(texts), tokenizer_file(), 64).collect()
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in rows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and len({r.doc_id for r in got}) == 180
