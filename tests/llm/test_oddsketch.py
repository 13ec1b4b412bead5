"""Near duplicates against all pairs of full sets."""

import random
import re

import pytest

from logvigil.llm import oddsketch, packing
from logvigil.llm.queries import tokenizer_file


def brute(rows, width, percent):
    sets = {}
    for doc_id, text, _ in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[doc_id] = {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [1024, 4])
def test_components(make, monkeypatch, block):
    monkeypatch.setattr(oddsketch.across, "__defaults__", (block,))
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["Größe", "the", "THE"]
    rows, texts = [], [None, "", " \n\t", "one", "ONE", "one two", "ONE  two", "a b " * 5000]
    for _ in range(12):
        text = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 200]))]
        texts.append(" ".join(text))
        for _ in range(rnd.choice([1, 3, 25])):
            text = [rnd.choice(words) if rnd.random() < 0.03 else w for w in text]
            texts.append("\n".join(text))
    rnd.shuffle(texts)
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)] + [(None, "one", "s")]
    got = oddsketch.near_duplicates(make(rows), width=2).collect()
    want = brute(rows[:-1], 2, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert oddsketch.near_duplicates(make([])).count() == 0


def test_packing(make):
    rnd = random.Random(9)
    texts = [None, "", "a<|endoftext|>b", "word " * 9000] + ["it's " * rnd.randrange(1, 900) for _ in range(200)]
    got = packing.pack(make(texts), tokenizer_file()).collect()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_file())
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    import zlib
    import numpy as np
    seen, room = {i: 0 for i in ids}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == seen[r.doc_id] and r.length <= 4096
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(room) <= -(-sum(seen.values()) // 4096) * 1.02 + 1
    assert packing.pack(make([]), tokenizer_file()).count() == 0


def test_plan_uses_every_length():
    rnd = random.Random(3)
    for top in (1, 7, 100):
        histogram = {rnd.randrange(1, top + 1): rnd.randrange(1, 40) for _ in range(30)}
        used = {}
        for filling, times in packing.plan(dict(histogram), top + 5):
            assert sum(filling) <= top + 5
            for size in filling:
                used[size] = used.get(size, 0) + times
        assert used == histogram
