"""Removed bytes against a dictionary of all 50-byte strings."""

import hashlib
import random

from logvigil.llm import suffixes


def brute(rows):
    least = {}
    data = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t, _ in rows]
    for i, b in data:
        for s in range(len(b) - 49):
            w = b[s:s + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for (key, b), (doc_id, _, _) in zip(data, rows):
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if least[b[s:s + 50]] < key:
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_removed_bytes(make, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 20_000)
    monkeypatch.setattr(suffixes, "BUCKET", 30_000)
    rnd = random.Random(2)
    plain = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passages = [plain(n) for n in (49, 50, 51, 60, 75, 200, 1000)] + ["ab" * 60, "z" * 130]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "\0" * 60, "\0" * 80, plain(200), plain(200)]
    for _ in range(120):
        texts.append("".join(rnd.choice([plain(rnd.randrange(80)), rnd.choice(passages)]) for _ in range(rnd.randrange(6))))
    texts += [texts[40]] * 30 + [texts[41][3:]] * 3
    rnd.shuffle(texts)
    rows = [(500 - 2 * i, t, "s") for i, t in enumerate(texts)] + [(500, passages[6], "s"), (None, passages[6], "s"), (None, passages[5], None)]
    got = suffixes.remove_repeats(make(rows)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert suffixes.remove_repeats(make([])).count() == 0


def test_repeat_inside_one_document_stays(make):
    row = suffixes.remove_repeats(make(["same words again and again, over sixty bytes of them in all. " * 3])).first()
    assert row.n_removed == 0 and row.n_spans == 0
