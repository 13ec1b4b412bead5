"""Whole repeated passages are removed and chance repeats stay, judged from the planted texts alone."""

import hashlib
import random

from logvigil.llm import chunks


def prose(rnd, words):
    return " ".join("".join(rnd.choice("etaoinsrhldcu") for _ in range(rnd.randrange(2, 9))) for _ in range(words))


def test_passages(make):
    rnd = random.Random(11)
    clean = [prose(rnd, 900) for _ in range(60)]
    planted = [prose(rnd, 51) for _ in range(60)]
    # "<", ">" and "[", "]" occur nowhere else, so a passage ends exactly at them.
    first = [f"{prose(rnd, 80)} <{p}> {prose(rnd, 80)}" for p in planted]
    later = [(f"{prose(rnd, 70)} [", p, f"] {prose(rnd, 60)}") for p in planted]
    odd = [None, "", "x", "x", clean[0], "é" * 500, "ab" * 3000]
    texts = clean + first + ["".join(x) for x in later] + odd
    got = {r.doc_id: r for r in chunks.remove_passages(make(texts)).collect()}
    assert len(got) == len(texts)

    def holds(i, kept):
        assert got[i].n_bytes == len((texts[i] or "").encode()) and got[i].n_removed == got[i].n_bytes - len(kept.encode())
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()

    for i in range(120):
        holds(i, texts[i])
    for i, (head, _, tail) in enumerate(later, 120):
        holds(i, head + tail)
    # A text that only repeats itself keeps its beginning; how much depends on where its cuts fall.
    for i, kept in zip(range(180, 185), ["", "", "x", "", ""], strict=True):
        holds(i, kept)
    for i in (185, 186):
        assert got[i].kept_sha256 in {hashlib.sha256(texts[i].encode()[:n]).hexdigest() for n in [got[i].n_bytes - got[i].n_removed]}
        assert got[i].n_removed < got[i].n_bytes
    assert chunks.remove_passages(make([])).count() == 0


def test_rows_of_one_id(make):
    """Different texts under one id lose only what stands before, equal rows count as one document."""
    rnd = random.Random(4)
    a, b = prose(rnd, 200), prose(rnd, 200)
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (7, b, "s"), (5, b, "s"), (None, b, "s"), (None, b, "s")]
    got = sorted((r.doc_id or 0, r.n_bytes - r.n_removed) for r in chunks.remove_passages(make(rows)).collect())
    assert got == sorted([(1, len(a)), (5, 0), (5, len(b)), (5, len(b)), (7, 0), (0, len(b)), (0, len(b))])
