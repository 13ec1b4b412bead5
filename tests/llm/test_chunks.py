"""Chunk dedup against a walk over the documents in order."""

import hashlib

import numpy as np

from logvigil.llm import chunks


def test_chunks(make):
    base = "a passage of words that will come back in other documents, shifted by what stands before it; " * 4
    texts = [None, "", "x", base, "inserted " + base, base + "tail", base, "other text " * 40, "é" * 500]
    got = {r.doc_id: r for r in chunks.remove_chunks(make(texts)).collect()}
    seen = set()
    for i, text in enumerate(texts):
        raw, at, kept = (text or "").encode(), 0, b""
        for end in chunks.cuts(np.frombuffer(raw, np.uint8)).tolist():
            if raw[at:end] not in seen:
                kept += raw[at:end]
            seen.add(raw[at:end])
            at = end
        assert (got[i].n_bytes, got[i].n_removed) == (len(raw), len(raw) - len(kept))
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert got[6].n_removed == len(base) and chunks.remove_chunks(make([])).count() == 0
