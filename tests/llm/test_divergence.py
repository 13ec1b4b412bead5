"""The source audit against a version over dense tables of all terms."""

import random
import re
from collections import Counter

import pytest

from logvigil.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, doc_id int, term int, p string, value long"


def plain(rows, threshold, top):
    rows = [tuple(c or "" for c in row[:3]) for row in rows]
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text)] for text, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, counts, whole = Counter(), {}, Counter()
        for (_, own, source), found in zip(rows, words):
            if own == lang:
                docs.update(set(found))
                counts.setdefault(source, Counter()).update(found)
                whole.update(found)
        kept = [w for w, n in docs.items() if n >= threshold]

        def shares(n):
            total = sum(n[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10 ** 9 * (n[w] + 2) // total for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        q, p = shares(whole), {s: shares(n) for s, n in counts.items()}
        for s in counts:
            pair = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(found, key=lambda e: (-e[1], e[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def random_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abéñ大", k=rng.randrange(1, 14))) for _ in range(80)] + ["the", "them", "themselves", "Ab_c", "x1y"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randrange(12))).title()
        rows.append((rng.choice([text, text, text, None, ""]) if i % 5 == 0 else text, rng.choice(["en", "en", "de", None]),
                     rng.choice(["s0"] * 4 + ["s1", "s2", None]), i, 1, "x", 2))
    return rows


@pytest.mark.parametrize("blocks, bits", [(8 << 20, 1 << 24), (300, 1 << 16)])
def test_against_dense_tables(spark, monkeypatch, blocks, bits):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(divergence, "FILTER_BITS", bits)
    rows = random_rows(blocks % 7, 260)
    rows += [rows[3]] * 90                                        # a third of the table is one row
    rows.append(("solo", "fr", "s9", 1, 1, "x", 2))               # a language without kept terms, one source
    rows += [("un", "it", "a", 1, 1, "x", 2), ("du", "it", "b", 1, 1, "x", 2), (None, "it", "c", 1, 1, "x", 2)]
    rows.append(("the " * 100_000, "en", "s2", 1, 1, "x", 2))     # a very long text
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows, 10, 10)


def test_ties_and_small_threshold(spark):
    rows = [("b a", "en", "x", 0, 0, "", 0), ("a b", "en", "y", 0, 0, "", 0), ("c é z", "en", "x", 0, 0, "", 0)]
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA), threshold=1, top=2)) == plain(rows, 1, 2)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels_drop_rare_prefixes(spark):
    """A level counts distinct documents, and only among terms whose shorter prefix survived."""
    rows = [(f"common rare{i:c}".replace(f"{i:c}", chr(97 + i)), "en", "s", i, 0, "", 0) for i in range(9)] + [("common commons", "en", "s", 9, 0, "", 0)]
    blocks = divergence.index_terms(spark.createDataFrame(rows, SCHEMA))
    first = divergence.count_prefixes(blocks, 2, 0, None)
    def named(df):
        return {(r.prefix.to_bytes(8, "big").rstrip(b"\0") if isinstance(r.prefix, int) else bytes(r.prefix), r.docs) for r in df.collect()}

    assert named(first) == {(b"co", 10), (b"ra", 9)}
    keep = divergence.filter_of(first.filter("docs >= 10"))
    assert named(divergence.count_prefixes(blocks, 7, 2, keep)) == {(b"common", 10), (b"commons", 1)}
    assert named(divergence.count_prefixes(blocks, 1 << 30, 2, keep)) == {(b"common", 10), (b"commons", 1)}
