"""Sharding, fingerprints and mixing against plain definitions on small fixtures."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from logvigil.llm import fingerprints, mixing, sharding

ODD = [None, "", "  \n", "one", "two words", "Größe über alles 😀 " * 30, "same text", "same text", "word " * 20_000, "a b c d e f g"]


def test_domain_covers_and_walk_is_short():
    for n in [1, 2, 3, 5, 40, 997, 10_007, 123_456_789]:
        a, b = sharding.domain(n)
        assert a * b >= n and a * b - n < a


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.permuted(sharding.F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        assert got != list(range(n))


def test_shards(make):
    rows = [(i, f"text {i}" if i % 7 else None, "s") for i in range(500)] + [(3, "text 3", "s"), (None, "x", None)]
    df = make(rows)
    got = sharding.shard(df).collect()
    assert len(got) == 502
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert len(per) == 40 and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    again = sharding.shard(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_tables(make):
    empty = make([])
    assert sharding.shard(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def test_fingerprints(make):
    texts = ODD + [f"{i} the quick brown fox jumps over lazy dog number {i * i} again and again {i % 3}" for i in range(60)]
    rows = [(i * 3, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(make(rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    prints = {}
    for (i, text, _), (after, following, _) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        tail = len(text) // 3
        edited = text[:len(text) - tail] + following[:tail]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        a, b = (set(re.findall(".{15}", got[x].fingerprint)) for x in (i, after))
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert len(got[8 * 3].fingerprint) == 15


def test_sketch_keeps_its_fraction(spark):
    text = " ".join(f"w{i}" for i in range(40_000))
    size = spark.createDataFrame([(text,)], "text string").select(fingerprints.F.size(fingerprints.sketch(fingerprints.F.col("text"))).alias("n")).first().n
    assert abs(size / 39_996 - 1 / fingerprints.KEEP_ONE_IN) < 0.02


def test_mix(make):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{0 if i % 3 == 0 else i % 11}") for i in range(900)]
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "lonely words", None), (5, "w " * 50, "s5")]
    got = mixing.mix(make(rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= above
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    again = mixing.mix(make(rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
