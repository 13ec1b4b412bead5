"""Dedup of 50-byte strings: bytes covered by matches with earlier documents, by groups of equal windows in place of a suffix array."""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.common import shuffle_width
from logvigil.llm.oddsketch import mixed

LENGTH = 50
#: Bytes of an anchor: every LENGTH-byte string has one, its least hashed GRAM-byte substring.
GRAM = 25
REACH = LENGTH - GRAM
WIDE = LENGTH + REACH
#: Bytes of text in one group of documents, and that one bucket of anchors stands for.
GROUP, BUCKET = 2 << 20, 8 << 20
LAST = np.iinfo(np.int64).max
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_B = np.uint64(0x9E3779B97F4A7C15)
_PLACES = mixed(np.arange(1000, 1000 + WIDE, dtype=np.uint64)) | np.uint64(1)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling: 1, 2, 4, 8, 16, then 16 + 8 + 1."""
    h1 = _BYTES[buf]
    b2, parts, power, span = _B, {1: h1}, _B, 1
    while span < 16:
        h = parts[span]
        parts[2 * span] = h[:-span] * power + h[span:]
        power, span = power * power, 2 * span
    n = len(buf) - GRAM + 1
    b8 = b2 ** np.uint64(8)
    return mixed((parts[16][:n] * b8 + parts[8][16:16 + n]) * b2 + h1[24:24 + n])


class Anchors:
    """Anchors of a group of documents: where they are, whose, and which windows are theirs (bit d: the window d bytes before)."""

    def __init__(self, table: pa.Table, buckets: int):
        ids = table["doc_id"].to_pylist()
        texts = [t.as_py() or b"" for t in table["text"]]
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.buf) - LENGTH + 1
        at = np.concatenate([np.arange(a, a + max(0, s - LENGTH + 1)) for a, s in zip(self.starts, self.sizes)] or [np.zeros(0, np.int64)]).astype(np.int64)
        if n <= 0 or not len(at):
            self.pos, self.hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            self.mask, self.doc = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        else:
            hashes = _gram_hashes(self.buf)
            # High half: hash; low half: position, so that the leftmost of equals wins.
            low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
            for step in (1, 2, 4, 8):
                low = np.minimum(low[:-step], low[step:])
            low = np.minimum(low[:-(REACH - 15)], low[REACH - 15:])
            anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            self.pos, self.hash = anchor[first], hashes[anchor[first]]
            self.mask = np.add.reduceat(np.uint32(1) << (anchor - at).astype(np.uint32), first).astype(np.uint32)
            self.doc = np.searchsorted(self.starts + self.sizes, self.pos, side="right")
        self.bucket = ((self.hash >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.low = (self.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def names(self):
        """Distinct (bucket, low half) in order, the anchors' places in them, and how many anchors each has."""
        return np.unique((self.bucket.astype(np.uint64) << np.uint64(32)) | self.low, return_inverse=True, return_counts=True)

    def contexts(self, shared: np.ndarray):
        """Of shared anchors: the bytes of their windows (others 0), and the classes of equal contexts with their least doc_id."""
        pos, mask = self.pos[shared], self.mask[shared]
        padded = np.concatenate([np.zeros(REACH, np.uint8), self.buf, np.zeros(WIDE, np.uint8)])
        bytes_ = padded[pos[:, None] + np.arange(WIDE)]
        far = np.floor(np.log2(np.maximum(mask, 1))).astype(np.int64)
        near = np.floor(np.log2(np.maximum(mask & (~mask + np.uint32(1)), 1))).astype(np.int64)
        spot = np.arange(WIDE)
        bytes_ = np.where((spot >= (REACH - far)[:, None]) & (spot < (REACH - near + LENGTH)[:, None]), bytes_, 0).astype(np.uint8)
        name = np.zeros(len(pos), np.uint64)
        for k in range(WIDE):
            name += _BYTES[bytes_[:, k]] * _PLACES[k]
        name = mixed(name + mask.astype(np.uint64))
        ids = self.ids[self.doc[shared]]
        order = np.lexsort((ids, name, self.bucket[shared]))
        first = np.ones(len(order), bool)
        first[1:] = (name[order][1:] != name[order][:-1]) | (self.bucket[shared][order][1:] != self.bucket[shared][order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(first) - 1
        heads = order[first]
        return bytes_[heads], mask[heads], ids[heads], self.bucket[shared][heads], which, ids


def _names(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            found = Anchors(table, buckets)
            names, _, counts = found.names()
            bucket = (names >> np.uint64(32)).astype(np.int64)
            each, first = np.unique(bucket, return_index=True)
            ends = [*first[1:], len(names)]
            low = (names & np.uint64(0xFFFFFFFF)).astype("<u4")
            return pa.table({"g": pa.array([table["g"][0].as_py()] * len(each), pa.int64()), "bucket": pa.array(each, pa.int64()),
                             "low": pa.array([low[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                             "many": pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in zip(first, ends)], pa.binary())})
    return run


def _shared(table: pa.Table) -> pa.Table:
    """One bucket of anchor names: for each group a bitmap of those that occur elsewhere too, or more than once in it."""
    lows = [np.frombuffer(x.as_py(), "<u4") for x in table["low"]]
    values, counts = np.unique(np.concatenate(lows), return_counts=True)
    twice = values[counts > 1]
    bits = [np.isin(low, twice, assume_unique=True) | np.unpackbits(np.frombuffer(many.as_py(), np.uint8), count=len(low)).astype(bool)
            for low, many in zip(lows, table["many"])]
    return pa.table({"g": table["g"], "bucket": table["bucket"], "kind": pa.array([0] * len(lows), pa.int32()),
                     "body": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _chosen(found: Anchors, marks: pa.Table) -> np.ndarray:
    """Which anchors are shared, from the bitmaps of the group."""
    names, which, _ = found.names()
    bucket = (names >> np.uint64(32)).astype(np.int64)
    shared = np.zeros(len(names), bool)
    for b, body in zip(marks["bucket"].to_pylist(), marks["body"]):
        a, z = np.searchsorted(bucket, b), np.searchsorted(bucket, b, side="right")
        shared[a:z] = np.unpackbits(np.frombuffer(body.as_py(), np.uint8), count=z - a).astype(bool)
    return shared[which] if len(names) else np.zeros(0, bool)


def _contexts(buckets: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            out = {"g": [], "bucket": [], "mask": [], "ids": [], "body": []}
            if docs.num_rows:
                found = Anchors(docs, buckets)
                body, mask, ids, bucket, _, _ = found.contexts(_chosen(found, marks))
                each, first = np.unique(bucket, return_index=True)
                for b, a, z in zip(each, first, [*first[1:], len(bucket)]):
                    for key, value in (("g", docs["g"][0].as_py()), ("bucket", int(b)), ("mask", mask[a:z].tobytes()), ("ids", ids[a:z].tobytes()), ("body", body[a:z].tobytes())):
                        out[key].append(value)
            return pa.table({k: pa.array(v, pa.int64() if k in ("g", "bucket") else pa.binary()) for k, v in out.items()})
    return run


def previous_factors(windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows of LENGTH bytes also stand in a document with a smaller id.

    Equal windows form a run in sorted order; those above the run's least id have a previous factor of LENGTH bytes or more.
    No suffix array or common-prefix lengths are built: only whether LENGTH is reached matters.
    """
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{LENGTH}")[:, 0], kind="stable")
    inside = (windows[order][1:] == windows[order][:-1]).all(1)
    starts = np.flatnonzero(np.concatenate([[True], ~inside]))
    least = np.minimum.reduceat(ids[order], starts)
    run = np.cumsum(np.concatenate([[True], ~inside])) - 1
    out = np.empty(len(ids), bool)
    out[order] = ids[order] > least[run]
    return out


def _factors(table: pa.Table) -> pa.Table:
    """One bucket: for each group and context, which of its windows have a previous factor."""
    masks = [np.frombuffer(x.as_py(), np.uint32) for x in table["mask"]]
    mask = np.concatenate(masks)
    ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["ids"]])
    body = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(-1, WIDE) for x in table["body"]])
    flags = np.zeros(len(mask), np.uint32)
    # Windows of one anchor are compared among themselves; slices of whole anchors, by their bytes, bound the memory.
    anchor = np.ascontiguousarray(body[:, REACH:REACH + GRAM]).view(f"S{GRAM}")[:, 0]
    order = np.argsort(anchor, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
    at = 0
    while at < len(order):
        until = heads[np.searchsorted(heads, at + 50_000)] if at + 50_000 <= heads[-1] else len(order)
        part = order[at:until]
        for d in range(REACH + 1):
            has = part[(mask[part] >> np.uint32(d)) & np.uint32(1) == 1]
            if len(has) > 1:
                found = previous_factors(body[has, REACH - d:REACH - d + LENGTH], ids[has])
                flags[has] |= found.astype(np.uint32) << np.uint32(d)
        at = until
    cuts = np.cumsum([0, *map(len, masks)])
    return pa.table({"g": table["g"], "bucket": table["bucket"], "kind": pa.array([1] * len(masks), pa.int32()),
                     "body": pa.array([flags[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())})


def _cleaned(buckets: int, with_text: bool):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            if not docs.num_rows:
                return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
            found = Anchors(docs, buckets)
            kind = marks["kind"].to_numpy()
            chosen = _chosen(found, marks.filter(pa.array(kind == 0)))
            _, mask, heads, bucket, which, ids = found.contexts(chosen)
            flags = np.zeros(len(mask), np.uint32)
            for b, body in zip(marks["bucket"].to_numpy()[kind == 1], marks.filter(pa.array(kind == 1))["body"]):
                flags[bucket == b] = np.frombuffer(body.as_py(), np.uint32)
            # A context that a smaller id of this very group has as well is covered whole.
            own = np.where(ids > heads[which], mask[which], flags[which]) if len(which) else np.zeros(0, np.uint32)
            change = np.zeros(len(found.buf) + 1, np.int32)
            for d in range(REACH + 1):
                starts = found.pos[chosen][(own >> np.uint32(d)) & np.uint32(1) == 1] - d
                np.add.at(change, starts, 1)
                np.add.at(change, starts + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            rows = []
            for doc_id, a, size in zip(docs["doc_id"].to_pylist(), found.starts, found.sizes):
                part = gone[a:a + size]
                kept = found.buf[a:a + size][~part].tobytes()
                spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum())
                rows.append((doc_id, int(size), int(part.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            return pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})
    return run


def remove_repeats(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """Removes every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Every 50-byte string has an anchor, its least hashed 25-byte substring, so equal strings meet under equal anchors. Documents
    are dealt into groups of about GROUP bytes once; groups send the names of their anchors to hash buckets and get back
    which are shared. Only windows of shared anchors are sent on, each distinct context of a group once with its least
    id, however many of its documents hold it. Buckets sort these windows and group equal ones, and
    the groups cut their texts. The four steps read one shuffle of the texts.

    Null text: empty. Texts under 50 bytes lose nothing. Null doc_ids count as the largest; rows of one id never remove
    each other. Empty table: no rows. ``with_text`` adds the remaining bytes. Further columns are not read.
    """
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    groups, buckets = max(1, ceil(total / GROUP)), max(1, ceil(total / BUCKET))
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).cast("long")).repartition(shuffle_width(documents.sparkSession), "g")
    marks = dealt.groupBy("g").applyInArrow(_names(buckets), "g long, bucket long, low binary, many binary").groupBy("bucket").applyInArrow(
        _shared, "g long, bucket long, kind int, body binary")
    contexts = dealt.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(_contexts(buckets), "g long, bucket long, mask binary, ids binary, body binary")
    factors = contexts.groupBy("bucket").applyInArrow(_factors, "g long, bucket long, kind int, body binary")
    out = dealt.groupBy("g").cogroup(marks.unionByName(factors).groupBy("g")).applyInArrow(
        _cleaned(buckets, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
