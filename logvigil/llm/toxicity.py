"""Toxicity: a convolutional text classifier over hashed words, trained in numpy, with thresholds by language."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.llm.oddsketch import word_hashes

DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
#: Most rows of each label that are fetched for fitting, most words of one that are used, most words with an embedding.
SAMPLE, WORDS, VOCABULARY = 1500, 5000, 1 << 16
HELD_OUT_MOD = 5
#: Function words by which a text's language is told.
TONGUES = {
    "en": "the and of to in is that it for with was on are as at by this from".split(),
    "de": "der die und das ist nicht ein eine zu den mit von auf für sich im des dem".split(),
    "fr": "le la les et des est un une que pour dans qui par sur pas avec du au".split(),
    "es": "el los las y es un una que por para con del se no en su al lo".split(),
}


@dataclass
class Network:
    keys: np.ndarray                  # sorted hashes of the words with an embedding
    tongues: np.ndarray               # len(keys) + 1 x languages: function words
    table: np.ndarray                 # len(keys) + 1 x DIM embeddings; the first stands for all other words and stays 0
    filters: dict[int, np.ndarray]    # width -> (width * DIM) x FILTERS
    bias: np.ndarray                  # one per filter of each width
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, tuple[float, float]]  # language -> (logit counted as 0.5, scale)


_SIGNS = bytes(32 if chr(i) in ".,;:!?\"()[]<>*_/" else i for i in range(256))


def slots(text: bytes) -> np.ndarray:
    """32-bit hashes of the words without the signs around them, A-Z lower-cased."""
    return (word_hashes(text.translate(_SIGNS)) >> np.uint64(32)).astype(np.uint32)


def indexed(net: Network, hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(net.keys, hashes), len(net.keys) - 1)
    return np.where(net.keys[at] == hashes, at + 1, 0)


def tongue(net: Network, words: np.ndarray) -> str:
    """The language whose function words the text has most of; told from the text alone."""
    hits = net.tongues[words].sum(0)
    return list(TONGUES)[int(hits.argmax())] if len(words) and hits.max() else "none"


def start(examples: list[tuple[np.ndarray, int]], rnd: np.random.Generator) -> Network:
    """Vocabulary and first weights. One dimension of each embedding starts at the word's log odds between the labels."""
    seen = [np.unique(h) for h, _ in examples]
    labels = np.array([y for _, y in examples])
    function = {name: slots(" ".join(words).encode()) for name, words in TONGUES.items()}
    keys, n = np.unique(np.concatenate([*seen, np.zeros(0, np.uint32)]), return_counts=True)
    often = keys[np.argsort(-n, kind="stable")[:VOCABULARY]]
    keys = np.unique(np.concatenate([often[np.isin(often, keys[n > 1])], *function.values()]))
    rows = len(keys) + 1
    net = Network(keys, np.zeros((rows, len(TONGUES)), np.float32), rnd.normal(0, 0.05, (rows, DIM)).astype(np.float32),
                  {w: rnd.normal(0, 0.1, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
                  np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -1.0, {})
    for k, hashes in enumerate(function.values()):
        net.tongues[indexed(net, hashes), k] = 1
    counts = np.zeros((2, rows))
    for hashes, label in zip(seen, labels):
        counts[label][indexed(net, hashes)] += 1
    share = (counts + 0.5) / np.maximum(1, np.array([[np.sum(labels == y)] for y in (0, 1)]) + 1)
    net.table[:, 0] = np.log(share[1] / share[0]) / 3
    net.table[0] = 0
    for width in WIDTHS:
        net.filters[width][::DIM] += 0.5
    return net


def _pooled(net: Network, words: np.ndarray):
    """Max over positions of every filter, and where it was. Texts are padded so that each width has a position."""
    vectors = net.table[words]
    pools, places = [], []
    for width in WIDTHS:
        n = max(len(words), width)
        padded = np.zeros((n, DIM), np.float32)
        padded[:len(words)] = vectors
        positions = n - width + 1
        scores = padded[:positions] @ net.filters[width][:DIM]
        for k in range(1, width):
            scores += padded[k:k + positions] @ net.filters[width][k * DIM:(k + 1) * DIM]
        best = scores.argmax(0)
        pools.append(scores[best, np.arange(FILTERS)])
        places.append(best)
    return np.concatenate(pools) + net.bias, places


def logit(net: Network, words: np.ndarray, block: int = 20_000) -> float:
    """Long texts go through in overlapping blocks; the maximum over blocks is the maximum over the text."""
    top = None
    for at in range(0, max(1, len(words)), block):
        pooled, _ = _pooled(net, words[at:at + block + max(WIDTHS) - 1])
        top = pooled if top is None else np.maximum(top, pooled)
    return float(np.maximum(top, 0) @ net.out + net.out_bias)


def fit(examples: list[tuple[np.ndarray, int]], seed: int = 10, epochs: int = 3, rate: float = 0.05) -> Network:
    """Adam, one example at a time; only the pooled positions of each filter get gradients, so a step is cheap."""
    rnd = np.random.default_rng(seed)
    net = start(examples, rnd)
    examples = [(indexed(net, hashes), label) for hashes, label in examples]
    share = np.mean([label for _, label in examples])
    weight = (0.5 / max(1 - share, 1e-3), 0.5 / max(share, 1e-3))
    squares = np.full(len(net.table), 1e-2, np.float32)     # AdaGrad: one scale per word, one per dense array
    dense = {"out": 1e-3, "bias": 1e-3, **{w: 1e-3 for w in WIDTHS}}
    for epoch in range(epochs):
        for at in rnd.permutation(len(examples)):
            words, label = examples[at]
            pooled, places = _pooled(net, words)
            live = np.maximum(pooled, 0)
            z = float(live @ net.out + net.out_bias)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight[label]
            if abs(slope) < 1e-3:
                continue
            back = slope * net.out * (pooled > 0)
            steps = {"out": slope * live, "bias": back}
            net.out_bias -= rate * slope
            for k, width in enumerate(WIDTHS):
                part = back[k * FILTERS:(k + 1) * FILTERS]
                seen = np.zeros((width * DIM, FILTERS), np.float32)
                for f in np.flatnonzero(part):
                    for j in range(width):
                        if places[k][f] + j >= len(words):
                            continue
                        word = words[places[k][f] + j]
                        if not word:
                            continue
                        rows = slice(j * DIM, (j + 1) * DIM)
                        seen[rows, f] = part[f] * net.table[word]
                        change = part[f] * net.filters[width][rows, f]
                        squares[word] += float(change @ change)
                        net.table[word] -= rate * change / np.sqrt(squares[word])
                dense[width] += float((seen ** 2).sum()) / seen.size
                net.filters[width] -= 0.1 * rate * seen / np.sqrt(dense[width])
            for name, step in steps.items():
                dense[name] += float(step @ step) / len(step)
                setattr(net, name, getattr(net, name) - 0.1 * rate * step / np.sqrt(dense[name]))
    return net


def calibrate(net: Network, examples: list[tuple[np.ndarray, int]], least: int = 30) -> None:
    """Per language, the logit at which both labels are told apart best; it becomes score 0.5. Few examples: all of them."""
    rows = [(tongue(net, words), logit(net, words), label) for words, label in ((indexed(net, h), y) for h, y in examples)]
    for name in [*TONGUES, "none", ""]:
        own = [(z, y) for t, z, y in rows if t == name]
        if name == "" or min(sum(y for _, y in own), sum(1 - y for _, y in own)) < least:
            own = [(z, y) for _, z, y in rows]
        own.sort()
        z, y = np.array([a for a, _ in own]), np.array([b for _, b in own])
        if not len(z) or y.min() == y.max():
            net.thresholds[name] = (0.0, 1.0)
            continue
        # Balanced error of cutting before each value; the cut lies in the middle of the best gap.
        toxic_below = np.concatenate([[0], np.cumsum(y)]) / y.sum()
        clean_below = np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
        error = toxic_below + 1 - clean_below
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        best = np.flatnonzero(error <= error.min() + 1e-9)
        net.thresholds[name] = (float(edges[best[len(best) // 2]]), max(float(z.std()), 1e-3))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fits on at most ``sample`` labelled rows of each label, the first by a hash of the id; held-out ids are never read.

    An example is the text's words, of a very long text WORDS consecutive ones around its middle (the score uses all).
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_MOD != 0).select("doc_id", "toxic")
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample ids: a bounded table.
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def shortened(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                words = [slots(t.as_py() or b"") for t in batch.column(1)]
                words = [w if len(w) <= WORDS else w[(len(w) - WORDS) // 2:][:WORDS] for w in words]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([w.tobytes() for w in words], pa.binary())],
                                                 names=["doc_id", "toxic", "words"])

    rows = texts.mapInArrow(shortened, "doc_id long, toxic int, words binary").orderBy(F.xxhash64("doc_id"), "doc_id", "words").limit(2 * sample).collect()
    examples = [(np.frombuffer(r["words"], np.uint32), r["toxic"]) for r in rows]
    if not examples:
        net = fit([(np.zeros(0, np.uint32), 0)], epochs=0)
        net.thresholds = {"": (1.0, 1.0)}
        return net
    kept = examples[::5] if len(examples) >= 50 else examples
    net = fit([e for i, e in enumerate(examples) if i % 5] if len(examples) >= 50 else examples)
    calibrate(net, kept)
    return net


def score(net: Network, text: bytes | None) -> float:
    words = indexed(net, slots(text or b""))
    middle, scale = net.thresholds.get(tongue(net, words)) or net.thresholds[""]
    return float(1 / (1 + np.exp(-np.clip(4 * (logit(net, words) - middle) / scale, -30, 30))))


def scored(documents: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) over whole texts. Null and empty texts have the score of no words."""
    shipped = documents.sparkSession.sparkContext.broadcast(pickle.dumps(net))   # at most VOCABULARY rows: a few MB

    def run(batches):
        model = pickle.loads(shipped.value)
        with np.errstate(over="ignore"):
            for batch in batches:
                marks = [score(model, text.as_py()) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def kept_below(documents: DataFrame, net: Network, limit: float) -> DataFrame:
    """Whole rows whose text scores below the limit, in one pass without a shuffle."""
    shipped = documents.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    column = documents.columns.index("text")

    def run(batches):
        model = pickle.loads(shipped.value)
        with np.errstate(over="ignore"):
            for batch in batches:
                keep = [score(model, (t.as_py() or "").encode()) < limit for t in batch.column(column)]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction for every document; labels of held-out ids are never read, and none is an input of a score.

    Null and empty texts are scored as texts without words. Null doc_ids are scored, not held out. Repeated rows get
    equal scores. Without usable labels every score is below 0.5. Empty table: no rows. Further columns are not read.
    """
    net = train(documents, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_MOD == 0, F.lit(False))
    return scored(documents, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
