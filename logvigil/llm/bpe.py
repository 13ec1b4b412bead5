"""BPE by speculation: greedy longest-match tokens, adjacent pairs checked in bulk, exact merging only where a check fails.

Why the check is enough: merging takes the lowest rank first and, among equal ranks, the leftmost place. As long as no merge
crosses a border between two proposed tokens, each of them is merged as if it stood alone, so the first merge that crosses a
border also crosses it when only the two tokens beside it are merged. If no adjacent pair merges over its border, and each
token alone merges into itself, the proposal is therefore what merging gives. Tokens that do not merge into themselves
can never come out and are not proposed.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Below this the tokenizer's own Unicode tables and Python's agree on every character (a test compares them). Parts of a text with
#: later characters, marks or apostrophes are normalised and split by the tokenizer's own steps.
SAFE = 0x530
#: Symbol of a byte that ends a word: the byte plus 256. The vocabulary starts with the 256 bytes, then the same as word ends.
END = 256
#: Words that one half of the table of remembered words holds. When it is full it becomes the older half, and what was
#: the older half is forgotten unless met again, so frequent words stay and memory is bounded.
REMEMBERED = 200_000
#: Words longer than this many bytes are proposed and merged one by one instead of in bulk.
LONG = 48
#: Rows leave a task in batches of about this many bytes.
OUT_BYTES = 8 << 20


class Lookup:
    """Non-negative integer keys to integers in an open hash table; every step works on whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            rows = left[free][first]
            self.keys[taken], self.values[taken] = keys[rows], values[rows]
            still = self.keys[slot] != keys[left]
            left, slot = left[still], (slot[still] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot_open = (slot[open_] + np.uint64(1)) & self.mask
            slot[open_] = slot_open
            held = self.keys[slot_open]
            out[open_] = np.where(held == keys[open_], self.values[slot_open], np.int32(-1))
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return out


def _bytes_of_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Bpe:
    """A BPE with word ends and a rank per merge, read from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError("the tokenizer file is not a BPE with word ends and plain decoding")
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_of = _bytes_of_characters()
        # Of the characters in the safe range: 0 white space, 1 letters, 2 numbers, which are words of their own, 3 all others.
        # Marks may compose with the character before, so they are left to the tokenizer's own steps as well.
        self.kinds, self.own_steps = np.full(SAFE, 3, np.int8), np.ones(SAFE + 1, bool)
        for i in range(SAFE):
            character = chr(i)
            kind = unicodedata.category(character)[0]
            self.own_steps[i] = character == "'" or "M" in kind or max(map(ord, unicodedata.normalize("NFC", character).lower())) >= SAFE
            self.kinds[i] = 1 if kind == "L" else 2 if kind == "N" else 0 if character.isspace() and not "\x1c" <= character <= "\x1f" else 3
        vocab: dict[str, int] = model["vocab"]
        self.surface = surfaces(path)
        size = len(self.surface)
        self.symbol_id = np.full(512, -1, np.int32)
        for character, byte in self.byte_of.items():
            self.symbol_id[byte], self.symbol_id[byte + END] = vocab[character], vocab[character + "</w>"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.left, self.right, self.rank = (np.full(size, -1, np.int64) for _ in range(3))
        self.left[made], self.right[made], self.rank[made] = left, right, np.arange(len(merges))
        if len(set(made.tolist())) != len(made) or (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(merges))).any():
            raise ValueError("every token must have one merge, later than those of its parts")
        self.size = size
        self.merged = Lookup(left * size + right, made)
        self.merge_of = {(a, b): (r, c) for r, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        # Tokens that merge into themselves: both parts do, and nothing crosses their border before the token's own merge.
        alone = self.symbol_id.tolist()
        whole = np.zeros(size, bool)
        whole[alone] = True
        early = self._crossing(left, right) < np.arange(len(merges))
        for a, b, c, bad in zip(left.tolist(), right.tolist(), made.tolist(), early.tolist()):
            whole[c] = whole[a] and whole[b] and not bad
        self._plant(vocab, whole)

    def _plant(self, vocab: dict[str, int], whole: np.ndarray) -> None:
        """The tree of proposable tokens: (node, symbol) to node, and the token that ends at a node."""
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for word, i in vocab.items():
            if not whole[i]:
                continue
            symbols = [self.byte_of[c] for c in word.removesuffix("</w>")]
            if word.endswith("</w>"):
                symbols[-1] += END
            at = 0
            for s in symbols:
                nxt = nodes.setdefault((at, s), len(ends))
                if nxt == len(ends):
                    ends.append(-1)
                at = nxt
            ends[at] = i
        keys = np.array([a * 512 + s for a, s in nodes], np.int64)
        self.step, self.ends = Lookup(keys, np.array(list(nodes.values()), np.int64)), np.array(ends, np.int32)
        self.nodes = nodes

    def _crossing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lowest rank of a merge over the border of each pair of tokens, when the two are merged alone; a large number where none is.

        The pieces beside the border are followed back in time, from the whole tokens to single symbols: the piece made later
        is undone first. A merge of the two pieces happens if its rank comes before the one that took either piece
        up; at equal ranks the left one goes first.
        """
        none = np.int64(1) << 40
        found = np.full(len(x), none)
        x, y, limit, at = x.astype(np.int64), y.astype(np.int64), np.full(len(x), none), np.arange(len(x))
        while len(at):
            made = self.merged(x * self.size + y)
            rank = np.where(made >= 0, self.rank[made], none)
            hit = rank < limit
            found[at[hit]] = rank[hit]
            by, bx = self.rank[y], self.rank[x]
            undo_left = bx > by
            limit = np.where(undo_left, bx, by + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
            go = (x >= 0) & (y >= 0)
            x, y, limit, at = x[go], y[go], limit[go], at[go]
        return found

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stays as it is."""
        return self._crossing(x, y) >= (1 << 40)

    def propose(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words side by side: (word, token id) in order of words and of tokens in a word."""
        words, ids = [], []
        word, at, stop = np.arange(len(start)), start.copy(), end
        node, best, best_at = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64), start.copy()
        while len(word):
            inside = at < stop
            nxt = np.where(inside, self.step(node * 512 + symbols[np.minimum(at, len(symbols) - 1)]), -1).astype(np.int64)
            on = nxt >= 0
            node, at = np.where(on, nxt, 0), np.where(on, at + 1, at)
            token = np.where(on, self.ends[node], -1)
            best, best_at = np.where(token >= 0, token, best), np.where(token >= 0, at, best_at)
            stuck = np.flatnonzero(~on)
            if len(stuck):
                words.append(word[stuck])
                ids.append(best[stuck])
                at[stuck] = best_at[stuck]
                best[stuck] = -1
                more = on | (best_at < stop)
                word, at, stop, node, best, best_at = (a[more] for a in (word, at, stop, node, best, best_at))
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, ids = np.concatenate(words), np.concatenate(ids)
        order = np.argsort(words, kind="stable")
        return words[order], ids[order]

    def propose_one(self, symbols: list[int]) -> list[int]:
        """Greedy longest matches of one long word."""
        out, at = [], 0
        while at < len(symbols):
            node, look, best, best_at = 0, at, -1, at
            while look < len(symbols) and (node := self.nodes.get((node, symbols[look]), -1)) >= 0:
                look += 1
                if self.ends[node] >= 0:
                    best, best_at = int(self.ends[node]), look
            out.append(best)
            at = best_at
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging of one word: lowest rank first, then leftmost; a heap keeps long words near n log n."""
        ids = self.symbol_id[symbols].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := self.merge_of.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge_of[a, b][1], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if m := self.merge_of.get((ids[i], ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[j]]))
            if before[i] >= 0 and (m := self.merge_of.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], ids[i]))
        return [i for i in ids if i >= 0]

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of x and y, a large number where there is none."""
        made = self.merged((x.astype(np.int64) * self.size + y).ravel()).reshape(x.shape)
        return np.where((made >= 0) & (x >= 0) & (y >= 0), self.rank[made], 1 << 30).astype(np.int32)

    def merge_many(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words side by side, one merge of each word a step: (word, id) in order."""
        words, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(length, kind="stable")
        for part in np.split(order, range(8192, len(order), 8192)):
            width = int(length[part].max(initial=1))
            place = np.arange(width)
            used = place < length[part][:, None]
            ids = np.full((len(part), width + 1), -1, np.int32)
            ids[:, :width][used] = self.symbol_id[symbols[(start[part][:, None] + place)[used]]]
            ranks = np.full((len(part), width + 1), 1 << 30, np.int32)
            ranks[:, :width] = self._ranks(ids[:, :-1], ids[:, 1:])
            word = part
            while len(word):
                at = ranks.argmin(axis=1)
                row = np.arange(len(word))
                done = ranks[row, at] == 1 << 30
                if done.any():
                    left = ids[done]
                    held = left >= 0
                    words.append(np.repeat(word[done], held.sum(axis=1)))
                    out.append(left[held].astype(np.int64))
                    ids, ranks, word, at = ids[~done], ranks[~done], word[~done], at[~done]
                    row = np.arange(len(word))
                    if not len(word):
                        break
                made = self.merged(ids[row, at].astype(np.int64) * self.size + ids[row, at + 1])
                gap = np.arange(ids.shape[1] - 1)
                take = gap + (gap > at[:, None])
                ids[:, :-1], ranks[:, :-1] = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
                ids[:, -1], ranks[:, -1] = -1, 1 << 30
                ids[row, at] = made
                ranks[row, at] = self._ranks(made, ids[row, at + 1])
                inner = np.flatnonzero(at > 0)
                ranks[inner, at[inner] - 1] = self._ranks(ids[inner, at[inner] - 1], made[inner])
        words, out = np.concatenate(words), np.concatenate(out)
        back = np.argsort(words, kind="stable")
        return words[back], out[back]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[end - 1] += END
        short = np.flatnonzero(length <= LONG)
        word, ids = self.propose(symbols, (end - length)[short], end[short])
        word = short[word]
        for w in np.flatnonzero(length > LONG).tolist():
            one = self.propose_one(symbols[end[w] - length[w]:end[w]].tolist())
            word, ids = np.append(word, np.full(len(one), w)), np.append(ids, one)
        beside = np.flatnonzero(word[1:] == word[:-1])
        wrong = beside[~self.compatible(ids[beside], ids[beside + 1])]
        failing = np.unique(word[wrong])
        if len(failing):
            failed = np.zeros(len(words), bool)
            failed[failing] = True
            few = failing[length[failing] <= LONG]
            again, exact = self.merge_many(symbols, end[few] - length[few], length[few])
            word, ids = np.append(word[~failed[word]], few[again]), np.append(ids[~failed[word]], exact)
            for w in failing[length[failing] > LONG].tolist():
                one = self.merge(symbols[end[w] - length[w]:end[w]].tolist())
                word, ids = np.append(word, np.full(len(one), w)), np.append(ids, one)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def split_own(self, text: str) -> list[bytes]:
        """Words of any text without special tokens by the tokenizer's own steps."""
        return [bytes(map(self.byte_of.__getitem__, word)) for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]


def _codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Encoder:
    """Texts to ids as little-endian 32-bit bytes.

    The tokenizer's steps never look across a space or a line feed, so the ids of a text are those of its parts between them, in
    order. Parts met before are remembered within a fixed bound; all others of a batch are encoded together.
    """

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of different parts without spaces and line feeds, which are joined by line feeds and cut in bulk."""
        code = _codes("\n".join(parts))
        of_part = np.cumsum(code == 10)
        strange = self.bpe.own_steps[np.minimum(code, SAFE)]
        strange[:-1] |= (code[:-1] == ord("<")) & (code[1:] == ord("|"))
        odd = np.zeros(len(parts), bool)
        odd[of_part[strange]] = True
        out = {parts[i]: self._odd(parts[i]) for i in np.flatnonzero(odd).tolist()}
        plain = [p for p, o in zip(parts, odd.tolist()) if not o] if out else parts
        if not plain:
            return out
        text = unicodedata.normalize("NFC", "\n".join(plain)).replace("Σ", "σ").lower()
        code = _codes(text)
        kind = self.bpe.kinds[code]
        first = (kind != np.append(0, kind[:-1])) | (kind == 2)
        start = np.flatnonzero(first & (kind > 0))
        stop = np.append(np.flatnonzero(first), len(code))
        stop = stop[np.searchsorted(stop, start, side="right")]
        words = [text[a:b] for a, b in zip(start.tolist(), stop.tolist())]
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, sizes = self.bpe.encode_words([w.encode() for w in known])
        word = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        # The ids of all words in text order, then one slice of them per part.
        size = sizes[word]
        end = np.cumsum(size)
        raw = ids[np.repeat((np.cumsum(sizes) - sizes)[word] - end + size, size) + np.arange(size.sum())].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(np.cumsum(code == 10)[start], weights=size, minlength=len(plain)).astype(np.int64)) * 4
        out.update(zip(plain, (raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist()))))
        return out

    def _odd(self, part: str) -> bytes:
        """One part with characters beyond the safe range or strings that may be special tokens."""
        bpe, out = self.bpe, []
        pieces = bpe.special_pattern.split(part) if bpe.special_pattern else [part]
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(np.array([bpe.special[piece]]))
            elif piece:
                out.append(bpe.encode_words(bpe.split_own(piece))[0])
        return np.concatenate(out).astype("<u4").tobytes() if out else b""

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts, remembered or learned."""
        out = list(map(self.young.get, parts))
        missing = [p for p, ids in zip(parts, out) if ids is None]
        again = {p: self.old[p] for p in missing if p in self.old}
        fresh = [p for p in missing if p not in again]
        # Very large batches are learned in portions, which bounds the arrays.
        for i in range(0, len(fresh), 100_000):
            again.update(self._learn(fresh[i:i + 100_000]))
        found = iter(missing)
        out = [again[next(found)] if ids is None else ids for ids in out]
        if len(self.young) + len(again) > REMEMBERED:
            self.old, self.young = self.young, {"": b""}
        if len(again) <= REMEMBERED:
            self.young.update((p, ids) for p, ids in again.items() if len(p) <= 64)
        return out

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Ids of each text of an array, as a large binary array. Only different parts become Python strings."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        ids = pa.array(self._ids_of(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        # The ids of all parts lie one after the other, so those of a text are one stretch of them.
        ends = np.frombuffer(ids.buffers()[1], np.int64)[parts.offsets.to_numpy()]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), ids.buffers()[2]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, for a batch of texts."""
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


@lru_cache(maxsize=2)
def surfaces(path: str) -> list[str]:
    """The string of each id."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pairs = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
    out = [""] * (1 + max(i for _, i in pairs))
    for word, i in pairs:
        out[i] = word
    return out


def slices(sizes: list[int], limit: int = 2 << 20):
    """Index ranges whose texts hold about ``limit`` bytes; a longer text is a range of its own."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def byte_sizes(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def encode(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, one after the other).

    Whole texts, no special tokens added, strings of special tokens in a text become these. A null text counts as empty and has no
    ids; repeated rows and null doc_ids are encoded like any other row; very long texts are one row each, in a batch of their own;
    an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    def run(batches):
        to_ids = encoder(tokenizer_path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for a, b in slices(byte_sizes(texts)):
                ids = to_ids.encode_array(texts.slice(a, b - a)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pc.divide(pc.binary_length(ids), 4).cast(pa.int64()), ids],
                                                 names=["doc_id", "n_tokens", "ids"])

    return documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ``text``, what the tokenizer decodes the ids to: the tokens' own strings, parted by spaces. Null ids give an empty text."""
    def run(batches):
        surface = surfaces(tokenizer_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for a, b in slices(byte_sizes(ids), OUT_BYTES // 4):
                texts = [" ".join(map(surface.__getitem__, np.frombuffer(i or b"", "<u4").tolist())) for i in ids.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("text", StringType())]))
