"""BPE encoding by speculation and verification, and decoding.

A word is cut greedily into the longest tokens of the vocabulary.  That guess is what merging gives if every token is
its own encoding and no two neighbours would merge across their border when they stand alone: the first merge across
a border in the whole word would, by rank and place, also be the first across it in those two tokens.  So all pairs of
neighbours of a batch are checked at once against the pairs known to hold, new pairs are tried once by merging them
alone, and only words that hold a failing pair are merged in full.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words whose ids a Python worker remembers before it forgets them all; pairs likewise.
WORDS_KEPT, PAIRS_KEPT = 150_000, 150_000
#: Bytes of text whose words are learnt at once; bytes beyond which a word is merged alone; words merged side by side.
GROUP_BYTES, LONG_WORD, ROWS_MERGED = 1 << 21, 48, 2048
#: Bits that hold an id; a rank above all others.
ID_BITS, NO_MERGE = 20, 1 << 62


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else extra))
        extra += b not in plain
    return letters


def unsettled(text: str) -> bool:
    """Whether ``text`` has code points without a character in this Python's Unicode tables; none are below U+0250."""
    return any(c > "\u024f" and unicodedata.category(c) == "Cn" for c in set(text))


class Vocabulary:
    """The vocabulary and merges of a tokenizers JSON file with NFC, lower-cased, byte-level words and a word end.

    A symbol is a byte of a word, plus 256 if it is the word's last.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        self.path, model = path, d["model"]
        ids: dict[str, int] = model["vocab"]
        end: str = model["end_of_word_suffix"]
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = [""] * (max(*ids.values(), *self.special.values()) + 1)
        for t, n in {**ids, **self.special}.items():
            self.tokens[n] = t
        self.spellings = pa.array(self.tokens, pa.string())
        self.symbol_ids = np.array([ids[c] for c in self.letters] + [ids[c + end] for c in self.letters], np.int64)

        ranks: dict[int, int] = {}
        for n, p in enumerate(model["merges"]):
            x, y = p if isinstance(p, list) else p.split(" ")
            ranks.setdefault(ids[x] << ID_BITS | ids[y], n << ID_BITS | ids[x + y])
        self.ranks = ranks
        self.pair_codes = np.array(sorted(ranks), np.int64)
        self.pair_ranks = np.array([*map(ranks.__getitem__, sorted(ranks)), NO_MERGE], np.int64)

        # a trie over symbols: (node, symbol) -> child, and each node's token or -1
        byte = {c: b for b, c in enumerate(self.letters)}
        self.token_symbols: list[list[int]] = [[]] * len(self.tokens)
        children: dict[int, int] = {}
        at_node = [-1]
        for t, n in ids.items():
            last = len(end) < len(t) and t.endswith(end)
            own = [byte[c] for c in (t[: -len(end)] if last else t)]
            own[-1] += 256 * last
            self.token_symbols[n], node = own, 0
            for x in own:
                if (child := children.get(node << 9 | x)) is None:
                    child = children[node << 9 | x] = len(at_node)
                    at_node.append(-1)
                node = child
            at_node[node] = n
        self.trie_codes = np.array(sorted(children), np.int64)
        self.trie_children = np.array([children[k] for k in sorted(children)], np.int64)
        self.trie_tokens = np.array(at_node, np.int64)

        pattern = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        every = [self.symbol_ids[x].tolist() for x in self.token_symbols]
        whole = self.merge_many(every)
        #: whether a token is its own encoding
        self.alone = np.array([x == [n] for n, x in enumerate(whole)])
        self.pairs, self.holds = np.empty(0, np.int64), np.empty(0, bool)
        self._forget()

    def _forget(self) -> None:
        """Empty the memory of words: index -> where the word's ids begin in ``flat`` and how many they are."""
        self.index: dict[str, int] = {t: k for k, t in enumerate(self.special)}
        self.flat = np.array([*self.special.values()], np.int32)
        self.starts, self.sizes = np.arange(len(self.flat)), np.ones(len(self.flat), np.int64)

    # -- exact merging ----------------------------------------------------------------------------------------------
    def merged(self, s: list[int]) -> list[int]:
        """The ids ``s`` after all merges, the lowest rank first and the leftmost of equals; n log n in their number."""
        n, get, mask = len(s), self.ranks.get, (1 << ID_BITS) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, s[i], s[i + 1]) for i in range(n - 1) if (r := get(s[i] << ID_BITS | s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j, x, y = heapq.heappop(heap)
            if s[i] != x or after[i] != j or s[j] != y:
                continue
            s[i], s[j] = r & mask, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(s[i] << ID_BITS | s[k])) is not None:
                    heapq.heappush(heap, (r, i, k, s[i], s[k]))
            if (h := before[i]) >= 0 and (r := get(s[h] << ID_BITS | s[i])) is not None:
                heapq.heappush(heap, (r, h, i, s[h], s[i]))
        return [x for x in s if x >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = left << ID_BITS | right
        at = np.searchsorted(self.pair_codes, codes)
        at[at == len(self.pair_codes)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.pair_codes[at] == codes), self.pair_ranks[at], NO_MERGE)

    def merge_many(self, sequences: list[list[int]]) -> list[list[int]]:
        """``merged`` of many sequences: those of like length side by side, one merge of each at a time."""
        out: list[list[int]] = [x for x in sequences]
        order = sorted((k for k, x in enumerate(sequences) if len(x) > 1), key=lambda k: len(sequences[k]))
        while order and len(sequences[order[-1]]) > LONG_WORD:
            k = order.pop()
            out[k] = self.merged(list(sequences[k]))
        for lo in range(0, len(order), ROWS_MERGED):
            rows = np.array(order[lo : lo + ROWS_MERGED])
            width = len(sequences[rows[-1]])
            ids = np.full((len(rows), width), -1, np.int64)
            for n, k in enumerate(rows.tolist()):
                ids[n, : len(sequences[k])] = sequences[k]
            ranks = self._rank(ids[:, :-1], ids[:, 1:])
            while len(rows):
                j = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
                r = np.arange(len(rows))
                best = ranks[r, j] if ranks.shape[1] else np.full(len(rows), NO_MERGE)
                if (done := best == NO_MERGE).any():
                    for k, x in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                        out[k] = [t for t in x if t >= 0]
                    rows, ids, ranks, j, best = rows[~done], ids[~done], ranks[~done], j[~done], best[~done]
                    r = np.arange(len(rows))
                    if not len(rows):
                        break
                ids[r, j] = best & ((1 << ID_BITS) - 1)
                wide = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, wide + (wide > j[:, None]), axis=1)
                ranks = np.take_along_axis(ranks, wide[:-1] + (wide[:-1] >= j[:, None]), axis=1)
                if ranks.shape[1]:
                    has, to = j > 0, j < ranks.shape[1]
                    ranks[r[has], j[has] - 1] = self._rank(ids[r[has], j[has] - 1], ids[r[has], j[has]])
                    ranks[r[to], j[to]] = self._rank(ids[r[to], j[to]], ids[r[to], j[to] + 1])
        return out

    # -- speculation ------------------------------------------------------------------------------------------------
    def greedy(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, token): the longest tokens of each word from left to right, all words one symbol at a time."""
        word, at, stop = np.arange(len(starts)), starts.copy(), ends
        node, best, to = np.zeros(len(word), np.int64), np.full(len(word), -1), starts.copy()
        owners, found = [], []
        while len(word):
            codes = node << 9 | symbols[np.minimum(at, len(symbols) - 1)]
            k = np.searchsorted(self.trie_codes, codes)
            k[k == len(self.trie_codes)] = 0
            step = (self.trie_codes[k] == codes) & (at < stop)
            node = np.where(step, self.trie_children[k], 0)
            at = at + step
            token = np.where(step, self.trie_tokens[node], -1)
            best, to = np.where(token >= 0, token, best), np.where(token >= 0, at, to)
            if not step.all():
                over = ~step  # every byte is a token, so there is a best one
                owners.append(word[over])
                found.append(best[over])
                at = np.where(over, to, at)
                best = np.where(over, -1, best)
                if (left := at < stop).all():
                    continue
                left |= step
                word, at, stop, node, best, to = (x[left] for x in (word, at, stop, node, best, to))
        owner, token = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    def pairs_hold(self, codes: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each (distinct, sorted) pair stay apart when they are encoded alone."""
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs, self.holds = self.pairs[:0], self.holds[:0]
        new = codes[~np.isin(codes, self.pairs, assume_unique=True)]
        if len(new):
            sides = [(c >> ID_BITS, c & (1 << ID_BITS) - 1) for c in new.tolist()]
            alone = self.merge_many([self.symbol_ids[self.token_symbols[x] + self.token_symbols[y]].tolist() for x, y in sides])
            pairs = np.concatenate([self.pairs, new])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.holds = pairs[order], np.concatenate([self.holds, [x == list(y) for x, y in zip(alone, sides, strict=True)]])[order].astype(bool)
        return self.holds[np.searchsorted(self.pairs, codes)]

    def learn(self, words: list[str]) -> None:
        """Remember the ids of ``words``, distinct and not known.  Words beyond LONG_WORD bytes are merged without a guess."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        symbols[ends - 1] += 256
        short = np.flatnonzero(sizes <= LONG_WORD)
        fine = np.ones(len(words), bool)
        fine[sizes > LONG_WORD] = False
        owner, token = self.greedy(symbols, (ends - sizes)[short], ends[short]) if len(short) else (np.empty(0, np.int64),) * 2
        owner = short[owner]
        fine[owner[~self.alone[token]]] = False
        inside = owner[1:] == owner[:-1]
        codes, at = np.unique(token[:-1][inside] << ID_BITS | token[1:][inside], return_inverse=True)
        fine[owner[1:][inside][~self.pairs_hold(codes)[at]]] = False
        failed = np.flatnonzero(~fine)
        letters = self.symbol_ids[symbols]
        exact = self.merge_many([letters[ends[k] - sizes[k] : ends[k]].tolist() for k in failed.tolist()])
        kept = fine[owner]
        ids = np.concatenate([token[kept], np.fromiter(chain.from_iterable(exact), np.int64)])
        whose = np.concatenate([owner[kept], np.repeat(failed, np.fromiter(map(len, exact), np.int64, len(exact)))])
        count = np.bincount(whose, minlength=len(words))
        ids = ids[np.argsort(whose, kind="stable")].astype(np.int32)
        first = len(self.sizes)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(count) - count])
        self.sizes, self.flat = np.concatenate([self.sizes, count]), np.concatenate([self.flat, ids])

    # -- texts ------------------------------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """The words of ``text`` after normalisation."""
        if not text.isascii() and unsettled(text):
            # letters newer than this Python: the library's own tables say what they are
            own, byte = library(self.path), {c: b for b, c in enumerate(self.letters)}
            return [bytes(byte[c] for c in w).decode() for w, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))]
        # one letter is lowered at a time, so a capital sigma at a word's end is no final one
        return self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[str]:
        """Words, and added tokens where the text spells them."""
        if self.cut is None or "<" not in text:
            return self.words(text)
        return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self.words(part))]

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; a null text has none."""
        split = [self.pieces(t or "") for t in texts]
        new = set(chain.from_iterable(split)).difference(self.index)
        if len(self.index) + len(new) > WORDS_KEPT and len(self.index) > len(self.special):
            self._forget()
            new = set(chain.from_iterable(split)).difference(self.index)
        if new:
            self.learn(list(new))
        k = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64)
        sizes = self.sizes[k]
        before = np.cumsum(sizes) - sizes
        flat = self.flat[np.repeat(self.starts[k] - before, sizes) + np.arange(int(sizes.sum()))]
        upto = np.cumsum([0, *map(len, split)])
        ends = np.append(before, len(flat))[upto].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each row, joined by a blank as the library does without a decoder; null for null."""
        ids = ids if len(ids) else ids.cast(pa.list_(pa.int32()))
        spelt = self.spellings.take(ids.flatten())
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), spelt)
        return pc.if_else(ids.is_valid(), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))


@cache
def library(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker and file."""
    return Vocabulary(path)


def _encode(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in (part for whole in batches for part in slices(whole, whole.num_columns - 1, GROUP_BYTES)):
            ids = v.encode_batch(b.column(b.num_columns - 1).to_pylist())
            more = [v.decode_batch(ids)] if decode else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, *more], [*b.schema.names[:-1], "ids", *["decoded"] * decode])

    return run


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", decode: bool = False) -> DataFrame:
    """The ``keep`` columns of ``docs`` and ids, an array of token ids of the whole text; with ``decode`` also the
    text ``decoded`` from those ids.

    A null or empty text has no ids.  Null and repeated keys keep their rows; an empty table gives an empty result;
    other columns are ignored.  A worker holds one Arrow batch and bounded memories of words and pairs.
    ``path`` names the vocabulary file, which must lie at that place on every executor.
    """
    kept = docs.select(*keep, F.col(text).alias("ids"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(_encode(path, decode), ", ".join([*own, "ids array<int>", *["decoded string"] * decode]))


def decoded(ids: Column | str, path: str) -> Column:
    """The text of any column of ids; null for null."""

    @F.arrow_udf("string")
    def join(x: pa.Array) -> pa.Array:
        return vocabulary(path).decode_batch(x)

    return join(ids)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids, joined by a blank, and of the decoded text."""
    e = encode(docs, path, decode=True)
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
