"""Phrase collocations: merged count-min sketches choose n-grams, a second pass counts the chosen ones exactly.

A cell of a count-min sketch never counts too little, so an n-gram whose cells do not all reach the least count cannot
be frequent.  Tasks send their counts of the cells, cut at the least count, by blocks of cells; merged, a block is
reduced to one bit a cell.  These bits alone go to the second pass, which aggregates the n-grams that pass them.  Parts
of a frequent phrase are at least as frequent, so its scores need no other counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Most words of a phrase, least count, phrases of a language, percent of its count by which a longer phrase subsumes one.
MOST_WORDS, LEAST, FIRST, SUBSUMED = 4, 30, 2000, 80
#: Factor of the score.
SCALE = 2_000_000
#: Rows of the sketch, bytes of text for each cell of a row, and the most cells: 2 x 64 MB of bits, whatever the corpus.
DEPTH, BYTES_A_CELL, MOST_CELLS = 2, 32, 1 << 29
#: Cells of a block, n-grams that a task counts before it sends them on, and bytes of text worked on at once.
BLOCK, BUFFER, CHUNK_BYTES = 1 << 20, 1 << 22, 1 << 22
#: Candidates that one task ranks before the ranks are merged.
RANKED = 1 << 17

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, each end of a piece as a full stop, tabs as spaces.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"." * len(_ENDS) + b" ")


class _Known(dict):
    """The number of each word, from 1; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language, joined by piece ends, of about CHUNK_BYTES; a longer text is cut at the end of a piece."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def out():
        for lang, texts in held.items():
            whole, at = b".".join(texts).translate(_PLAIN), 0
            while at < len(whole):
                end = whole.find(b".", at + CHUNK_BYTES)
                end = len(whole) if end < 0 else end
                yield lang, whole[at:end]
                at = end

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= 2 * CHUNK_BYTES:
                yield from out()
                held, size = {}, 0
    yield from out()


def grams(lang: str, chunk: bytes, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """For each length k: where n-grams of k words begin, their hashes, the chunk's word numbers and the words."""
    known = _Known()
    words = chunk.replace(b".", b" . ").split()
    w = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    vocabulary = list(known)
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in vocabulary), np.uint64, len(vocabulary))[w]
    at, h = np.flatnonzero(w), None
    for k in range(1, most + 1):
        if k == 1:
            h = _mixed(hashes[at] + np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42)))
        else:
            on = at + k - 1 < len(w)
            on[on] = w[at[on] + k - 1] > 0
            at, h = at[on], h[on]
            h = _mixed(h * np.uint64(3) + hashes[at + k - 1])
        yield k, at, h, w, vocabulary


def cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch; ``width`` is a power of two."""
    return (_mixed(h + np.uint64(row)) & np.uint64(width - 1)).astype(np.uint32)


_ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(x: np.ndarray) -> bytes:
    """Numbers in the narrowest type that holds them all, compressed, after its width and how many there are."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return kind.itemsize.to_bytes(1, "little") + len(x).to_bytes(4, "little") + _ZSTD.compress(x.astype(kind).tobytes(), asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    kind, n = np.dtype(f"u{x[0]}"), int.from_bytes(x[1:5], "little")
    return np.frombuffer(_ZSTD.decompress(x[5:], n * kind.itemsize), kind)


def _sketched(most: int, least: int, width: int, block: int):
    """(row, block, gaps, counts): the cells that a task's n-grams hit, as steps from the one before, with their counts."""

    def sent(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(hashes)
        for row in range(DEPTH):
            c, n = np.unique(cells(h, row, width), return_counts=True)
            n = np.minimum(n, least)
            starts = np.flatnonzero(np.r_[True, c[1:] // block != c[:-1] // block])
            out = []
            for s, e in zip(starts, np.r_[starts[1:], len(c)], strict=True):
                number = int(c[s]) // block
                gaps = np.diff(c[s:e], prepend=np.uint32(number * block)).astype(np.uint32)
                out.append((row, number, _packed(gaps), _packed(n[s:e])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["row", "block", "gaps", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for lang, chunk in chunks(batches):
            for _, _, h, _, _ in grams(lang, chunk, most):
                held.append(h)
                size += len(h)
            if size >= BUFFER:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    return run


def _merged(least: int, width: int, block: int):
    """(row, block, bits): which cells of each block reach ``least`` in the sum over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for row, number, gaps, counts in zip(*(b.column(c).to_pylist() for c in ("row", "block", "gaps", "counts")), strict=True):
                total = sums.setdefault((row, number), np.zeros(min(block, width), np.uint32))
                c = np.cumsum(_unpacked(gaps), dtype=np.int64)
                total[c] = np.minimum(total[c] + _unpacked(counts), least)
        for (row, number), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([number], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], ["row", "block", "bits"])

    return run


def sketch(rows: DataFrame, most: int, least: int, width: int, block: int = BLOCK) -> list[np.ndarray]:
    """For each row of the merged count-min sketch, one bit a cell: does it reach ``least``?  DEPTH * width / 8 bytes in all."""
    sent = rows.mapInArrow(_sketched(most, least, width, block), "row int, block int, gaps binary, counts binary")
    merged = sent.repartition("row", "block").mapInArrow(_merged(least, width, block), "row int, block int, bits binary")
    size = min(block, width) // 8
    out = [np.zeros(max(1, width // 8), np.uint8) for _ in range(DEPTH)]
    for r in merged.toLocalIterator():
        out[r.row][r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(bits: list[np.ndarray], h: np.ndarray, width: int) -> np.ndarray:
    """Whether the cells of each hash reach the least count in every row."""
    ok = np.ones(len(h), bool)
    for row, held in enumerate(bits):
        c = cells(h[ok], row, width)
        ok[ok] = (held[c >> np.uint32(3)] >> (np.uint32(7) - (c & np.uint32(7))).astype(np.uint8)) & 1 > 0
    return ok


def _counted(most: int, width: int, shared):
    """(lang, phrase, f) of the n-grams that pass the sketch, summed within a chunk; the phrase '' counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for lang, chunk in chunks(batches):
            phrases, counts = [b""], [0]
            for k, at, h, w, vocabulary in grams(lang, chunk, most):
                if k == 1:
                    counts[0] = len(at)
                on = passes(bits, h, width)
                at, h = at[on], h[on]
                _, first, group = np.unique(h, return_index=True, return_inverse=True)
                n = np.bincount(group, minlength=len(first))
                # n-grams whose hashes agree by chance are told apart by their words and counted one by one
                odd = np.zeros(len(at), bool)
                for j in range(k):
                    odd |= w[at + j] != w[at[first][group] + j]
                n -= np.bincount(group[odd], minlength=len(first))
                at = np.concatenate([at[first], at[odd]])
                counts.extend(np.concatenate([n, np.ones(odd.sum(), np.int64)]).tolist())
                phrases.extend(b" ".join([vocabulary[x] for x in p]) for p in zip(*(w[at + j].tolist() for j in range(k)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

    return run


def width_for(total_bytes: int) -> int:
    """Cells of a row of the sketch for so many bytes of text: a power of two, MOST_CELLS at most.

    Beyond that size cells fill up and more n-grams pass to the exact count: that costs time, never results.
    """
    return min(MOST_CELLS, 1 << max(10, (total_bytes // BYTES_A_CELL - 1).bit_length()))


def frequent(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, width: int | None = None) -> DataFrame:
    """lang, phrase and f, the exact count of occurrences, of every n-gram of up to ``most`` words with f >= ``least``; '' has all words.

    Words are as in ``collocations``.  ``width`` sets the cells of a row of the sketch (a power of two); any gives the same rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text.cast("binary").alias("text"))
    width = width or width_for(rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0)
    bits = rows.sparkSession.sparkContext.broadcast(sketch(rows, most, least, width))
    counted = rows.mapInArrow(_counted(most, width, bits), "lang string, phrase binary, f bigint")
    sums = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return sums.where((F.col("f") >= least) | (F.length("phrase") == 0)).select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def _times(n: int, x: Column) -> Column:
    """A product that may pass 64 bits."""
    return x.cast("decimal(20,0)") * F.lit(n).cast("decimal(10,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, and l, r and score of the cut that scores lowest, then comes first, for each phrase of two words or more."""
    c = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    k = F.col("k")
    cut = c.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", F.size("w").alias("words"), "k", part(F.lit(1), k).alias("left"), part(k + 1, F.size("w") - k).alias("right"))
    l, r = (counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])) for side in ("left", "right"))
    cut = cut.join(l, ["lang", "left"]).join(r, ["lang", "right"])
    score = F.expr(f"(cast(a AS decimal(20,0)) * {SCALE}) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))").cast("bigint")
    lowest = cut.select("lang", "phrase", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c"))
    return lowest.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.min("c").alias("c")).select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def subsumed(counts: DataFrame, percent: int = SUBSUMED) -> DataFrame:
    """lang and phrase of the phrases inside a longer one of ``counts`` whose count is ``percent`` of theirs or more."""
    c = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase", "f", F.split("phrase", " ").alias("w"))
    size = F.size("w")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    longer = c.where(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return c.join(longer, ["lang", "phrase"]).where(_times(100, F.col("longer")) >= _times(percent, F.col("f"))).select("lang", "phrase")


def collocations(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, first: int = FIRST, percent: int = SUBSUMED, width: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``first`` phrases of two to ``most`` words.

    Texts are split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs; A-Z count as a-z.
    A phrase with ``least`` occurrences or more is scored by the cut into two parts that scores lowest: a against the
    sum of the counts l and r of the parts.  It is dropped if a longer phrase that holds it has ``percent`` of its count.
    Ties in score go by a, then by the phrase in byte order.

    A null language counts as ``und``, a null text as empty.  Repeated rows count again; doc_id isn't read.  Texts of any
    length are read whole.  An empty table, and a language without such a phrase, give no rows.  Other columns are ignored.
    """
    counts = stored(frequent(docs, most, least, width))
    kept = stored(scored(counts).join(subsumed(counts, percent), ["lang", "phrase"], "left_anti"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    # no task ranks a large language whole: first within shares of its candidates, and again while many are left of them
    short, left = kept, kept.count()
    while left > RANKED and first * (shares := 1 + left // RANKED) < left:
        within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        short, left = short.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= first).drop("rank"), first * shares
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    words = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
