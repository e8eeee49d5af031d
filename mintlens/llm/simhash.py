"""SimHash near-duplicates by tiled exact comparison.

Fingerprints at most RADIUS bits apart agree in full on at least one of RADIUS + 1 blocks of bits.  So a tile holds
distinct fingerprints that share a block's value, ordered by population count.  A tile above ``tile_rows`` is cut into
sub-tiles along that order, and each pair of sub-tiles whose population counts come within the radius is one unit of
work.  Units are compared in full by numpy exclusive-or and bit counts and emit a forest, never all linked pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, free_name, same, slices, small, stored
from .graph import components

#: Words in a shingle, seed of its hash, most bits by which linked fingerprints differ.
SHINGLE_WORDS, HASH_SEED, RADIUS = 3, 42, 2
#: Fingerprints in the largest tile that is compared as one; rows of numpy work at once; hashes counted at once.
TILE_ROWS, CHUNK_ROWS, HASH_CHUNK = 2048, 256, 1 << 15
#: Removal of near-duplicates: words in a shingle, least similarity, bits of a fingerprint, most that differ, texts in a tile compared as one.
NEAR_WORDS, NEAR_LEAST, NEAR_BITS, NEAR_RADIUS, NEAR_TILE_ROWS = 5, 0.8, 512, 120, 1024
#: Least shingles that large tiles screen pairs by, and texts from which a tile is large.
SCREEN, SCREENED_ROWS = 256, 64
#: Least shingle hashes by which a text meets others, and the share of them from which frequent ones count too.
PROBES, HOT_SHARE = 24, 0.5


def fingerprint(text: bytes | None, words_per: int = SHINGLE_WORDS) -> int:
    """The SimHash of a UTF-8 text: A-Z in lower case, words split at ASCII white space, every shingle counted."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < words_per:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[k:] for k in range(words_per)), strict=False)), len(words) - words_per + 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while len(h := np.fromiter((digest(s, HASH_SEED) for s in islice(shingles, HASH_CHUNK)), np.uint64)):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(f)], ["doc_id", "mark", "f"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, null for null) and f (the fingerprint as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, mark bigint, f bigint")


def rooted(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge in ``labels``, which maps each index to its root, the groups of the linked indexes i and j."""
    while True:
        x, y = labels[i], labels[j]
        if not (apart := x != y).any():
            return
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def tile_links(f: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (node, root) over the fingerprints of one unit that are within ``radius`` of each other.

    Where the unit has two sides, only pairs across them are compared; the other pairs are units of their own.
    """
    pop = np.bitwise_count(f)
    order = np.argsort(pop, kind="stable")
    f, side, pop = f[order], side[order], pop[order].astype(np.int64)
    labels = np.arange(len(f))
    two = side.any() and not side.all()
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(f)),) * 2
    for at in range(0, len(rows), CHUNK_ROWS):
        r = rows[at : at + CHUNK_ROWS]
        for to in range(0 if two else at, len(cols), CHUNK_ROWS):
            c = cols[to : to + CHUNK_ROWS]
            if pop[c[0]] - pop[r[-1]] > radius:
                break  # population counts only rise from here
            if pop[r[0]] - pop[c[-1]] > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(f[r][:, None] ^ f[c][None, :]) <= radius)
            if len(i):
                rooted(labels, r[i], c[j])
    moved = np.flatnonzero(labels != np.arange(len(f)))
    return f[moved], f[labels[moved]]


def small_links(unit: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same over many small units at once, each contiguous: compare every row with the k-th after it, k = 1, 2, ..."""
    labels, k = np.arange(len(f)), 1
    while k < len(f) and (together := unit[k:] == unit[:-k]).any():
        i = np.flatnonzero(together & (np.bitwise_count(f[k:] ^ f[:-k]) <= radius))
        if len(i):
            rooted(labels, i, i + k)
        k += 1
    moved = np.flatnonzero(labels != np.arange(len(f)))
    return f[moved], f[labels[moved]]


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.ChunkedArray]]:
    """The columns of batches that come ordered by unit, cut between units: the last of each waits for the next batch."""
    held: list[pa.RecordBatch] = []

    def together() -> dict[str, pa.ChunkedArray]:
        t = pa.Table.from_batches(held)
        return dict(zip(t.schema.names, t.columns, strict=True))

    for b in batches:
        if not b.num_rows:
            continue
        unit = b.column("unit").to_numpy()
        first = int(np.argmax(unit == unit[-1]))  # where the last unit begins
        if held and held[-1].column("unit")[0].as_py() != unit[0]:
            yield together()
            held = []
        if first:
            held.append(b.slice(0, first))
            yield together()
            held = []
        held.append(b.slice(first))
    if held:
        yield together()


def _links(radius: int, small: int = 64):
    def edges(unit, side, f) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        ends = np.r_[starts[1:], len(unit)]
        big = ends - starts > small
        few = np.repeat(~big, ends - starts)
        found = [small_links(unit[few], f[few], radius)] + [tile_links(f[s:e], side[s:e], radius) for s, e in zip(starts[big], ends[big], strict=True)]
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return lambda batches: (edges(x["unit"].to_numpy(), x["side"].to_numpy(), x["f"].to_numpy().view(np.uint64)) for x in whole_units(batches))


def block_rows(f: DataFrame, radius: int) -> DataFrame:
    """f, block, value and pos (the population count): a row for each of radius + 1 blocks of bits."""
    blocks, at, cells = radius + 1, 0, []
    for k in range(blocks):
        width = 64 * (k + 1) // blocks - at
        cells.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("f", at).bitwiseAND((1 << width) - 1).alias("value")))
        at += width
    return f.select("f", F.bit_count("f").alias("pos"), F.explode(F.array(*cells)).alias("c")).select("f", "c.*", "pos")


def units(rows: DataFrame, reach: int, tile_rows: int, carry: Sequence[str] = ("f",), keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """unit, side and ``carry``: any two rows of one (block, value) whose pos differ by ``reach`` at most share a unit at least."""
    key = ["block", "value"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("in_tile")).where("in_tile > 1")
    shared = keep(rows.join(sizes, key))  # alone in each of its tiles, a fingerprint links to none
    whole = shared.where(F.col("in_tile") <= tile_rows).select(F.xxhash64(*key).alias("unit"), F.lit(0).alias("side"), *carry)

    # large tiles: where the rows of one pos begin and end along the order, in sub-tiles
    by_pos = shared.where(F.col("in_tile") > tile_rows).groupBy(*key, "pos").agg(F.count(F.lit(1)).alias("m"))
    tile = by_pos.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("all"))  # an entry for each pos, 65 at most
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<pos:int,lo:bigint,m:bigint>>").alias("all"))
    run = F.aggregate("all", zero, lambda s, x: F.struct((s["at"] + x["m"]).alias("at"), F.concat(s["all"], F.array(F.struct(x["pos"].cast("int").alias("pos"), s["at"].alias("lo"), x["m"].alias("m")))).alias("all")))
    tile = tile.select(*key, run["all"].alias("all"))
    split = shared.where(F.col("in_tile") > tile_rows).join(tile, key)
    own = F.element_at(F.filter("all", lambda x: x["pos"] == F.col("pos")), 1)
    # rows of one pos spread over its part of the order by their hash
    spread = F.pmod(F.xxhash64(*carry), own["m"])
    split = split.withColumn("t", F.floor((own["lo"] + spread) / tile_rows).cast("bigint"))
    near = F.filter("all", lambda x: F.abs(x["pos"] - F.col("pos")) <= reach)
    first = F.floor(F.element_at(near, 1)["lo"] / tile_rows).cast("bigint")
    last = F.floor((F.element_at(near, -1)["lo"] + F.element_at(near, -1)["m"] - 1) / tile_rows).cast("bigint")
    split = split.select(*dict.fromkeys([*key, *carry]), "t", F.explode(F.sequence(F.least(first, "t"), F.greatest(last, "t"))).alias("u"))
    split = split.select(F.xxhash64(*key, F.least("t", "u"), F.greatest("t", "u")).alias("unit"), (F.col("t") > F.col("u")).cast("int").alias("side"), *carry)
    return whole.union(split)


def forest(dealt: DataFrame, radius: int) -> DataFrame:
    """(node, root) of the fingerprints that reach another one by links within the units."""
    ordered = dealt.repartition("unit").sortWithinPartitions("unit")
    return components(ordered.mapInArrow(_links(radius), "a bigint, b bigint"))


def linked(f: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(node, root) of the distinct fingerprints in column f that reach another one by links of ``radius`` bits."""
    return forest(units(block_rows(f, radius), radius, tile_rows), radius)


def grouped(digests: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """f and component_id, the smallest doc_id of its component, for each distinct fingerprint of ``digests``."""
    first = digests.groupBy("f").agg(F.min("doc_id").alias("first"))
    reach = cut(linked(first.select("f"), radius, tile_rows)).withColumnRenamed("node", "f")
    least = reach.join(first, "f").groupBy("root").agg(F.min("first").alias("least"))
    return first.join(reach.join(least, "root").select("f", "least"), "f", "left").select("f", F.coalesce("least", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    A null text counts as empty; texts without words have fingerprint zero and link like any other.  A null doc_id
    keeps its row and never names a component that has another id (null if it has none).  Repeated rows each stay; an
    empty table gives an empty result; other columns are ignored.  Texts of any length are counted whole, in chunks.
    """
    d = cut(fingerprints(docs))
    # the groups are a table of their own, so that Spark can split the join where copies of one text fill a third of the rows
    out = d.select("doc_id", "f").join(stored(grouped(d, radius, tile_rows)), "f")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


# -- removal of near-duplicates ------------------------------------------------------------------------------------------------
# Near copies of 0.8 similarity differ in more bits than a few, so no block of bits is sure to be shared.  Tiles are keyed by the
# least shingle hashes of a text instead, the radius is wide, and every link is verified.


class _Words(dict):
    """Hashes of words, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, HASH_SEED)
        return h


def shingles(text: bytes | None, words_per: int, known: _Words) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; of all words if there are fewer, none if there are none."""
    words = (text or b"").lower().split()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    per = min(words_per, len(w))
    h = np.full(len(w) - per + 1 if per else 0, per, np.uint64)
    for k in range(per):
        h = (h ^ w[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


#: Odd numbers, one for each 64 bits of a fingerprint, by which the hash of a shingle is spread over them.
_SPREAD = np.random.default_rng(HASH_SEED).integers(1, 1 << 63, NEAR_BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def set_fingerprint(s: np.ndarray) -> bytes:
    """The SimHash, of NEAR_BITS bits, of distinct shingles, each counted once, as in the similarity that links are verified by."""
    ones = np.zeros(NEAR_BITS, np.int64)
    for at in range(0, len(s), HASH_CHUNK // 8):
        h = (s[at : at + HASH_CHUNK // 8, None] ^ (s[at : at + HASH_CHUNK // 8, None] >> np.uint64(31))) * _SPREAD
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(s), bitorder="little").tobytes()


def prefix(n: int) -> int:
    """Of two texts of n shingles, similar by NEAR_LEAST or more, the first so many in any one order share one."""
    return n - int(np.ceil(NEAR_LEAST * n - 1e-9)) + 1 if n else 0


def _sketched(probes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("text"))):
            sets = [shingles(t.as_py(), NEAR_WORDS, known) for t in b.column("text")]
            f = pa.array([set_fingerprint(s) for s in sets], pa.binary())
            toks = [s[: probes or prefix(len(s))].view(np.int64) for s in sets]
            n = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), f, n, pa.array(toks, pa.list_(pa.int64()))], ["doc_id", "mark", "f", "n", "toks"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for b in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("text"))):
        s = [shingles(t.as_py(), NEAR_WORDS, known).view(np.int64) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("mark"), pa.array(s, pa.list_(pa.int64()))], ["mark", "s"])


Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def compatible(x: dict[str, pa.ChunkedArray], radius: int, small: int = 64) -> Pairs:
    """Indexes i and j of the rows of each unit whose numbers of shingles and fingerprints allow NEAR_LEAST similarity, and the bits that differ.

    Small units are compared many at once, every row with the k-th after it; in a large one, chunks along the
    population count whose counts differ by more than ``radius`` are skipped, and of a two-sided one only pairs across.
    """
    unit, side, n = (x[k].to_numpy() for k in ("unit", "side", "n"))
    f = np.frombuffer(b"".join(x["f"].to_pylist()), np.uint64).reshape(len(unit), -1)

    def alike(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sized = np.minimum(n[i], n[j]) >= NEAR_LEAST * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[sized], j[sized]
        bits = np.bitwise_count(f[i] ^ f[j]).sum(axis=1, dtype=np.int64)
        return i[bits <= radius], j[bits <= radius], bits[bits <= radius]

    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    ends = np.r_[starts[1:], len(unit)]
    few, k = np.flatnonzero(np.repeat(ends - starts <= small, ends - starts)), 1
    while len(few) > k and (together := unit[few[k:]] == unit[few[:-k]]).any():
        yield alike(few[:-k][together], few[k:][together])
        k += 1
    for s, e in zip(starts, ends, strict=True):
        if e - s <= small:
            continue
        pop = np.bitwise_count(f[s:e]).sum(axis=1, dtype=np.int64)
        at, pop = s + np.argsort(pop, kind="stable"), np.sort(pop)
        two = side[s:e].any() and not side[s:e].all()
        rows, cols = (np.flatnonzero(side[at] == 0), np.flatnonzero(side[at] == 1)) if two else (np.arange(len(at)),) * 2
        for r0 in range(0, len(rows), CHUNK_ROWS):
            r = rows[r0 : r0 + CHUNK_ROWS]
            for c0 in range(0 if two else r0, len(cols), CHUNK_ROWS):
                c = cols[c0 : c0 + CHUNK_ROWS]
                if pop[c[0]] - pop[r[-1]] > radius:
                    break  # population counts only rise from here
                if pop[r[0]] - pop[c[-1]] > radius:
                    continue
                i, j = (z.ravel() for z in np.broadcast_arrays(r[:, None], c[None, :]))
                if not two and r0 == c0:
                    i, j = i[i < j], j[i < j]
                yield alike(at[i], at[j])


def _partners(radius: int):
    """Of each row of a unit that is compatible with others, its mark with the least mark of those and with the nearest (bits, mark)."""

    def pairs(x: dict[str, pa.ChunkedArray]) -> pa.RecordBatch:
        mark, tok, far = x["mark"].to_numpy(), x["tok"].to_numpy(), np.iinfo(np.int64).max
        least, bits, near = (np.full(len(mark), far) for _ in range(3))
        for i, j, d in compatible(x, radius):
            for p, q in ((i, j), (j, i)):
                np.minimum.at(least, p, mark[q])
                was = bits.copy()
                np.minimum.at(bits, p, d)
                near[bits < was] = far
                best = d == bits[p]
                np.minimum.at(near, p[best], mark[q[best]])
        has = near < far
        return pa.RecordBatch.from_arrays([pa.array(y[has]) for y in (tok, mark, least, bits, near)], ["tok", "a", "least", "bits", "near"])

    return lambda batches: (pairs(x) for x in whole_units(batches))


def padded(lists: pa.ChunkedArray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers (null: empty) as one matrix, filled up on the right, and their lengths."""
    lists = lists.combine_chunks()
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = lists.flatten().to_numpy()
    out = np.full((len(size), max(1, size.max(initial=0))), fill, values.dtype)
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out, size


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the rows of two matrices, padded by -1, share; one that a row repeats counts again, so never too few."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)
    return same.sum(axis=1)


def _crossing(radius: int):
    """All compatible pairs of marks whose roots differ, each in the unit of the least token that both have only.

    Where rows bring the least SCREEN of their shingles, cut to 15 bits, pairs that these rule out are left aside:
    with no more shingles than that because too few can be shared, else by five standard deviations.
    """

    def pairs(x: dict[str, pa.ChunkedArray]) -> Iterator[pa.RecordBatch]:
        root, mark, tok, n = (x[k].to_numpy() for k in ("root", "mark", "tok", "n"))
        live, _ = padded(x["live"], np.iinfo(np.int64).max)
        cut_to, held = padded(x["least"], -1)
        for every_i, every_j, _ in compatible(x, radius):
            for at in range(0, len(every_i), 4096):
                i, j = every_i[at : at + 4096], every_j[at : at + 4096]
                i, j = (y[root[i] != root[j]] for y in (i, j))
                before = np.where(live[i] < tok[i, None], live[i], -1)
                other = np.where(live[j] < tok[j, None], live[j], -2)
                i, j = (y[~(before[:, :, None] == other[:, None, :]).any(axis=(1, 2))] for y in (i, j))
                told = (held[i] > 0) & (held[j] > 0)
                c = common(cut_to[i], cut_to[j])
                whole = (n[i] <= SCREEN) & (n[j] <= SCREEN)
                least = np.where(whole, (n[i] + n[j]) * (NEAR_LEAST / (1 + NEAR_LEAST)) - 1e-6, NEAR_LEAST * SCREEN - 5 * np.sqrt(NEAR_LEAST * (1 - NEAR_LEAST) * SCREEN))
                i, j = (y[~told | (c >= least)] for y in (i, j))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(mark[i], mark[j])), pa.array(np.minimum(mark[i], mark[j]))], ["a", "b"])

    return lambda batches: (y for x in whole_units(batches) for y in pairs(x))


def dealt(tiles: DataFrame, tile_rows: int, radius: int, keep: Scratch) -> DataFrame:
    """Units of the tiles' rows, in order: a tile of up to ``tile_rows`` texts as one, a larger one cut along the population count."""
    cold = tiles.where(F.col("g") <= tile_rows).select(F.col("tok").alias("unit"), F.lit(0).alias("side"), "*")
    hot = tiles.where(F.col("g") > tile_rows)
    if not hot.isEmpty():
        words = (F.conv(F.hex(F.substring("f", 8 * k + 1, 8)), 16, -10).cast("bigint") for k in range(NEAR_BITS // 64))
        rows = hot.select(F.lit(0).alias("block"), F.col("tok").alias("value"), reduce(Column.__add__, map(F.bit_count, words)).alias("pos"), *hot.columns)
        cold = cold.unionByName(units(rows, radius, tile_rows, hot.columns, keep))
    return cold.repartition("unit").sortWithinPartitions("unit")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of marks whose sets of shingles have a Jaccard similarity of NEAR_LEAST or more."""
    both = pairs.join(sets.select(F.col("mark").alias("a"), "s"), "a").join(sets.select(F.col("mark").alias("b"), F.col("s").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    return both.where(common >= NEAR_LEAST * (F.size("s") + F.size("t") - common) - 1e-9).select("a", "b")


def verified(docs: DataFrame, sketch: DataFrame, radius: int, tile_rows: int, hot_share: float, keep: Scratch) -> DataFrame:
    """(node, root) over the text marks of ``sketch`` that reach another one by links of true similarity.

    Texts that have a token in common form its tile.  In a tile of over ``tile_rows`` texts (a passage that many quote)
    only those take part of whose tokens ``hot_share`` lie in such tiles: others that are similar meet elsewhere.
    First each text is verified with the least and the nearest of its compatible ones in every tile, which joins most
    of what is alike by a few pairs a text; then all compatible pairs that are still apart, each once.
    """
    texts = keep(sketch.where("n > 0").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("f", "n", "toks"))))
    tokens = texts.select(F.explode("toks").alias("tok"), "mark")
    # counts are tables of their own, so that Spark can split the frequent tokens of the join
    tiles = keep(tokens.join(keep(tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("g")).where("g > 1")), "tok"))
    hot = tiles.where(F.col("g") > tile_rows)
    if hot_share and not hot.isEmpty():
        several = hot.groupBy("mark").agg(F.count(F.lit(1)).alias("k")).join(texts.select("mark", F.size("toks").alias("of")), "mark").where(F.col("k") >= hot_share * F.col("of")).select("mark")
        again = keep(hot.drop("g").join(several, "mark"))
        again = again.join(keep(again.groupBy("tok").agg(F.count(F.lit(1)).alias("g")).where("g > 1")), "tok")
        tiles = keep(tiles.where(F.col("g") <= tile_rows).unionByName(again))

    prints = texts.select("mark", "f", "n")
    met = dealt(tiles.join(prints, "mark"), tile_rows, radius, keep).mapInArrow(_partners(radius), "tok bigint, a bigint, least bigint, bits bigint, near bigint")
    met = keep(met.groupBy("tok", "a").agg(F.min("least").alias("least"), F.min(F.struct("bits", "near")).alias("x")).select("a", F.explode(F.array("least", "x.near")).alias("b")).distinct())
    asked = keep(texts.join(met.select(F.col("a").alias("mark")).distinct(), "mark").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    named = small(asked)
    sets = keep(rows.join(named, same(rows, named, {"doc_id": "__id", "mark": "__mark"}), "left_semi").mapInArrow(_sets, "mark bigint, s array<bigint>").dropDuplicates(["mark"]))
    met = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = keep(similar(met, sets))

    reach = keep(components(links)).withColumnRenamed("node", "mark")
    left = tiles.drop("g").join(asked.select(F.col("__mark").alias("mark")).join(reach, "mark", "left").withColumn("root", F.coalesce("root", "mark")), "mark")
    left = keep(left)
    apart = left.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("g")).where("lo < hi").select("tok", "g")
    left = keep(left.join(keep(apart), "tok"))
    live = left.groupBy("mark").agg(F.collect_list("tok").alias("live")).join(prints, "mark")  # ``probes`` tokens a text at most
    live = live.join(sets.select("mark", F.transform(F.slice("s", 1, SCREEN), lambda h: h.bitwiseAND(0x7FFF).cast("smallint")).alias("least")), "mark")
    left = left.join(live, "mark").withColumn("least", F.when(F.col("g") > SCREENED_ROWS, F.col("least")))
    more = dealt(left, tile_rows, radius, keep).mapInArrow(_crossing(radius), "a bigint, b bigint").distinct().join(met, ["a", "b"], "left_anti")
    return components(links.union(keep(similar(keep(more), sets))))


def dedupe(docs: DataFrame, radius: int = NEAR_RADIUS, tile_rows: int = NEAR_TILE_ROWS, probes: int | None = PROBES, hot_share: float = HOT_SHARE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates; columns as they were.

    Texts link if their sets of NEAR_WORDS-word shingles have a Jaccard similarity of NEAR_LEAST or more; texts
    without words, nulls among them, are all alike.  Of each group of reachable texts the row of the smallest doc_id
    stays; among rows that share that id the one of the smallest text hash; rows that agree in id and text stay once.
    A null id stays only where the group has no other.  An empty table gives an empty result.

    Links are exact.  A pair of 0.8 is only missed if none of the ``probes`` least hashes is shared (0.2 ** 24; never,
    where a text has no more shingles; up to 6e-4 if most of them lie in tiles of over ``tile_rows`` texts and most of
    the others differ), or if the fingerprints differ in more than ``radius`` of 512 bits (about 1e-6 at 120).
    ``probes=None, radius=512, hot_share=0`` takes
    all of the prefix that similar texts must share and moves a fifth of all shingles.  What remains in any form: pairs that
    meet in tiles of over SCREENED_ROWS texts only are left aside where their least SCREEN hashes fall five standard
    deviations short (3e-7 at 0.8).
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    with Scratch(docs.sparkSession) as keep:
        d = keep(rows.mapInArrow(_sketched(probes), "doc_id bigint, mark bigint, f binary, n int, toks array<bigint>"))
        reach = verified(docs, d, radius, tile_rows, hot_share, keep).withColumnRenamed("node", "mark")
        grouped_rows = d.select("doc_id", "mark", "n").join(reach, "mark", "left").withColumn("g", F.when(F.col("n") == 0, 0).otherwise(F.coalesce("root", "mark")))
        rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "mark")
        best = grouped_rows.groupBy("g").agg(F.min(rank).alias("r")).select(F.col("g").alias("__g"), F.col("r.doc_id").alias("__id"), F.col("r.mark").alias("__mark"))
        counted = grouped_rows.groupBy("g", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
        verdict = counted.join(best, counted["g"] == best["__g"])
        kept = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("mark").eqNullSafe(F.col("__mark"))
        verdict = keep(verdict.select("doc_id", "mark", "rows", kept.alias("kept")))
        drop = stored(verdict.where("not kept").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")))
        once = stored(verdict.where("kept and rows > 1").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")))
    text = free_name(docs, "mark")
    seen, drop = docs.withColumn(text, F.xxhash64("text")), small(drop)
    rest = seen.join(drop, same(seen, drop, {"doc_id": "__id", text: "__mark"}), "left_anti")
    if not once.isEmpty():
        on = same(rest, once, {"doc_id": "__id", text: "__mark"})
        rest = rest.join(once, on, "left_anti").unionByName(rest.join(once, on, "left_semi").dropDuplicates(["doc_id", text]))
    return rest.drop(text)
