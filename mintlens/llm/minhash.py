"""MinHash near-duplicates by an inverted join over the coordinates of signatures.

A text's signature is, for each of COORDINATES hash orders, the shingle that comes first.  Texts are posted under their
coordinate-value pairs, so texts of one posting agree in a coordinate, and two texts are a candidate pair if they agree
in MATCHES coordinates at least.  Prefix: in the order of rarity, the last MATCHES - 1 pairs of a text can't hold all
that such two texts share, so they aren't posted; a text with fewer than MATCHES pairs that any other text has isn't
posted at all.  Skip: a pair is counted in one posting, the least coordinate under which both are posted, and only if the
sizes of the sets allow the similarity and the two aren't joined yet.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, same, slices, small, stored
from .graph import components
from .simhash import _Words, common, padded, rooted, shingles, units, whole_units

#: Words in a shingle, least percentage of similarity, coordinates of a signature, and those in which a candidate pair agrees.
SHINGLE_WORDS, PERCENT, COORDINATES, MATCHES = 2, 80, 32, 13
#: Texts of a posting that are compared as one, rows of numpy work at once, shingles hashed at once.
POSTING_ROWS, CHUNK_ROWS, HASH_CHUNK = 1024, 256, 1 << 8
#: Least shingle hashes by which pairs are screened, texts of a posting from which all its pairs are, and one posting in so many that joins most texts first.
SCREEN, SCREENED_ROWS, JOINING = 256, 8, 4
#: Rows of one text that one task joins with its group, and texts that one task compares with one other.
COPIES, STAR = 1 << 20, 512

_MAX = np.uint64(2**64 - 1)
#: Odd numbers by which a shingle's hash is multiplied: an order of all hashes for each coordinate.
_ORDERS = np.random.default_rng(11).integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """For each coordinate, the least hash in its order, mixed, with the coordinate's number in the lowest six bits."""
    low = np.full(COORDINATES, _MAX)
    for at in range(0, len(s), HASH_CHUNK):
        np.minimum(low, (s[at : at + HASH_CHUNK, None] * _ORDERS).min(axis=0), out=low)
    low = (low ^ (low >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    low ^= low >> np.uint64(29)
    return (low & ~np.uint64(63)) | np.arange(COORDINATES, dtype=np.uint64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for b in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("text"))):
        sets = [shingles(t.as_py(), SHINGLE_WORDS, known) for t in b.column("text")]
        keys = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in sets]
        toks = [signature(s).view(np.int64) if len(s) else None for s in sets]
        columns = [b.column("doc_id"), b.column("mark"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(toks, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "key", "n", "toks"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, least): the least SCREEN hashes of a text's set, cut to 15 bits."""
    known = _Words()
    for b in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("text"))):
        least = [(shingles(t.as_py(), SHINGLE_WORDS, known)[:SCREEN] & np.uint64(0x7FFF)).astype(np.int16) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(least, pa.list_(pa.int16()))], ["cid", "least"])


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the texts of each star whose set is similar to that of its hub b; a hub comes before its texts."""
    known, hub, held = _Words(), None, None
    for b in batches:
        found = []
        for star, cid, key, is_hub, text in zip(*(b.column(c) for c in ("star", "cid", "key", "hub", "text")), strict=True):
            s = shingles(text.as_py(), SHINGLE_WORDS, known)
            if hashlib.md5(s.tobytes(), usedforsecurity=False).digest() != key.as_py():
                continue  # another text at the same place
            if is_hub.as_py():
                hub, held = (star.as_py(), cid.as_py()), s
            elif hub is not None and hub[0] == star.as_py():
                common = len(s) + len(held) - len(np.unique(np.concatenate([s, held])))
                if 100 * common >= PERCENT * (len(s) + len(held) - common):
                    found.append((cid.as_py(), hub[1]))
        a, c = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])


def postings(classes: DataFrame, keep: Scratch) -> DataFrame:
    """tok, cid and mask: the postings of each text, and the coordinates of all that it is posted under, as bits."""
    tokens = classes.select(F.explode("toks").alias("tok"), "cid")
    shared = keep(tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("g")).where("g > 1"))
    # at most COORDINATES entries a text; pairs that no other text has come first in the order, but have no posting
    order = F.sort_array(F.collect_list(F.struct("g", "tok")))
    held = tokens.join(shared, "tok").groupBy("cid").agg(order.alias("held")).where(F.size("held") >= MATCHES)
    posted = held.select("cid", F.slice("held", F.lit(1), F.size("held") - (MATCHES - 1))["tok"].alias("toks"))
    mask = F.expr("aggregate(toks, 0L, (m, t) -> m | shiftleft(1L, cast(t & 63 AS int)))")
    rows = keep(posted.select("cid", mask.alias("mask"), F.explode("toks").alias("tok")))
    # a table of its own, so that Spark can split the join where one posting is very long
    counts = keep(rows.groupBy("tok").agg(F.count(F.lit(1)).alias("g")).where("g > 1"))
    return keep(rows.join(counts, "tok").drop("g"))


def matching(x: dict[str, pa.ChunkedArray], once: bool = True, least: int = MATCHES, few: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes i and j of the rows of each unit that agree in ``least`` coordinates and have two roots, and in how many they agree.

    Sizes that rule out the similarity are skipped, and with ``once`` pairs that another posting counts.  Where rows bring their least
    SCREEN hashes, so are pairs that these rule out: sets of no more hashes if they share too few, others by five
    standard deviations; the pairs then come with the hashes they share.  Small units are compared many at once, every
    row with the k-th after it; in a large one chunks along the size, of a two-sided one only across.
    """
    unit, side, n, root, mask, tok = (x[k].to_numpy() for k in ("unit", "side", "n", "root", "mask", "tok"))
    held, size = padded(x["least"], -1)
    sig = x["sig"].combine_chunks().flatten().to_numpy().reshape(len(unit), -1)
    lowest = np.int64(1) << (tok & 63)

    def alike(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        on = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        i, j = i[on], j[on]
        out = []
        for at in range(0, len(i), 1 << 14):
            p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            equal = sig[p] == sig[q]
            m = equal.sum(axis=1)
            p, q, equal, m = (y[m >= least] for y in (p, q, equal, m))
            if once:  # the least coordinate of those that agree, of which 32 bits are compared, and under which both are posted
                both = (equal * (np.int64(1) << np.arange(sig.shape[1], dtype=np.int64))).sum(axis=1) & mask[p] & mask[q]
                p, q, m = (y[(both & -both) == lowest[p]] for y in (p, q, m))
            told = (size[p] > 0) & (size[q] > 0)
            if told.any():
                c = common(held[p], held[q])
                whole = (n[p] <= SCREEN) & (n[q] <= SCREEN)
                part = PERCENT / 100
                on = ~told | (c >= np.where(whole, (n[p] + n[q]) * (part / (1 + part)) - 1e-6, part * SCREEN - 5 * np.sqrt(part * (1 - part) * SCREEN)))
                p, q, m = p[on], q[on], np.where(told, c, m)[on]
            out.append((p, q, m))
        return tuple(np.concatenate(y) for y in zip(*out, strict=True)) if out else (i, j, i)

    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    ends = np.r_[starts[1:], len(unit)]
    rows, k = np.flatnonzero(np.repeat(ends - starts <= few, ends - starts)), 1
    while len(rows) > k and (together := unit[rows[k:]] == unit[rows[:-k]]).any():
        yield alike(rows[:-k][together], rows[k:][together])
        k += 1
    for s, e in zip(starts, ends, strict=True):
        if e - s <= few:
            continue
        at = s + np.argsort(n[s:e], kind="stable")
        two = side[s:e].any() and not side[s:e].all()
        left, right = (at[side[at] == 0], at[side[at] == 1]) if two else (at, at)
        for r0 in range(0, len(left), CHUNK_ROWS):
            r = left[r0 : r0 + CHUNK_ROWS]
            for c0 in range(0 if two else r0, len(right), CHUNK_ROWS):
                c = right[c0 : c0 + CHUNK_ROWS]
                if 100 * n[r[-1]] < PERCENT * n[c[0]]:
                    break  # sizes only rise from here
                if 100 * n[c[-1]] < PERCENT * n[r[0]] or (root[r] == root[c[0]]).all() and (root[c] == root[c[0]]).all():
                    continue
                i, j = (z.ravel() for z in np.broadcast_arrays(r[:, None], c[None, :]))
                if not two and r0 == c0:
                    i, j = i[i < j], j[i < j]
                yield alike(i, j)


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid of the rows that have a candidate in their unit."""
    for x in whole_units(batches):
        cid = x["cid"].to_numpy()
        on = np.zeros(len(cid), bool)
        for i, j, _ in matching(x, once=False):
            on[i] = on[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(cid[on])], ["cid"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), a > b: pairs that join all candidates of a unit, those that agree most first; fewer than it has rows."""
    for x in whole_units(batches):
        cid, root = x["cid"].to_numpy(), x["root"].to_numpy()
        found = list(matching(x, once=False))
        if not found:
            continue
        i, j, m = (np.concatenate(y) for y in zip(*found, strict=True))
        order = np.argsort(-m, kind="stable")
        i, j = i[order], j[order]
        _, labels = np.unique(root, return_inverse=True)
        group = np.arange(len(root))
        out = []
        while len(i):
            a, b = group[labels[i]], group[labels[j]]
            i, j, a, b = (y[a != b] for y in (i, j, a, b))
            if not len(i):
                break
            ends = np.stack([a, b], axis=1).ravel()
            take = np.unique(np.unique(ends, return_index=True)[1] // 2)  # the first pair of every group
            out.append((i[take], j[take]))
            rooted(group, a[take], b[take])
        if out:
            i, j = (np.concatenate(y) for y in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(cid[i], cid[j])), pa.array(np.minimum(cid[i], cid[j]))], ["a", "b"])


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), a > b: all candidate pairs, each once."""
    for x in whole_units(batches):
        cid = x["cid"].to_numpy()
        for i, j, _ in matching(x):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(cid[i], cid[j])), pa.array(np.minimum(cid[i], cid[j]))], ["a", "b"])


def dealt(tiles: DataFrame, reach: DataFrame, prints: DataFrame, screened: int, keep: Scratch) -> DataFrame:
    """The rows of postings that hold texts of several roots, in units; a long posting is cut along the sizes of its sets.

    Rows of postings of over ``screened`` texts bring their least hashes.
    """
    rooted = keep(tiles.select("tok", "cid", "mask").join(reach, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    apart = keep(rooted.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("g")).where("lo < hi").select("tok", "g"))
    rows = rooted.join(apart, "tok").join(prints, "cid").withColumn("least", F.when(F.col("g") > screened, F.col("least")))
    carry = ["tok", "cid", "mask", "root", "n", "sig", "least"]
    out = rows.where(F.col("g") <= POSTING_ROWS).select(F.col("tok").alias("unit"), F.lit(0).alias("side"), *carry)
    if not apart.where(F.col("g") > POSTING_ROWS).isEmpty():
        # eight steps for each factor of 100 / PERCENT, so sizes within that factor are nine steps apart at most
        steps = F.floor(F.log(F.col("n").cast("double")) * (8 / np.log(100 / PERCENT))).cast("int")
        hot = rows.where(F.col("g") > POSTING_ROWS).select(F.lit(0).alias("block"), F.col("tok").alias("value"), steps.alias("pos"), *carry)
        out = out.unionByName(units(hot, 9, POSTING_ROWS, carry, keep))
    return out.repartition("unit").sortWithinPartitions("unit")


def confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, keep: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of PERCENT or more.

    The pairs of one b are a star: its texts travel to it once each, in shares of STAR texts, so no star fills a task.
    Texts are smaller than sets of hashes, and only the hub's set is held.
    """
    sizes = keep(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("of")))
    share = F.pmod(F.xxhash64("a"), F.floor(F.col("of") / STAR) + 1)
    rays = pairs.join(sizes, "b").select("a", "b", F.xxhash64("b", share).alias("star"))
    ends = rays.select("star", F.col("a").alias("cid"), F.lit(False).alias("hub")).union(rays.select("star", F.col("b").alias("cid"), F.lit(True).alias("hub")).distinct())
    ends = small(keep(ends.join(classes.select("cid", "key", "loc"), "cid").select("star", "cid", "hub", "key", F.col("loc.doc_id").alias("__id"), F.col("loc.mark").alias("__mark"))))
    texts = located(docs)
    met = texts.join(ends, same(texts, ends, {"doc_id": "__id", "mark": "__mark"})).select("star", "cid", "key", "hub", "text")
    return met.repartition("star").sortWithinPartitions("star", F.desc("hub")).mapInArrow(_starred, "a bigint, b bigint").distinct()


def linked(docs: DataFrame, classes: DataFrame, keep: Scratch) -> DataFrame:
    """(node, root) over the cid of ``classes`` that reach another one by confirmed links.

    First every text is compared with the others of its postings by a short form of the signature, and those that agree
    with none are left aside.  Then, in a part of the postings, pairs that would join all candidates are confirmed, a
    forest a posting, which joins most of what is alike; last, all candidates that are still apart.
    """
    tiles = postings(classes, keep)
    none = classes.select(F.col("cid"), F.col("cid").alias("root")).limit(0)
    short = classes.select("cid", "n", F.transform("toks", lambda t: F.shiftright(t, 48).cast("smallint")).alias("sig"), F.lit(None).cast("array<smallint>").alias("least"))
    alive = keep(dealt(tiles, none, short, 0, keep).mapInArrow(_alive, "cid bigint").distinct())
    asked = keep(classes.join(alive, "cid").select("cid", "key", "loc", "n", F.transform("toks", lambda t: F.shiftright(t, 32).cast("int")).alias("sig")))
    tiles = keep(tiles.join(alive, "cid"))
    places = small(asked.select("cid", F.col("loc.doc_id").alias("__id"), F.col("loc.mark").alias("__mark")))
    texts = located(docs)
    least = texts.join(places, same(texts, places, {"doc_id": "__id", "mark": "__mark"})).select("cid", "text").mapInArrow(_sketched, "cid bigint, least array<smallint>")
    prints = keep(asked.select("cid", "n", "sig").join(least.dropDuplicates(["cid"]), "cid"))

    some = tiles.where(F.pmod(F.xxhash64("tok"), F.lit(JOINING)) == 0)
    first = keep(dealt(some, none, prints, 0, keep).mapInArrow(_forest, "a bigint, b bigint").distinct())
    links = keep(confirmed(docs, first, asked, keep))
    reach = keep(components(links)).withColumnRenamed("node", "cid")
    rest = dealt(tiles, reach, prints, SCREENED_ROWS, keep).mapInArrow(_crossing, "a bigint, b bigint")
    rest = keep(rest.join(first, ["a", "b"], "left_anti"))
    return components(links.union(keep(confirmed(docs, rest, asked, keep))))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash that, with the id, tells where a text stands, no more) and text of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    The set of a text is its distinct shingles of SHINGLE_WORDS words, or all words as one where there are fewer.  Texts
    link if their sets have PERCENT of their union in common; component_id is the least doc_id that a row reaches, and
    kept says whether that is its own.  Texts of equal sets are one node, told by 128 bits of their shingles' hashes.

    Links are exact.  A pair of similarity 0.8 is no candidate only if it agrees in fewer than MATCHES of COORDINATES
    (a chance of 4e-7), or if both sets have over SCREEN shingles, meet in postings of over SCREENED_ROWS texts only, and
    their least hashes fall five standard deviations short (3e-7); both chances vanish above 0.8.  ``tests/llm`` compares
    with brute force.

    A null text counts as empty; a text without words links with nothing, so each such row is its own component.  A null
    doc_id keeps its row, links like any other, never names a component that has another id, and is kept only where
    the component has none.  Rows that repeat an id are rows of their own.  Texts of any length are read whole.  An empty
    table gives an empty result; other columns are ignored.
    """
    schema = "doc_id bigint, mark bigint, key binary, n bigint, toks array<bigint>"
    with Scratch(docs.sparkSession) as keep:
        d = keep(located(docs).mapInArrow(_signed, schema))
        with_words = d.where("n > 0")
        # copies of one text may be a third of all rows: shares of them are counted, and meet their group, each on its own
        shares = 16 + with_words.count() // COPIES
        share = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(shares)).alias("share")
        one = F.struct("doc_id", "mark")
        parts = with_words.select("key", share).distinct()
        classes = with_words.groupBy("key").agg(F.min("doc_id").alias("id"), F.min(one).alias("loc"), F.first("n").alias("n"), F.first("toks").alias("toks"))
        classes = keep(classes.withColumn("cid", F.monotonically_increasing_id()))  # a table, so the numbers stay
        reach = keep(linked(docs, classes, keep)).withColumnRenamed("node", "cid")
        grouped = keep(classes.select("key", "id", "cid").join(reach, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
        least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
        names = keep(grouped.join(keep(least), "root").select("key", "component_id"))
        named = keep(parts.join(names, "key"))
        out = stored(with_words.select("doc_id", "n", "key", share).join(named, ["key", "share"]).select("doc_id", "n", "component_id").union(d.where("n = 0").select("doc_id", "n", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
