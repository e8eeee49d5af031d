"""Phrases, fill in the middle and MinHash near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mintlens.llm import fim, minhash, oracles, phrases, simhash

from test_sql import rows

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(n, t, lang, "s", 0) for n, t in enumerate(texts)], DOCS)


def view(df, path):
    df.write.parquet(str(path))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{path}/*.parquet'")
    return db


# -- 12 phrases ---------------------------------------------------------------------------------------------------------------
def odd_texts():
    rng = random.Random(5)
    vocabulary = ["a", "B", "b", "é", "İ", "x\x1cy", "c-d", "z z", "q"]
    return [rng.choice([" ", "\t ", "  "]).join(rng.choices(vocabulary, k=40)) + rng.choice([".", "\n", ";;", ""]) for _ in range(120)]


def test_phrases_match_sql_at_any_width_of_the_sketch(spark, tmp_path):
    langs = ["en", None, "und", "de"]
    data = [(n, t, langs[n % 4], "s", 0) for n, t in enumerate(odd_texts())] + [(None, None, "en", None, None), (1, "", "fr", "s", 0), (2, "a b. a\nb", None, "s", 0)] * 2
    df = spark.createDataFrame(data, DOCS)
    db = view(df, tmp_path / "d")
    want = db.sql(oracles.phrases_sql()).df()
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("phrase", "f", "w", "rank", "n", "share", "a")))
    for width in (None, 1 << 3, 1 << 16):
        got = phrases.collocations(clash, width=width).toPandas()
        assert rows(got) == rows(want) and set(want["lang"]) == {"en", "und", "de"} and len(want) > 40
    assert phrases.collocations(df.limit(0)).count() == 0 and phrases.collocations(df.where("lang = 'fr'")).count() == 0


def test_first_phrases_and_large_counts(spark, monkeypatch):
    df = frame(spark, odd_texts())
    whole, first = phrases.collocations(df).collect(), phrases.collocations(df, first=7).collect()
    assert sorted(map(tuple, first)) == sorted(tuple(r) for r in whole if r["rank"] <= 7) and len(first) == 7
    monkeypatch.setattr(phrases, "RANKED", 10)  # ranked in shares, several times over
    for most in (2, 3, 7):
        assert sorted(map(tuple, phrases.collocations(df, first=most).collect())) == sorted(tuple(r) for r in whole if r["rank"] <= most)
    # counts whose products pass 64 bits
    big = 4 * 10**17
    counts = spark.createDataFrame([("en", "x", big + 3), ("en", "y", big + 9), ("en", "z", big), ("en", "x y", big), ("en", "y z", big), ("en", "x y z", big * 79 // 100)], "lang string, phrase string, f bigint")
    got = {r.phrase: r.score for r in phrases.scored(counts).collect()}
    assert got["x y"] == 2_000_000 * big // (2 * big + 12)
    assert got["x y z"] == min(2_000_000 * (big * 79 // 100) // (2 * big + 3), 2_000_000 * (big * 79 // 100) // (2 * big))
    assert phrases.subsumed(counts).count() == 0 and {r.phrase for r in phrases.subsumed(counts, 79).collect()} == {"x y", "y z"}


def test_phrases_of_long_texts_and_of_many_chunks(spark, monkeypatch):
    text = ("one two three. " * 400 + "no end here " * 500).strip()
    want = {(r.phrase, r.a, r.n) for r in phrases.collocations(frame(spark, [text])).collect()}
    pieces = Counter()
    for piece in text.split("."):
        w = piece.split()
        pieces.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert all(pieces[p] == a and n == 2700 for p, a, n in want) and want
    import pyarrow as pa

    monkeypatch.setattr(phrases, "CHUNK_BYTES", 64)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 40), pa.array([b"A b. c d" * 20, b""] * 40)], ["lang", "text"])
    cut = defaultdict(bytes)
    for lang, chunk in phrases.chunks([batch]):
        cut[lang] += b"." + chunk
    assert [x for x in cut["en"].split(b".") if x] == [x for x in (b".".join([b"a b. c d" * 20] * 40)).split(b".") if x]


def test_a_sketch_never_counts_too_little():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    times = rng.integers(1, 60, 5000)
    bits = []
    for row in range(phrases.DEPTH):
        total = np.zeros(1 << 12, np.int64)
        np.add.at(total, phrases.cells(h, row, 1 << 12), times)
        bits.append(np.packbits(total >= 30))
    ok = phrases.passes(bits, h, 1 << 12)
    assert ok[times >= 30].all() and not ok[times < 5].all()
    assert phrases.width_for(0) == 1 << 10 and phrases.width_for(1 << 60) == phrases.MOST_CELLS


# -- 13 fill in the middle ------------------------------------------------------------------------------------------------------
UNITS = {
    "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "character": r"(?s).",
    "line": r"[^\n]*\n|[^\n]+",
    "sentence": None,
    "paragraph": None,
}
ODD = [None, "", " \t\n", "one", "a😀 😀b  c ", "😀😀", "x<P>y z", "<S>", "a <M", "< <S <", "  é\n\n\nñ\x0b\x1cx y z. Q! r", "w " * 30_000]


def test_fill_in_middle_against_brute_force(spark, tmp_path):
    texts = ODD + [f"doc {n} < <S <P of some words{' ' * (n % 3)}" for n in range(300)]
    df = frame(spark, texts).union(spark.createDataFrame([(None, "a null id here", None, None, None), (7, "again the same id", "en", "s", 0)], DOCS))
    got = fim.digest(df.select("*", *(F.lit("x").alias(c) for c in ("u", "c", "parts", "restored", "form", "h1")))).collect()
    want = []
    for r in df.collect():
        t = r.text or ""
        u = re.findall(UNITS["word"], t)
        h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        lo, hi = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r.doc_id, len(u), form, *((None, None) if form == "plain" else (len(p), len(m))), sha(out), sha(t)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and {w[2] for w in want} == {"plain", "psm", "spm"}
    assert rows(fim.digest(df).toPandas()) == rows(view(df, tmp_path / "d").sql(oracles.fim_sql()).df())
    assert fim.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", sorted(fim.GRAMMARS))
def test_every_grammar_rebuilds_the_text(spark, unit):
    df = frame(spark, ODD + ["One. Two! three\nfour\n\nfive  \n\n\n six."] * 40)
    made = fim.transform(df, unit, plain_percent=0)
    back = fim.restored(made)
    assert back.where("restored <> text").count() == 0 and back.where("form <> 'plain'").count() > 30
    if UNITS[unit]:
        for r in df.select("text", fim.units(F.coalesce("text", F.lit("")), fim.GRAMMARS[unit]).alias("u")).collect():
            assert r.u == re.findall(UNITS[unit], r.text or "")
    assert "restored" in back.columns and "_restored" in fim.restored(back).columns


def test_markers_that_cannot_be_told_apart(spark):
    for bad in (("", "s", "m"), ("ab", "a", "m"), ("<a<", "b", "m"), ("xa", "ay", "m")):
        with pytest.raises(ValueError):
            fim.Markers(*bad)
    m = fim.Markers("[pre]", "[suf]", "[mid]")
    back = fim.restored(fim.transform(frame(spark, ["a b c d [pre e"] * 50), markers=m), markers=m)
    assert back.where("restored <> text").count() == 0 and back.where("output like '%[mid]%'").count() > 10


# -- 11 MinHash near-duplicates -------------------------------------------------------------------------------------------------
def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute_components(data):
    """One row an item: (doc_id, size, least id reachable, kept)."""
    sets = [shingle_set(t) for _, t in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(data):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i)), doc == least.get(root(i))) for i, (doc, _) in enumerate(data)]


def families(rng, words=90):
    """Chains of revisions, templates whose texts are alike by a half, copies around 0.8, and the odd ones."""
    vocabulary = [f"w{n}" for n in range(4000)]
    fresh = lambda n: rng.choices(vocabulary, k=n)
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE  two", "one two three", "é ñ", "É ñ", "a\x1cb c"]
    for _ in range(6):
        w = fresh(words)
        for _ in range(12):
            texts.append(" ".join(w))
            for _ in range(3):
                w[rng.randrange(words)] = rng.choice(vocabulary)
    shared = fresh(60)
    texts += [" ".join(shared + fresh(30)) for _ in range(60)]
    for _ in range(40):
        w = fresh(words)
        texts.append(" ".join(w))
        for k in rng.sample(range(words), rng.choice([4, 5, 6, 10])):
            w[k] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    return texts + texts[:40] + [texts[20].upper() + "\n"] * 30


def test_minhash_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    texts = families(rng)
    order = list(range(len(texts)))
    rng.shuffle(order)
    data = [(order[n], t) for n, t in enumerate(texts)] + [(None, texts[30]), (None, "alone of its kind here"), (None, None), (3, texts[40]), (3, texts[90])]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("mark", "key", "n", "toks", "cid", "share", "root", "component_id")))
    want = brute_components(data)
    for posting in (minhash.POSTING_ROWS, 8):
        monkeypatch.setattr(minhash, "POSTING_ROWS", posting)
        got = minhash.near_duplicates(clash).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert 100 < sum(not k for *_, k in want) < len(want) - 100
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.near_duplicates(df.where("text is null")).count() == 3


def test_minhash_of_large_groups(spark):
    """A group of near copies, a template and copies of one text, each beyond what is compared as one."""
    rng = random.Random(2)
    vocabulary = [f"w{n}" for n in range(5000)]
    base, shared = rng.choices(vocabulary, k=80), rng.choices(vocabulary, k=50)

    def changed(k):
        w = list(base)
        for i in rng.sample(range(80), k):
            w[i] = rng.choice(vocabulary)
        return " ".join(w)

    texts = [changed(rng.choice([1, 2, 3, 6, 7, 9])) for _ in range(1200)] + [" ".join(shared + rng.choices(vocabulary, k=30)) for _ in range(300)] + ["the same words again"] * 3000
    data = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string").repartition(7)).collect()}
    distinct = {t: n for n, t in reversed(data)}
    want = {doc: c for doc, _, c, _ in brute_components([(n, t) for t, n in distinct.items()])}
    assert all(got[n] == want[distinct[t]] for n, t in data)


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(4)
    share = []
    for n in (5, 40, 400):
        for _ in range(200):
            both, a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (int(n * 0.8), (n - int(n * 0.8)) // 2, n - int(n * 0.8) - (n - int(n * 0.8)) // 2))
            x, y = (minhash.signature(np.unique(np.concatenate([both, z]))) for z in (a, b))
            share.append((x == y).sum())
    share = np.array(share)
    assert abs(share.mean() / minhash.COORDINATES - 0.8) < 0.02 and (share >= minhash.MATCHES).all()


def test_skipped_postings_lose_no_pair(spark, tmp_path):
    """The posted coordinates of any two texts that agree in MATCHES of them have one in common."""
    texts = [t for t in families(random.Random(3)) if t and t.strip()]
    sig = {t: set(minhash.signature(simhash.shingles(t.encode(), 2, simhash._Words())).tolist()) for t in texts}
    rows_ = [(n, [x - (1 << 64) if x >> 63 else x for x in s]) for n, s in enumerate(sig.values())]
    df = spark.createDataFrame(rows_, "cid bigint, toks array<bigint>")
    with simhash.Scratch(spark) as keep:
        posted = defaultdict(set)
        for r in minhash.postings(df, keep).collect():
            posted[r.cid].add(r.tok)
    for i, a in rows_:
        for j, b in rows_[:i]:
            if len(set(a) & set(b)) >= minhash.MATCHES:
                assert posted[i] & posted[j]


# -- 1 sharding, draw by draw -------------------------------------------------------------------------------------------------------
def test_shards_follow_the_draws(spark):
    from math import log

    from mintlens.llm import sharding

    def reach(key, node, path=""):
        """The child of the smallest draw, level by level."""
        if not isinstance(node, dict):
            return None
        draw = lambda k: -log((int(hashlib.md5(f"{path}/{k}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / sharding.weight(node[k])
        best = min(node, key=draw) if len(node) > 1 else next(iter(node))
        return best if not isinstance(node[best], dict) else reach(key, node[best], f"{path}/{best}")

    ids = [*range(400), -7, None]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
    eight, nine = sharding.topology(8), sharding.topology(9)
    got = sharding.shard_documents(df).collect()
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (reach(key, eight), reach(key, nine))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
