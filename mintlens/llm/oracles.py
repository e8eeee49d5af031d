"""The corpus queries in SQL, where SQL can express them; DuckDB runs these over the same tables."""

from __future__ import annotations

from . import decontam, fim, phrases, secrets, urls


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- 2 secrets: what stands between the matches gives their places ------------------------------------------------------------------
def _spelt(kind: str, pattern: str, group: int, least: int) -> str:
    """The rule for RE2: letters in either case spelt out, as its folding goes beyond ASCII; where a match has no parts,
    its least length in the pattern, as a run that is long enough is the same run."""
    if kind in secrets.BASE.any_case:
        head, _, tail = pattern.partition(")")
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail
    return pattern[:-1] + f"{{{least - (len('AKIA') if pattern.startswith('AKIA') else 0)},}}"


def secrets_sql() -> str:
    size = "list_transform({}, lambda x: len(x))"
    kinds = []
    for n, rule in enumerate(secrets.BASE.rules):
        kind, _, group, least = rule
        p = _text(_spelt(*rule))
        at = f"CAST(list_sum({size.format('g[1:i]')}) + coalesce(list_sum({size.format('w[1:i - 1]')}), 0) AS BIGINT)"
        kinds.append(f"SELECT row, {n} AS n, {_text(kind)} AS kind, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'s': {at}, 'e': {at} + len(w[i]), 'v': len(v[i])}})) AS m FROM (SELECT row, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {group}) AS v, regexp_split_to_array(t, {p}) AS g FROM d)")
    counts = ", ".join(f"count(*) FILTER (kind = {_text(k)}) AS n_{k}" for k, *_ in secrets.BASE.rules)
    floor = " ".join(f"WHEN {_text(k)} THEN {least}" for k, _, _, least in secrets.BASE.rules)
    names = [f"n_{k}" for k, *_ in secrets.BASE.rules]
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
f AS (SELECT row, {counts}, string_agg(kind || ':' || m.s || ':' || m.e, ',' ORDER BY m.s, n) AS spans FROM m WHERE m.v >= CASE kind {floor} END GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in names)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (row)"""


# -- 6 nearest neighbours: each query against every other row -----------------------------------------------------------------------------
def nearest_sql(k: int = 5, every: int = 50) -> str:
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
u AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(list_cosine_similarity(q.v, c.v)) AS score FROM u q JOIN u c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v) GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= {k}"""


# -- 7 decontamination: every shingle of every document against every item's -------------------------------------------------------
def _shingles(words: str, size: int) -> str:
    long = f"list_transform(range(1, len({words}) - {size - 2}), lambda i: array_to_string({words}[i:i + {size - 1}], ' '))"
    return f"CASE WHEN len({words}) >= {size} THEN {long} WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


def decontamination_sql(size: int = decontam.SHINGLE_WORDS, threshold: float = decontam.THRESHOLD) -> str:
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS row, {words} AS w FROM documents),
iw AS (SELECT item_id, row_number() OVER () AS item, {words} AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, row, unnest({_shingles("w", size)}) AS s FROM dw),
i AS (SELECT DISTINCT item_id, item, unnest({_shingles("w", size)}) AS s FROM iw),
n AS (SELECT item, count(*) AS n_item FROM i GROUP BY 1),
c AS (SELECT doc_id, item_id, row, item, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY ALL),
f AS (SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM c JOIN n USING (item) WHERE n_shared >= ceil(n_item * {threshold}::DOUBLE - 1e-9))
SELECT doc_id, item_id, containment, n_shared, n_item FROM f
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, n_item DESC, n_shared DESC) = 1"""


# -- 8 URL filters: each url against each rule ------------------------------------------------------------------------------------------
def urls_sql(rules: tuple[urls.Rule, ...] = urls.RULES, default: str = "allow") -> str:
    listed = ", ".join(f"({_text(r.host)}, {_text(r.path)}, {_text(r.verdict)})" for r in rules)
    return f"""
WITH rules AS (SELECT *, host || path AS spelt FROM (VALUES {listed}) AS t(host, path, verdict)),
cut AS (SELECT page_id, row_number() OVER () AS row, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, row, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
m AS (SELECT row, arg_max({{'spelt': r.spelt, 'verdict': r.verdict}}, {{'n': len(r.spelt), 'block': r.verdict = 'block', 'spelt': r.spelt}}) AS best
 FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY row)
SELECT page_id, host, path, best.spelt AS rule, coalesce(best.verdict, {_text(default)}) AS verdict FROM p LEFT JOIN m USING (row)"""


# -- 12 phrases: every n-gram counted --------------------------------------------------------------------------------------------------------
def phrases_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS t(k)),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT x.*, l.f AS l, r.f AS r, CAST((CAST({phrases.SCALE} AS HUGEINT) * a) // (l.f + r.f) AS BIGINT) AS score
 FROM x JOIN f l ON l.lang = x.lang AND l.phrase = lp JOIN f r ON r.lang = x.lang AND r.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT DISTINCT c.lang, inside.phrase FROM c JOIN c inside ON inside.lang = c.lang AND inside.k < c.k
 AND contains(' ' || c.phrase || ' ', ' ' || inside.phrase || ' ') AND CAST(100 AS HUGEINT) * c.a >= CAST({phrases.SUBSUMED} AS HUGEINT) * inside.a),
k AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN i USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM k JOIN n USING (lang) WHERE rank <= {phrases.FIRST}"""


# -- 13 fill in the middle: units found one after the other, the text itself in place of what is rebuilt ------------------------------------------
def fim_sql() -> str:
    unit = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
    draw = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, {draw}, regexp_extract_all(t, '{unit}') AS u FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {100 - fim.PLAIN_PERCENT} THEN 'plain' WHEN h4 % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(len(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
