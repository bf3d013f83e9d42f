"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p : p + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
LOWER = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
first AS (SELECT s, min(doc_id) AS source FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM win JOIN first USING (s) WHERE source < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM hit),
per AS (SELECT doc_id, list(q) AS g FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(len(g), 0) AS n_removed, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k FROM d LEFT JOIN per USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

DECONTAMINATE = f"""
WITH i AS (SELECT item_id, list_distinct({SHINGLES}) AS s FROM (SELECT DISTINCT item_id, {LOWER} AS w FROM benchmark)),
d AS (SELECT doc_id, list_distinct({SHINGLES}) AS s FROM (SELECT doc_id, {LOWER} AS w FROM documents)),
p AS (SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM (SELECT doc_id, unnest(s) AS x FROM d) JOIN (SELECT item_id, len(s) AS n_item, unnest(s) AS x FROM i) USING (x) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM p WHERE 100 * n_shared >= 80 * n_item
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_distinct({SHINGLES}) AS s FROM (SELECT doc_id, {LOWER} AS w FROM documents)),
c AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), '|'))) END AS rep FROM d),
x AS (SELECT rep, n, unnest(s) AS t FROM c WHERE doc_id = rep),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b USING (t) WHERE a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, r) AS (SELECT rep, rep FROM c UNION SELECT reach.a, y.b FROM reach JOIN y ON reach.r = y.a),
m AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM c JOIN m ON c.rep = m.a
"""

URL_FILTER = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
v AS (SELECT page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '{n}', 'g'), '/') AS s0,
  TRY_CAST(nullif(regexp_extract(url, '/([0-9]{1,18})(?:\.html|/)?(?:[?#].*)?$', 1), '') AS BIGINT) AS key FROM u),
b AS (SELECT page_id, path, host, key, s0 AS segs FROM v),
lb AS (SELECT doc_id AS key, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sh AS (SELECT host, segs, count(*) AS pages, coalesce(sum(good), 0) AS good, count(good) AS labelled FROM b LEFT JOIN lb USING (key) GROUP BY host, segs),
pt AS (SELECT host, segs, pages, pos, array_to_string(segs[1 : pos], '/') AS pre FROM (SELECT host, segs, pages, unnest(range(1, len(segs) + 1)) AS pos FROM sh)),
of AS (SELECT host, pos, pre FROM pt GROUP BY ALL HAVING sum(pages) >= 30),
ld AS (SELECT pt.host, pt.segs, count(of.pos) AS k FROM pt LEFT JOIN of ON of.host = pt.host AND of.pos = pt.pos AND of.pre = pt.pre GROUP BY pt.host, pt.segs),
af AS (SELECT pt.*, k, array_to_string(pt.segs[1 : k], '/') AS base FROM pt JOIN ld USING (host, segs)),
cm AS (SELECT host, k, base, pos, segs[pos] AS seg FROM af WHERE pos > k + 1 GROUP BY ALL HAVING sum(pages) >= 30),
nm AS (SELECT af.host, af.segs, list(CASE WHEN af.pos <= af.k OR cm.seg IS NOT NULL THEN af.segs[af.pos] ELSE '*' END ORDER BY af.pos) AS names FROM af LEFT JOIN cm ON cm.host = af.host AND cm.k = af.k AND cm.base = af.base AND cm.pos = af.pos AND cm.seg = af.segs[af.pos] GROUP BY af.host, af.segs),
t AS (SELECT host, segs, '/' || array_to_string(names, '/') AS template, CASE WHEN len(names) > 1 THEN '/' || array_to_string(names[1 : len(names) - 1], '/') ELSE '' END AS parent FROM nm),
k AS (SELECT host, parent, template, sum(good) AS good, sum(labelled) AS n FROM sh JOIN t USING (host, segs) GROUP BY ALL),
ks AS (SELECT k.*, sum(good) OVER w AS pg, sum(n) OVER w AS pn, sum(good) OVER (PARTITION BY host) AS hg, sum(n) OVER (PARTITION BY host) AS hn, sum(good) OVER () AS g, sum(n) OVER () AS al FROM k WINDOW w AS (PARTITION BY host, parent)),
z AS (SELECT *, CASE WHEN pn > 0 THEN pg / pn ELSE 0.0 END::DOUBLE AS p FROM ks),
br AS (SELECT *, CASE WHEN n = 0 OR good = n * p OR abs(good - n * p) / sqrt(greatest(n * p * (1 - p), 1e-9)) < 2 THEN '' ELSE template END AS branch FROM z),
pu AS (SELECT *, (sum(good) OVER x + 10 * ((hg + 10 * CASE WHEN al > 0 THEN g / al ELSE 1 END) / (hn + 10))) / (sum(n) OVER x + 10) AS purity FROM br WINDOW x AS (PARTITION BY host, parent, branch)),
o AS (SELECT page_id, host, path, template, purity FROM b JOIN t USING (host, segs) JOIN (SELECT host, parent, template, purity FROM pu) USING (host, parent, template)),
ru AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM o)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN purity < 0.6 THEN 'block' ELSE 'allow' END AS verdict, template, round(purity, 6) AS purity FROM ru
"""


def _share(k: int, parent: list[str], name: str, weight: str, before: str) -> str:
    """Budgets of one level of the source tree, as mixing shares them out."""
    keys = ", ".join([*parent, name])
    part = f"PARTITION BY {', '.join(parent)} " if parent else ""
    source = f"SELECT {keys}, sum(tokens) * 2 AS cap, any_value({before}) AS b FROM " + ("leaf" if not parent else f"leaf JOIN g{k - 1} USING ({', '.join(parent)})") + f" GROUP BY {keys} HAVING sum(tokens) > 0"
    return f"""n{k} AS (SELECT *, {weight} AS w FROM ({source})),
o{k} AS (SELECT *, b - coalesce(sum(cap) OVER (w1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(w) OVER (w1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst FROM n{k} WINDOW w1 AS ({part}ORDER BY cap / w, {name})),
q{k} AS (SELECT *, cap * rst <= lft * w AS fit FROM o{k}),
e{k} AS (SELECT *, min(CASE WHEN NOT fit THEN {{'r': cap / w, 'n': {name}, 'l': lft, 'k': rst}} END) OVER ({part}) AS lv FROM q{k}),
g{k} AS (SELECT {keys}, CASE WHEN fit THEN cap ELSE least(cap, greatest((lv.l * w) // lv.k, 0)) END AS bud{k} FROM e{k})"""


MIXING = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, md5(coalesce(text, '')) AS h, len({WORDS}) AS tokens,
  CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'other' ELSE 'domain' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS HUGEINT) % 4) END AS domain FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL),
""" + ",\n".join([
    _share(1, [], "domain", "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END", "(SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) FROM leaf)"),
    _share(2, ["domain"], "lang", "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END", "bud1"),
    _share(3, ["domain", "lang"], "source", "1", "bud2")]) + """,
pl AS (SELECT domain, lang, source, bud3 // tokens AS whole, bud3 % tokens AS rest FROM leaf JOIN g3 USING (domain, lang, source)),
k AS (SELECT d.*, whole, rest, md5('17:' || whole || ':' || coalesce(doc_id::VARCHAR, '') || ':' || h) AS key FROM d JOIN pl USING (domain, lang, source)),
t AS (SELECT *, whole + CASE WHEN coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest THEN 1 ELSE 0 END AS times FROM k)
SELECT doc_id, domain, lang, source, CAST(unnest(range(CAST(times AS BIGINT))) AS INTEGER) AS epoch, tokens AS n_tokens FROM t
"""


# crc32 of the decimal id: bytes folded one by one, eight shifts each
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda s, b: list_reduce(range(8), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(s, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _merkle(levels: int = 5) -> str:
    """Trees of up to 16**levels leaves: per level, runs of 16 in order, the path's place in its run kept."""
    cell = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(cell, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    parts = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {leaf(LOWER_TEXT)} END AS claim FROM documents)",
        "s0 AS (SELECT source AS g, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "b0 AS (SELECT doc_id, source AS g, leaf, coalesce(claim, leaf) AS fold, '' AS sib, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)",
    ]

    def climb(tree: str, base: str, keep: str) -> None:
        for k in range(levels):
            parts.append(f"{tree}r{k} AS (SELECT g, i // 16 AS r, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {tree}{k} GROUP BY g, i // 16)")
            parts.append(f"{tree}{k + 1} AS (SELECT g, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, r AS i, (n + 15) // 16 AS n FROM {tree}r{k})")
            left, right = f"array_to_string(hs[1 : b.i % 16], '')", "array_to_string(hs[b.i % 16 + 2 : 16], '')"
            parts.append(f"{base}{k + 1} AS (SELECT {keep}, CASE WHEN b.n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold, CASE WHEN b.n = 1 THEN sib ELSE sib || {left} || {right} END AS sib, b.i // 16 AS i, (b.n + 15) // 16 AS n FROM {base}{k} b JOIN {tree}r{k} t ON b.g IS NOT DISTINCT FROM t.g AND b.i // 16 = t.r)")

    climb("s", "b", "doc_id, b.g, leaf")
    parts.append(f"t0 AS (SELECT 1 AS g, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, g AS name FROM s{levels})")
    parts.append(f"c0 AS (SELECT doc_id, b.g AS name, leaf, t.h AS subroot, fold, sib, t.i, t.n, 1 AS g FROM b{levels} b JOIN t0 t ON b.g IS NOT DISTINCT FROM t.name)")
    climb("t", "c", "doc_id, leaf, subroot, b.g")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM c{levels} CROSS JOIN (SELECT h FROM t{levels})"


LOWER_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MERKLE_MANIFEST = _merkle()

# runs are stretches of word pairs p apart: 16-word windows that return p words later, one after another
PERIODIC_RUNS = rf"""
WITH raw AS (SELECT doc_id, {WORDS} AS w, {_CRC} AS h FROM documents),
laid AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM laid),
win AS (SELECT doc_id, p, hash(array_to_string(w[p + 1 : p + 16], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 15)) AS p FROM d)),
twice AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
few AS (SELECT win.* FROM win JOIN twice USING (doc_id, s)),
pair AS (SELECT x.doc_id, x.p, y.p - x.p AS q FROM few x JOIN few y ON x.doc_id = y.doc_id AND x.s = y.s AND x.p < y.p),
island AS (SELECT doc_id, q, p, p - row_number() OVER (PARTITION BY doc_id, q ORDER BY p) AS k FROM pair),
stretch AS (SELECT doc_id, q, min(p) AS s, max(p) + q + 16 AS e FROM island GROUP BY doc_id, q, k),
run AS (SELECT doc_id, s AS start, e - s AS length, min(q) AS period FROM stretch WHERE e - s >= greatest(24, 3 * q) GROUP BY doc_id, s, e),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM run),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS p FROM run) GROUP BY doc_id),
kept AS (SELECT d.doc_id, array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i - 1)) END, ' ') AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT kept.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(kept.k) AS collapsed_sha256
FROM kept LEFT JOIN per USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (doc_id)
"""
