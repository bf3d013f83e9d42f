"""Operators that join several tables, and the pipeline."""

import math
import random
import re

import numpy as np
import pytest
from test_documents import components_of, sets_of, words

from filamet.llm.decontaminate import contained_items, drop_contaminated, partition_of
from filamet.llm.graph import components
from filamet.llm.mixing import domain_of, mix_sources, share_out
from filamet.llm.toxicity import fit, judge, maximal_segments, toxicity, training_rows
from filamet.llm.url_filter import first_rule, host_of, path_of, url_filter
from pyspark.sql import functions as F

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@pytest.fixture(scope="module")
def items(spark, rows):
    rnd = random.Random(2)
    long = [r[1].split() for r in rows if r[1] and len(r[1].split()) > 80]
    data = []
    for k in range(60):
        w = rnd.choice(long)
        n = rnd.choice([3, 5, 7, 12, 15, 20, 30, 50, 70])
        at = rnd.randrange(max(1, len(w) - n))
        part = w[at : at + n]
        if k % 3 == 0 and n > 15:
            part[rnd.randrange(2)] = "changed"
        data.append((k, " ".join(part)))
    data += [(100, None), (101, ""), (102, "one"), (103, "no document has this item text at all anywhere"), (0, data[0][1]), (None, data[1][1])]
    return spark.createDataFrame(data, "item_id long, text string")


def test_containment(docs, rows, items, empty, odd):
    docs_ = sets_of(rows)
    want = set()
    for item, s in {(r[0], x[1]) for r, x in zip(items.collect(), sets_of([tuple(r) for r in items.collect()]))}:
        for d, x in docs_:
            if s and 100 * len(s & x) >= 80 * len(s):
                want.add((d, item, len(s), len(s & x)))
    got = [tuple(r) for r in contained_items(docs, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    kept = {r["doc_id"] for r in drop_contaminated(docs, items).collect()}
    assert kept == {r[0] for r in rows} - {w[0] for w in want}
    assert drop_contaminated(odd, items).count() == odd.count()
    assert contained_items(empty, items).count() == 0 and contained_items(docs, items.where("false")).count() == 0
    assert drop_contaminated(docs, items.where("false")).count() == len(rows)


def test_partitions():
    assert [partition_of(n) for n in (1, 8, 9, 16, 17, 32, 33, 1000)] == [0, 0, 16, 16, 32, 32, 64, 1024]


def test_components(spark):
    rnd = random.Random(4)
    path = [(k, k + 1) for k in range(300)]
    other = [(1000 + rnd.randrange(200), 1000 + rnd.randrange(200)) for _ in range(120)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(path + other + path[:5], "a long, b long")).collect()}
    label = {}
    for a, b in path + other:
        label.setdefault(a, a), label.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in path + other:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                moved = True
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in path + other)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- toxicity -----------------------------------------------------------------------------------


def test_maximal_segments():
    """Every segment found is a best one left, and they come in order."""

    def recursive(s, base=0):
        best = None
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                v = sum(s[a:b])
                if v > 0 and (best is None or v > best[0] or (v == best[0] and b - a < best[2] - best[1])):
                    best = (v, a, b)
        if best is None:
            return []
        v, a, b = best
        return recursive(s[:a], base) + [(base + a, base + b, v)] + recursive(s[b:], base + b)

    rnd = random.Random(1)
    for _ in range(60):
        s = [rnd.choice([-7, -5, -3, -2, 1.5, 2.25, 4.125, 6.5]) + rnd.random() / 64 for _ in range(rnd.randint(0, 14))]
        got = maximal_segments(np.array(s, dtype=float))
        want = recursive(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(got, want))


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(9)
    plain = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    bad = [f"nasty{c}" for c in "abcdefgh"] + ["foul", "vile"]
    rows, labels = [], []
    for i in range(900):
        w = rnd.choices(plain, k=rnd.randint(20, 200))
        y = int(rnd.random() < 0.2)
        if y:
            at = rnd.randrange(len(w))
            w[at:at] = rnd.choices(bad, k=5)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    rows += [(901, None), (902, ""), (None, "foul vile nastya foul vile"), (5, rows[5][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (901, None), (5, labels[5][1])], "doc_id long, toxic int"), dict(labels)


def test_toxicity_held_out(judged):
    docs, labels, truth = judged
    out = toxicity(docs, labels).collect()
    assert len(out) == 904
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    blank = {r["score"] for r in out if r["doc_id"] in (901, 902)}
    assert len(blank) == 1 and max(blank) < 0.5
    assert [r["predicted"] for r in out if r["doc_id"] is None] == [1]


def test_toxicity_learns_from_training_rows_only(judged):
    docs, labels, _ = judged
    import zlib

    got = [r["id"] for r in training_rows(docs, labels).collect()]
    assert got and all(zlib.crc32(str(i).encode()) % 5 for i in got)
    few = training_rows(docs, labels, sample_rows=200).count()
    assert 120 < few < 280


def test_toxicity_passages(spark, judged):
    docs, labels, _ = judged
    model = spark.sparkContext.broadcast(fit(training_rows(docs, labels)))
    text = " ".join(["abcde"] * 100 + ["foul", "vile", "foul"] + ["abcde"] * 50)
    got = spark.createDataFrame([(text,)], "t string").select(judge(F.col("t"), model).alias("j")).first()["j"]
    assert got["n_passages"] == 1 and (got["passages"][0]["first"], got["passages"][0]["end"]) == (100, 103)


def test_toxicity_without_labels(judged, empty):
    docs, labels, _ = judged
    assert {r["predicted"] for r in toxicity(docs, labels.where("false")).collect()} == {0}
    assert toxicity(empty, labels).count() == 0


# -- urls ---------------------------------------------------------------------------------------


def judge_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


URLS = ["http://A.Example.COM/en/12?x=1#y", "https://www.example.com/en/", "http://example.com", "http://example.com?q=/en/", "ftp://net/es/1", "http://x.net/fr", "http://x.net/fr/9", "x://y://z/p", "no scheme/en/", "", None, "http://notexample.com/en/1", "://h/p\nq/r?z", "http://É.com/Ü/1", "http://com/", "http://www.example.com/EN/1"]


def test_url_parts_and_rules(spark):
    data = spark.createDataFrame([(u,) for u in URLS], "url string")
    rule, says = first_rule(host_of(F.col("url")), path_of(F.col("url")), RULES)
    for r in data.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), rule.alias("rule"), says.alias("says")).collect():
        assert (r["h"], r["p"]) == judge_url(r["url"])
        fit = [(len(h + p), h + p, v) for v, h, p in RULES if (r["h"] == h or r["h"].endswith("." + h)) and r["p"].startswith(p)]
        assert (r["rule"], r["says"]) == (max(fit)[1:] if fit else (None, None))


def test_url_templates(spark):
    rows, labels = [], []
    for i in range(400):
        section = ["news", "spam", "blog"][i % 3]
        rows.append((i, f"http://host.org/{section}/title-{'abcdefghij'[i % 10]}x{'klmnopqrst'[i // 10 % 10]}y{i}/page"))
        labels.append((i, int(section != "spam")))
    rows += [(None, "http://host.org/news/1/page"), (1, rows[1][1]), (500, None), (501, "http://fresh.org/a/b/c/d/e/f")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    known = spark.createDataFrame(labels, "key long, good int")
    out = url_filter(pages, known, RULES).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert all(by[i]["verdict"] == ("block" if i % 3 == 1 else "allow") for i in range(400))
    assert by[501]["verdict"] == "allow" and by[500]["host"] == ""
    assert {r["verdict"] for r in url_filter(pages, known.where("false"), []).collect()} == {"allow"}
    assert url_filter(pages.where("false"), known, RULES).count() == 0


def test_url_sections_of_a_hot_host(spark):
    """A bad section with labels enough is judged by itself, however small its share and however deep it parts."""
    letter = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}"
    rows = [(i, f"http://hot.org/sec-{letter(i % 60)}/title-{letter(i // 60)}", i % 60 != 7) for i in range(2400)]
    rows += [(3000 + i, f"http://deep.org/a/b/c/d/{'bad' if i % 4 == 0 else 'good'}/title-{letter(i)}", i % 4 > 0) for i in range(240)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    known = spark.createDataFrame([(i, int(good)) for i, _, good in rows], "key long, good int")
    got = {r["page_id"]: r["verdict"] for r in url_filter(pages, known, []).collect()}
    assert got == {i: "allow" if good else "block" for i, _, good in rows}


def test_url_sql_on_a_hot_host(spark, tmp_path):
    """The query and its SQL on a host of 104 sections with one bad one, a host that parts late, and a path of 2000 segments."""
    import duckdb

    from filamet.llm.queries import op6
    from filamet.llm.sql import URL_FILTER

    letter = lambda i: f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}"
    rows = [(i, f"http://hot.org/sec-{letter(i % 104)}/title-{letter(i // 104)}/{i}", int(i % 104 != 7)) for i in range(6240)]
    rows += [(7000 + i, f"http://deep.net/{'/'.join('abcdefgh')}/{'bad' if i % 4 == 0 else 'good'}/t-{letter(i)}/{7000 + i}", int(i % 4 > 0)) for i in range(240)]
    rows += [(8000, "http://long.org/" + "/".join(letter(k) for k in range(2000)), 1), (8001, None, 0), (8002, "http://hot.org", None), (8003, "no url", 1)]
    spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    with duckdb.connect() as con:
        for name in ("pages", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = con.execute(URL_FILTER).fetchall()
    got = [tuple(r) for r in op6(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    bad = {r[0] for r in got if r[4] == "block"}
    assert {i for i, _, q in rows if q == 0 and i != 8001 and i < 7000} <= bad and not bad & {i for i, _, q in rows if q == 1 and i < 7000}


# -- mixing -------------------------------------------------------------------------------------


def fill(budget, children):
    """children: (name, weight, capacity) -> budgets, by repeated rounds without shortcuts."""
    got, left, live = {}, budget, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while live:
        name, w, cap = live[0]
        rest = sum(c[1] for c in live)
        if cap * rest <= left * w:
            got[name] = cap
            left -= cap
            live = live[1:]
        else:
            for name, w, cap in live:
                got[name] = min(cap, left * w // rest)
            return got
    return got


def test_share_out(spark):
    rnd = random.Random(6)
    data, want = [], {}
    for p in range(12):
        children = [(f"n{k}", rnd.randint(1, 5), rnd.randint(0, 1000) + 1) for k in range(rnd.randint(1, 9))]
        budget = rnd.randint(0, 3000)
        want.update({(p, n): b for n, b in fill(budget, children).items()})
        data += [(p, n, w, c, budget) for n, w, c in children]
    nodes = spark.createDataFrame(data, "p int, name string, weight long, capacity long, budget long")
    assert {(r["p"], r["name"]): r["budget"] for r in share_out(nodes, ["p"]).collect()} == want


@pytest.mark.parametrize("share,epochs,weights", [(0.5, 1, {}), (0.8, 3, {("domain0",): 5, ("*", "en"): 4, ("domain1", "de"): 0}), (1.0, 1, {}), (0.0, 2, {})])
def test_mixing(docs, rows, share, epochs, weights):
    import hashlib

    out = mix_sources(docs, weights=weights, share=share, max_epochs=epochs).select("row.doc_id", "domain", "lang", "source", "epoch", "n_tokens").collect()
    leaves = {}
    for i, t, lang, source, *_ in rows:
        m = re.search(r"([0-9]+)$", source or "")
        path = (f"domain{int(m[1]) % 4}" if m else "other", lang or "(none)", source or "(none)")
        leaves.setdefault(path, []).append((i, t or "", len(words(t))))
    size = {p: sum(x[2] for x in v) for p, v in leaves.items()}

    def weight(path):
        w = 1
        for names, v in sorted(weights.items(), key=lambda kv: (len(kv[0]), kv[0])):
            if len(names) == len(path) and all(n in ("*", c) for n, c in zip(names, path)):
                w = v
        return w

    def down(prefix, budget, depth):
        if depth == 3:
            return {prefix: budget}
        below = {}
        for p, n in size.items():
            if p[:depth] == prefix:
                below[p[: depth + 1]] = below.get(p[: depth + 1], 0) + n * epochs
        got = fill(budget, [(p[-1], weight(p), c) for p, c in below.items() if c and weight(p)])
        return {k: v for name, b in got.items() for k, v in down((*prefix, name), b, depth + 1).items()}

    want = []
    for path, budget in down((), int(sum(size.values()) * share), 0).items():
        whole, rest = divmod(budget, size[path])
        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        order = sorted((md5(f"17:{whole}:{i}:{md5(t)}"), i, n) for i, t, n in leaves[path])
        for i, _, n in leaves[path]:
            want += [(i, *path, e, n) for e in range(whole)]
        at = 0
        for _, i, n in order:
            if at < rest:
                want.append((i, *path, whole, n))
            at += n
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_mixing_odd(odd, empty, docs):
    assert mix_sources(empty).count() == 0
    assert mix_sources(odd, share=1.0, max_epochs=1).count() >= odd.where("length(text) > 0").count()
    assert mix_sources(docs).select("row.*").columns == docs.columns
    assert docs.select(domain_of(F.col("source")).alias("d")).where("d is null").count() == 0


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark, docs, rows, items, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    bad = "wretched loathsome vermin"
    extra = docs.columns[:5]
    more = spark.createDataFrame([(1000 + k, " ".join(f"w{k}x{q}" for q in range(60)) + (f" {bad} {bad}" if k % 4 == 0 else ""), "en", "src1", 1) for k in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    table = docs.select(*extra).unionByName(more)
    table.write.parquet(f"{sf}/documents.parquet")
    items.where("item_id is not null").write.parquet(f"{sf}/benchmark.parquet")
    more.selectExpr("doc_id", "1 as quality", "cast(doc_id % 4 = 0 as int) as toxic").write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "token_binary"]
    left = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, left, sf)
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in left.collect()} - {1000 + k for k in range(0, 200, 4)}
    two = stages["ngram_jaccard"](spark, one, sf)
    data = [tuple(r) for r in one.collect()]
    assert {r["doc_id"] for r in two.collect()} == {i for i, _, c in components_of(sets_of(data)) if c == i}
    three = stages["decontamination"](spark, two, sf)
    listed = [s for _, s in sets_of([tuple(r) for r in items.where("item_id is not null").collect()]) if s]
    clean = {i for i, s in sets_of([tuple(r) for r in two.collect()]) if not any(100 * len(s & x) >= 80 * len(x) for x in listed)}
    assert {r["doc_id"] for r in three.collect()} == clean
    four = stages["mixing"](spark, three, sf)
    picked = {r["doc_id"] for r in four.collect()}
    assert picked < clean and len(picked) > 0.8 * len(clean) and four.columns == left.columns
    whole = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in whole} == picked and whole[0].asDict().keys() == {"doc_id", "start", "n_tokens", "ids_crc32"}
