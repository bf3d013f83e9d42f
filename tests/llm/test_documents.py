"""Operators on whole documents against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filamet.llm.license_scan import Index, align, license_scan, winnow
from filamet.llm.ngram_join import drop_similar, ngram_jaccard
from filamet.llm.piece_counts import Automaton, token_counts, vocabulary
from filamet.llm.quality import quality
from filamet.llm.substring_dedup import recompress, substring_dedup
from filamet.llm.token_file import bit_width, pack, read_at, read_documents, unpack, write_tokens
from filamet.session import checkpoint_root

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def sets_of(rows):
    out = []
    for i, t, *_ in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def components_of(sets):
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                label[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(s), least.get(find(a))) for a, (i, s) in enumerate(sets)]


def key(rows):
    return sorted(rows, key=repr)


def test_jaccard(docs, rows):
    got = [tuple(r) for r in ngram_jaccard(docs).collect()]
    assert key(got) == key(components_of(sets_of(rows)))


@pytest.mark.parametrize("unit,small", [(3, 2), (4, 32)])
def test_jaccard_in_small_units(docs, rows, monkeypatch, unit, small):
    """Clusters above the unit size and frequent tokens take the other way, with the same answer."""
    import filamet.llm.ngram_join as j

    monkeypatch.setattr(j, "UNIT_DOCS", unit)
    monkeypatch.setattr(j, "SMALL", small)
    monkeypatch.setattr(j, "SALT_ROWS", 5)
    got = [tuple(r) for r in ngram_jaccard(docs).collect()]
    assert key(got) == key(components_of(sets_of(rows)))


def test_jaccard_odd(odd, empty):
    got = key(tuple(r) for r in ngram_jaccard(odd).collect())
    assert got == key(components_of(sets_of([tuple(r) for r in odd.collect()])))
    assert ngram_jaccard(empty).count() == 0


def test_jaccard_with_full_counters(spark, monkeypatch):
    # the counters of a large corpus tell a passage of 120 documents from their own words no more
    import filamet.llm.ngram_join as j

    rng = np.random.default_rng(3)
    full = lambda *a: j_summed(*a) + rng.integers(0, 1000, (a[1], a[2]))
    edges = []
    j_summed, j_components = j.summed_chunks, j.components
    monkeypatch.setattr(j, "summed_chunks", full)
    monkeypatch.setattr(j, "components", lambda e: edges.append(e.count()) or j_components(e))
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [" ".join(f"w{i}x{k}" for k in range(100)) + " " + passage for i in range(120)]
    texts += [texts[7] + " more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard(df).collect()}
    assert got == {i: i for i in range(120)} | {120: 7}
    assert edges[0] <= 3  # once a star over all documents of the passage


def test_drop_similar(docs, rows, odd):
    kept = {r["doc_id"] for r in drop_similar(docs).collect()}
    assert kept == {i for i, _, c in components_of(sets_of(rows)) if c == i}
    out = drop_similar(odd).collect()
    assert Counter(r["doc_id"] for r in out) == Counter([None, None, None, 4, 9]) or Counter(r["doc_id"] for r in out)[4] == 1
    assert set(drop_similar(odd).columns) == set(odd.columns)


def test_drop_similar_by_id_and_text(spark):
    """Another text under the id of a dropped copy stays; copies without an id are reduced to one."""
    t, other, third = ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven", "red green blue yellow black white")
    rows = [(1, t), (2, t), (2, other), (2, other), (3, other.upper()), (None, third), (None, third), (None, t), (None, None), (None, ""), (5, None), (5, ""), (6, "x y z a b c d")]
    docs = spark.createDataFrame([(*r, "u") for r in rows], "doc_id long, text string, _KEY0 string")
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in drop_similar(docs).collect()]
    assert Counter(got) == Counter([(1, t), (2, other), (None, third), (None, ""), (None, ""), (5, ""), (6, "x y z a b c d")])
    assert drop_similar(docs).columns == docs.columns


def cut(rows, width=50):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            if i is not None:
                first[s] = min(i, first.get(s, i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings(docs, rows, odd, empty):
    assert key(tuple(r) for r in substring_dedup(docs).collect()) == key(cut(rows))
    assert key(tuple(r) for r in substring_dedup(odd).collect()) == key(cut([tuple(r) for r in odd.collect()]))
    assert substring_dedup(empty).count() == 0


def test_substrings_keep_text(docs):
    for r in substring_dedup(docs, keep_text=True).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_recompression_is_consistent():
    """A settled symbol of a passage appears wherever the passage does."""
    rnd = np.random.default_rng(1)
    passage = rnd.integers(0, 50, 120).astype(np.uint64)
    runs = []
    for pad in (3, 17, 40):
        h = np.concatenate((rnd.integers(0, 50, pad).astype(np.uint64), passage, rnd.integers(0, 50, pad + 5).astype(np.uint64)))
        sym, _, lo, hi = recompress(h, np.zeros(len(h), dtype=np.int64), rounds=4)
        inside = (lo >= pad) & (hi <= pad + len(passage))
        runs.append({(int(s), int(a) - pad) for s, a in zip(sym[inside], lo[inside])})
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 5


def test_token_file(spark, docs, rows, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = f"{checkpoint_root(spark)}/tokens-test"
    width = write_tokens(docs, out, path)
    assert width == bit_width(t.get_vocab_size()) == 16
    got = {r["doc_id"]: tuple(r) for r in read_documents(spark, out, width).collect()}
    at = 0
    for i, text, *_ in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[i] == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert read_at(spark, out, width, [5])[0][1] == [*t.encode(dict((r[0], r[1]) for r in rows)[5] or "", add_special_tokens=False).ids, 2]
    write_tokens(odd, out + "odd", path)
    assert read_documents(spark, out + "odd", width).count() == odd.count()
    write_tokens(empty, out + "empty", path)
    assert read_documents(spark, out + "empty", width).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> x<|startoftext|>.", "Don't WE'LL I'd 12,345! «été» İSTANBUL Σίσυφος ΣΑΣ", "a\u0301 e\u0301\u00a0x\u2003y \x1cz\x85 ﬁ ǅ", "日本語テキスト 한국어 emoji 🙂🙂 e\u0301\u0323"])
def test_encoding_by_words(text):
    from filamet.llm.token_file import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    assert np.frombuffer(Encoder(path).encode([text])[0], dtype="<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    raw = pack(ids, width)
    assert len(raw) == -(-1001 * width // 8)
    assert (unpack(raw, width, 1001) == ids).all() and (unpack(raw, width, 30, 517) == ids[517:547]).all()


def greedy(word, starts, inner):
    at = n = 0
    while at < len(word):
        allowed = starts if at == 0 else inner
        for k in range(len(word) - at, 0, -1):
            if word[at : at + k] in allowed:
                at, n = at + k, n + 1
                break
        else:
            return -1
    return n


def test_automaton_against_greedy_matching():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        starts = {bytes(rnd.integers(97, 100, rnd.integers(1, 5)).tolist()) for _ in range(6)}
        inner = {bytes(rnd.integers(97, 100, rnd.integers(1, 5)).tolist()) for _ in range(6)}
        both, one = Automaton(sorted(starts), sorted(inner)), Automaton(sorted(starts))
        for _ in range(60):
            w = bytes(rnd.integers(97, 100, rnd.integers(1, 12)).tolist())
            assert both.count(w) == greedy(w, starts, inner)
            assert one.count(w) == greedy(w, starts, starts)
        assert both.count(b"") == 0


def test_token_counts(docs, rows, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    entries = vocabulary(path)
    inner = {e for e in entries if e[:1] != b" "}
    starts = inner | {e[1:] for e in entries if e[:1] == b" " and len(e) > 1}
    got = {r["doc_id"]: tuple(r) for r in token_counts(docs, path).collect()}
    for i, t, *_ in rows:
        w = words(t)
        assert got[i] == (i, len(w), sum(abs(greedy(x.encode(), starts, inner)) for x in w), 0)
    assert token_counts(odd, path).count() == odd.count() and token_counts(empty, path).count() == 0


def test_quality_base(docs, rows, labels, odd, empty):
    got = {r["doc_id"]: r for r in quality(docs, labels).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {q for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for q in range(k, k + 8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), t[:60]
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality(odd, labels).count() == odd.count() and quality(empty, labels).count() == 0
    assert {r["llr"] for r in quality(odd, labels.where("false")).collect()} == {0.0}


def test_quality_ratio(spark):
    """Ratios against a count by hand."""
    from filamet.llm.quality import BUCKETS, MILLION, ratios

    docs = spark.createDataFrame([(1, "a b"), (2, "a a c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    bucket = {w: spark.sql(f"select pmod(xxhash64('{w}'), {BUCKETS}) b").first()["b"] for w in "abc"}
    got = {r["bucket"]: r["ratio"] for r in ratios(docs, labels).collect()}
    for w, t, n in (("a", 1, 3), ("b", 1, 1), ("c", 0, 1)):
        assert got[bucket[w]] == round(float(np.log((t + 1) / (3 + BUCKETS) / ((n + 1) / (8 + BUCKETS)))) * MILLION)


def test_license(docs, spark, empty, odd):
    text = "Some words.\nLicensed under the Apache License, Version 2.0. More, and released under the mit license! Nothing else."
    d = spark.createDataFrame([(1, text), (2, "Licensed under nothing in particular"), (None, "licensed under CC BY-NC 4.0"), (3, None), (4, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["coverage"], r["first_word"], r["end_word"]) for r in license_scan(d).collect()}
    assert got == {(1, "Apache-2.0-short"): (1.0, 2, 9), (1, "MIT-short"): (1.0, 11, 16), (None, "CC-BY-NC-4.0-short"): (1.0, 0, 5)}
    assert license_scan(docs).count() == 0 and license_scan(empty).count() == 0 and license_scan(odd).count() == 0


def test_license_edited():
    """A notice with changed, missing and added words is still found, with its coverage."""
    from filamet.llm.license_scan import TEMPLATES, tokens

    full = TEMPLATES["MIT"].split()
    edited = [w for k, w in enumerate(full) if k not in (10, 40)]
    edited[20] = "CHANGED"
    edited[30:30] = ["two", "more"]
    hits = Index(TEMPLATES).matches("intro " * 500 + " ".join(edited) + " outro" * 300)
    assert len(hits) == 1 and hits[0][0] == "MIT" and hits[0][2] == 500
    assert abs(hits[0][1] - (len(tokens(TEMPLATES["MIT"])) - 3) / len(tokens(TEMPLATES["MIT"]))) < 1e-9


def test_short_licenses_edited():
    """Every change of as many words as the coverage bar allows, and words put in anywhere, in every short template."""
    from itertools import combinations

    from filamet.llm.license_scan import LEAST_COVERAGE, TEMPLATES, tokens

    index = Index(TEMPLATES)
    for name in ("Apache-2.0-short", "MIT-short", "GPL-3.0-short", "CC-BY-NC-4.0-short"):
        words = [w.decode() for w in tokens(TEMPLATES[name])]
        most = max(k for k in range(len(words)) if len(words) - k >= LEAST_COVERAGE * len(words))
        for k in range(1, most + 1):
            for gone in combinations(range(len(words)), k):
                text = " ".join(["some", "intro", *("changed" if i in gone else w for i, w in enumerate(words)), "and", "an", "end"])
                hits = index.matches(text)
                assert [(h[0], round(h[1] * len(words))) for h in hits] == [(name, len(words) - k)], text
        for at in combinations(range(1, len(words)), 2):
            text = " ".join(("new " if i in at else "") + w for i, w in enumerate(words))
            assert index.matches(text) == [(name, 1.0, 0, len(words) + 2)], text


def test_repeated_licenses():
    """Every copy of a notice is a passage: in a row, edited, among other notices."""
    from filamet.llm.license_scan import TEMPLATES, tokens

    index = Index(TEMPLATES)
    spans = lambda text: sorted((h[2], h[3], h[0]) for h in index.matches(text))
    sizes = {name: len(tokens(t)) for name, t in TEMPLATES.items()}
    for name, size in sizes.items():
        for k in (2, 3, 9):
            assert spans(" ".join([TEMPLATES[name]] * k)) == [(i * size, (i + 1) * size, name) for i in range(k)]
    mit = "MIT-short"
    assert spans("Released the MIT License. Released under the MIT License.") == [(0, 4, mit), (4, 9, mit)]
    assert spans("Released under the MIT Licence. Release under the MIT License.") == [(0, 4, mit), (6, 10, mit)]
    assert spans("Released under the new and improved MIT License.") == [(0, 8, mit)]
    at, text, want = 0, [], []
    for name in [mit, "Apache-2.0-short", mit, "MIT", "CC-BY-NC-4.0-short", "CC-BY-NC-4.0-short", "GPL-3.0-short", "Apache-2.0", "Apache-2.0-short"] * 2:
        text.append(TEMPLATES[name])
        want.append((at, at := at + sizes[name], name))
    assert spans("\n".join(text)) == want


def test_alignment_and_winnowing():
    a = np.array([1, 2, 3, 4, 5], dtype=np.uint64)
    assert align(a, np.array([9, 9, 1, 2, 8, 3, 5], dtype=np.uint64), 2) == (4, 2, 7)
    grams = np.array([7, 3, 9, 3, 8, 8, 1, 6], dtype=np.uint64)
    want = set()
    for k in range(len(grams) - 3):
        part = grams[k : k + 4]
        want.add(k + max(q for q in range(4) if part[q] == part.min()))
    assert set(winnow(grams, 4).tolist()) == want




def test_encoding_remembers_and_forgets(rows, monkeypatch):
    """Tiny generations: what is forgotten is tokenised again, with the same ids."""
    import filamet.llm.token_file as f

    monkeypatch.setattr(f, "REMEMBERED", 40)
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), f.Encoder(path)
    texts = [r[1] for r in rows] + ["End). (x)? foo!? 3.5, 7; é! ».. it's. <|endoftext|>. <|ENDOFTEXT|>! ... a.b."]
    for x in texts + texts[:20]:
        assert np.frombuffer(e.encode([x])[0], dtype="<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_words_of_letters_go_together(monkeypatch):
    """Letters that normalise to more than letters, and combining marks, do not shift the cut."""
    import filamet.llm.token_file as f

    monkeypatch.setattr(f, "JOINED", 7)
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), f.Encoder(path)
    for x in ["क़ख़ग़ alpha beta gamma", "ẖello H̱ELLO T̈a J̌ ẘ", "İstanbul ISTANBUL ıI ﬁn ǅ ΣΑΣ ΑΣ", "x². ½, Ⅷ; a_. a_b, _!", "a b c d e f g h i j k l m n o p q r s t", "don't. WE'LL! o'clock's, 's. ''d;"]:
        assert np.frombuffer(e.encode([x])[0], dtype="<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
