"""Merkle manifest, piece encoding and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from filamet.llm.merkle import FAN, HASH, build, height_of, merkle_manifest, position, row_digest
from filamet.llm.periodic_runs import periodic_runs, runs_of
from filamet.llm.piece_encoding import Normalizer, Pieces, decode_pieces, encode_pieces
from filamet.llm.queries import with_periods
from filamet.llm.shared import ascii_lower

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def key(rows):
    return sorted(rows, key=repr)


# -- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root and, per leaf, the siblings to the left and right on each level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i - i % 16
            paths[k].append((level[first:i], level[i + 1 : first + 16]))
            at[k] = i // 16
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0] if level else None, paths


def manifest(rows):
    groups = {}
    for r in rows:
        i, text, lang, source, n = r[:5]
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf, other = (h(*map(cell, (i, source, lang, n, t))) for t in (text, low))
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, other if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort()
    trees = {g: tree([x[2] for x in groups[g]]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (named, i, leaf, claim), path in zip(groups[g], trees[g][1], strict=True):
            node = claim
            for a, b in path + top:
                node = h(*a, node, *b)
            out.append((i if named else None, leaf, trees[g][0], root, h(*(x for a, b in path + top for x in a + b)), node, node == root))
    return out


def manifest_of(docs, **more):
    leaf, claim = (row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t) for t in (F.col("text"), ascii_lower(F.col("text"))))
    return merkle_manifest(docs, leaf, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, claim), **more)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(docs, rows, levels):
    """With segments of one level, trees span several tiers."""
    got = [tuple(r) for r in manifest_of(docs, levels=levels).drop("group").collect()]
    assert key(got) == key(manifest(rows))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_odd(odd, empty, spark):
    assert key(tuple(r) for r in manifest_of(odd).drop("group").collect()) == key(manifest([tuple(r) for r in odd.collect()]))
    assert manifest_of(empty).count() == 0
    one = odd.where("text like '%another%'")
    row = manifest_of(one, with_siblings=True).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h() and row["verified"] and row["lefts"] == []


def test_manifest_of_many(spark):
    """A group of more than one full segment."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("x").alias("lang"), F.when(F.col("id") > 20, "big").alias("source"), F.lit(1).alias("n_chars"))
    assert key(tuple(r) for r in manifest_of(docs).drop("group").collect()) == key(manifest([(r[0], r[1], r[2], r[3], r[4]) for r in docs.collect()]))


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 33, 255, 256, 257, 300])
def test_positions(leaves):
    """Closed positions are those of the log, also where a segment ends early."""
    for height in {height_of(leaves), 3}:
        level = [hashlib.sha256(str(k).encode()).digest() for k in range(leaves)]
        log = build(level, height)
        for k in range(height + 1):
            for i, node in enumerate(level):
                p = position(k, i, leaves, height)
                assert log[HASH * p : HASH * (p + 1)] == node
            level = [hashlib.sha256("".join(x.hex() for x in level[j : j + FAN]).encode()).digest() for j in range(0, len(level), FAN)]


# -- pieces


def spans(machine, text):
    ids, starts, ends = machine.encode([text])[0]
    return ids.tolist(), list(zip(starts.tolist(), ends.tolist(), strict=True))


def library(model, text):
    found = model.encode(text, return_type="proto").pieces
    n = len(text.encode())
    return [1, *(p.id for p in found), 2], [(0, 0), *((p.begin, p.end) for p in found), (n, n)]


def test_pieces_and_spans():
    machine, model = Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(3)
    letters = "abcdetheing  \n▁éßЖ日本🙂ꙮ\U00010348́'’0123456789<>-_.,\t\x00"
    texts = ["", " ", "  a  b ", "▁x▁", "<s>x</s><unk>", "　x", "a" * 3000, " " * 999, "ab" * 700 + "🙂🙃é" * 100, *("".join(rnd.choices(letters, k=rnd.randint(0, 80))) for _ in range(800))]
    for t in texts:
        assert spans(machine, t) == library(model, t), t


def test_remembered_units(monkeypatch):
    """Forgetting changes nothing."""
    import filamet.llm.piece_encoding as p

    monkeypatch.setattr(p, "REMEMBERED", 3)
    machine, model = Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in ["the cat sat on the mat.", "the dog, the cat", "a b c d e f", "the cat"]:
        assert spans(machine, t) == library(model, t)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_maps(rule, dummy, squeeze):
    """Normalised text and source offsets with the library's own maps."""
    ready = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(ready.serialized_model_proto())
    mine = Normalizer(model.normalizer_spec.precompiled_charsmap, dummy, squeeze, True)
    rnd = random.Random(5)
    for _ in range(200):
        t = "".join(rnd.choices(" aAbＡ①ﬁé　​́e가가½Ⅷ\n\t．…ｶﾞ㌀", k=rnd.randint(0, 30)))
        normal, to = ready.normalize(t, with_offsets=True)
        got, align = mine(t)
        chars = [0, *np.cumsum([len(c.encode()) for c in t]).tolist()]
        places = [0, *np.cumsum([len(c.encode()) for c in got]).tolist()]
        assert got == normal and [int(align[int(p)]) for p in places] == [int(chars[int(i)]) for i in to], t


def test_encode_and_decode(docs, rows, odd, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = encode_pieces(docs, MODEL)
    texts = {r[0]: r[1] for r in rows}
    for r in encoded.collect():
        ids, cut = library(model, texts[r["doc_id"]] or "")
        assert r["ids"] == ids and list(zip(r["starts"], r["ends"], strict=True)) == cut
    for r in decode_pieces(encoded, MODEL).collect():
        ids = [1, *model.encode(texts[r["doc_id"]] or ""), 2]
        assert r["n_tokens"] == len(ids) and r["decoded"] == model.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert encode_pieces(odd, MODEL).count() == odd.count()
    assert decode_pieces(encode_pieces(empty, MODEL), MODEL).count() == 0


def test_decode_odd_ids(spark):
    """Bytes that are no character, control pieces, null; unknown ids are an error."""
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    lists = [[1, 240, 259, 2], [131, 200, 133], [0, 5, 28705], [], [2287, 264]]
    got = decode_pieces(spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(9, None)], "doc_id long, ids array<int>"), MODEL)
    assert {r["doc_id"]: r["decoded"] for r in got.collect()} == {**{i: model.decode(x) for i, x in enumerate(lists)}, 9: ""}
    with pytest.raises(Exception, match="no piece has the id"):
        decode_pieces(spark.createDataFrame([(1, [40000])], "doc_id long, ids array<int>"), MODEL).collect()


# -- periodic runs


def runs_by_force(w, least=24, periods=3):
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, periods * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = np.random.default_rng(7)
    for _ in range(400):
        docs = []
        for _ in range(int(rng.integers(1, 5))):
            parts = [np.tile(rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 12))), int(rng.integers(1, 7))) for _ in range(int(rng.integers(1, 6)))]
            docs.append(np.concatenate(parts)[: int(rng.integers(1, 200))])
        least, expected, at = int(rng.choice([3, 6, 24])), [], 0
        for d in docs:
            expected += [(s + at, e + at, q) for s, e, q in runs_by_force(d.tolist(), least)]
            at += len(d)
        assert runs_of(np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), least) == expected


def test_one_word_without_end():
    n = 300_000
    assert runs_of(np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)) == [(0, n, 1)]


def plant(i, text):
    w = WORD.findall(text or "")
    crc = zlib.crc32(str(i).encode())
    g, n = crc // 10, len(w)
    if crc % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def runs_row(i, w):
    runs = runs_by_force(w)
    gone = {k for s, e, q in runs for k in range(s + q, e)}
    return i, len(w), [(s, e - s, q) for s, e, q in runs], " ".join(x for k, x in enumerate(w) if k not in gone)


def rows_of(df):
    return [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect()]


def test_periodic_runs(docs, rows, odd, empty):
    short = [r for r in rows if len(r[1] or "") < 20000]
    some = docs.where("text is null or length(text) < 20000")
    assert key(rows_of(periodic_runs(some))) == key(runs_row(r[0], WORD.findall(r[1] or "")) for r in short)
    planted = key(rows_of(periodic_runs(with_periods(some))))
    assert planted == key(runs_row(r[0], plant(r[0], r[1])) for r in short)
    assert key(rows_of(periodic_runs(odd))) == key(runs_row(r[0], WORD.findall(r[1] or "")) for r in odd.collect())
    assert periodic_runs(empty).count() == 0


def test_periodic_query(spark, docs, rows, monkeypatch, tmp_path):
    """The digest columns, the best run by exact fractions."""
    from filamet.llm.queries import op13

    docs.where("text is null or length(text) < 20000").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op13(spark, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        if len(text or "") >= 20000:
            continue
        _, _, runs, collapsed = runs_row(i, plant(i, text))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed.encode()).hexdigest()
    assert len(got) == sum(len(r[1] or "") < 20000 for r in rows)


def test_parameters(docs):
    with pytest.raises(ValueError):
        periodic_runs(docs, periods=2)
