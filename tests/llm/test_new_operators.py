"""Whitening, cross-tokenizer alignment and decontamination against brute force, and their edge cases."""

import bisect
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from eqpanel.llm import alignment as AL
from eqpanel.llm import decontamination as DC
from eqpanel.llm import whitening as WH

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- whitening ---------------------------------------------------------------


@pytest.mark.parametrize(
    "v",
    [
        np.eye(20), np.zeros((6, 6)), np.ones((9, 9)), np.diag([3.0, 3, 3, 2, 1, 0]), np.kron(np.eye(4), [[2.0, 1], [1, 2]]), np.array([[5.0]]),
        np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1), np.diag(10.0 ** -np.arange(18)),
    ],
)
def test_eigensolver(v):
    k = min(16, len(v))
    e, z = WH.leading_components(v, k)
    want = np.linalg.eigvalsh(v)[::-1][:k]
    size = max(want[0], 1e-300)
    assert np.abs(e - want).max() <= 1e-14 * size and np.abs(z.T @ z - np.eye(k)).max() < 1e-13
    assert np.abs(v @ z - z * e).max() <= 1e-14 * size


def test_sturm_counts_are_eigenvalues_below():
    rng = np.random.default_rng(0)
    d, e = rng.normal(size=12), np.r_[rng.normal(size=5), 0.0, rng.normal(size=5)]
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 41)
    assert WH.sturm_count(d, e, at).tolist() == [(values < x).sum() for x in at]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, x long, component string")


def expect(rows, k=16):
    """vec_id, component -> (n, deviation, whitened up to sign, explained)"""
    use = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for d in {len(v) for _, v in use}:
        own = [(i, np.floor(64 * v).astype(np.int64) + 1000000) for i, v in use if len(v) == d]
        fit = np.unique(np.array([x for _, x in own]), axis=0)
        n, s = len(fit), fit.sum(axis=0)
        c = fit - s / n
        e, z = np.linalg.eigh(c.T @ c / n)
        e, z = e[::-1], z[:, ::-1]
        for i, x in own:
            for j in range(min(k, d)):
                live = e[0] > 0 and e[j] > 1e-13 * e[0]
                out.append((i, d, j + 1, n, int(((n * x - s) ** 2).sum()), abs(float((x - s / n) @ z[:, j] / np.sqrt(e[j]))) if live else None, float(e[j] / e.sum()) if live else 0.0))
    return out


def test_whitening_against_plain_linear_algebra(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(300, 20)) * np.linspace(3, 0.5, 20))]
    rows += [(5, rows[5][1]), (900, rows[7][1]), (None, rows[8][1]), (901, None), (902, []), (903, [1.0] * 19 + [None]), (904, [float("nan")] * 20), (905, [float("inf")] * 20)]
    rows += [(1000 + i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(40, 3)))] + [(2000, [0.5] * 7)] * 2
    got = WH.whitened(vectors(spark, rows)).collect()
    want = sorted(expect(rows), key=str)
    assert len(got) == len(want)
    have = Counter((r.vec_id, r.component, r.n, r.deviation) for r in got)
    assert have == Counter((i, j, n, dev) for i, _, j, n, dev, _, _ in want)
    at = {(i, d, j): (w, x) for i, d, j, _, _, w, x in want}
    sizes = {i: len(v) for i, v in rows if v}
    for r in got:
        w, x = at[r.vec_id, sizes[r.vec_id], r.component]
        assert r.explained == pytest.approx(x, rel=1e-9) and r.identity_error < 1e-9
        assert r.whitened is None if w is None else abs(r.whitened) == pytest.approx(w, rel=1e-6, abs=1e-8)


def test_whitening_signs_hold_for_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(200, 5)))]
    got = WH.whitened(vectors(spark, rows)).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(got.T @ got / 200 - got.mean(axis=0)[:, None] * got.mean(axis=0) - np.eye(5)).max() < 1e-9


def test_whitening_of_nothing_and_of_extremes(spark):
    assert WH.whitened(vectors(spark, []).limit(0)).count() == 0
    big = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])]
    got = WH.whitened(vectors(spark, big)).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3) and all(np.isfinite(r.whitened) for r in got if r.whitened is not None)


# --- alignment -----------------------------------------------------------------

TEXTS = [
    None, "", " ", "  ", "\n", " \n ", "a", "word", "two words", "trailing ", "  leading", "a  b\n\n c\t d", "x<|endoftext|>y <s> </s> <unk> <0x0A>", "under▁score", "▁", "a ▁b",
    "don't stop, now!!  (really) e.g. http://x.y/z?a=1", "ciónñgaco erthndly Thshble", "é" * 400, "ab" * 3000, "日本語 テキスト　全角 ﬁ Å é ́", "\U0001f600\U0001f468‍\U0001f469 z",
    "nul\x00 \x1c sep \x85 nel \xa0 nbsp   ls", "﻿bom ​ zero", "same same same", "same same same",
]


def aligned_by_hand(texts):
    a, b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a.encode_special_tokens = True
    known = AL.Aligner(PATH_A, PATH_B)
    rows, counts = [], Counter()
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        parts = [[of[i] for i in ids] for of, ids in ((known.bytes_a, ids_a), (known.bytes_b, ids_b))]
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in both]
        for side, ids in enumerate((ids_a, ids_b)):
            for i, e in zip(ids, ends[side]):
                groups[bisect.bisect_left(both, e)][side].append(i)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        rows.append((len(ids_a), len(ids_b), len(groups), links, ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [
        zero if r is None else (r[0], r[1], r[2], len(r[3]), sum(counts[p] == best[p[0]] for p in r[3]), sum(counts[p] for p in r[3]), hashlib.sha256(r[4].encode()).hexdigest())
        for r in rows
    ]


@pytest.mark.parametrize("cache", [AL.CACHE_CHUNKS, 3])
def test_alignment_against_whole_texts(spark, sf, monkeypatch, cache):
    given = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = TEXTS + given
    df = spark.createDataFrame([(i if i != 6 else None, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, n_a int").repartition(3)
    monkeypatch.setattr(AL, "CACHE_CHUNKS", cache)
    got = Counter(tuple(r) for r in AL.alignment(df, PATH_A, PATH_B).collect())
    want = Counter((i if i != 6 else None, *row) for i, row in enumerate(aligned_by_hand(texts)))
    assert got == want
    assert sum(row[0] == 0 for row in aligned_by_hand(TEXTS)) == 5


def test_aligner_learns_alike_in_any_order():
    one, two = AL.Aligner(PATH_A, PATH_B), AL.Aligner(PATH_A, PATH_B)
    texts = [t for t in TEXTS if t]
    alone = [list(next(one.of([t]))) for t in texts]
    assert list(two.of(texts)) == alone
    whole = AL.Aligner(PATH_A, PATH_B)
    whole.cuts, whole.chunks = False, lambda text: [text]
    for t, records in zip(texts, alone):
        [r] = list(whole.of([t]))[0] or [None]
        assert (r is None) == (not records)
        if r:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links) == tuple(map(sum, list(zip(*records))[:4]))
            assert r.groups == b";".join(x.groups for x in records)


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert AL.alignment(empty, PATH_A, PATH_B).count() == 0
    nulls = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert [tuple(r) for r in AL.alignment(nulls, PATH_A, PATH_B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


# --- decontamination -------------------------------------------------------------


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated_by_hand(docs, items):
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, text in items:
            q = words(text)
            n = min(10, len(q))
            for s in range(len(q) - n + 1 if q else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == q[s : s + n]:
                        hit |= set(range(at, at + n))
                        names.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination_against_every_place(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["the"] * 6
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(n)) for i, n in enumerate((1, 2, 3, 9, 10, 11, 14, 25, 40))]
    items += [(20, None), (21, ""), (22, "—!?"), (None, say(12)), (8, say(12)), (30, "the " * 12), (31, items[7][1]), (100, "ÀÉ naïve Straße"), (101, "the THE. The")]
    docs = [(i, say(60)) for i in range(25)] + [(50, None), (51, ""), (52, "\n.,"), (53, "the " * 40), (54, "x" * 5000), (55, "ÀÉ NAÏVE STRAßE àé naïve straße ÀÉ naïve strasse")]
    for i in range(5, 9):
        docs.append((60 + i, say(15) + " " + items[i][1].upper() + ", " + items[7][1] + " " + items[8][1]))
    docs += [(60, docs[-1][1]), (60, docs[-1][1]), (60, say(10) + " " + items[6][1]), (None, items[6][1]), (0, items[6][1])]
    df = spark.createDataFrame([(d, t, "x", 3, "y") for d, t in docs], "doc_id long, text string, word string, place int, item string").repartition(4)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc string")
    want = contaminated_by_hand(docs, items)
    assert Counter(tuple(r) for r in DC.contamination(df, bench).collect()) == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables too large to broadcast
    try:
        assert Counter(tuple(r) for r in DC.contamination(df, bench).collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_contamination_of_nothing(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert DC.contamination(docs.limit(0), bench).count() == 0
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in DC.contamination(docs, bench.limit(0)).collect()] == [(1, 2, 0, 0, none, False)]
    assert DC.contamination(docs, bench).first().n_hit == 2


def test_no_python_on_the_native_path(spark, sf):
    plan = DC.op13_decontamination(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|MapInArrow|MapInPandas|ArrowEval|ExistingRDD", plan)


def test_proximity_by_plain_search(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), 60, p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02]))) for i in range(12)] + [(40, None), (41, "")]
    queries = {1: ["g", "a", "c"], 2: ["h"], 3: ["f", "g", "h"], 4: ["a", "zz"], 5: ["e", "d"]}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws], "query int, word string")
    got = {(r.query, r.doc, r.place) for r in DC.proximity(DC.postings(df), asked, 6).collect()}
    every = Counter(w for _, t in docs for w in words(t))
    want = set()
    for q, ws in queries.items():
        rare = min(ws, key=lambda w: (every[w], w))
        for d, t in docs:
            w = words(t)
            for at in range(len(w)):
                if w[at] == rare and any(s <= at < s + 6 and set(ws) <= set(w[max(s, 0) : s + 6]) for s in range(at - 5, at + 1)):
                    want.add((q, d, at))
    assert got == want and want
