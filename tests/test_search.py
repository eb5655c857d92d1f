"""Search operators against brute force, with odd rows, small blocks and a kept index."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, search


def chunks(spark, rows):
    return spark.createDataFrame([(str(i), t, 1) for i, t in rows], "chunk_id string, content string, score int")


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, text string")


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_bm25(rows, queries, k):
    words = {i: words_of(t) for i, t in rows}
    n, mean = len(rows), sum(map(len, words.values())) / len(rows)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, t in queries:
        scores = {}
        for w in set(words_of(t)):
            for i, ws in words.items():
                if tf := ws.count(w):
                    scores[i] = scores.get(i, 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 6), str(s[0])))[:k]
        out += [(q, str(i), s, r + 1) for r, (i, s) in enumerate(best)]
    return sorted(out)


def same(hits, want):
    got = sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in hits.collect())
    return [(*r[:2], r[3]) for r in got] == [(*r[:2], r[3]) for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-6)


def made(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.8)) % 300}" for _ in range(4000)] + ["Ünï", "日本", "x1"]
    text = lambda m: " ".join(rng.choice(words) + rng.choice(["", ",", "-", "."]) for _ in range(rng.randrange(1, m)))
    rows = [(i, text(60)) for i in range(n)] + [(1000, ""), (1001, " ,. "), (1002, "same text"), (1003, "same text")]
    queries = [(i, text(9)) for i in range(25)] + [(90, "same"), (91, "nothing here"), (92, ""), (93, "--")]
    return rows, queries


@pytest.mark.parametrize(("products", "bytes_"), [(4_000_000, 4_000_000), (50, 40)])
def test_bm25_equals_brute_force(spark, monkeypatch, products, bytes_):
    monkeypatch.setattr(lexical, "PRODUCTS", products)
    monkeypatch.setattr(lexical, "QUERY_BYTES", bytes_ if bytes_ > 40 else 200)
    rows, queries = made(51)
    got = search.bm25_search(chunks(spark, rows), asked(spark, [*queries, (94, None)]), 5)
    assert same(got, plain_bm25(rows, queries, 5))
    assert search.bm25_search(chunks(spark, rows).limit(0), asked(spark, queries), 5).count() == 0
    assert search.bm25_search(chunks(spark, rows), asked(spark, []), 5).count() == 0


def test_kept_index_follows_updates(spark, tmp_path):
    rows, queries = made(52)
    index = lexical.TextIndex(spark, str(tmp_path / "index"))
    found = lambda: index.search(asked(spark, queries), 5)
    assert found().count() == 0
    index.update(chunks(spark, rows))
    assert same(found(), plain_bm25(rows, queries, 5))
    changed = [(i, t if i % 3 else "other words w1 w2") for i, t in rows if i % 5]
    index.update(chunks(spark, [r for r in changed if r not in rows] + [(2000, "a new w3")]), chunks(spark, [r for r in rows if not r[0] % 5]).select("chunk_id"))
    now = [*changed, (2000, "a new w3")]
    assert same(found(), plain_bm25(now, queries, 5))
    os.makedirs(tmp_path / "index" / "draft-2" / "postings")  # a writer that died
    assert same(found(), plain_bm25(now, queries, 5))
    index.merge()
    assert index.segments() == [2] and same(found(), plain_bm25(now, queries, 5))


def test_substrings_and_phrases(spark, monkeypatch):
    rows, queries = made(53)
    rows += [(3000, "The quick,  Brown fox-trot"), (3001, None)]
    queries += [(95, "quick brown"), (96, "brown fo"), (97, "rown fox"), (98, "quick,  Brown"), (99, "w1")]
    flat = lambda t: " " + " ".join(words_of(t))
    for size in (4_000_000, 100):
        monkeypatch.setattr(lexical, "QUERY_BYTES", size)
        got = search.phrase_search(chunks(spark, rows), asked(spark, queries))
        want = {(q, str(i)) for q, p in queries for i, t in rows if words_of(p) and flat(p) in flat(t or "")}
        assert {(r.query_id, r.chunk_id) for r in got.collect()} == want and got.count() == len(want)
        got = search.substring_search(chunks(spark, rows), asked(spark, queries))
        assert {(r.query_id, r.chunk_id) for r in got.collect()} == {(q, str(i)) for q, p in queries for i, t in rows if p.strip() and p in (t or "")}


@pytest.mark.parametrize("metric", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
def test_vector_search_equals_brute_force(spark, monkeypatch, metric):
    import lodestone.functions.vectors as vectors

    monkeypatch.setattr(search, "QUERY_BYTES", 1000)
    monkeypatch.setattr(vectors, "SCORED_ROWS", 64)
    rng = np.random.default_rng(54)
    v = rng.normal(size=(300, 12))
    v[250:] = v[:50]
    v[7] = 0
    df = spark.createDataFrame([(f"c{i}", x.tolist(), i % 3) for i, x in enumerate(v)] + [("none", None, 0), ("short", [1.0, 2.0], 0)], "chunk_id string, vector array<double>, label int")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 12)))] + [(77, None), (78, [0.0] * 12)], "query_id long, vector array<float>")
    for exact in (False, True):
        got = sorted((r.query_id, r.chunk_id, r["rank"]) for r in search.vector_search(df, q, 7, metric, F.col("label") != 1, exact).collect())
        want = []
        for row in q.where("vector is not null").collect():
            a = np.array(row.vector)
            scorer = vectors.Scorer(a[None], metric, exact)
            all_ = [(f"c{i}", float(scorer.scores(x[None])[0, 0])) for i, x in enumerate(v) if i % 3 != 1]
            best = sorted(all_, key=lambda s: (-round(s[1], 6), s[0]))[:7]
            want += [(row.query_id, c, r + 1) for r, (c, _) in enumerate(best)]
        assert got == sorted(want)
    assert search.vector_search(df, q.limit(0), 3).count() == 0 and search.vector_search(df.limit(0), q, 3).count() == 0


def test_scorer_equals_the_column_functions(spark):
    from lodestone.functions import vectors

    rng = np.random.default_rng(55)
    a, b = rng.normal(size=(5, 9)), rng.normal(size=(5, 9))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<double>, b array<double>")
    for metric in vectors.METRICS:
        got = [r[0] for r in df.orderBy("i").select(vectors.quantized_similarity(vectors.quantize(F.col("a")), vectors.quantize(F.col("b")), metric)).collect()]
        assert np.allclose(got, np.diag(vectors.Scorer(a, metric).scores(b)))


def test_index_search_equals_brute_force_over_its_cells(spark):
    rng = np.random.default_rng(56)
    v = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(30, 8)))], "query_id long, vector array<double>")
    celled, centres = search.ann_cells(df, 6)
    every = lambda hits: sorted((r.query_id, r.chunk_id, r["rank"]) for r in hits.collect())
    assert every(search.ann_search(celled, centres, q, 10, 6)) == every(search.vector_search(df, q, 10))
    cell = {r.chunk_id: r.cell for r in celled.collect()}
    for r in q.collect():
        near = set(np.argsort(-(np.asarray(centres) @ np.array(r.vector)), kind="stable")[:2].tolist())
        got = {h.chunk_id for h in search.ann_search(celled, centres, q.where(F.col("query_id") == r.query_id), 10, 2).collect()} if r.query_id < 3 else set()
        assert all(cell[c] in near for c in got)


def plain_pipeline(rows, vecs, queries, k, threshold, lam):
    """Both legs, fusion, gate and diversification by plain loops: (query, chunk, rank)."""
    from lodestone.functions.vectors import Scorer

    content, out = dict(rows), []
    lexical_hits = plain_bm25(rows, [(q, t) for q, t, _ in queries], 4 * k)
    for q, _, v in queries:
        score = Scorer(np.array([v])).scores(np.array(list(vecs.values())))[0]
        dense = sorted(zip(map(str, vecs), score, strict=True), key=lambda s: (-round(s[1], 6), s[0]))[: 4 * k]
        v_rank = {c: i + 1 for i, (c, _) in enumerate(dense)}
        t_rank = {c: r for qq, c, _, r in lexical_hits if qq == q}
        far = 10**9
        fused = {c: (1 / (60 + v_rank[c]) if c in v_rank else 0) + (1 / (60 + t_rank[c]) if c in t_rank else 0) for c in {*v_rank, *t_rank}}
        best = sorted(fused, key=lambda c: (-round(fused[c], 6), v_rank.get(c, far), t_rank.get(c, far), c))[: 2 * k]
        if max([s for c, s in dense if c in best], default=0) < threshold:
            continue
        words = {c: set(re.split(r"\s+", content[int(c)].lower())) for c in best}
        chosen = best if len(best) <= k else [max(best, key=lambda c: (fused[c], -best.index(c)))]
        while len(chosen) < min(k, len(best)):
            alike = lambda c: max(len(words[c] & words[x]) / len(words[c] | words[x]) for x in chosen)  # noqa: B023, E731
            chosen.append(max((c for c in best if c not in chosen), key=lambda c: (lam * fused[c] - (1 - lam) * alike(c), -best.index(c))))
        out += [(q, c, i + 1) for i, c in enumerate(chosen)]
    return sorted(out)


@pytest.mark.parametrize("lam", [0.7, 0.2])
def test_the_whole_retrieval_equals_plain_loops(spark, lam):
    rows, queries = made(57, 80)
    rows = [(i, t) for i, t in rows if words_of(t)]
    rng = np.random.default_rng(57)
    vecs = {i: rng.normal(size=6) for i, _ in rows}
    queries = [(q, t, rng.normal(size=6).tolist()) for q, t in queries[:15]] + [(60, "nothing", [0.0] * 6)]
    c = spark.createDataFrame([(str(i), "d", 0, t, 1, {"k": str(i % 2)}) for i, t in rows], "chunk_id string, document_id string, seq int, content string, token_count int, metadata map<string,string>")
    v = spark.createDataFrame([(str(i), x.tolist()) for i, x in vecs.items()], "chunk_id string, vector array<double>")
    q = spark.createDataFrame(queries, "query_id long, text string, vector array<double>")
    got = search.retrieve(c, v, q, 4, 0.5, lam)
    want = plain_pipeline(rows, vecs, queries, 4, 0.5, lam)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == want and {w[0] for w in want} != {x[0] for x in queries}
    odd = [r for r in rows if r[0] % 2]
    only = search.hybrid_search(c, v, q, 5, F.col("metadata")["k"] == "1").select("chunk_id").distinct().collect()
    assert {int(r.chunk_id) for r in only} <= {i for i, _ in odd} and only
    assert search.retrieve(c, v, q, 4, 0.5, None, rerank=lambda df: df.withColumn("rank", F.lit(9))).count() == 0
