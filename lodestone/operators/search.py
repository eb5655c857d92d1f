"""Retrieval: vector and lexical top-k for batches of queries, rank fusion, diversification.

Chunks are (scope_id, collection_id, chunk_id, document_id, seq, content, token_count,
metadata map<string,string>), vectors (scope_id, collection_id, chunk_id, vector).
Queries are a DataFrame (query_id, text, vector): searching is plural. Access
predicates are applied to the base scan, below every limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import jaccard, rrf_score
from lodestone.functions.vectors import COSINE, top_scores
from lodestone.operators.lexical import bm25_search, phrase_prefix, phrase_search, postings, rank_top_k, substring_search, terms  # noqa: F401 - part of this module's interface

RRF_K = 60
TOP_K, THRESHOLD, LAMBDA = 5, 0.35, 0.7
#: Query vectors are sent to the tasks so many bytes at a time.
QUERY_BYTES = 4_000_000


def matches_filter(metadata: Column, wanted: dict[str, str]) -> Column:
    """Every pair equals; a missing key fails."""
    return reduce(lambda a, kv: a & F.coalesce(metadata[kv[0]] == kv[1], F.lit(False)), wanted.items(), F.lit(True))


def query_blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of the queries, in blocks of about QUERY_BYTES that are dealt by a hash of the id; null vectors ask
    nothing. Only one block is with the driver at a time."""
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    q = q.withColumn("size", F.size("vector"))
    for size, n in sorted(map(tuple, q.groupBy("size").agg(F.count("*").alias("n")).collect())):  # lengths of vectors are few
        blocks = -(-n * 8 * max(1, size) // QUERY_BYTES)
        for i in range(blocks):
            t = q.where((F.col("size") == size) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).select("query_id", "vector").toArrow().combine_chunks()
            if t.num_rows and size:
                yield t["query_id"].combine_chunks(), t["vector"].combine_chunks().flatten().to_numpy().reshape(-1, size)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = COSINE, where: Column | None = None, exact: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): quantized similarity of every query with every vector, best k.

    The scan is whole: each block of queries meets all vectors in one pass, by
    matrix products on Arrow batches, and only what may be among a query's k best
    leaves a task. `where` filters the vectors' own columns before any scoring.
    exact: on the vectors as they are, not quantized.
    """
    base = (vectors if where is None else vectors.where(where)).select("chunk_id", "vector")
    parts = [top_scores(base, ids, values, k, metric, exact) for ids, values in query_blocks(queries)]
    if not parts:
        empty = queries.select("query_id").limit(0).crossJoin(base.select("chunk_id").limit(0)).withColumn("score", F.lit(0.0))
        return empty.withColumn("rank", F.lit(0))
    return rank_top_k(reduce(DataFrame.unionByName, parts), k, "chunk_id")


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (query_id, chunk_id, score, rank, dense_score). Items of one leg count with that leg alone;
    ties keep the vector leg's order, then the text leg's."""
    v = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("v_rank"), F.col("score").alias("dense_score"))
    t = text_hits.select("query_id", "chunk_id", F.col("rank").alias("t_rank"))
    both = v.join(t, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce(rrf_score(F.col("v_rank"), rrf_k), F.lit(0.0)) + F.coalesce(rrf_score(F.col("t_rank"), rrf_k), F.lit(0.0))
    return rank_top_k(both.withColumn("score", score), k, F.col("v_rank").asc_nulls_last(), F.col("t_rank").asc_nulls_last(), "chunk_id").drop("v_rank", "t_rank")


def hybrid_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Both legs fetch twice as many, then fuse. `where` is put on both base scans."""
    c = chunks if where is None else chunks.where(where)
    v = vectors if where is None else vectors.join(c.select("chunk_id"), "chunk_id", "left_semi")
    return fuse(vector_search(v, queries, 2 * k), bm25_search(c, queries, 2 * k), k)


def confidence_gate(results: DataFrame, threshold: float = THRESHOLD, score: str = "dense_score") -> DataFrame:
    """Adds status: ok, or insufficient_evidence for queries whose best score is below the threshold.

    Fused scores never exceed 2 / (RRF_K + 1); the gate reads the dense leg's score.
    """
    top = F.max(score).over(W.partitionBy("query_id"))
    return results.withColumn("status", F.when(F.coalesce(top, F.lit(0.0)) >= threshold, "ok").otherwise("insufficient_evidence"))


def diversify(candidates: DataFrame, k: int, lam: float = LAMBDA, similarity=None, scale: bool = False) -> DataFrame:  # noqa: ANN001
    """Maximal marginal relevance over (query_id, chunk_id, score, content, ...): the best first, then k - 1 times the
    candidate with the greatest lam * score - (1 - lam) * greatest similarity to those chosen; the first wins ties.

    With at most k candidates a query keeps them all in their order. similarity: two structs of the candidate's
    columns to a number, by default the word-set similarity of contents. scale maps scores to [0, 1] per query.
    The fold runs within one row per query; a query has as many candidates as were retrieved for it.
    """
    alike = similarity or (lambda a, b: jaccard(a["content"], b["content"]))
    cols = [c for c in candidates.columns if c not in ("query_id", "rank")]
    order = "rank" if "rank" in candidates.columns else None
    place = F.col(order) if order else F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    item = F.struct(place.alias("place"), *[F.col(c) for c in cols])
    in_order = lambda a, b: a["place"] - b["place"]
    lists = candidates.withColumn("__i", item).groupBy("query_id").agg(F.array_sort(F.collect_list("__i"), in_order).alias("c"))
    if scale:
        lo, hi = F.array_min(F.transform("c", lambda x: x["score"])), F.array_max(F.transform("c", lambda x: x["score"]))
        lists = lists.withColumn("c", F.transform("c", lambda x: x.withField("score", F.when(hi > lo, (x["score"] - lo) / (hi - lo)).otherwise(1.0))))

    def best(left: Column, value) -> Column:  # noqa: ANN001
        """The place of the element of greatest value; the earliest among equals. Rows may hold maps, which have no order."""
        return F.element_at(F.array_sort(F.transform(left, lambda x: F.struct((-value(x)).alias("v"), x["place"].alias("p")))), 1)["p"]

    at = lambda p: F.filter(F.col("c"), lambda x: x["place"] == p)

    def step(chosen: Column, _: Column) -> Column:
        left = F.filter(F.col("c"), lambda x: ~F.exists(chosen, lambda y: y["place"] == x["place"]))
        near = lambda x: F.array_max(F.transform(chosen, lambda y: alike(x, y)))
        return F.concat(chosen, at(best(left, lambda x: lam * x["score"] - (1 - lam) * near(x))))

    first = at(best(F.col("c"), lambda x: x["score"]))
    steps = F.sequence(F.lit(2), F.lit(k)) if k > 1 else F.array().cast("array<int>")
    picked = F.when(F.size("c") <= k, F.col("c")).otherwise(F.aggregate(steps, first, step))
    out = lists.select("query_id", F.posexplode(picked).alias("pos", "x"))
    return out.select("query_id", *[F.col(f"x.{c}").alias(c) for c in cols], (F.col("pos") + 1).alias("rank"))


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD, lam: float | None = LAMBDA, where: Column | None = None, rerank=None) -> DataFrame:  # noqa: ANN001
    """The whole pipeline: hybrid search for 2k, gate, optional rerank (a function of the results), diversification or top k."""
    hits = confidence_gate(hybrid_search(chunks, vectors, queries, 2 * k, where), threshold)
    full = hits.join(chunks.select("chunk_id", "document_id", "seq", "content", "token_count", "metadata"), "chunk_id")
    full = rerank(full) if rerank else full
    ok = full.where("status = 'ok'")
    return diversify(ok, k, lam) if lam is not None else ok.where(F.col("rank") <= k)


def rerank_exact(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Re-scores (query_id, chunk_id) candidates with the original vectors and keeps the best k."""
    from lodestone.functions.vectors import cosine

    v = candidates.select("query_id", "chunk_id").join(vectors.select("chunk_id", "vector"), "chunk_id")
    scored = v.join(queries.select("query_id", F.col("vector").alias("qv")), "query_id").select("query_id", "chunk_id", cosine(F.col("qv"), F.col("vector")).alias("score"))
    return rank_top_k(scored, k, "chunk_id")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): share of the true items found."""
    hit = truth.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def ann_cells(vectors: DataFrame, cells: int = 16, seed: int = 42) -> tuple[DataFrame, list]:
    """An inverted file: vectors with the nearest of `cells` centres (k-means on a sample of 100,000 at most)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    sample = vectors if n <= 100_000 else vectors.sample(100_000 / n, seed=seed)
    model = KMeans(k=cells, seed=seed, featuresCol="f", predictionCol="cell").fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("f")))
    out = model.transform(vectors.withColumn("f", array_to_vector(F.col("vector").cast("array<double>")))).drop("f")
    return out, [list(map(float, c)) for c in model.clusterCenters()]


def ann_search(celled: DataFrame, centres: list, queries: DataFrame, k: int, probe: int = 11) -> DataFrame:
    """Approximate top-k: only the cells of the `probe` nearest centres are scanned for a query, by matrix products of
    the queries that look into a cell with its vectors. The default is for 16 cells."""
    c = np.asarray(centres, float)
    parts = []
    for ids, values in query_blocks(queries):
        near = np.argsort(-(values @ c.T), axis=1, kind="stable")[:, :probe]
        probes = np.zeros((len(values), len(c)), bool)
        np.put_along_axis(probes, near, True, axis=1)
        parts.append(top_scores(celled, ids, values, k, probes=probes))
    return rank_top_k(reduce(DataFrame.unionByName, parts), k, "chunk_id")
