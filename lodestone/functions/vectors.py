"""Vector arithmetic as column expressions, in double precision, and an Arrow twin for bulk scoring.

A quantized vector is struct<q: array<tinyint>, scale: double, norm: double>: int8
values with a symmetric scale, and the norm of the original vector.
"""

from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

COSINE, DOT_PRODUCT, EUCLIDEAN = "COSINE", "DOT_PRODUCT", "EUCLIDEAN"
METRICS = (COSINE, DOT_PRODUCT, EUCLIDEAN)
#: Fixed values of the fallback embedder.
MIX = 0x45D9F3B
SYNTHETIC_TOKENS = 128


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _each_with(values: Column, constant: Column, f) -> Column:  # noqa: ANN001
    """transform() with a value computed once: an outer expression within a lambda is evaluated again for every element."""
    return F.zip_with(values, F.array_repeat(constant, F.size(values)), f)


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    """Both vectors cut to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def dot(a: Column, b: Column) -> Column:
    a, b = _common(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, clamp: bool = False) -> Column:
    """0 where a vector is zero; clamp holds rounding within [-1, 1]."""
    a, b = _common(a, b)
    both = norm(a) * norm(b)
    value = F.when(both > 0, dot(a, b) / both).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)) if clamp else value


def euclidean_score(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    a, b = _common(a, b)
    return 1.0 / (1.0 + F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))))


def quantize(v: Column) -> Column:
    """Symmetric int8: scale = max |v| / 127 (1 for a zero vector), values rounded half up and held within 127."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127.0).otherwise(1.0)
    q = _each_with(v, scale, lambda x, s: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / s + 0.5))).cast("tinyint"))
    return F.struct(q.alias("q"), scale.alias("scale"), norm(v).alias("norm"))


def dequantize(qv: Column) -> Column:
    return _each_with(qv["q"], qv["scale"], lambda x, s: x.cast("double") * s)


def quantized_similarity(a: Column, b: Column, metric: str = COSINE) -> Column:
    """Similarity from the integer dot product and the stored scales and norms; larger is nearer for each metric."""
    d = F.aggregate(F.zip_with(a["q"], b["q"], lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    value = d.cast("double") * a["scale"] * b["scale"]
    if metric == DOT_PRODUCT:
        return value
    if metric == EUCLIDEAN:
        return 1.0 / (1.0 + F.sqrt(F.greatest(F.lit(0.0), a["norm"] * a["norm"] + b["norm"] * b["norm"] - 2.0 * value)))
    if metric == COSINE:
        both = a["norm"] * b["norm"]
        return F.when(both > 0, value / both).otherwise(0.0)
    raise ValueError(f"unknown metric {metric}; one of {METRICS}")


def post_process(v: Column, dimensions: int | None = None, normalize: bool = True) -> Column:
    """Cuts a vector to its first dimensions and scales it to length 1 unless it is almost zero."""
    cut = F.slice(v, 1, dimensions) if dimensions else v
    length = norm(cut)
    return _each_with(cut, length, lambda x, n: F.when(n > 1e-12, x.cast("double") / n).otherwise(x.cast("double"))) if normalize else cut


def to_blob(qv: Column) -> Column:
    """Little-endian scale and norm as 32-bit floats, then the int8 values."""
    return _blob(qv)


@F.pandas_udf(T.BinaryType())
def _blob(s: pd.DataFrame) -> pd.Series:
    return pd.Series([np.float32(a).tobytes() + np.float32(n).tobytes() + np.asarray(q, np.int8).tobytes() for q, a, n in zip(s["q"], s["scale"], s["norm"], strict=True)])


@F.pandas_udf(T.StructType([T.StructField("q", T.ArrayType(T.ByteType())), T.StructField("scale", T.DoubleType()), T.StructField("norm", T.DoubleType())]))
def from_blob(blobs: pd.Series) -> pd.DataFrame:
    rows = []
    for b in blobs:
        scale, length = np.frombuffer(b[:8], "<f4")
        rows.append((np.frombuffer(b[8:], np.int8), float(scale), float(length)))
    return pd.DataFrame(rows, columns=["q", "scale", "norm"])


def synthesize(ids: list[int], dimensions: int) -> np.ndarray:
    """A deterministic vector from token ids, the fallback where no model is installed: the mean over
    tokens of a chain of 64-bit mixes, one for each component, mapped to [-1, 1). Arithmetic wraps."""
    h = np.asarray(ids[:SYNTHETIC_TOKENS], np.int64) * np.int64(MIX)
    out = np.zeros(dimensions)
    for d in range(dimensions if len(h) else 0):
        h = (h ^ (h >> np.int64(16))) * np.int64(MIX)
        h = h ^ (h >> np.int64(16))
        out[d] = ((h & np.int64(0xFFFF)) / 32768.0 - 1.0).mean()
    return out


def embed_tokens(dimensions: int):  # noqa: ANN201
    """array<int> of token ids to array<double>: synthesize() as an Arrow function."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([synthesize(list(i), dimensions) for i in ids])

    return F.pandas_udf(run, "array<double>")


def fake_embedding(text: Column, dimensions: int = 16) -> Column:
    """The test double: ((h * (i + 1)) mod 100) / 100 for a 32-bit hash h of the text, scaled to length 1."""
    from lodestone.functions.text import java_hash

    two32 = F.lit(4294967296)
    wrapped = lambda x: F.pmod(x + 2147483648, two32) - 2147483648
    h = wrapped(java_hash(text))
    raw = _each_with(F.sequence(F.lit(1), F.lit(dimensions)), h, lambda i, x: (wrapped(x * i.cast("long")) % 100).cast("double") / 100.0)
    return post_process(raw)


def _quantized(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = np.abs(v).max(1)
    scale = np.where(top > 0, top / 127.0, 1.0)
    return np.clip(np.floor(v / scale[:, None] + 0.5), -127, 127), scale, np.linalg.norm(v, axis=1)


class Scorer:
    """Similarities of a block of query vectors with batches of vectors, quantized or exact, by matrix products."""

    def __init__(self, queries: np.ndarray, metric: str = COSINE, exact: bool = False):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}; one of {METRICS}")
        self.metric, self.exact = metric, exact
        # Sums of products of int8 values are exact in single precision up to 2^24.
        self.kind = np.float64 if exact or queries.shape[1] * 127 * 127 >= 2**24 else np.float32
        self.values, self.scale, self.norm = self._prepared(queries)

    def _prepared(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.exact:
            return v, np.ones(len(v)), np.linalg.norm(v, axis=1)
        q, scale, norm = _quantized(v)
        return q.astype(self.kind), scale, norm

    def of(self, rows: np.ndarray) -> "Scorer":
        """The scorer of some of the queries."""
        out = copy(self)
        out.values, out.scale, out.norm = self.values[rows], self.scale[rows], self.norm[rows]
        return out

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """(queries, vectors) in double precision; larger is nearer for each metric."""
        v, scale, norm = self._prepared(vectors)
        out = (self.values @ v.T).astype(np.float64)
        if not self.exact:
            out *= self.scale[:, None]
            out *= scale
        if self.metric == DOT_PRODUCT:
            return out
        if self.metric == EUCLIDEAN:
            return 1.0 / (1.0 + np.sqrt(np.maximum(0.0, (self.norm**2)[:, None] + norm**2 - 2.0 * out)))
        both = np.outer(self.norm, norm)
        return np.divide(out, both, out=np.zeros_like(out), where=both > 0)


#: Vectors are scored so many at a time; with a block of queries that bounds the matrix of scores.
SCORED_ROWS = 4096


def top_scores(corpus: DataFrame, ids: pa.Array, queries: np.ndarray, k: int, metric: str = COSINE, exact: bool = False, probes: np.ndarray | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of candidates for the k best of each query, in one pass over corpus (chunk_id, vector).

    A task keeps the k-th best score of each query so far and hands on only what
    reaches it, ties included, so after its first rows it hands on little. Scores
    are compared at six decimals, ties by chunk_id. Null vectors and those of
    another length than the queries' are no candidates. probes: (queries, cells)
    whether a query looks into a cell; corpus then has a column cell.
    """
    kinds = {f.name: f.dataType for f in corpus.schema.fields}
    out = T.StructType([T.StructField("query_id", from_arrow_type(ids.type)), T.StructField("chunk_id", kinds["chunk_id"]), T.StructField("score", T.DoubleType())])
    sent = corpus.sparkSession.sparkContext.broadcast((ids, queries, probes))
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, probes = sent.value
        every = Scorer(queries, metric, exact)
        least = np.full(len(ids), -np.inf)

        def best(part: pa.RecordBatch, asking: np.ndarray, scorer: Scorer) -> pa.RecordBatch:
            """What of a part may be among the best of the queries that ask."""
            flat = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            score = np.round(scorer.scores(flat.reshape(-1, dim)), 6)
            if score.shape[1] >= k:
                least[asking] = np.maximum(least[asking], np.partition(score, -k, axis=1)[:, -k])
            row, column = np.nonzero(score >= least[asking][:, None])
            place = np.empty(part.num_rows, np.int64)
            place[pc.sort_indices(part.column(0)).to_numpy()] = np.arange(part.num_rows)
            order = np.lexsort((place[column], -score[row, column], row))
            row, column = row[order], column[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)  # rows are sorted: each one's place among its query's
            row, column = row[nth < k], column[nth < k]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(asking[row])), part.column(0).take(pa.array(column)), pa.array(score[row, column])], ["query_id", "chunk_id", "score"])

        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False))
            for at in range(0, b.num_rows, SCORED_ROWS):
                part = b.slice(at, SCORED_ROWS)
                if probes is None:
                    yield best(part, np.arange(len(ids)), every)
                    continue
                cells = part.column(2).to_numpy()
                for cell in np.unique(cells):
                    asking = np.flatnonzero(probes[:, cell])
                    if len(asking):
                        yield best(part.filter(pa.array(cells == cell)), asking, every.of(asking))

    return corpus.select("chunk_id", "vector", *(["cell"] if probes is not None else [])).mapInArrow(run, out)
