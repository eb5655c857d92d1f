"""Lexical retrieval: BM25 over texts or over a kept index, phrases and substrings for batches of queries.

Queries are a DataFrame (query_id, text). They are worked off in blocks of about
QUERY_BYTES, each sent to all tasks, so that nothing sent grows with the query set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
QUERY_BYTES = 4_000_000
#: Products of a posting and a query that are summed at a time.
PRODUCTS = 4_000_000


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def arrow_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts in a row, the text that each is of): the Arrow twin of terms()."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{N}]+")
    flat, of = split.flatten(), pc.list_parent_indices(split)
    some = pc.not_equal(flat, "")
    return flat.filter(some), of.filter(some).to_numpy()


def rank_top_k(scored: DataFrame, k: int, *tie: str, score: str = "score", by: str = "query_id") -> DataFrame:
    """The k best of each query with their rank from 1; ties by the given columns. Scores are compared at six decimals."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.round(score, 6).desc(), *tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def text_blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of the queries, in blocks of about QUERY_BYTES dealt by a hash of the row; null texts ask nothing."""
    q = queries.select("query_id", "text").where("text IS NOT NULL")
    blocks = -(-(q.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) // QUERY_BYTES)
    for i in range(blocks):
        t = q.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if t.num_rows:
            yield t["query_id"].combine_chunks(), t["text"].combine_chunks()


def _result(corpus: DataFrame, ids: pa.Array, ident: str, *more: T.StructField) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_type

    return T.StructType([T.StructField("query_id", from_arrow_type(ids.type)), T.StructField("chunk_id", corpus.schema[ident].dataType), *more])


def _none(corpus: DataFrame, queries: DataFrame, ident: str) -> DataFrame:
    return queries.select("query_id").limit(0).crossJoin(corpus.select(F.col(ident).alias("chunk_id")).limit(0))


class TermQueries:
    """A block of queries as its distinct terms, in sorted order, and the queries that ask for each."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        flat, of = arrow_terms(texts)
        coded = flat.dictionary_encode()
        self.ids, self.terms = ids, coded.dictionary
        pairs = np.unique(np.stack([coded.indices.to_numpy(), of], 1), axis=0) if len(flat) else np.zeros((0, 2), np.int64)
        self.query = pairs[:, 1]
        self.count = np.bincount(pairs[:, 0], minlength=len(self.terms))
        self.first = np.cumsum(self.count) - self.count

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of the texts' asked terms, by text, and the number of all terms of each text."""
        flat, of = arrow_terms(texts)
        length = np.bincount(of, minlength=len(texts))
        at = pc.index_in(flat, self.terms)
        some = pc.is_valid(at)
        key, tf = np.unique(of[some.to_numpy(zero_copy_only=False)] * max(1, len(self.terms)) + at.filter(some).to_numpy(), return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), tf, length


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int, ident: str = "chunk_id", text: str = "content") -> DataFrame:
    """(query_id, chunk_id, score, rank): any-term BM25 of every query over all chunks.

    Two passes over the texts for a block of queries: the first counts the chunks
    that have each asked term, and all words; the second scores in Arrow batches,
    summing the products of postings and queries by index, and hands on only what
    may be among a query's k best. Words that no query asks for never become rows.
    """
    corpus = chunks.select(F.col(ident).alias("chunk_id"), F.col(text).alias("text"))
    parts = []
    for ids, texts in text_blocks(queries):
        asked = TermQueries(ids, texts)
        if not len(asked.terms):
            continue
        sent = chunks.sparkSession.sparkContext.broadcast(asked)
        df, n, words = _frequencies(corpus, sent, len(asked.terms))
        if not n:
            continue
        weight = np.log(1 + (n - df + 0.5) / (df + 0.5))
        parts.append(_scored(corpus, sent, ids, weight, max(words / n, 1e-9), k))
    if not parts:
        return _none(chunks, queries, ident).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    return rank_top_k(reduce(DataFrame.unionByName, parts), k, "chunk_id")


def _frequencies(corpus: DataFrame, sent, n_terms: int) -> tuple[np.ndarray, int, int]:  # noqa: ANN001
    """(number of chunks with each asked term, number of chunks, of words). A task reports one row for each term it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        df, n, words = np.zeros(len(asked.terms), np.int64), 0, 0
        for b in batches:
            _, term, _, length = asked.counted(b.column(0))
            df += np.bincount(term, minlength=len(df))
            n, words = n + b.num_rows, words + int(length.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at], pa.int64()), pa.array([n, words, *df[at]], pa.int64())], ["term", "n"])

    found = corpus.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(found["term"].to_pylist(), found["n"].to_pylist(), strict=True))
    df = np.zeros(n_terms)
    for t, c in counts.items():
        if t >= 0:
            df[t] = c
    return df, counts.get(-2, 0), counts.get(-1, 0)


def _scored(corpus: DataFrame, sent, ids: pa.Array, weight: np.ndarray, mean: float, k: int) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        n_queries = len(asked.ids)
        least = np.full(n_queries, -np.inf)
        for b in batches:
            doc, term, tf, length = asked.counted(b.column(1))
            impact = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
            upto = np.cumsum(asked.count[term])
            low = 0
            while low < len(doc):  # whole texts, as many as make about PRODUCTS products
                until = np.searchsorted(upto, (upto[low - 1] if low else 0) + PRODUCTS, side="right")
                high = int(np.searchsorted(doc, doc[max(low, min(until, len(doc) - 1))], side="left")) if until < len(doc) else len(doc)
                high = high if high > low else int(np.searchsorted(doc, doc[low], side="right"))
                yield _best(asked, b.column(0), doc[low:high], term[low:high], impact[low:high], least, k)
                low = high

    return corpus.mapInArrow(run, _result(corpus, ids, "chunk_id", T.StructField("score", T.DoubleType())))


def _best(asked: TermQueries, names: pa.Array, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, least: np.ndarray, k: int) -> pa.RecordBatch:
    """What of some texts' postings may be among the best of the queries; least: the k-th best score of each so far."""
    n = asked.count[term]
    ends = np.cumsum(n)
    query = asked.query[np.repeat(asked.first[term] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    docs, place = np.unique(doc, return_inverse=True)
    cell = np.repeat(place, n) + query * len(docs)
    found = np.unique(cell) if len(docs) * len(least) > 4 * len(cell) else np.flatnonzero(np.bincount(cell, minlength=len(docs) * len(least)))
    score = np.round(np.bincount(np.searchsorted(found, cell), np.repeat(impact, n), len(found)), 6)
    row, column = found // len(docs), docs[found % len(docs)]
    some = score >= least[row]
    row, column, score = row[some], column[some], score[some]
    order_of = np.empty(len(names), np.int64)
    order_of[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    order = np.lexsort((order_of[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    full = nth == k - 1
    least[row[full]] = np.maximum(least[row[full]], score[full])
    keep = nth < k
    return pa.RecordBatch.from_arrays([asked.ids.take(pa.array(row[keep])), names.take(pa.array(column[keep])), pa.array(score[keep])], ["query_id", "chunk_id", "score"])


# A kept index


def postings(chunks: DataFrame, ident: str = "chunk_id", text: str = "content") -> DataFrame:
    """(term, id, tf, dl): the inverted index of the chunks."""
    words = chunks.select(F.col(ident).alias("id"), terms(F.col(text)).alias("w"))
    return words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


class TextIndex:
    """A kept inverted index, so that searches read the postings of their terms and no text.

    A folder of segments, as search engines keep them: an update adds a segment
    with the postings and lengths of the chunks written and the ids of those that it
    replaces or deletes; nothing written is changed. A chunk counts as the last
    segment that names it has it. `merge` writes the live chunks as one segment.
    Postings lie in files by a hash of the term, sorted by it, so that the filter on
    the terms skips most files and row groups. A segment counts once its folder has
    its final name, so a writer that dies leaves the index as it was. One writer at
    a time.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        top = self._new(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n.removeprefix("segment-")) for n in names if n.startswith("segment-"))

    def update(self, chunks: DataFrame | None, deleted: DataFrame | None = None, ident: str = "chunk_id", text: str = "content") -> None:
        """Indexes chunks (ident, text), in place of what was known of their ids, and drops the ids in `deleted` (ident)."""
        named = [df.select(F.col(ident).cast("string").alias("id")) for df in (chunks, deleted) if df is not None]
        fresh = None if chunks is None else chunks.select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text"))
        self._write(None if fresh is None else postings(fresh, "id", "text"), None if fresh is None else fresh.select("id", F.size(terms(F.col("text"))).alias("dl")), reduce(DataFrame.unionByName, named).distinct())

    def _write(self, found: DataFrame | None, lengths: DataFrame | None, replaced: DataFrame) -> int:
        number = max(self.segments(), default=-1) + 1
        draft = f"{self.path}/draft-{number}"
        self._fs.delete(self._new(draft), True)
        replaced.write.parquet(f"{draft}/replaced")
        empty = self.spark.createDataFrame([], "term string, id string, tf long, dl int")
        cut = (empty if found is None else found).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int"))
        cut.repartition("bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{draft}/postings")
        (empty.select("id", "dl") if lengths is None else lengths).write.parquet(f"{draft}/lengths")
        if not self._fs.rename(self._new(draft), self._new(f"{self.path}/segment-{number}")):
            raise OSError(f"segment {number} could not take its place")
        return number

    def _read(self, part: str, schema: str) -> DataFrame:
        out = [self.spark.read.schema(schema).parquet(f"{self.path}/segment-{n}/{part}").withColumn("segment", F.lit(n)) for n in self.segments()]
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], f"{schema}, segment int")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, segment, ...) that no later segment replaces."""
        last = self._read("replaced", "id string").groupBy("id").agg(F.max("segment").alias("last"))
        return rows.join(last, "id").where(F.col("segment") == F.col("last")).drop("segment", "last")

    def rebuild(self, chunks: DataFrame, ident: str = "chunk_id", text: str = "content") -> None:
        """Indexes chunks anew and forgets everything else."""
        old = self.segments()
        self.update(chunks, ident=ident, text=text)
        for n in old:
            self._fs.delete(self._new(f"{self.path}/segment-{n}"), True)

    def merge(self) -> None:
        """The live chunks as one segment; the segments before it go once it stands."""
        old = self.segments()
        lengths = self._live(self._read("lengths", "id string, dl int"))
        self._write(self._live(self._read("postings", "term string, id string, tf long, dl int, bucket int")).drop("bucket"), lengths, self._read("replaced", "id string").select("id").distinct())
        for n in old:
            self._fs.delete(self._new(f"{self.path}/segment-{n}"), True)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank) by BM25 from the postings of the asked terms alone."""
        parts = []
        n, mean = self._live(self._read("lengths", "id string, dl int")).agg(F.count("*"), F.avg("dl")).first()
        for ids, texts in text_blocks(queries) if n else ():
            flat, of = arrow_terms(texts)
            if not len(flat):
                continue
            asked = self.spark.createDataFrame(pa.table([ids.take(pa.array(of)), flat.cast(pa.string())], ["query_id", "term"])).distinct()
            some = F.broadcast(asked.select("term", F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int").alias("bucket")).distinct())
            # The bucket of the terms prunes the folders as they are read; one block's terms are few enough to send.
            found = self._live(self._read("postings", "term string, id string, tf long, dl int, bucket int").join(some, ["bucket", "term"], "left_semi"))
            df = found.groupBy("term").agg(F.count("*").alias("df"))
            idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
            scored = found.join(F.broadcast(df), "term").select("term", F.col("id").alias("chunk_id"), weight.alias("w")).join(F.broadcast(asked), "term")
            parts.append(scored.groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score")))
        if not parts:
            return queries.select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        return rank_top_k(reduce(DataFrame.unionByName, parts), k, "chunk_id")


# Phrases


def flat_terms(text: Column) -> Column:
    """The terms in a row, each after a space; a text's flat terms contain those of a phrase where its words occur in a
    row, the last as a prefix."""
    return F.concat(F.lit(" "), F.array_join(terms(text), " "))


def phrase_prefix(text: Column, phrase: Column) -> Column:
    """Whether the phrase's words occur in a row, the last as a prefix: what a quoted, starred full-text query asks."""
    return (flat_terms(phrase) != " ") & flat_terms(text).contains(flat_terms(phrase))


def substring_search(chunks: DataFrame, queries: DataFrame, ident: str = "chunk_id", text: str = "content", shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(query_id, chunk_id) of the chunks whose text holds a query's text, both as `shown` makes them; empty ones hold in none.

    One automaton for a block of queries reads each text once, whatever their number.
    """
    asked = queries.select("query_id", shown(F.col("text")).alias("text")).where("trim(text) <> ''")
    corpus = chunks.select(F.col(ident).alias("chunk_id"), shown(F.col(text)).alias("text"))
    parts = []
    for ids, texts in text_blocks(asked):
        sent = chunks.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import ahocorasick

            ids, texts = sent.value
            places: dict[str, list[int]] = {}
            for i, t in enumerate(texts.to_pylist()):
                places.setdefault(t, []).append(i)
            search = ahocorasick.Automaton()
            for t in places:
                search.add_word(t, t)
            search.make_automaton()
            for b in batches:
                query, chunk = [], []
                for row, t in enumerate(b.column(1)):
                    for hit in {w for _, w in search.iter(t.as_py() or "")}:
                        query += places[hit]
                        chunk += [row] * len(places[hit])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query, pa.int64())), b.column(0).take(pa.array(chunk, pa.int64()))], ["query_id", "chunk_id"])

        parts.append(corpus.mapInArrow(run, _result(corpus, ids, "chunk_id")))
    return reduce(DataFrame.unionByName, parts) if parts else _none(chunks, queries, ident)


def phrase_search(chunks: DataFrame, queries: DataFrame, ident: str = "chunk_id", text: str = "content") -> DataFrame:
    """(query_id, chunk_id) of the chunks that hold a query's text as a phrase prefix."""
    return substring_search(chunks, queries, ident, text, flat_terms)
