"""Benchmark decontamination: a BM25 index of the test items with block-max WAND.

The items are the indexed documents, cut into segments of at most SEGMENT words;
the training texts are the queries. Every text is read in passages of PASSAGE
words, each beginning half a passage after the one before, so that any segment's
words stand whole in some passage. A passage retrieves every segment whose BM25
score reaches RETRIEVE times the score that the segment gives itself. Impacts are
stored divided by that self score, which makes the threshold one number.

Retrieval is exact. A segment's commonest terms are not essential to it while all
of them together stay well below the threshold: a passage in which its essential
terms do not make up the rest scores below the threshold. One vectorised sum over
a text's essential postings tells that for all passages at once. Passages with a
segment left run block-max WAND: pivoting on the terms' greatest impacts, then on the blocks' greatest
impacts, skipping blocks that cannot reach the threshold.

A retrieved item is then verified on the whole text: five-word shingles of the
item are contained to OVERLAP, those of its question (the first half of its
words) and of its answer (the second half) each to HALF_OVERLAP. Words are runs of
anything but ASCII white space, A-Z lower-cased; fewer than five words are one
shingle.

The index is sent to every task. Items are dealt to as many shards as keep one
index under SHARD_BYTES of text; shards are worked off one after the other, a pass
over the texts for each, with document frequencies counted over all items.

An item whose words stand scattered, so that no passage of a text scores half of a
segment's own score, is not retrieved, though its shingles may be contained in the
whole text; that takes shingles spread over many passages, which no copy of an item
has. Against containment in whole texts recall is 1.0 on the tables at hand and on
the fixtures of the tests.

Defined results: null and empty texts, and items without words, match nothing; a
very long text is read whole, passage by passage; repeated items or rows each give
their own matches (equal items are indexed once, with a count); an empty benchmark
or table gives an empty result. Extra columns are ignored, whatever their names;
`flag_contaminated` keeps them, and flags null and empty texts false.
"""

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, lower_ascii, release, releasing, small_batches

K1, B = 1.2, 0.75
SEGMENT, PASSAGE, STRIDE = 64, 128, 64
RETRIEVE = 0.5
#: Of the threshold, what terms that are not essential may reach together.
SPARE = 0.6
OVERLAP, HALF_OVERLAP = 0.75, 0.5
SHINGLE = 5
BLOCK = 8
SHARD_BYTES = 8_000_000

MATCHES = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    if len(words) < SHINGLE:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def segments(words: list[bytes]) -> list[list[bytes]]:
    """Pieces of equal length, of SEGMENT words at most."""
    k = max(1, math.ceil(len(words) / SEGMENT))
    n = math.ceil(len(words) / k)
    return [words[i : i + n] for i in range(0, len(words), n)] if words else []


@dataclass
class Postings:
    """One term's segments in ascending order with their impacts, in blocks with their last segment and greatest impact."""

    segments: list[int]
    impacts: list[float]
    last: list[int] = field(default_factory=list)
    most: list[float] = field(default_factory=list)
    top: float = 0.0

    def seal(self) -> None:
        for at in range(0, len(self.segments), BLOCK):
            self.last.append(self.segments[min(at + BLOCK, len(self.segments)) - 1])
            self.most.append(max(self.impacts[at : at + BLOCK]))
        self.top = max(self.most)


class Index:
    """items: (item_id, words, how often it stands). df and n: document frequency of each term and number of segments, over all shards."""

    def __init__(self, items: list[tuple[int, list[bytes], int]], df: dict[bytes, int], n: int, mean_words: float):
        self.items = items
        self.of_segment: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.postings: list[Postings] = []
        self.essential: list[list[tuple[int, float]]] = []
        self.spare: list[float] = []
        for k, (_, words, _) in enumerate(items):
            for seg in segments(words):
                self._add(k, seg, df, n, mean_words)
        for p in self.postings:
            p.seal()
        self.spare = np.array(self.spare)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in self.essential]), [0]]).astype(np.int64)
        self.first[-1] = self.first[-2]  # the place of words that no item has
        flat = [x for e in self.essential for x in e]
        self.essential_segment = np.array([s for s, _ in flat], np.int64)
        self.essential_impact = np.array([w for _, w in flat])

    def _add(self, item: int, words: list[bytes], df: dict[bytes, int], n: int, mean_words: float) -> None:
        s = len(self.of_segment)
        self.of_segment.append(item)
        raw = {}
        for t, tf in Counter(words).items():
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            raw[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
        own = sum(raw.values())
        spare = 0.0
        for t in sorted(raw, key=lambda t: (-df[t], t)):
            k = self.terms.setdefault(t, len(self.postings))
            if k == len(self.postings):
                self.postings.append(Postings([], []))
                self.essential.append([])
            impact = raw[t] / own
            self.postings[k].segments.append(s)
            self.postings[k].impacts.append(impact)
            if spare + impact < SPARE * RETRIEVE:
                spare += impact
            else:
                self.essential[k].append((s, impact))
        self.spare.append(spare)

    def passages(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Word ranges of the passages that may reach the threshold."""
        look = self.terms.get
        none = len(self.postings)
        w = np.fromiter((look(x, none) for x in words), np.int64, len(words))
        n = self.first[w + 1] - self.first[w]
        at = np.flatnonzero(n)
        n, total = n[at], int(n.sum())
        if not total:
            return
        entry = np.repeat(self.first[w[at]] - (np.cumsum(n) - n), n) + np.arange(total)
        last = max(0, -(-(len(words) - STRIDE) // STRIDE) - 1)
        here = np.repeat(at // STRIDE, n)
        segment, impact = self.essential_segment[entry], self.essential_impact[entry]
        # Every word lies in the passage that begins at its stride and in the one before.
        key = np.concatenate([np.minimum(here, last), np.maximum(here, 1) - 1]) * len(self.spare) + np.concatenate([segment, segment])
        impact = np.concatenate([impact, np.where((here > 0) & (here <= last), impact, 0.0)])
        keys, back = np.unique(key, return_inverse=True)
        bound = np.bincount(back, impact) + self.spare[keys % len(self.spare)]
        for i in np.unique(keys[bound >= RETRIEVE - 1e-9] // len(self.spare)):
            yield int(i) * STRIDE, min(int(i) * STRIDE + PASSAGE, len(words))

    def retrieve(self, words: list[bytes], threshold: float = RETRIEVE) -> list[tuple[int, float]]:
        """(segment, score) of every segment that scores at least the threshold, by block-max WAND."""
        lists = [self.postings[k] for k in sorted({self.terms[x] for x in words if x in self.terms})]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        eps = 1e-9
        while True:
            live = [i for i in live if at[i] < len(lists[i].segments)]
            live.sort(key=lambda i: lists[i].segments[at[i]])
            bound, pivot = 0.0, -1
            for j, i in enumerate(live):
                bound += lists[i].top
                if bound >= threshold - eps:
                    pivot = j
                    break
            if pivot < 0:
                return found
            s = lists[live[pivot]].segments[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].segments[at[live[pivot + 1]]] == s:
                pivot += 1
            # The blocks that hold s, or would.
            block_bound, next_s = 0.0, math.inf
            for i in live[: pivot + 1]:
                b = bisect_left(lists[i].last, s)
                if b < len(lists[i].last):
                    block_bound += lists[i].most[b]
                    next_s = min(next_s, lists[i].last[b] + 1)
            if block_bound >= threshold - eps:
                score = 0.0
                for i in live[: pivot + 1]:
                    at[i] = bisect_left(lists[i].segments, s, at[i])
                    if at[i] < len(lists[i].segments) and lists[i].segments[at[i]] == s:
                        score += lists[i].impacts[at[i]]
                        at[i] += 1
                if score >= threshold - eps:
                    found.append((s, score))
                continue
            # No segment before next_s can reach the threshold with these lists; the next list's segment ends the argument.
            if pivot + 1 < len(live):
                next_s = min(next_s, lists[live[pivot + 1]].segments[at[live[pivot + 1]]])
            next_s = max(next_s, s + 1)
            for i in live[: pivot + 1]:
                at[i] = bisect_left(lists[i].segments, next_s, at[i]) if next_s < math.inf else len(lists[i].segments)

    def matches(self, words: list[bytes]) -> list[tuple[int, float, float, float, float]]:
        """(item number, best score, overlap, question overlap, answer overlap) of the verified items of a text."""
        best: dict[int, float] = {}
        for start, end in self.passages(words):
            for s, score in self.retrieve(words[start:end]):
                k = self.of_segment[s]
                best[k] = max(best.get(k, 0.0), score)
        if not best:
            return []
        have = shingles(words)
        sizes: dict[int, set] = {}
        out = []
        for k in sorted(best):
            item = self.items[k][1]
            half = len(item) // 2
            parts = [contained(x, have, words, sizes) for x in (item, item[:half], item[half:])]
            if parts[0] >= OVERLAP and min(parts[1:]) >= HALF_OVERLAP:
                out.append((k, best[k], *parts))
        return out


def contained(part: list[bytes], have: set, words: list[bytes], short: dict[int, set]) -> float:
    """Share of a part's shingles that a text has. Parts under five words are looked for as they are."""
    n = len(part)
    if not n:
        return 1.0
    if n >= SHINGLE:
        mine = shingles(part)
        return len(mine & have) / len(mine)
    if n not in short:
        short[n] = set(zip(*(words[i:] for i in range(n)), strict=False))
    return float(tuple(part) in short[n])


def build_indexes(items: DataFrame) -> Iterator[Index]:
    """One index for each shard of items (item_id, text). Only one shard's items are with the driver at a time."""
    tested = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where(F.col("text").isNotNull())
    tested = tested.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    size, n_items = tested.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not n_items:
        return
    shards = max(1, math.ceil(size / SHARD_BYTES))
    tested = tested.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    if shards > 1:
        # Document frequencies over the segments of all items; segments are cut as in segments().
        w = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"({WORD})"), F.lit(1))
        k = F.greatest(F.lit(1), F.ceil(F.size("w") / SEGMENT))
        cut = tested.select("shard", "times", w.alias("w")).withColumn("n", F.ceil(F.size("w") / k).cast("int")).where("n > 0")
        segs = cut.select("shard", "times", F.explode(F.transform(F.sequence(F.lit(1), F.size("w"), F.col("n")), lambda i: F.slice("w", i, F.col("n")))).alias("s"))
        n, words = segs.agg(F.sum("times"), F.sum(F.col("times") * F.size("s"))).first()
        mean = (words or 0) / max(1, n or 0)
        terms = segs.select("shard", "times", F.explode(F.array_distinct("s")).alias("term"))
        counts = terms.groupBy("term").agg(F.sum("times").alias("df"))
    for s in range(shards):
        mine = [(r["item_id"], words_of(r["text"]), r["times"]) for r in tested.where(F.col("shard") == s).orderBy("item_id", "text").collect()]
        mine = [x for x in mine if x[1]]
        if shards == 1:
            cuts = [(c, times) for _, words, times in mine for c in segments(words)]
            df = Counter()
            for c, times in cuts:
                df.update(dict.fromkeys(c, times))
            n = sum(times for _, times in cuts)
            mean = sum(len(c) * times for c, times in cuts) / max(1, n)
        else:
            own = terms.where(F.col("shard") == s).select("term").distinct()
            df = {r["term"].encode(): r["df"] for r in counts.join(own, "term").collect()}
        if mine:
            yield Index(mine, df, n, mean)


def find_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): a row for each text and item found in it."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for index in build_indexes(items):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = sent.value
            for b in batches:
                found: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                    for k, *rest in index.matches(words_of(text.as_py())):
                        for column, v in zip(found, (doc_id.as_py(), index.items[k][0], *rest), strict=True):
                            column += [v] * index.items[k][2]
                kinds = [pa.int64()] * 2 + [pa.float64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, kinds, strict=True)], MATCHES.replace(" long", "").replace(" double", "").split(", "))

        part = rows.mapInArrow(releasing(run), MATCHES)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], MATCHES) if out is None else out


def _holds(sent):  # noqa: ANN001, ANN202
    def holds(texts: pa.Array) -> pa.Array:
        out = pa.array([bool(sent.value.matches(words_of(t.as_py()))) for t in texts], pa.bool_())
        release()
        return out

    return holds


def flag_contaminated(docs: DataFrame, items: DataFrame, flag: str) -> DataFrame:
    """docs with a boolean column: whether a text holds a test item. Other columns stay as they are."""
    out = small_batches(docs).withColumn(flag, F.lit(False))
    for index in build_indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        holds = F.arrow_udf(_holds(sent), "boolean")

        out = out.withColumn(flag, F.col(flag) | holds(docs["text"]))
    return out
