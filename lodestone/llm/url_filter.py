"""URL filters by a cascade of Bloom filters.

A cascade answers "is this key listed?" without error for every key of a known
universe. Level 0 holds the listed keys. Level 1 holds the unlisted keys of the
universe that level 0 accepts by mistake, level 2 the listed keys that level 1
accepts by mistake, and so on until a level makes no mistake. A key is listed if
the number of levels that accept it in a row, from level 0, is odd.

The bits of all levels, BITS_PER_KEY for each listed key and little more, are one
array of bytes that every task is sent; a look-up tests bits in Arrow batches and
joins nothing. Only building joins the sets of mistakes. A list of more than
KEYS_PER_PASS keys is dealt by hash to several cascades, which are looked up one
after the other, the column of answers being staged between: a task holds the bits
of one, whatever the length of the list.

Defined results: a null url, or one without "://", has an empty host and path and
fits no rule; a very long url is looked at whole and has no more candidate keys
than the rules have shapes; repeated rows are judged alike; an empty rule list
accepts nothing; an empty table gives an empty result; columns of the input other
than the url are carried along untouched, but for host, path, rule and verdict,
which the result replaces.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lower_ascii, remove, staged

BITS_PER_KEY = 20
HASHES = 7
#: Keys of one cascade: 25 MB of bits for every task at most.
KEYS_PER_PASS = 10_000_000


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_hashes(*parts: Column) -> Column:
    """Two independent 64-bit hashes of a key, from which all bit positions derive."""
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """The bits of keys in a level's filter, one array for each hash function."""
    for i in range(HASHES):
        x = h1 ^ (h2 + np.uint64((0x9E3779B97F4A7C15 * (1 + i + HASHES * level)) % 2**64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        yield (x ^ (x >> np.uint64(31))) % np.uint64(bits)


@dataclass(frozen=True)
class FilterCascade:
    """levels: the bits of each, in 64-bit words."""

    levels: list[np.ndarray]

    def accepted(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        words = self.levels[level]
        out = np.ones(len(h1), bool)
        for at in _positions(h1, h2, level, 64 * len(words)):
            out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether the keys, given by their hashes as unsigned 64-bit integers, are listed."""
        out = np.zeros(len(h1), bool)
        at = np.arange(len(h1))
        for k in range(len(self.levels)):
            at = at[self.accepted(h1[at], h2[at], k)]
            out[at] = k % 2 == 0
        return out


def _hashes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(b.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))


def _level_bits(keys: DataFrame, level: int, n: int) -> np.ndarray:
    """The filter of n keys. Tasks report words with the bits that their keys set; the driver gets the words, once each."""
    words = max(1, math.ceil(n * BITS_PER_KEY / 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = _hashes(b)
            at = np.concatenate(list(_positions(h1, h2, level, 64 * words)))
            word, back = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    put = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[put["word"].to_numpy()] = put["bits"].to_numpy().view(np.uint64)
    return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> FilterCascade:
    """listed and universe: (h1 long, h2 long), distinct. universe: every key that will be looked
    up, listed or not. The driver gathers the bits of the levels, BITS_PER_KEY for each listed key
    and for each mistake, never a set of keys. Mistakes grow fewer by three orders of magnitude a level,
    and a level that makes none ends the cascade.
    """
    spark = listed.sparkSession
    hold, path = staged(listed.select("h1", "h2"), "listed")
    against, other_path = staged(universe.select("h1", "h2").join(hold, ["h1", "h2"], "left_anti"), "unlisted")
    paths, levels = [path, other_path], []
    for k in itertools.count():
        n = hold.count()
        if not n:
            break
        levels.append(_level_bits(hold, k, n))
        # A level sees the keys that those before let through, so it alone decides which of them are mistakes.
        sent = spark.sparkContext.broadcast((k, levels[-1]))

        def wrong(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            k, words = sent.value
            level = FilterCascade([np.zeros(0, np.uint64)] * k + [words])
            for b in batches:
                yield b.filter(pa.array(level.accepted(*_hashes(b), k)))

        false, path = staged(against.mapInArrow(wrong, "h1 long, h2 long"), f"level{k}")
        sent.unpersist()
        paths.append(path)
        hold, against = false, hold
    remove(spark, *paths)
    return FilterCascade(levels)


def split_rule(rule: str) -> tuple[str, str]:
    """host/path, as in example.com/en/ ."""
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), slash + path


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The (host suffix, path prefix) pairs of a url that some rule could name. shapes: the numbers of
    labels in a rule's host and of characters in its path that occur together. The pairs are as
    many as the shapes at most, however long the url."""
    split = F.split(host, r"\.")
    suffix = {n: F.when((F.size(split) >= n) & (host != ""), F.array_join(F.slice(split, -n, n), ".")) for n, _ in shapes}
    prefix = {n: F.when(F.length(path) >= n, F.substring(path, 1, n)) for _, n in shapes}
    pairs = [F.when(suffix[n].isNotNull() & prefix[m].isNotNull(), F.struct(suffix[n].alias("host"), prefix[m].alias("path"))) for n, m in shapes]
    return F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<struct<host:string,path:string>>")


def _look_up(cascade: FilterCascade, spark, code: int):  # noqa: ANN001, ANN202
    """A function of arrays of hashes and of codes so far: the code where the cascade holds a key."""
    sent = spark.sparkContext.broadcast(cascade)

    def answer(h1: pa.Array, h2: pa.Array, codes: pa.Array) -> pa.Array:
        got = codes.flatten().to_numpy(zero_copy_only=False).copy()
        got[sent.value.contains(*(x.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for x in (h1, h2)))] = code
        offsets = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got, pa.int32()))

    answer.__annotations__ = {"h1": pa.Array, "h2": pa.Array, "codes": pa.Array, "return": pa.Array}
    return F.arrow_udf(answer, "array<int>")


def judge_urls(df: DataFrame, url: str, rules: dict[str, str], default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to df (replacing columns of these names).

    rules: "host/path" to "allow" or "block". A rule fits its host and all
    subdomains if the url's path starts with its path; the longest rule wins, and
    of equally long ones the one with the longer host. Which of a url's candidate
    keys are listed is answered by cascades, one or more for each verdict, built
    over all candidate keys of df. Urls that no rule fits get `default`.
    """
    spark = df.sparkSession
    verdicts = sorted(set(rules.values()))
    parts = [(*split_rule(r), verdicts.index(v)) for r, v in rules.items()]
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in parts})
    universe = df.select(F.explode(candidate_keys(url_host(F.col(url)), url_path(F.col(url)), shapes)).alias("k")).select(key_hashes(F.col("k.host"), F.col("k.path")).alias("h"))
    universe, universe_path = staged(universe.select("h.h1", "h.h2").distinct(), "universe")
    columns = list(zip(*parts, strict=True)) or [(), (), ()]
    listed = spark.createDataFrame(pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], ["host", "path", "code"]))
    listed, listed_path = staged(listed.select(key_hashes(F.col("host"), F.col("path")).alias("h"), "code").select("h.h1", "h.h2", "code").distinct(), "rules")
    counts = {r["code"]: r["n"] for r in listed.groupBy("code").agg(F.count("*").alias("n")).collect()}
    passes = [(code, i, math.ceil(n / KEYS_PER_PASS)) for code, n in sorted(counts.items()) for i in range(math.ceil(n / KEYS_PER_PASS))]

    # Beside the input's columns, whatever their names, a struct holds what the look-ups need.
    named = df.select(F.struct(*[c for c in df.columns if c not in ("host", "path", "rule", "verdict")]).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    judged = named.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), shapes)).withColumn("codes", F.transform("keys", lambda _: F.lit(-1)))
    for code, i, n in passes:
        mine = F.pmod(F.xxhash64("h2", "h1", F.lit("pass")), F.lit(n)) == i
        cascade = build_cascade(listed.where((F.col("code") == code) & mine), universe.where(mine))
        h1, h2 = F.transform("keys", lambda k: key_hashes(k["host"], k["path"])["h1"]), F.transform("keys", lambda k: key_hashes(k["host"], k["path"])["h2"])
        judged = judged.withColumn("codes", _look_up(cascade, spark, code)(h1, h2, F.col("codes")))
        if len(passes) > len(verdicts):
            judged, _ = staged(judged, "judged")
    remove(spark, universe_path, listed_path)

    found = F.zip_with("keys", "codes", lambda k, c: F.struct((F.length(k["host"]) + F.length(k["path"])).alias("n"), F.length(k["host"]).alias("m"), F.concat(k["host"], k["path"]).alias("rule"), c.alias("code")))
    best = judged.withColumn("best", F.array_max(F.filter(found, lambda x: x["code"] >= 0)))
    name = reduce(lambda rest, v: F.when(F.col("best.code") == v[0], F.lit(v[1])).otherwise(rest), enumerate(verdicts), F.lit(default))
    out = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("best.rule"), "verdict": name}
    kept = [c for c in df.columns if c not in out]
    return best.select(*[F.col("row").getField(c).alias(c) for c in kept], *[v.alias(k) for k, v in out.items()])
