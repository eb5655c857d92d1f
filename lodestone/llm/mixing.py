"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Every source is cut into shards of about SHARD_WORDS words by a seeded hash, and
a shard, its documents laid end to end in a seeded order, into blocks of
BLOCK_WORDS words. The seats (blocks that the mix takes) go to the sources, and
then to each source's shards, by the highest quotients votes / (2k - 1). A shard
with more seats than blocks is taken whole once more; the remaining seats are a
run of blocks from a seeded start, going round at the end. As documents stand in
a seeded random order, such a run is a seeded sample of them.

Defined results: a null or blank text has size 0 and gives no words; a null source
is a source of its own, last in order; a null doc_id is a value like others; equal
rows are interchangeable and each is counted; a very long text is one row of its
shard, counted whole; an empty table gives an empty result. The input's other
columns are ignored, whatever their names. The level that caps the sources is
found by one task from a row of numbers for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, and_all, ranked, staged

BLOCK_WORDS = 64
SHARD_WORDS = 65_536
SEED = "mix-1"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def with_totals(rows: DataFrame, group: list[str], **sums: Column) -> DataFrame:
    """Adds aggregates of a row's group to it. They are few, so that Spark can send them to the rows."""
    of = rows.groupBy(*group).agg(*[c.alias(k) for k, c in sums.items()])
    of = of.select(*[F.col(c).alias(f"__of_{c}") for c in group], *sums)
    return rows.join(of, and_all(F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group)).drop(*[f"__of_{c}" for c in group])


def seats(parties: DataFrame, votes: str, total: str, group: list[str], name: str) -> DataFrame:
    """Adds `name`: each party's seats by Sainte-Lague out of `total` (a column, equal within a group).

    Each party's number of seats lies within p(n/2) + 1 of its exact share, where
    p is its share of the votes and n the number of parties, so only quotients
    in that range compete; those below it are won beyond doubt. The rows made are
    five for each party, whatever the number of seats, and no task ranks a whole
    group. Ties: by more votes, then by the party's order, given in the column
    __order.
    """
    p = with_totals(parties, group, __sum=F.sum(votes), __n=F.count("*")).withColumn("__p", F.col(votes) / F.col("__sum"))
    half = F.col("__p") * F.col("__n") / 2 + 1
    p = p.withColumns(
        {
            "__sure": F.coalesce(F.greatest(F.lit(0), F.floor(F.col("__p") * F.col(total) - half).cast("long")), F.lit(0)),
            "__most": F.coalesce(F.ceil(F.col("__p") * F.col(total) + half).cast("long"), F.lit(0)),
        }
    )
    p, _ = staged(p, "parties")
    p = with_totals(p, group, __sures=F.sum("__sure")).withColumn("__left", F.col(total) - F.col("__sures"))
    bids = p.where(F.col(votes) > 0).select(
        *group, "__order", F.col(votes).alias("__v"), "__left", F.explode(F.sequence(F.col("__sure") + 1, F.greatest(F.col("__most"), F.col("__sure") + 1))).alias("__k")
    )
    bids = bids.withColumn("__quotient", F.col("__v") / (2 * F.col("__k") - 1))
    places = ranked(bids, group, [F.col("__quotient").desc(), F.col("__v").desc(), F.col("__order"), F.col("__k")], "__rank")
    won = places.where("__rank <= __left").groupBy(*group, "__order").agg(F.count("*").alias("__won"))
    keys = [*group, "__order"]
    won = won.select(*[F.col(c).alias(f"__w_{c}") for c in keys], "__won")
    out = p.join(won, and_all(F.col(c).eqNullSafe(F.col(f"__w_{c}")) for c in keys), "left").drop(*[f"__w_{c}" for c in keys])
    return out.withColumn(name, F.col("__sure") + F.coalesce("__won", F.lit(0))).drop("__p", "__n", "__sum", "__sure", "__sures", "__most", "__left", "__won")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to the words wanted of each: shares by weight, none above CAP times the
    source's size, the excess shared by weight among the rest until none is above.

    Raising one common level until the shares use up the total gives the same:
    sources reach their cap in the order of cap / weight, and the first that
    the level does not reach ends the search.
    """
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("__order") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    one = F.lit(1)
    t = sizes.withColumn("__order", F.row_number().over(W.partitionBy(one).orderBy(F.col("source").asc_nulls_last()))).withColumn("__w", weights)
    t = t.withColumns({"__cap": F.col("source_size") * F.lit(float(CAP)), "__total": F.sum("source_size").over(W.partitionBy(one)) * F.lit(SHARE)})
    by = W.partitionBy(one).orderBy(F.col("__cap") / F.col("__w"), "__order")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    rest = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest))
    t = t.withColumn("__final", F.first(F.when(F.col("__cap") > F.col("__level") * F.col("__w"), F.col("__level")), ignorenulls=True).over(everything))
    return t.withColumn("target", F.least("__cap", F.coalesce(F.col("__final") * F.col("__w"), F.col("__cap"))))


def size_documents(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size, draw) of docs, and more: number of words, and the digest that stands for a random draw. Staged."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.md5(F.concat(F.lit(SEED), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary"))
    return staged(docs.select("doc_id", "source", size.alias("size"), draw.alias("draw"), *more), "sizes")[0]


def mix_plan(sized: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """For each sized document: doc_id, size, source, source_size, target, taken, and the parts that make
    up taken: passes (times it is taken whole) and the word ranges [lo1, hi1) and [0, hi2) of it.

    `extra` columns are carried.
    """
    extra = extra or []
    sized = sized.select("doc_id", "source", "size", "draw", *extra)
    t = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    one = W.partitionBy(F.lit(1))
    t = t.withColumn("__votes", F.col("target")).withColumn("__total_seats", F.round(F.sum("target").over(one) / BLOCK_WORDS).cast("long")).withColumn("__all", F.lit(1))
    t = seats(t, "__votes", "__total_seats", ["__all"], "source_seats")
    t = t.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long"))
    t, _ = staged(t.select(F.col("source").alias("s_source"), "source_size", "target", "source_seats", "shards"), "targets")

    shard = F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.col("shards"))
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("shard", shard)
    rows, _ = staged(rows.drop("s_source"), "sharded")
    parts = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_words"), F.first("source_seats").alias("source_seats")).withColumn("__order", F.col("shard"))
    parts = seats(parts, "shard_words", "source_seats", ["source"], "quota")
    parts = parts.select(F.col("source").alias("p_source"), F.col("shard").alias("p_shard"), "quota")

    by = W.partitionBy("source", "shard").orderBy("draw", "doc_id", "size")
    whole = W.partitionBy("source", "shard")
    d = rows.withColumn("b", F.sum("size").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("len", F.sum("size").over(whole))
    d = d.withColumn("a", F.col("b") - F.col("size"))
    d = d.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard")))
    q = BLOCK_WORDS
    blocks = F.ceil(F.col("len") / q).cast("long")
    quota = F.least("quota", F.lit(CAP) * F.col("blocks"))
    d = d.withColumn("blocks", blocks).withColumn("quota", quota)
    d = d.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"))
    d = d.withColumn("run", F.col("quota") - F.col("passes") * F.col("blocks"))
    start = F.md5(F.concat(F.lit(SEED), F.lit("|start|"), F.coalesce("source", F.lit("")), F.lit("|"), F.col("shard").cast("string")).cast("binary"))
    d = d.withColumn("off", F.when(F.col("blocks") > 0, F.pmod(F.conv(F.substring(start, 1, 8), 16, 10).cast("long"), F.greatest("blocks", F.lit(1)))).otherwise(0))
    lo1, hi1 = F.col("off") * q, F.least((F.col("off") + F.col("run")) * q, "len")
    hi2 = F.greatest(F.lit(0), F.col("off") + F.col("run") - F.col("blocks")) * q
    d = d.withColumns(
        {
            "lo1": F.least(F.greatest(F.lit(0), lo1 - F.col("a")), "size"),
            "hi1": F.least(F.greatest(F.lit(0), hi1 - F.col("a")), "size"),
            "hi2": F.least(F.greatest(F.lit(0), hi2 - F.col("a")), "size"),
        }
    )
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.col("hi1") - F.col("lo1")) + F.col("hi2")
    d = d.withColumn("taken", taken.cast("long"))
    return d.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "lo1", "hi1", "hi2", *extra)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of documents."""
    return mix_plan(size_documents(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken whole and
    one for the part taken beside that. Of a part the text holds the taken words, joined by one space.
    n_chars, if docs has it, follows the text. Documents of which nothing is taken are left out.

    Rows get a number when they are staged with their sizes. The plan is made of numbers and sizes
    alone, and the texts are shuffled once, to meet it. A repeat is a row of a small sequence; texts
    are never put into arrays, and only those cut by an end of a run are cut into words. Null and
    blank texts are never taken; equal rows are planned one by one; an empty table gives no rows;
    columns of docs may have any names, as they travel inside a struct; a very long text is one row
    of its shard, of which words are taken like others.
    """
    sized = size_documents(docs, F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"))
    part = F.greatest(F.lit(0), F.col("hi1") - F.col("lo1")) + F.col("hi2")
    plan = mix_plan(sized, ["row"]).where("taken > 0").select(F.col("row").alias("of_row"), "size", "passes", "lo1", "hi1", "hi2", part.alias("part"))
    both = sized.select("row", "doc").join(plan, F.col("row") == F.col("of_row"))
    times = both.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0))))
    words = F.regexp_extract_all("doc.text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.filter(words, lambda _, i: (i < F.col("hi2")) | ((i >= F.col("lo1")) & (i < F.col("hi1")))), " ")
    text = F.when((F.col("nth") <= F.col("passes")) | (F.col("part") == F.col("size")), F.col("doc.text")).otherwise(cut)
    out = times.select("doc", text.alias("text"))
    n_chars = F.length("text")
    new = {"text": F.col("text")} | ({"n_chars": n_chars.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
