"""What the training-data operators share: the cluster's shared folder, staged tables and components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else, so no locale or Unicode rule can change a result."""
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a local session, where all
    is one machine, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


#: Staged tables that nothing has removed yet, oldest first. What is left when the program ends goes then.
_tables: dict[str, None] = {}


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession() if _tables else None
    if spark is not None:
        remove(spark, *_tables)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again: the lineage ends there and a
    lost executor costs a reread, not a recomputation. Returns the table and its path."""
    path = scratch_path(df.sparkSession, name)
    _tables[path] = None
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def scratch_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written to a scratch path, which counts as staged from now on."""
    _tables[path] = None
    return spark.read.parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that no later result reads."""
    for p in paths:
        _tables.pop(p, None)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Removes what was staged inside and is still there, on success and on failure. An operator's result reads its last
    staged tables, so write the result before the block ends."""
    before = set(_tables)
    try:
        yield
    finally:
        remove(spark, *[p for p in _tables if p not in before])


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`: each row's place, from 1, in its group by `order`, which must leave no ties.

    No task sees a whole group: rows are dealt by ranges of group and order, and a
    row's place is its place in its range after the group's rows in the ranges
    before. The number of counts is that of ranges and groups together.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt, _ = staged(rows.repartitionByRange(n, *[F.col(c) for c in group], *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__range", *group).agg(F.count("*").alias("__count"))
    ahead = F.sum("__count").over(W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    ahead = counts.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__r_{c}") for c in group], F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    here = dealt.withColumn("__here", F.row_number().over(W.partitionBy("__range", *group).orderBy(*order)))
    same = (F.col("__range") == F.col("__r")) & and_all(F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in group)
    placed = here.join(ahead, same).withColumn(name, F.col("__ahead") + F.col("__here"))
    return placed.drop("__range", "__here", "__ahead", "__r", *[f"__r_{c}" for c in group])


def and_all(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


#: Bytes of an Arrow batch that goes to a Python worker, where the session does not say otherwise.
BATCH_BYTES = "4m"
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to Arrow batches of BATCH_BYTES if it has Spark's own setting, 64 MB: whole texts go to
    Python in these batches, which an executor's cores hold at once, on both sides."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, BATCH_BYTES)
    return df


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers outlive their tasks, and what one stage
    held would otherwise stand beside the next one's needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that releases its memory at the end of each task."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return out


#: A graph of at most so many edges is finished by one task, in bounded memory.
ONE_TASK_EDGES = 300_000


def _roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node of each one's component."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, roots = _roots_of(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> tuple[DataFrame, str]:
    """Connected components of an undirected graph.

    edges: (a long, b long), staged; repeats and loops allowed. Returns (node long,
    root long) for each node with an edge to another node, and the staged table's
    path; root is the smallest node of the component.

    A graph whose counted size is small is finished by one task. Otherwise each
    round hooks every node's tree onto the smallest root among its neighbours and
    then halves the paths, so the number of rounds grows with the logarithm of
    the longest chain. All state stays in staged tables; a hub's edges meet in
    partial aggregates, never in one task's list.
    """
    spark = edges.sparkSession
    links = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if links.count() <= one_task_edges:
        return staged(links.coalesce(1).mapInArrow(releasing(_one_task), "node long, root long"), "labels")
    # Rows are doubled by explode, not by union: a union of equally partitioned sides may not survive coalescing.
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both, both_path = staged(links.select(ends.alias("e")).select("e.a", "e.b").distinct(), "graph")
    labels, path = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:  # each round brings every node nearer to its root; the last one changes nothing
        # The smallest label in reach of a node's neighbours, offered to the node's root as well.
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        offers = labels.join(seen, labels.node == seen.a).select("node", "root", F.least("root", "near").alias("best"))
        told = F.explode(F.array(F.struct("node", "best"), F.struct(F.col("root").alias("node"), F.col("best"))))
        merged = offers.select(told.alias("t")).groupBy("t.node").agg(F.min("t.best").alias("root"))
        hop = merged.select(F.col("node").alias("root"), F.col("root").alias("up"))
        nxt, nxt_path = staged(merged.join(hop, "root").select("node", F.least("up", "root").alias("root")), "labels")
        old = labels.select("node", F.col("root").alias("was"))
        changed = not nxt.join(old, "node").where("root <> was").isEmpty()
        remove(spark, path)
        labels, path = nxt, nxt_path
        if not changed:
            remove(spark, both_path)
            return labels, path
