"""Near-duplicates of word shingles by SetSketch registers.

A document's set holds its distinct five-word shingles (words: runs of anything
but ASCII white space, A-Z lower-cased; with fewer words the whole sequence is
one shingle). Its sketch has REGISTERS registers; register i is a truncated,
exponentially spaced minimum: with the least of the set's hashes under the i-th
hash function seen as an exponential variable x with rate RATE, the register is
floor(1 - log_BASE(x)), held between 0 and TOP + 1. The register-wise maximum of
two sketches is the sketch of the union (`merge`).

Two sets agree in a register with a probability close to their Jaccard
similarity, so BANDS bands of ROWS registers bring similar sets together: at
similarity 0.75 a pair misses all bands once in 170,000. Pairs whose joint
maximum-likelihood estimate from the registers lies below KEEP_ESTIMATE, four
standard deviations under the threshold, go no further unless other pairs bring
both into one cluster; what is in one cluster is verified on the full sets. These
two chances, about one pair in 30,000 at the threshold itself and fewer above it,
are the only way to miss a link.

Copies never multiply: documents with equal sets form one class, and only classes
are compared. `forest` compares the classes of a group and reports spanning
forests, not pairs:

1. In each bucket the sketches' estimates give a forest of pairs that may be
   similar; its components are clusters, which no candidate pair leaves.
2. In each cluster full sets are intersected; the links' forest gives the final
   components.

A group of up to a block's rows is compared pair by pair. Of a larger one every row
first meets REPRESENTATIVES of the group, once. Whatever then hangs together needs
no further comparison among itself; only rows outside the group's largest part
meet all the others, in blocks. A group of copies of one text thus costs a number
of comparisons that grows with its size, not with its square, and no pair that
could join two parts is passed over.

Defined results: documents without words have no set, link with nothing and stay;
a null doc_id is less than no other: a component's id is its smallest doc_id that
is not null, and null if it has none; kept means doc_id and component_id are
equal, nulls included; equal rows get equal results; a very long text is read
whole and is one set (its hashes take eight bytes a word while a task compares
it); an empty table gives an empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, components, discarding, releasing, remove, scratch_path, scratch_table, small_batches, staged

WORDS = 5
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_534
SIMILAR, OF = 75, 100
KEEP_ESTIMATE = 0.6
#: Shares of equal registers that settle a pair without the estimate (which is within 0.02 of the share where sizes fit).
SURE_APART, SURE_NEAR = 0.45, 0.7
#: Groups of so many rows are compared by offset; larger ones as a matrix.
SMALL_GROUP = 16
#: Rows of a block. A pair of blocks of clusters is two such numbers of whole texts, held by one task.
BUCKET_BLOCK, CLUSTER_BLOCK = 1024, 256
REPRESENTATIVES = 4
CHUNK = 2048

_rng = np.random.default_rng(20_240_607)
FACTORS = _rng.integers(1, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
MASKS = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the set's shingles, sorted."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = _mix(h + w[i : len(w) - n + 1 + i] * _POWERS[i])
    return np.unique(_mix(h + np.uint64(n)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes, as unsigned 16-bit registers; all 0 for an empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    for at in range(0, len(short), CHUNK):
        h = short[at : at + CHUNK, None] * FACTORS
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= MASKS
        np.minimum(low, h.min(0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard estimates of sketch pairs (rows of a and b) of sets of known sizes.

    The likelihood of how many registers are greater, smaller and equal is
    concave in the similarity; a golden-section search finds its top.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    g = (np.sqrt(5) - 1) / 2
    lo, hi = np.zeros(len(top)), top.copy()
    x, y = hi - g * (hi - lo), lo + g * (hi - lo)
    fx, fy = fit(x), fit(y)
    for _ in range(30):
        left = fx > fy
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        fx, fy = fit(x), fit(y)
    return (lo + hi) / 2


SKETCHED = "doc_id long, text_hash long, n_shingles long, class_key binary, sketch binary"


def sketch_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_key, sketch): class_key is a 128-bit digest of the set, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, sketches = [], [], []
            for t in b.column(2):
                h = shingle_hashes(words_of(t.as_py()))
                n.append(len(h))
                keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sketches.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "n_shingles", "class_key", "sketch"])

    return _rows(docs).mapInArrow(releasing(run), SKETCHED)


def _rows(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by their first `keys` columns: a table of some groups and the rows at which
    they begin. Holds one batch and the group that runs on into the next."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        starts = _starts(t, keys)
        if starts[-1]:
            yield t.slice(0, int(starts[-1])), starts[:-1]
        held = t.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in range(keys):
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _spread(ids: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least id that each row reaches over links between left and right rows."""
    root = ids.copy() if root is None else root
    most = np.iinfo(np.int64).max
    while True:
        new = root.copy()
        new[left] = np.minimum(new[left], np.where(linked, root[right][None, :], most).min(1, initial=most))
        np.minimum.at(new, right, np.where(linked, new[left][:, None], most).min(0, initial=most))
        if (new == root).all():
            return root
        root = new


#: Sides of a row in a group: compared with all rows, or as the left or the right of a pair.
BOTH, LEFT, RIGHT = 0, 1, 2


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if side[0] == BOTH:
        return np.arange(len(side)), np.arange(len(side))
    return np.flatnonzero(side == LEFT), np.flatnonzero(side == RIGHT)


def may_link(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sizes and joint estimate leave similarity open, for pairs of sketches."""
    open_ = (np.minimum(na, nb) * OF >= SIMILAR * np.maximum(na, nb)) & ((sa == sb).mean(1) >= SURE_APART)
    at = np.flatnonzero(open_)
    open_[at] = estimate(sa[at], sb[at], na[at], nb[at]) >= KEEP_ESTIMATE
    return open_


def _candidate_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the pairs in each bucket's groups that may be similar."""
    for t, starts in _groups(batches, 3):
        ids, size, side = t.column("class").to_numpy(), t.column("n_shingles").to_numpy().astype(float), t.column("side").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        ends = np.append(starts[1:], t.num_rows)
        group = np.repeat(np.arange(len(starts)), ends - starts)
        small = ((ends - starts) <= SMALL_GROUP) & (side[starts] == BOTH)
        found_a, found_b = [], []
        for d in range(1, int((ends - starts)[small].max(initial=1))):
            r = np.flatnonzero((group[:-d] == group[d:]) & small[group[:-d]])
            r = r[may_link(sketch[r], sketch[r + d], size[r], size[r + d])]
            found_a.append(ids[r])
            found_b.append(ids[r + d])
        for g in np.flatnonzero(~small):
            rows = slice(starts[g], ends[g])
            left, right = _sides(side[rows])
            if len(left) and len(right):
                found_a.append(ids[rows])
                found_b.append(_large_group(ids[rows], size[rows], sketch[rows], left, right))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
        off = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[off]), pa.array(b[off])], ["a", "b"])


def _large_group(ids: np.ndarray, size: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    same = np.stack([(sketch[right] == sketch[r]).mean(1) for r in left])
    fits = np.minimum(size[left][:, None], size[right]) * OF >= SIMILAR * np.maximum(size[left][:, None], size[right])
    root = _spread(ids, left, right, fits & (same >= SURE_NEAR))
    x, y = np.nonzero(fits & (same >= SURE_APART) & (root[left][:, None] != root[right][None, :]))
    linked = np.zeros(same.shape, bool)
    for at in range(0, len(x), 100_000):  # what the share of equal registers leaves open, by the joint estimate
        u, v = x[at : at + 100_000], y[at : at + 100_000]
        linked[u, v] = estimate(sketch[left[u]], sketch[right[v]], size[left[u]], size[right[v]]) >= KEEP_ESTIMATE
    return _spread(ids, left, right, linked | (fits & (same >= SURE_NEAR)), root)


def _link_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the links in each cluster's groups, by intersections of full sets."""
    for t, starts in _groups(batches, 3):
        ids, texts, side = t.column("class").to_numpy(), t.column("text"), t.column("side").to_numpy()
        found_a, found_b = [], []
        for lo, hi in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
            left, right = _sides(side[lo:hi])
            if len(left) and len(right):
                linked = similar_sets([shingle_hashes(words_of(texts[int(r)].as_py())) for r in range(lo, hi)], left, right)
                found_a.append(ids[lo:hi])
                found_b.append(_spread(ids[lo:hi], left, right, linked))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
        off = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[off]), pa.array(b[off])], ["a", "b"])


def similar_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Boolean matrix: whether left and right sets have at least the wanted similarity. Hashes are numbered, and a row's
    intersections with all right sets are one look-up and one sum over these sets' numbers."""
    size = np.array([len(x) for x in sets])
    names, number = np.unique(np.concatenate(sets), return_inverse=True)
    upto = np.concatenate([[0], np.cumsum(size)])
    own = [number[upto[k] : upto[k + 1]] for k in range(len(sets))]
    flat = np.concatenate([own[k] for k in right])
    first = np.concatenate([[0], np.cumsum(size[right])])[:-1]
    have = np.zeros(len(names), np.int64)
    out = np.zeros((len(left), len(right)), bool)
    for row, k in enumerate(left):
        have[own[k]] = 1
        both = np.add.reduceat(have[flat], first)
        have[own[k]] = 0
        out[row] = OF * both >= SIMILAR * (size[k] + size[right] - both)
    return out


def forest(entries: DataFrame, groups: DataFrame, payload: DataFrame, key: str, block: int, find: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(a, b) long, staged: edges that join, of each group, just what the pairs that `find` accepts would join.

    entries: (key, class); groups: (key, members) of the groups to compare, staged;
    payload: (class, ...), a row for each class. find gets rows (key, i, j, side,
    class, ...) sorted by (key, i, j) and compares the sides of each (key, i, j).
    """
    of = groups.select(F.col(key).alias("g"), "members", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    large = of.where("blocks > 1")
    named = payload.withColumnRenamed("class", "c")
    own = lambda n: F.pmod(F.xxhash64("class", F.lit("block")), n).cast("int")
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def compared(rows: DataFrame, places: Column) -> DataFrame:
        more = [c for c in payload.columns if c != "class"]
        cut = rows.join(named, F.col("class") == F.col("c")).select(key, "class", *more, F.explode(places).alias("at"))
        cut = cut.select(key, "at.i", "at.j", "at.side", "class", *more).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
        return staged(cut.mapInArrow(releasing(find), "a long, b long").distinct(), "forest")[0]

    if large.isEmpty():
        return compared(entries.join(of, F.col(key) == F.col("g")), F.array(place(F.lit(0), F.lit(0), BOTH)))
    # The representatives are those with the least of several hashes, so that no group is sorted, and the least of a large
    # group are found in as many tasks as it has blocks.
    hashed = [F.struct(F.xxhash64("class", F.lit(k)).alias("h"), F.col("class")).alias(f"r{k}") for k in range(REPRESENTATIVES)]
    dealt = entries.join(large, F.col(key) == F.col("g")).select("g", own(F.col("blocks")).alias("b"), *hashed).repartition("g", "b")
    least = dealt.groupBy("g", "b").agg(*[F.min(f"r{k}").alias(f"r{k}") for k in range(REPRESENTATIVES)])
    chosen = least.groupBy("g").agg(F.array(*[F.min(f"r{k}")["class"] for k in range(REPRESENTATIVES)]).alias("reps"))
    of, _ = staged(of.join(chosen, "g", "left"), "groups")
    as_right = F.array(place(F.lit(0), own(F.col("blocks")), RIGHT))
    as_left = F.when(F.array_contains("reps", F.col("class")), F.transform(upto(F.col("blocks")), lambda j: place(F.lit(0), j, LEFT))).otherwise(none)
    first = F.when(F.col("blocks") == 1, F.array(place(F.lit(0), F.lit(0), BOTH))).otherwise(F.concat(as_right, as_left))
    edges = compared(entries.join(of, F.col(key) == F.col("g")), first)

    # What a large group's representatives and the other groups joined is one part.
    labels = components(edges)[0].withColumnRenamed("root", "found")
    parts = entries.join(large.select("g", "blocks"), F.col(key) == F.col("g")).join(labels, F.col("class") == F.col("node"), "left")
    parts, _ = staged(parts.select(key, "class", "blocks", F.coalesce("found", "class").alias("part")), "parts")
    sizes = parts.groupBy(key, "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy(F.col(key).alias("m")).agg(F.max(F.struct("n", "part"))["part"].alias("main"), (F.sum("n") - F.max("n")).alias("apart"))
    main, _ = staged(main.where("apart > 0").withColumn("strips", F.ceil(F.col("apart") / block).cast("int")), "apart")
    if main.isEmpty():
        return edges
    rest = parts.join(main, F.col(key) == F.col("m"))
    as_right = F.transform(upto(F.col("strips")), lambda i: place(i, own(F.col("blocks")), RIGHT))
    as_left = F.when(F.col("part") != F.col("main"), F.transform(upto(F.col("blocks")), lambda j: place(own(F.col("strips")), j, LEFT))).otherwise(none)
    return staged(edges.unionByName(compared(rest, F.concat(as_right, as_left))).distinct(), "forest")[0]


def link_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Components of the classes' similarity graph: (node, root) for each class linked with another.

    classes: (class, n_shingles, sketch, rep), staged; rep names a row of docs that has the set.
    """
    with discarding(classes.sparkSession):
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * 2 * ROWS + 1, 2 * ROWS)))
        entries = classes.select("class", F.explode(bands).alias("bucket"))
        busy, _ = staged(entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
        near = forest(entries, busy, classes.select("class", "n_shingles", "sketch"), "bucket", BUCKET_BLOCK, _candidate_forest)
        clusters = components(near)[0].withColumnRenamed("node", "class")
        sizes, _ = staged(clusters.groupBy("root").agg(F.count("*").alias("members")), "clusters")
        # Each cluster's texts are found once; the corpus is shuffled for them once.
        needed = clusters.join(classes.select(F.col("class").alias("c"), "rep"), F.col("class") == F.col("c"))
        rows = _rows(docs).join(needed, F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash")))
        texts, _ = staged(rows.select("class", "text").dropDuplicates(["class"]), "texts")
        links = forest(clusters, sizes, texts, "root", CLUSTER_BLOCK, _link_forest)
        labels = components(links)[0]
        path = scratch_path(classes.sparkSession, "components")
        labels.write.parquet(path)
    return scratch_table(classes.sparkSession, path)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, class), class null without words, and (class, root, component_id) of every class; both staged."""
    sketched, sketched_path = staged(sketch_documents(docs), "sketches")
    # A class is a set; its number comes from the set's digest, its representative text from any row that has it.
    by_key = sketched.where("class_key is not null").groupBy("class_key").agg(
        F.min("doc_id").alias("first_id"),
        F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"),
    )
    classes, classes_path = staged(by_key.withColumn("class", F.xxhash64("class_key")), "classes")
    if classes.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").head():
        raise RuntimeError("two sets share a 64-bit class number")
    number = F.when(F.col("class_key").isNotNull(), F.xxhash64("class_key")).alias("class")
    rows, _ = staged(sketched.select("doc_id", "text_hash", "n_shingles", number), "rows")
    labels = link_classes(classes, docs)
    ids = classes.select("class", "first_id")
    linked = labels.join(ids.withColumnRenamed("class", "node"), "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Staged, so that both sides of the join on the root are plain shuffles, which Spark can split where a root is frequent.
    smallest, smallest_path = staged(linked, "smallest")
    named = labels.join(smallest, "root").select("node", "root", "component_id")
    alone = F.col("node").isNull()
    both = ids.join(named, F.col("class") == F.col("node"), "left")
    of_class, _ = staged(both.select("class", F.coalesce("root", "class").alias("root"), F.when(alone, F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")), "class-components")
    remove(docs.sparkSession, sketched_path, classes_path, smallest_path)
    return rows, of_class


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    rows, of_class = _grouped(docs)
    out = rows.join(of_class.select("class", "component_id"), "class", "left")
    component = F.when(F.col("class").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component (the smallest doc_id, null last) and all rows without words.

    Of rows that are equal in doc_id and text the one stays whose other columns have
    the smallest hash (maps and variants aside), so reruns agree. Null and blank texts are without words and
    stay, every row; an empty table gives no rows; columns keep their names.
    """
    rows, of_class = _grouped(docs)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_hash"))
    stay = rows.join(of_class, "class").groupBy("root").agg(F.min(place).alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    row = F.struct(*docs.columns).alias("row")
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("words"), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]).alias("rank"), row)
    kept = keyed.where("words").join(stay, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")), "left_semi")
    one = kept.groupBy("id", "hash").agg(F.min_by("row", "rank").alias("row"))
    return one.select("row").unionByName(keyed.where("not words").select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
