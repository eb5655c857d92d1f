"""A corpus store over Parquet: upsert, delete, export, statistics. Tables are partitioned by scope and collection.

A partition is a row of numbered versions, each a folder that never changes. A
base holds a partition's rows; a delta after it holds rows that were added or take
the place of those with their key. An upsert writes one delta, however large the
partition; a reader takes the last base and merges the deltas after it, the latest
row of a key winning. After MAX_DELTAS deltas, and for every deletion, a new base is
written. A version is written aside and then renamed to its number, in one step:
a writer that dies before leaves a draft that nobody reads, and one that dies after
leaves older versions that nobody reads, until the next base clears them away. Two
writers of one partition cannot both take a number: the second one fails. Reads go
through one place, which always binds the scope.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import sha256_hex
from lodestone.functions.vectors import METRICS, dequantize, quantize

COLLECTION = "scope_id string, collection_id string, name string, embedding_model_id string, embedding_version string, dimensions int, distance_metric string, created_at long"
DOCUMENT = "scope_id string, collection_id string, document_id string, name string, mime_type string, size_bytes long, checksum string, created_at long"
CHUNK = "scope_id string, collection_id string, chunk_id string, document_id string, seq int, content string, token_count int, metadata map<string,string>"
VECTOR = "scope_id string, collection_id string, chunk_id string, document_id string, dimensions int, qv struct<q:array<tinyint>,scale:double,norm:double>"
JOB = "scope_id string, collection_id string, document_id string, status string, done int, total int, payload string, updated_at long"
MESSAGE = "scope_id string, collection_id string, session_id string, turn long, role string, content string"
SCHEMAS = {"collections": COLLECTION, "documents": DOCUMENT, "chunks": CHUNK, "vectors": VECTOR, "jobs": JOB, "messages": MESSAGE}
KEYS = {"collections": ["collection_id"], "documents": ["document_id"], "chunks": ["chunk_id"], "vectors": ["chunk_id"], "jobs": ["document_id"], "messages": ["session_id", "turn"]}
PART = ["scope_id", "collection_id"]
#: Bytes of a quantized vector beside its components: scale and norm.
VECTOR_OVERHEAD = 8


#: Deltas that a partition may have before they are merged into a new base.
MAX_DELTAS = 16


def keep_any(df: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key."""
    return df.dropDuplicates(key)


def keep_latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of greatest version for each key."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.col(version).desc()))
    return df.withColumn("__r", rank).where("__r = 1").drop("__r")


class UnknownCollectionError(ValueError):
    pass


class CorpusStore:
    """A store in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _versions(self, name: str, scope: str | None = None, collection: str | None = None) -> dict[str, list[tuple[int, str]]]:
        """Of each partition its live versions, (number, kind): the last base and the deltas after it."""
        one = lambda v: "*" if v is None else _escape(self.spark, v)
        found: dict[str, list[tuple[int, str]]] = {}
        for s in self._fs().globStatus(self._path(f"{name}/scope_id={one(scope)}/collection_id={one(collection)}/version=*")) or []:
            number, kind = s.getPath().getName().removeprefix("version=").split("-")
            part = s.getPath().getParent()
            found.setdefault(f"{part.getParent().getName()}/{part.getName()}", []).append((int(number), kind))
        base = {part: max((n for n, kind in of if kind == "base"), default=-1) for part, of in found.items()}
        return {part: sorted(v for v in of if v[0] >= base[part]) for part, of in found.items()}

    def read(self, name: str, scope: str | None, collection: str | None = None, where: Column | None = None) -> DataFrame:
        """A scope's rows of a table. Partitions without deltas are read as they are; in the others the last row of a key counts."""
        plain, mixed = [], []
        for part, versions in self._versions(name, scope, collection).items():
            (plain if len(versions) == 1 else mixed).extend(f"{self.root}/{name}/{part}/version={n:010}-{kind}" for n, kind in versions)
        df = self.spark.createDataFrame([], SCHEMAS[name])
        if plain:
            df = self._load(name, plain).drop("version")
        if mixed:
            merged = keep_latest(self._load(name, mixed), PART + KEYS[name], "version").drop("version")
            df = df.unionByName(merged) if plain else merged
        return df if where is None else df.where(where)

    def _load(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name] + ", version string").option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _write(self, name: str, rows: DataFrame, scope: str, collection: str, kind: str) -> None:
        """rows as the next version of a partition; a base clears the versions before it away."""
        part = f"{name}/scope_id={_escape(self.spark, scope)}/collection_id={_escape(self.spark, collection)}"
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema.fields if f.name not in PART]
        draft, fs = f".draft-{uuid.uuid4().hex}", self._fs()
        rows.select(*names).write.parquet(f"{self.root}/{draft}")
        there = fs.listStatus(self._path(part)) if fs.exists(self._path(part)) else []
        number = max((int(s.getPath().getName().removeprefix("version=").split("-")[0]) for s in there), default=-1) + 1
        fs.mkdirs(self._path(part))
        place = self._path(f"{part}/version={number:010}-{kind}")
        if fs.exists(place) or not fs.rename(self._path(draft), place):
            fs.delete(self._path(draft), True)
            raise OSError(f"version {number} of {part} is taken")
        if kind == "base":
            for s in there:
                fs.delete(s.getPath(), True)

    def _merge(self, name: str, rows: DataFrame, scope: str, collection: str) -> None:
        self._write(name, keep_any(rows, KEYS[name]), scope, collection, "delta")
        if any(len(v) > MAX_DELTAS for v in self._versions(name, scope, collection).values()):
            self.compact(name, scope, collection)

    def compact(self, name: str, scope: str, collection: str) -> None:
        """The partition's rows as a new base."""
        self._write(name, self.read(name, scope, collection), scope, collection, "base")

    def _remove(self, name: str, scope: str, collection: str, gone: Column | DataFrame) -> int:
        """Rewrites a partition without some rows, so that no file keeps them; their number. gone: a predicate, or a table
        of values of its one column."""
        rows = self.read(name, scope, collection)
        is_table = isinstance(gone, DataFrame)
        n = (rows.join(gone, gone.columns[0], "left_semi") if is_table else rows.where(gone)).count()
        if n:
            self._write(name, rows.join(gone, gone.columns[0], "left_anti") if is_table else rows.where(~F.coalesce(gone, F.lit(False))), scope, collection, "base")
        return n

    # Collections

    def create_collection(self, scope: str, collection: str, dimensions: int, metric: str = "COSINE", name: str | None = None, model: str = "", version: str = "1", now: int = 0) -> DataFrame:
        """The collection, made if it is not there; an existing one stays as it is."""
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        if self.read("collections", scope, collection).isEmpty():
            row = [(scope, collection, name or collection, model, version, dimensions, metric, now)]
            self._merge("collections", self.spark.createDataFrame(row, COLLECTION), scope, collection)
        return self.read("collections", scope, collection)

    def upsert(self, scope: str, collection: str, chunks: DataFrame, documents: DataFrame | None = None) -> None:
        """Chunks (chunk_id, document_id, seq, content, token_count, metadata, vector), new or in the place of old ones with
        their ids. One vector of a wrong length rejects the batch."""
        found = self.read("collections", scope, collection).first()
        if found is None:
            raise UnknownCollectionError(collection)
        # Written once, so that whatever made the chunks and their vectors runs once; read from there by all that follows.
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        try:
            chunks.select("chunk_id", "document_id", "seq", "content", "token_count", "metadata", F.size("vector").alias("dimensions"), quantize(F.col("vector")).alias("qv")).write.parquet(draft)
            rows = self.spark.read.parquet(draft)
            if rows.where(F.coalesce("dimensions", F.lit(-1)) != found["dimensions"]).head():
                raise ValueError(f"a vector has not {found['dimensions']} dimensions")
            self._merge("vectors", rows, scope, collection)
            self._merge("chunks", rows, scope, collection)
            if documents is not None:
                self._merge("documents", documents, scope, collection)
        finally:
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(draft), True)

    def new_documents(self, scope: str, collection: str, documents: DataFrame, content: str = "content") -> DataFrame:
        """Documents whose content is not in the collection yet, each content once; adds checksum."""
        hashed = documents.withColumn("checksum", sha256_hex(F.col(content)))
        fresh = hashed.join(self.read("documents", scope, collection).select("checksum"), "checksum", "left_anti")
        return fresh.withColumn("__r", F.row_number().over(W.partitionBy("checksum").orderBy("document_id"))).where("__r = 1").drop("__r")

    def delete_documents(self, scope: str, collection: str, gone: Column | DataFrame) -> dict[str, int]:
        """The documents of a collection that a predicate on document_id, or a table (document_id), names, with their
        chunks, vectors and jobs: the numbers of rows that went, by table. The collection stays."""
        return {name: self._remove(name, scope, collection, gone) for name in ("vectors", "chunks", "documents", "jobs")}

    def delete_document(self, scope: str, collection: str, document_id: str) -> dict[str, int]:
        return self.delete_documents(scope, collection, F.col("document_id") == document_id)

    def shred_collection(self, scope: str, collection: str) -> None:
        """All partitions of a collection; with its wrapped key gone too, copies elsewhere stay unreadable."""
        for name in SCHEMAS:
            self._fs().delete(self._path(f"{name}/scope_id={_escape(self.spark, scope)}/collection_id={_escape(self.spark, collection)}"), True)

    def clear_scope(self, scope: str) -> None:
        for name in SCHEMAS:
            self._fs().delete(self._path(f"{name}/scope_id={_escape(self.spark, scope)}"), True)

    # Jobs and messages

    def save_checkpoint(self, scope: str, collection: str, document_id: str, stage: str, done: int, total: int, payload: str | None = None, now: int = 0) -> None:
        self._merge("jobs", self.spark.createDataFrame([(scope, collection, document_id, stage, done, total, payload, now)], JOB), scope, collection)

    def save_checkpoints(self, scope: str, collection: str, jobs: DataFrame, now: int = 0) -> None:
        """Checkpoints (document_id, status, done, total) of many documents at once."""
        self._merge("jobs", jobs.select("document_id", "status", "done", "total", F.lit(None).cast("string").alias("payload"), F.lit(now).cast("long").alias("updated_at")), scope, collection)

    def checkpoint(self, scope: str, collection: str, document_id: str) -> DataFrame:
        return self.read("jobs", scope, collection, F.col("document_id") == document_id)

    def clear_checkpoint(self, scope: str, collection: str, document_id: str) -> None:
        self._remove("jobs", scope, collection, F.col("document_id") == document_id)

    def add_messages(self, scope: str, workspace: str, messages: DataFrame) -> None:
        self._merge("messages", messages, scope, workspace)

    def messages(self, scope: str, workspace: str, session: str) -> DataFrame:
        return self.read("messages", scope, workspace, F.col("session_id") == session).orderBy("turn")

    def clear_messages(self, scope: str, workspace: str, session: str) -> None:
        self._remove("messages", scope, workspace, F.col("session_id") == session)

    # Reports

    def stats(self, scope: str, collection: str | None = None) -> DataFrame:
        return collection_stats(self.read("chunks", scope, collection), self.read("vectors", scope, collection))

    def export(self, scope: str, collection: str) -> DataFrame:
        return export_chunks(self.read("chunks", scope, collection), self.read("vectors", scope, collection))

    def export_user_data(self, scope: str, audit: DataFrame | None = None) -> DataFrame:
        """One JSON text of a scope's counts."""
        count = lambda df: df.agg(F.count("*").alias("n"))
        c, d = count(self.read("collections", scope)), count(self.read("documents", scope))
        a = count(audit.where(F.col("scope_id") == scope)) if audit is not None else self.spark.createDataFrame([(0,)], "n long")
        joined = c.withColumnRenamed("n", "collections").crossJoin(d.withColumnRenamed("n", "documents")).crossJoin(a.withColumnRenamed("n", "audit_events"))
        return joined.select(F.to_json(F.struct("collections", "documents", "audit_events")).alias("json"))

    def reembed(self, scope: str, collection: str, embed, dimensions: int) -> None:  # noqa: ANN001
        """New vectors for all chunks of a collection. embed: content column to vector column."""
        old = self.read("collections", scope, collection).drop("dimensions").withColumn("dimensions", F.lit(dimensions))
        self._write("collections", old, scope, collection, "base")
        self.upsert(scope, collection, self.read("chunks", scope, collection).withColumn("vector", embed(F.col("content"))))

    # Documents and data subjects

    def list_documents(self, scope: str, collection: str | None = None) -> DataFrame:
        """(document_id, collection_id, name, mime_type, size_bytes, created_at)."""
        return self.read("documents", scope, collection).select("document_id", "collection_id", "name", "mime_type", "size_bytes", "created_at")

    def status(self, scope: str, collection: str | None = None) -> DataFrame:
        """(document_id, stage, done, total, progress) of the documents with a checkpoint; progress 0 without a total."""
        share = F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0)
        return self.read("jobs", scope, collection).select("document_id", F.col("status").alias("stage"), "done", "total", share.alias("progress"))

    def reindex(self, scope: str, collection: str, index, embed=None) -> DataFrame:  # noqa: ANN001
        """Builds a collection's text index (lexical.TextIndex) and, with `embed`, its vectors anew from its chunks; one row
        (total, completed, failed, fraction) when done."""
        if embed is not None:
            self.reembed(scope, collection, embed, self.read("collections", scope, collection).first()["dimensions"])
        index.rebuild(self.read("chunks", scope, collection))
        documents = self.read("chunks", scope, collection).select("document_id").distinct()
        return ingestion_rollup(documents.select(F.lit("DONE").alias("status")))

    def export_subject(self, scope: str, user: str, owners: DataFrame, consents: DataFrame) -> DataFrame:
        """One JSON text of all that is held on a user: documents, messages of the sessions and consents that are theirs.
        owners: (user_id, kind, id), kind document or session; consents: (user_id, ...)."""
        mine = owners.where(F.col("user_id") == user)
        ids = lambda kind: mine.where(F.col("kind") == kind).select("id")
        docs = self.list_documents(scope).join(ids("document"), F.col("document_id") == F.col("id"), "left_semi")
        said = self.read("messages", scope).join(ids("session"), F.col("session_id") == F.col("id"), "left_semi")
        listed = lambda df, name, *by: df.agg(F.array_sort(F.collect_list(F.struct(*by, *[c for c in df.columns if c not in by]))).alias(name))
        parts = [listed(docs, "documents", "document_id"), listed(said.select("session_id", "turn", "role", "content"), "messages", "session_id", "turn"), listed(consents.where(F.col("user_id") == user), "consents", *[c for c in consents.columns if c != "user_id"])]
        return reduce(DataFrame.crossJoin, parts).select(F.to_json(F.struct(F.lit(user).alias("user_id"), "documents", "messages", "consents")).alias("json"))

    def erase_subject(self, scope: str, user: str, owners: DataFrame, request_id: str, ts_ms: int) -> DataFrame:
        """Deletes a user's documents (with chunks, vectors and jobs) and messages in every collection of the scope; the
        receipt (request_id, user_id, documents, chunks, ts_ms, proof)."""
        from lodestone.operators.governance import deletion_proof

        mine = owners.where(F.col("user_id") == user)
        ids = lambda kind, name: mine.where(F.col("kind") == kind).select(F.col("id").alias(name)).distinct()
        gone = {"documents": 0, "chunks": 0}
        for name, kind, column in (("documents", "document", "document_id"), ("messages", "session", "session_id")):
            for part in self._versions(name, scope):
                collection = _unescape(self.spark, part.partition("/collection_id=")[2])
                if name == "documents":
                    for k, n in self.delete_documents(scope, collection, ids(kind, column)).items():
                        gone[k] = gone.get(k, 0) + n
                else:
                    self._remove(name, scope, collection, ids(kind, column))
        row = self.spark.createDataFrame([(request_id, user, gone["documents"], gone["chunks"], ts_ms)], "request_id string, user_id string, documents long, chunks long, ts_ms long")
        return row.withColumn("proof", deletion_proof(F.col("request_id"), F.col("user_id"), F.col("documents") + F.col("chunks"), F.col("ts_ms")))


def _unescape(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)


def _escape(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def collection_stats(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(scope_id, collection_id, chunks, documents, vector_bytes)."""
    c = chunks.groupBy(*PART).agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))
    v = vectors.groupBy(*PART).agg(F.sum(F.col("dimensions") + VECTOR_OVERHEAD).alias("vector_bytes"))
    return c.join(v, PART, "left").withColumn("vector_bytes", F.coalesce("vector_bytes", F.lit(0)))


def export_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors in full; an empty vector where there is none."""
    v = vectors.select(*PART, "chunk_id", dequantize(F.col("qv")).alias("vector"))
    return chunks.join(v, [*PART, "chunk_id"], "left").withColumn("vector", F.coalesce("vector", F.array().cast("array<double>")))


def parse_status(status: Column) -> Column:
    """STAGE:done:total as a struct."""
    return F.struct(F.split_part(status, F.lit(":"), F.lit(1)).alias("stage"), F.split_part(status, F.lit(":"), F.lit(2)).try_cast("int").alias("done"), F.split_part(status, F.lit(":"), F.lit(3)).try_cast("int").alias("total"))


def ingestion_rollup(jobs: DataFrame) -> DataFrame:
    """(total, completed, failed, fraction)."""
    done, failed = F.count(F.when(F.col("status") == "DONE", 1)), F.count(F.when(F.col("status") == "FAILED", 1))
    return jobs.agg(F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), F.coalesce(done / F.count("*"), F.lit(0.0)).alias("fraction"))


def compatible_models(catalog: DataFrame, ram: int, os_version: int, abis: list[str]) -> DataFrame:
    """Models that a device can run."""
    abi = (F.size("supported_abis") == 0) | F.arrays_overlap("supported_abis", F.array(*[F.lit(a) for a in abis]))
    return catalog.where((F.col("min_os_version") <= os_version) & (F.col("min_ram_bytes") <= ram) & abi)


def parse_model_catalog(files: DataFrame, text: str = "json") -> DataFrame:
    """Models of catalogue JSON with defaults: version 1, licence Unknown, no memory need, OS version 26."""
    model = "array<struct<id:string,version:int,sizeBytes:bigint,sha256:string,signature:string,license:string,minRamBytes:bigint,minOsVersion:int,supportedAbis:array<string>>>"
    m = files.select(F.explode(F.from_json(F.col(text), f"struct<models:{model}>")["models"]).alias("m"))
    return m.select(
        "m.id", F.coalesce("m.version", F.lit(1)).alias("version"), F.col("m.sizeBytes").alias("size_bytes"), "m.sha256", "m.signature", F.coalesce("m.license", F.lit("Unknown")).alias("license"),
        F.coalesce("m.minRamBytes", F.lit(0)).alias("min_ram_bytes"), F.coalesce("m.minOsVersion", F.lit(26)).alias("min_os_version"), F.coalesce("m.supportedAbis", F.array().cast("array<string>")).alias("supported_abis"),
    )


def stale_models(installed: DataFrame) -> DataFrame:
    """Installed versions that are neither active nor pinned."""
    return installed.where(~F.col("active") & ~F.col("pinned"))


# Where three kinds of provider put text, usage and end in a streamed event.
EVENTS = {
    "gemini": ("struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>,usageMetadata:struct<totalTokenCount:int>>", "e.candidates[0].content.parts[0].text", "e.candidates[0].finishReason", "e.usageMetadata.totalTokenCount"),
    "openai": ("struct<choices:array<struct<delta:struct<content:string>,finish_reason:string>>,usage:struct<total_tokens:int>>", "e.choices[0].delta.content", "e.choices[0].finish_reason", "e.usage.total_tokens"),
    "anthropic": ("struct<type:string,delta:struct<text:string,stop_reason:string>,usage:struct<output_tokens:int>>", "e.delta.text", "e.delta.stop_reason", "e.usage.output_tokens"),
}


def decode_events(lines: DataFrame, kind: str) -> DataFrame:
    """(message_id, seq, kind, text, finish, usage) from recorded server-sent event lines (message_id, seq, line).
    [DONE] ends a message; lines that are not JSON are skipped."""
    schema, text, finish, usage = EVENTS[kind]
    data = F.trim(F.regexp_replace("line", r"^data:\s*", ""))
    rows = lines.where(F.col("line").startswith("data:")).select("message_id", "seq", data.alias("d"), F.from_json(data, schema).alias("e"))
    is_json = F.expr("try_parse_json(d)").isNotNull()
    out = rows.where((F.col("d") == "[DONE]") | is_json)
    done = F.col("d") == "[DONE]"
    return out.select("message_id", "seq", F.when(done, "done").otherwise("token").alias("kind"), F.when(~done, F.expr(text)).alias("text"), F.when(~done, F.expr(finish)).alias("finish"), F.when(~done, F.expr(usage)).alias("usage"))
