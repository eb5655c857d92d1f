"""Registered queries that run the store, the kept index, ingestion and the prompt-side operators on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text, vectors
from lodestone.operators import context, evaluation, governance, lexical, search, store
from lodestone.plans.queries import BM25_SQL, FIXED_SQL, QUANT_SQL, query, r6
from lodestone.session import shared_dir, table
from lodestone.streaming import ingest


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """documents with string ids, a collection by language and one chunk each."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit(0).alias("seq"), F.coalesce("text", F.lit("")).alias("content"),
        text.quarter_tokens(F.coalesce("text", F.lit(""))).alias("token_count"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"), F.array(F.col("n_chars").cast("double"), F.lit(0.0)).alias("vector"),
        F.col("lang").alias("collection"), F.col("doc_id").cast("string").alias("name"), F.lit("text/plain").alias("mime_type"), F.col("n_chars").cast("long").alias("size_bytes"), text.sha256_hex(F.col("text")).alias("checksum"), F.col("doc_id").cast("long").alias("created_at"),
    )


LANGUAGES = ("de", "en", "es", "fr")


def _store(spark: SparkSession, d: str, scope: str = "s") -> store.CorpusStore:
    """A store with all documents, in a collection for each language."""
    s = store.CorpusStore(spark, _folder(spark, "store"))
    docs = _docs(spark, d)
    for c in LANGUAGES:
        mine = docs.where(F.col("collection") == c)
        s.create_collection(scope, c, 2)
        s.upsert(scope, c, mine, mine)
    return s


@query("""SELECT lang AS collection_id, 'c' || doc_id AS chunk_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h, round(CASE WHEN doc_id % 3 = 0 THEN 7 ELSE n_chars END, 3)::DOUBLE AS v FROM documents""")
def b1_store_upsert(spark, d):  # noqa: ANN001, ANN201
    s = _store(spark, d)
    for c in LANGUAGES:
        again = _docs(spark, d).where((F.col("collection") == c) & (F.col("created_at") % 3 == 0))
        s.upsert("s", c, again.withColumns({"content": F.concat("content", F.lit("!")), "vector": F.array(F.lit(7.0), F.lit(0.0))}))
    return s.export("s", None).select("collection_id", "chunk_id", F.md5(F.col("content").cast("binary")).alias("h"), F.round(F.col("vector")[0], 3).alias("v"))


@query("""SELECT d.doc_id, d.lang, 1::BIGINT AS chunks, 1::BIGINT AS vectors FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def b4_delete_cascade(spark, d):  # noqa: ANN001, ANN201
    s = _store(spark, d)
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    for c in LANGUAGES:
        s.delete_documents("s", c, gone)
    chunks = s.read("chunks", "s").groupBy("document_id").agg(F.count("*").alias("chunks"))
    held = s.read("vectors", "s").groupBy("document_id").agg(F.count("*").alias("vectors"))
    docs = s.list_documents("s").join(chunks, "document_id", "full_outer").join(held, "document_id", "full_outer")
    return docs.select(F.col("document_id").cast("long").alias("doc_id"), F.col("collection_id").alias("lang"), "chunks", "vectors")


@query("""SELECT lang AS collection, count(*) AS chunks, count(DISTINCT doc_id) AS documents, (10 * count(*))::BIGINT AS vector_bytes FROM documents WHERE lang <> 'fr' GROUP BY lang""")
def b5_shred_collection(spark, d):  # noqa: ANN001, ANN201
    s = _store(spark, d)
    s.shred_collection("s", "fr")
    return s.stats("s").select(F.col("collection_id").alias("collection"), "chunks", "documents", "vector_bytes")


@query("SELECT role, count(*) AS n FROM conversations WHERE conv_id % 2 = 1 GROUP BY role")
def b6_clear_scope(spark, d):  # noqa: ANN001, ANN201
    s = store.CorpusStore(spark, _folder(spark, "store"))
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"), "conv_id")
    for scope, odd in (("even", 0), ("odd", 1)):
        s.add_messages(scope, "w", c.where(F.col("conv_id") % 2 == odd))
    s.clear_scope("even")
    return s.read("messages", None).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT min(doc_id::VARCHAR) AS document_id, sha256(text) AS checksum FROM documents o WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 2 = 0 AND s.text = o.text) GROUP BY text")
def b7_new_documents(spark, d):  # noqa: ANN001, ANN201
    s = store.CorpusStore(spark, _folder(spark, "store"))
    docs = _docs(spark, d)
    even = docs.where(F.col("created_at") % 2 == 0)
    s.create_collection("s", "c", 2)
    s.upsert("s", "c", even, even)
    return s.new_documents("s", "c", docs.select("document_id", "content")).select("document_id", "checksum")


@query("SELECT '{\"collections\":4,\"documents\":' || count(*) || ',\"audit_events\":' || (SELECT count(*) FROM events WHERE event_type = 'click') || '}' AS json FROM documents")
def b10_export_user_data(spark, d):  # noqa: ANN001, ANN201
    audit = table(spark, d, "events").select(F.when(F.col("event_type") == "click", "s").otherwise("t").alias("scope_id"))
    return _store(spark, d).export_user_data("s", audit)


@query("SELECT conv_id, turn, role, text || CASE WHEN turn % 2 = 0 THEN '!' ELSE '' END AS content FROM conversations WHERE conv_id % 7 <> 0")
def b13_messages(spark, d):  # noqa: ANN001, ANN201
    """Messages written, half of them written again, and the sessions of one workspace cleared."""
    s = store.CorpusStore(spark, _folder(spark, "store"))
    c = table(spark, d, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"))
    for workspace, mine in (("w", F.col("conv_id") % 7 != 0), ("gone", F.col("conv_id") % 7 == 0)):
        s.add_messages("s", workspace, c.where(mine))
    s.add_messages("s", "w", c.where("conv_id % 7 <> 0 AND turn % 2 = 0").withColumn("content", F.concat("content", F.lit("!"))))
    s.shred_collection("s", "gone")
    return s.read("messages", "s").select(F.col("session_id").cast("long").alias("conv_id"), "turn", "role", "content")


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def a12_key_scan(spark, d):  # noqa: ANN001, ANN201
    s = store.CorpusStore(spark, _folder(spark, "store"))
    s.add_messages("s", "w", table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content")))
    mine = s.read("messages", "s", "w", F.col("role") == "user")
    return mine.groupBy(F.col("session_id").cast("long").alias("conv_id")).agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"))


@query("SELECT doc_id, name, lang AS collection, n_chars AS size_bytes, CASE WHEN doc_id % 10 = 0 THEN 'EMBEDDING' END AS stage, CASE WHEN doc_id % 10 = 0 THEN (doc_id % 100) / 200.0::DOUBLE END AS progress FROM (SELECT *, doc_id::VARCHAR AS name FROM documents)")
def b14_documents_and_status(spark, d):  # noqa: ANN001, ANN201
    s = _store(spark, d)
    for c in LANGUAGES:
        at = _docs(spark, d).where((F.col("collection") == c) & (F.col("created_at") % 10 == 0))
        s.save_checkpoints("s", c, at.select("document_id", F.lit("EMBEDDING").alias("status"), (F.col("created_at") % 100).cast("int").alias("done"), F.lit(200).alias("total")))
    j = s.list_documents("s").join(s.status("s"), "document_id", "left")
    return j.select(F.col("document_id").cast("long").alias("doc_id"), "name", F.col("collection_id").alias("collection"), "size_bytes", "stage", "progress")


@query("SELECT 'c' || doc_id AS chunk_id, length(text)::DOUBLE AS v FROM documents WHERE lang = 'en'")
def b15_reembed(spark, d):  # noqa: ANN001, ANN201
    s = _store(spark, d)
    s.reembed("s", "en", lambda c: F.array(F.length(c).cast("double")), 1)
    return s.export("s", "en").select("chunk_id", F.round(F.col("vector")[0], 3).alias("v"))


@query(BM25_SQL.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))", 1).replace("doc_id AS chunk_id, sum(", "doc_id::VARCHAR AS chunk_id, sum(") + "SELECT * FROM r WHERE rank <= 10")
def b3_text_index(spark, d):  # noqa: ANN001, ANN201
    """The kept index: all documents in two updates, a third that deletes some, and a search over what is left."""
    index = lexical.TextIndex(spark, _folder(spark, "index"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    index.update(docs.where("chunk_id % 2 = 0"))
    index.update(docs.where("chunk_id % 2 = 1"))
    index.update(None, table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search(q, 10).select("query_id", "chunk_id", r6("score").alias("score"), "rank")


@query(FIXED_SQL + ", first AS (SELECT min(doc_id::VARCHAR) AS document_id, sha256(text) AS checksum FROM documents GROUP BY text) SELECT f.document_id, f.checksum, count(*) AS chunks FROM first f JOIN chunks c ON c.doc_id::VARCHAR = f.document_id GROUP BY ALL")
def p1_stream_ingestion(spark, d):  # noqa: ANN001, ANN201
    """The streaming ingestion over the documents' file, and again over nothing new."""
    s = store.CorpusStore(spark, _folder(spark, "store"))
    s.create_collection("s", "c", 1)
    place, schema = _folder(spark, "stream"), "doc_id long, text string"
    table(spark, d, "documents").select("doc_id", "text").repartition(3, "doc_id").write.parquet(f"{place}/in")
    for _ in range(2):
        ingest.start_ingestion(spark, f"{place}/in", schema, s, "s", "c", lambda c: F.array(F.length(c).cast("double")), f"{place}/checkpoint").awaitTermination()
    chunks = s.read("chunks", "s").groupBy("document_id").agg(F.count("*").alias("chunks"))
    return s.read("documents", "s").join(chunks, "document_id").select("document_id", "checksum", "chunks")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, sum(greatest(floor(value)::BIGINT, 0))::BIGINT AS tokens, sum(greatest(floor(value)::BIGINT, 0)) > 1000 AS over_limit FROM events GROUP BY 1")
def p5_stream_quota(spark, d):  # noqa: ANN001, ANN201
    place = _folder(spark, "stream")
    table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("tokens")).write.parquet(f"{place}/in")
    days = ingest.daily_quota(spark.readStream.schema("ts timestamp, tokens long").parquet(f"{place}/in"), 1000, late="1000 days")
    return _finished(spark, days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tokens", "over_limit"), place, ["day"])


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id")
def p7_stream_latest(spark, d):  # noqa: ANN001, ANN201
    place = _folder(spark, "stream")
    table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(f"{place}/in")
    last = ingest.latest_value(spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(f"{place}/in"), ["user_id"], "event_type")
    return _finished(spark, last.select("user_id", "event_type"), place, ["user_id"])


def _finished(spark: SparkSession, stream: DataFrame, place: str, key: list[str]) -> DataFrame:
    """What a stream in update mode leaves: the last row of each key over its batches."""

    def batch(df: DataFrame, n: int) -> None:
        df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{place}/out/{n}")

    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").schema(f"{stream._jdf.schema().toDDL()}, batch int").parquet(f"{place}/out")
    return store.keep_latest(rows, key, "batch").drop("batch")


# Retrieval


#: Both legs' tables side by side.
HYBRID_SQL = BM25_SQL.rstrip().replace("q AS (SELECT item_id", "bq AS (SELECT item_id").replace("FROM q JOIN", "FROM bq JOIN").replace("r AS (SELECT query_id", "tr AS (SELECT query_id") + "," + QUANT_SQL.strip().removeprefix("WITH")


@query(HYBRID_SQL + """,
vs AS (SELECT b.item_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(a.q, c.q) * a.scale * c.scale / (a.n * c.n), 6) AS score FROM benchmark b JOIN q a ON a.vec_id = b.item_id JOIN q c ON c.vec_id IN (SELECT doc_id FROM documents)),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 20),
f AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + t.rank), 0) AS score, v.rank AS vr, t.rank AS tr FROM vr v FULL OUTER JOIN (SELECT * FROM tr WHERE rank <= 20) t USING (query_id, chunk_id))
SELECT query_id, chunk_id, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vr NULLS LAST, tr NULLS LAST, chunk_id)::INT AS rank FROM f QUALIFY rank <= 10""")
def h4_hybrid_search(spark, d):  # noqa: ANN001, ANN201
    """Documents as chunks with the vectors of their numbers; an item asks by its text and the vector of its number."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    q = table(spark, d, "benchmark").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id", "left")
    return search.hybrid_search(chunks, vecs, q.select(F.col("item_id").alias("query_id"), "text", "vector"), 10).select("query_id", "chunk_id", r6("score").alias("score"), "rank")


# Prompts and answers


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Three documents as each item's results."""
    j = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), "n_chars")
    j = j.withColumn("doc_id", (F.col("query_id") * 3 + F.col("i")) % 100).join(docs, "doc_id")
    return j.select("query_id", F.concat(F.lit("c_"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), "content", F.create_map(F.lit("page_start"), F.col("i").cast("string"), F.when(F.col("i") == 1, "page").otherwise("other"), F.lit("7")).alias("metadata"), (F.lit(1.0) - F.col("i") / 10).alias("score"), (F.col("i") + 1).alias("rank"), "doc_id", (F.col("n_chars") % 500).cast("int").alias("token_count"), F.col("i").alias("seq"))


RESULTS_SQL = "WITH j AS (SELECT item_id AS query_id, i, (item_id * 3 + i) % 100 AS doc_id FROM benchmark, range(0, 3) t(i)), r AS (SELECT query_id, i, 'c_' || j.doc_id AS chunk_id, j.doc_id::VARCHAR AS document_id, text AS content, 1.0 - i / 10 AS score, i + 1 AS rank, j.doc_id, (n_chars % 500)::INT AS cost FROM j JOIN documents d ON d.doc_id = j.doc_id)\n"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer to each item that cites its third result twice, its first and one that it has not."""
    i = F.col("item_id") * 3
    cite = lambda n: F.concat(F.lit("[c_"), ((i + n) % 100).cast("string"), F.lit("]"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("So "), cite(2), F.lit(" and "), cite(0), F.lit(" or "), cite(50), F.lit(" "), cite(2)).alias("answer"))


@query(RESULTS_SQL + "SELECT query_id, CASE i WHEN 2 THEN 0 ELSE 1 END::INT AS position, chunk_id, document_id, left(content, 200) AS snippet, i::INT AS page, score::DOUBLE AS score FROM r WHERE i <> 1")
def m8_citations(spark, d):  # noqa: ANN001, ANN201
    return context.citations(_answers(spark, d), _results(spark, d))


@query(RESULTS_SQL + "SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'I do not have enough information to answer this question based on the provided documents.' ELSE 'So [c_' || (item_id * 3 + 2) % 100 || '] and [c_' || (item_id * 3) % 100 || '] or [c_' || (item_id * 3 + 50) % 100 || '] [c_' || (item_id * 3 + 2) % 100 || ']' END AS answer, CASE WHEN item_id % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN item_id % 4 = 0 THEN 0 ELSE 2 END::BIGINT AS n_citations FROM benchmark")
def m10_finalize(spark, d):  # noqa: ANN001, ANN201
    return context.finalize(_answers(spark, d), _results(spark, d).where("query_id % 4 <> 0")).withColumn("n_citations", F.col("n_citations").cast("long"))


@query(RESULTS_SQL.replace("WITH j AS", "WITH RECURSIVE j AS", 1) + """, p AS (SELECT *, CASE WHEN cost > 0 THEN cost WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 4) END AS tokens, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS plain FROM r),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, 0::BIGINT AS tokens, []::VARCHAR[] AS ids, []::VARCHAR[] AS seen, false AS truncated FROM p
 UNION ALL SELECT f.query_id, p.rank, CASE WHEN list_contains(seen, plain) OR f.tokens + p.tokens > 400 THEN f.tokens ELSE f.tokens + p.tokens END, CASE WHEN list_contains(seen, plain) OR f.tokens + p.tokens > 400 THEN ids ELSE list_append(ids, chunk_id) END,
 CASE WHEN list_contains(seen, plain) OR f.tokens + p.tokens > 400 THEN seen ELSE list_append(seen, plain) END, truncated OR (NOT list_contains(seen, plain) AND f.tokens + p.tokens > 400) FROM f JOIN p ON p.query_id = f.query_id AND p.rank = f.rank + 1)
SELECT query_id, array_to_string(ids, ',') AS included, tokens::INT AS tokens, truncated FROM f WHERE rank = 3""".replace("\\\\", "\\"))
def m4_pack_by_score(spark, d):  # noqa: ANN001, ANN201
    return context.pack(_results(spark, d), 400, by_score=True).select("query_id", F.array_join("included", ",").alias("included"), "tokens", "truncated")


@query(RESULTS_SQL + "SELECT query_id, md5('=== BEGIN RETRIEVED CONTEXT (UNTRUSTED DATA) ===' || chr(10) || chr(10) || string_agg('<<<RETRIEVED_CHUNK id=\"' || chunk_id || '\" nonce=\"n1\">>>' || chr(10) || content || chr(10) || '<<<END_RETRIEVED_CHUNK nonce=\"n1\">>>' || chr(10) || chr(10), '' ORDER BY rank) || '=== END RETRIEVED CONTEXT ===') AS h FROM r GROUP BY query_id")
def m5_retrieved_context(spark, d):  # noqa: ANN001, ANN201
    """Also J29: the fences around each chunk. The documents hold nothing that the sanitizer changes."""
    return context.retrieved_context(_results(spark, d), F.lit("n1")).select("query_id", F.md5(F.col("context").cast("binary")).alias("h"))


@query("""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'GEMMA' ELSE 'OPENAI' END AS family, (count(*) FILTER (role <> 'system') + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END)::INT AS n,
 md5(CASE WHEN conv_id % 2 = 0 THEN 'rules' || chr(10) || chr(10) || 'ask ' || conv_id ELSE 'ask ' || conv_id END) AS last FROM conversations GROUP BY conv_id""")
def m5_messages(spark, d):  # noqa: ANN001, ANN201
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(F.upper(x["role"]).alias("role"), x["text"].alias("content"))).alias("h"))
    family = F.when(F.col("conv_id") % 2 == 0, "GEMMA").otherwise("OPENAI")
    m = context.messages(F.lit("rules"), F.col("h"), F.concat(F.lit("ask "), F.col("conv_id").cast("string")), family)
    return turns.select("conv_id", family.alias("family"), F.size(m).alias("n"), F.md5(F.element_at(m, -1)["content"].cast("binary")).alias("last"))


@query("""SELECT item_id AS query_id, '{"title":"' || item_id || '","summary":"s"}' AS answer, 1.0::DOUBLE AS confidence, 0::BIGINT AS n_citations FROM benchmark WHERE item_id % 3 <> 2
UNION ALL SELECT item_id, 'never valid', 1.0, 0 FROM benchmark WHERE item_id % 3 = 2""")
def m7_ask_with_retries(spark, d):  # noqa: ANN001, ANN201
    """A third of the answers is valid at once, a third after a rejection, a third never."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("item <"), F.col("item_id").cast("string"), F.lit(">")).alias("text"))
    results = _results(spark, d).select("query_id", "chunk_id", "document_id", F.lit("body").alias("content"), "metadata", F.lit(1.0).alias("score"), "rank")

    def generate(prompt):  # noqa: ANN001, ANN202
        item = F.regexp_extract(prompt, r"item <(\d+)>", 1)
        valid = F.concat(F.lit('{"title":"'), item, F.lit('","summary":"s"}'))
        again = prompt.contains("Your last output was rejected")
        return F.when((item.cast("long") % 3 == 0) | ((item.cast("long") % 3 == 1) & again), valid).otherwise("never valid")

    return context.ask(q, results, generate, '{"required":["title","summary"]}').withColumn("n_citations", F.col("n_citations").cast("long"))


@query("""SELECT item_id AS case_id, CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS refusal, 1.0::DOUBLE AS recall, item_id % 2 = 0 AS passed FROM benchmark""")
def o2_refusals(spark, d):  # noqa: ANN001, ANN201
    none = F.array().cast("array<string>")
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"), none.alias("expected_docs"), F.lit(True).alias("expected_refusal"), none.alias("retrieved_docs"), none.alias("retrieved_texts"), F.when(F.col("item_id") % 2 == 0, "I do not know that.").otherwise("It is so.").alias("answer"), F.lit(10).alias("latency_ms"))
    return evaluation.evaluate_cases(cases).select("case_id", "refusal", "recall", "passed")


# Functions


@query("SELECT item_id, CASE WHEN trim(t) = '' THEN '\"\"' ELSE '\"' || trim(t) || '\"*' END AS asked FROM (SELECT item_id, replace(replace(CASE WHEN item_id % 9 = 0 THEN ' '' ' ELSE '\"' || text || '\" it''s ' END, '\"', ''), '''', '') AS t FROM benchmark)")
def j21_phrase_query(spark, d):  # noqa: ANN001, ANN201
    raw = F.when(F.col("item_id") % 9 == 0, " ' ").otherwise(F.concat(F.lit('"'), F.col("text"), F.lit("\" it's ")))
    return table(spark, d, "benchmark").select("item_id", text.phrase_prefix_query(raw).alias("asked"))


@query(QUANT_SQL + "SELECT vec_id, list_sum(list_transform(q, lambda x: x))::BIGINT AS q_sum, list_sum(list_transform(q, lambda x: abs(x)))::BIGINT AS q_abs, len(q)::INT AS n, (8 + len(q))::INT AS bytes, round(scale, 6) AS scale, round(n, 3) AS norm FROM q")
def j6_blob_round_trip(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "embeddings").select("vec_id", vectors.to_blob(vectors.quantize(F.col("embedding"))).alias("b"))
    e = e.select("vec_id", F.octet_length("b").alias("bytes"), vectors.from_blob(F.col("b")).alias("v"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("vec_id", total(F.transform("v.q", lambda x: x.cast("long"))).alias("q_sum"), total(F.transform("v.q", lambda x: F.abs(x.cast("long")))).alias("q_abs"), F.size("v.q").alias("n"), "bytes", F.round("v.scale", 6).alias("scale"), F.round("v.norm", 3).alias("norm"))


@query("""WITH h AS (SELECT item_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) & 4294967295) AS u FROM benchmark),
s AS (SELECT item_id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM h),
m AS (SELECT item_id, list_transform(range(1, 17), lambda i: (h * i) - floor((h * i + 2147483648) / 4294967296.0)::BIGINT * 4294967296) AS w FROM s),
v AS (SELECT item_id, list_transform(w, lambda x: (sign(x) * (abs(x) % 100)) / 100.0::DOUBLE) AS v FROM m)
SELECT item_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM v""")
def j18_fake_embedding(spark, d):  # noqa: ANN001, ANN201
    v = table(spark, d, "benchmark").select("item_id", vectors.fake_embedding(F.col("text")).alias("v"))
    return v.select("item_id", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.col("v")[0]).alias("first"))


@query("SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 AND event_id % 11 = 0 THEN 'RULE-NETWORK-001' WHEN event_id % 4 = 2 THEN 'RULE-PROVIDER-001' WHEN event_id % 3 = 0 AND event_id % 200 > 120 THEN 'RULE-QUOTA-001' END AS rule_id FROM events")
def n5_rule_table(spark, d):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % n + 1).cast("int"))
    req = table(spark, d, "events").select(i.alias("request_id"), pick(3, "CLOUD", "LOCAL", "LOCAL").alias("locality"), F.lit(None).cast("string").alias("labels"), F.lit("w").alias("workspace"), (i % 11 == 0).alias("roaming"), pick(4, "p1", "p2", "p3", None).alias("provider"), F.lit(None).cast("string").alias("region"), (i % 200).alias("tokens"))
    rules = governance.rule_table(spark, ("roaming", None), ("providers", ["p1", "p2"]), ("quota", 120))
    return governance.evaluate_policy(req, rules).select("request_id", "rule_id")


@query("SELECT DISTINCT source AS collection_id, 44 AS wrapped, true AS same FROM documents WHERE source <> 'src1' AND source IS NOT NULL")
def n13_envelope_keys(spark, d):  # noqa: ANN001, ANN201
    """A data key for each source that has none, wrapped, and wrapped anew; the key within stays the same."""
    from lodestone.session import kept

    a, b = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    sources = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("collection_id"))
    made = kept(governance.missing_keys(sources, spark.createDataFrame([("src1",)], "collection_id string"), a), "keys")
    turned = governance.rotate_keys(made, a, b).select(F.col("collection_id").alias("c"), F.col("wrapped").alias("new"))
    j = made.join(turned, F.col("collection_id") == F.col("c"))
    return j.select("collection_id", F.octet_length("new").alias("wrapped"), (governance.decrypt(F.col("wrapped"), a) == governance.decrypt(F.col("new"), b)).alias("same"))
