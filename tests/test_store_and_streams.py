"""The store's mutations and the streaming operators, over temporary folders."""

import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.functions.vectors import fake_embedding
from lodestone.operators import context, evaluation, governance, search, store
from lodestone.streaming import ingest


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_id string, seq int, content string, token_count int, metadata map<string,string>, vector array<double>")


def test_store(spark, tmp_path):
    s = store.CorpusStore(spark, str(tmp_path))
    with pytest.raises(store.UnknownCollectionError):
        s.upsert("a", "c", _chunks(spark, [("x", "d", 0, "t", 1, {}, [1.0])]))
    assert s.create_collection("a", "c", 2).first().dimensions == 2
    assert s.create_collection("a", "c", 5).first().dimensions == 2
    s.upsert("a", "c", _chunks(spark, [("x", "d1", 0, "one", 1, {"k": "v,w:x"}, [1.0, 0.0]), ("y", "d2", 0, "two", 1, {}, [0.0, 1.0])]))
    s.upsert("a", "c", _chunks(spark, [("x", "d1", 0, "uno", 1, {"k": "v,w:x"}, [0.0, 1.0])]))
    with pytest.raises(ValueError):
        s.upsert("a", "c", _chunks(spark, [("z", "d3", 0, "t", 1, {}, [1.0])]))
    rows = {r.chunk_id: r for r in s.export("a", "c").collect()}
    assert rows["x"].content == "uno" and rows["x"].metadata == {"k": "v,w:x"} and abs(rows["x"].vector[1] - 1) < 0.01
    assert s.read("chunks", "b").count() == 0
    assert s.stats("a").first()["vector_bytes"] == 20
    s.save_checkpoint("a", "c", "d1", "EMBEDDING", 3, 9)
    assert s.checkpoint("a", "c", "d1").first().done == 3
    s.delete_document("a", "c", "d1")
    assert [r.chunk_id for r in s.read("chunks", "a").collect()] == ["y"] and s.checkpoint("a", "c", "d1").count() == 0
    assert s.export_user_data("a").first()[0] == '{"collections":1,"documents":0,"audit_events":0}'
    s.shred_collection("a", "c")
    assert s.read("chunks", "a").count() == 0 and s.read("collections", "a").count() == 0


def test_store_survives_writers_that_die(spark, tmp_path, monkeypatch):
    s = store.CorpusStore(spark, str(tmp_path))
    s.create_collection("a", "c", 1)
    one = lambda i, text: _chunks(spark, [(f"x{i}", f"d{i}", 0, text, 1, {}, [1.0])])
    s.upsert("a", "c", one(1, "first"))
    before = sorted(map(str, s.read("chunks", "a").collect()))

    class Dies(Exception):
        pass

    fs = type(s)._fs
    for method in ("rename", "exists"):

        class Broken:
            def __init__(self, real):
                self.real = real

            def __getattr__(self, name):
                if name == method:
                    raise Dies
                return getattr(self.real, name)

        monkeypatch.setattr(type(s), "_fs", lambda self, Broken=Broken: Broken(fs(self)))
        with pytest.raises(Dies):
            s._merge("chunks", one(2, "second").select("chunk_id", "document_id", "seq", "content", "token_count", "metadata"), "a", "c")
        monkeypatch.setattr(type(s), "_fs", fs)
        assert sorted(map(str, s.read("chunks", "a").collect())) == before
    # After the rename, before older versions go: the new base alone counts.
    s.upsert("a", "c", one(1, "changed"))
    part = tmp_path / "chunks" / "scope_id=a" / "collection_id=c"
    shutil.copytree(part, tmp_path / "kept")
    s.compact("chunks", "a", "c")
    for old in (tmp_path / "kept").iterdir():
        shutil.copytree(old, part / old.name)
    assert [r.content for r in s.read("chunks", "a").collect()] == ["changed"]


def test_deltas_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MAX_DELTAS", 3)
    s = store.CorpusStore(spark, str(tmp_path))
    want = {}
    for n in range(9):
        scope, key = "a/b" if n % 2 else "a", f"s{n % 3}"
        s.add_messages(scope, "w 1", spark.createDataFrame([(key, n % 2, "user", f"said {n}"), (key, n % 2, "user", f"said {n}")], "session_id string, turn long, role string, content string"))
        want[scope, key, n % 2] = f"said {n}"
        assert all(len(v) <= 4 for v in s._versions("messages").values())
    got = {(r.scope_id, r.session_id, r.turn): r.content for r in s.read("messages", None).collect()}
    assert got == want
    assert {r.content for r in s.messages("a", "w 1", "s0").collect()} == {v for k, v in want.items() if k[:2] == ("a", "s0")}
    s.clear_messages("a", "w 1", "s0")
    assert s.messages("a", "w 1", "s0").count() == 0 and s.read("messages", "a/b").count() == sum(k[0] == "a/b" for k in want)


def test_upsert_makes_its_rows_once(spark, tmp_path):
    s = store.CorpusStore(spark, str(tmp_path))
    s.create_collection("a", "c", 1)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):  # noqa: ANN001, ANN202
        made.add(1)
        return [1.0]

    rows = spark.range(20).select(F.col("id").cast("string").alias("chunk_id"), F.lit("d").alias("document_id"), F.col("id").cast("int").alias("seq"), F.lit("t").alias("content"), F.lit(1).alias("token_count"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"), embed(F.col("id").cast("string")).alias("vector"))
    s.upsert("a", "c", rows)
    assert made.value == 20 and s.read("vectors", "a").count() == 20


def test_documents_and_data_subjects(spark, tmp_path):
    import json

    from lodestone.operators.lexical import TextIndex

    s = store.CorpusStore(spark, str(tmp_path / "store"))
    for c in ("c", "c 2"):
        s.create_collection("a", c, 1)
        docs = spark.createDataFrame([(f"{c}-d{i}", f"name {i}", "text/plain", 5, f"sum{c}{i}", i) for i in range(3)], "document_id string, name string, mime_type string, size_bytes long, checksum string, created_at long")
        s.upsert("a", c, _chunks(spark, [(f"{c}-x{i}{j}", f"{c}-d{i}", j, f"words of {i} part {j}", 3, {}, [1.0]) for i in range(3) for j in range(2)]), docs)
    s.save_checkpoint("a", "c", "c-d1", "EMBEDDING", 1, 4)
    s.save_checkpoint("a", "c", "c-d2", "QUEUED", 0, 0)
    s.add_messages("a", "c", spark.createDataFrame([("mine", 0, "user", "hello"), ("other", 0, "user", "hi")], "session_id string, turn long, role string, content string"))
    assert s.list_documents("a").count() == 6 and s.list_documents("a", "c 2").count() == 3
    assert {r.document_id: (r.stage, r.progress) for r in s.status("a").collect()} == {"c-d1": ("EMBEDDING", 0.25), "c-d2": ("QUEUED", 0.0)}
    owners = spark.createDataFrame([("u", "document", "c-d1"), ("u", "document", "c 2-d0"), ("u", "session", "mine"), ("v", "document", "c-d0")], "user_id string, kind string, id string")
    consents = spark.createDataFrame([("u", "search", True), ("v", "search", False)], "user_id string, purpose string, granted boolean")
    held = json.loads(s.export_subject("a", "u", owners, consents).first().json)
    assert [d["document_id"] for d in held["documents"]] == ["c 2-d0", "c-d1"] and [m["content"] for m in held["messages"]] == ["hello"] and len(held["consents"]) == 1
    receipt = s.erase_subject("a", "u", owners, "r1", 7).first()
    proof = governance.deletion_proof(F.lit("r1"), F.lit("u"), F.lit(6), F.lit(7))
    assert (receipt.documents, receipt.chunks) == (2, 4) and receipt.proof == spark.range(1).select(proof).first()[0]
    assert {r.document_id for r in s.list_documents("a").collect()} == {"c-d0", "c-d2", "c 2-d1", "c 2-d2"} and s.read("messages", "a").count() == 1 and s.status("a").count() == 1
    assert json.loads(s.export_subject("a", "u", owners, consents).first().json)["documents"] == []
    index = TextIndex(spark, str(tmp_path / "index"))
    assert s.reindex("a", "c", index, fake_embedding_of_one).first().completed == 2
    found = index.search(spark.createDataFrame([(1, "part 1")], "query_id int, text string"), 9)
    assert {r.chunk_id for r in found.collect()} == {"c-x00", "c-x01", "c-x20", "c-x21"}


def fake_embedding_of_one(text):  # noqa: ANN001, ANN201
    return F.transform(F.array(F.length(text).cast("double")), lambda x: x)


def test_streaming_ingestion_resumes(spark, tmp_path):
    s = store.CorpusStore(spark, str(tmp_path / "store"))
    s.create_collection("a", "c", 16)
    schema = "doc_id long, text string"
    embed = lambda c: fake_embedding(c)
    for n, rows in enumerate([[(1, "a text"), (2, "a text"), (3, "more")], [(4, "more"), (5, "last one")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.start_ingestion(spark, str(tmp_path / "in"), schema, s, "a", "c", embed, str(tmp_path / "cp")).awaitTermination()
        assert s.read("documents", "a").count() == (2, 3)[n]
    assert s.read("vectors", "a").count() == 3


def test_quota_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 01:00:00' ts, 60L tokens union all select timestamp'2024-01-01 23:00:00', 50L union all select timestamp'2024-01-02 00:30:00', -5L").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, tokens long").parquet(str(tmp_path / "e"))
    q = ingest.daily_quota(stream, 100).writeStream.format("memory").queryName("quota").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.tokens, r.over_limit) for r in spark.sql("select * from quota order by day").collect()] == [(110, True), (0, False)]


def test_chain_breaks_are_found(spark):
    rows = [("t", i, i * 10, "act", "u", "none", "", "m") for i in range(3)]
    led = governance.append_chain(spark.createDataFrame(rows, "chain string, seq long, ts_ms long, action string, actor string, model string, document_ids string, metadata_hash string"), "g")
    assert governance.verify_chain(led, "g").first().broken_seq is None
    bad = governance.verify_chain(led.withColumn("action", F.when(F.col("seq") == 1, "x").otherwise(F.col("action"))), "g").first()
    assert (bad.broken_seq, bad.reason) == (1, "hash")
    assert governance.verify_chain(led, "other").first().broken_seq == 0


def test_key_rotation(spark):
    a, b = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    keys = spark.createDataFrame([("c",)], "collection string").withColumn("wrapped", governance.encrypt(F.lit("data key").cast("binary"), a))
    back = governance.rotate_keys(keys, a, b).select(governance.decrypt(F.col("wrapped"), b).cast("string")).first()[0]
    assert back == "data key"


def test_clearance_and_roles(spark):
    rows = [("c1", {"sensitivity": "PUBLIC"}), ("c2", {"sensitivity": "INTERNAL"}), ("c3", {"sensitivity": "CONFIDENTIAL", "required_roles": "hr,executive"}), ("c4", {"sensitivity": "RESTRICTED"})]
    df = spark.createDataFrame(rows, "id string, m map<string,string>")
    see = lambda rank, role: [r.id for r in df.where(governance.is_authorized(F.col("m"), F.lit(rank), F.array(F.lit(role)), F.lit(None).cast("string"))).orderBy("id").collect()]
    assert see(1, "eng") == ["c1", "c2"] and see(2, "HR") == ["c1", "c2", "c3"] and see(2, "sales") == ["c1", "c2"]


def test_fusion_ties_and_single_legs(spark):
    leg = lambda *ids: spark.createDataFrame([(0, c, 1.0 - i / 10, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, score double, rank int")
    got = search.fuse(leg("a", "b"), leg("c", "b"), 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and abs(got[0].score - 2 / 62) < 1e-9


def test_citations_and_refusal(spark):
    results = spark.createDataFrame([(1, "chunk_0", "d", "body " * 60, {"page_start": "3"}, 0.9, 1)], "query_id int, chunk_id string, document_id string, content string, metadata map<string,string>, score double, rank int")
    answers = spark.createDataFrame([(1, "It is so [chunk_0] and [chunk_9] and [chunk_0]."), (2, "no idea")], "query_id int, answer string")
    c = context.citations(answers, results).collect()
    assert len(c) == 1 and c[0].page == 3 and len(c[0].snippet) == 200
    out = {r.query_id: r for r in context.finalize(answers, results).collect()}
    assert out[1].n_citations == 1 and out[2].answer == context.REFUSAL and out[2].confidence == 0


def test_golden_and_report(spark):
    golden = '{"documents":[],"cases":[{"id":"q","question":"what is kept","isAnswerable":true,"expectedCitations":[{"documentId":"a"}],"expectedRefusal":false},{"id":"r","question":"x","isAnswerable":false,"expectedRefusal":true}]}'
    cases = evaluation.load_golden(spark.createDataFrame([(golden,)], "json string"))
    assert {r.case_id: (r.expected_docs, r.expected_refusal) for r in cases.collect()} == {"q": (["a"], False), "r": ([], True)}
    rows = cases.withColumns({"retrieved_docs": F.array(F.lit("a"), F.lit("b")), "retrieved_texts": F.array(F.lit("things are kept here")), "answer": F.when(F.col("case_id") == "q", "things are kept").otherwise("I do not know"), "latency_ms": F.lit(10)})
    r = {x.case_id: x for x in evaluation.evaluate_cases(rows).collect()}
    assert (r["q"].recall, r["q"].precision, r["q"].faithfulness) == (1.0, 0.5, 1.0) and r["r"].passed
    assert evaluation.report(rows.limit(0).transform(evaluation.evaluate_cases)).first().passed


def test_event_folding(spark):
    lines = spark.createDataFrame([("m", 0, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), ("m", 1, 'data: {"choices":[{"delta":{"content":"lo"}}]}'), ("m", 2, "data: {broken"), ("m", 3, "data: [DONE]")], "message_id string, seq int, line string")
    r = context.fold_events(store.decode_events(lines, "openai")).first()
    assert (r.text, r.status) == ("Hello", "done")


def test_model_catalogue(spark):
    j = '{"models":[{"id":"a","minRamBytes":100,"supportedAbis":["arm64"]},{"id":"b","minRamBytes":900},{"id":"c","supportedAbis":["x86"]}]}'
    m = store.parse_model_catalog(spark.createDataFrame([(j,)], "json string"))
    assert [r.id for r in store.compatible_models(m, 500, 30, ["arm64"]).collect()] == ["a"] and m.first().license == "Unknown"


def test_parse_all_and_files(spark, tmp_path):
    from lodestone.sources import parsers

    rows = [(1, "text/plain", 5, b"# H\nwords"), (2, "text/html", 5, b"<p>x</p>"), (3, "text/csv", 5, b"a,b\n1,2"), (4, "video/mp4", 5, b""), (5, "application/msword", 5, b"junk"), (6, "image/png", 5, b"img"), (7, "text/plain", 10**9, b"big"), (8, "text/tab-separated-values", 5, b"a\tb\n1\t2")]
    files = spark.createDataFrame([(i, m, n, bytearray(b)) for i, m, n, b in rows], "doc_id long, mime_type string, size_bytes long, content binary")
    good, bad = parsers.parse_all(files, lambda c: F.concat(F.lit("seen "), c.cast("string")))
    assert {(r.doc_id, r.kind) for r in good.collect()} == {(1, "heading"), (1, "text"), (2, "text"), (3, "table"), (6, "text"), (8, "table")}
    assert {r.doc_id: r.error for r in bad.collect()}.keys() == {4, 5, 7}
    (tmp_path / "a.txt").write_text("x")
    assert parsers.read_files(spark, str(tmp_path)).first().size_bytes == 1


def test_rules_keys_and_rewriting(spark):
    rules = governance.rule_table(spark, ("roaming", None), ("quota", 10))
    req = spark.createDataFrame([(1, "CLOUD", None, "w", False, "p", None, 11), (2, "CLOUD", None, "w", True, "p", None, 11), (3, "LOCAL", None, "w", True, "p", None, 11)], "request_id int, locality string, labels string, workspace string, roaming boolean, provider string, region string, tokens int")
    got = {r.request_id: r.rule_id for r in governance.evaluate_policy(req, rules).collect()}
    assert got == {1: "RULE-QUOTA-001", 2: "RULE-NETWORK-001", 3: None}
    key = F.lit("0123456789abcdef").cast("binary")
    made = governance.missing_keys(spark.createDataFrame([("a",), ("b",)], "collection_id string"), spark.createDataFrame([("a",)], "collection_id string"), key)
    assert [(r.collection_id, len(r.wrapped)) for r in made.collect()] == [("b", 12 + 16 + 16)]
    h = spark.createDataFrame([(1, 0, "user", "hello")], "conv_id int, turn int, role string, text string")
    q = spark.createDataFrame([(1, 1, "and then?"), (2, 2, "alone")], "query_id int, conv_id int, text string")
    out = {r.query_id: r.text for r in context.rewrite_queries(q, h, lambda t, past: F.concat(past, F.lit(" / "), t)).collect()}
    assert out == {1: "USER: hello / and then?", 2: "alone"}


def test_diversify_and_pack_by_score(spark):
    rows = [(0, "c1", 0.95, "Kotlin coroutines flow dispatchers", "d", 0, 5), (0, "c2", 0.90, "Kotlin coroutines flow dispatchers and scope", "d", 1, 5), (0, "c3", 0.85, "SQLite database encryption using SQLCipher", "d", 2, 5)]
    c = spark.createDataFrame(rows, "query_id int, chunk_id string, score double, content string, document_id string, seq int, token_count int")
    assert [r.chunk_id for r in search.diversify(c, 2, 0.5).orderBy("rank").collect()] == ["c1", "c3"]
    assert list(context.pack(c, 10).first().included) == ["c1", "c2"]
    assert list(context.pack(c.withColumn("seq", -F.col("seq")), 10, by_score=True).first().included) == ["c1", "c2"]
