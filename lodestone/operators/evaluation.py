"""Evaluation of retrieval and answers: per-case metrics, a report, threshold violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import faithful, faithfulness, refuses, relevance, relevant

TOP_K = 3
# Gates of a report.
THRESHOLDS = (("recall", 0.85), ("precision", 0.80), ("faithfulness", 0.90), ("relevance", 0.85), ("refusal", 0.95))
MAX_LATENCY_MS = 1500

GOLDEN = (
    "struct<documents:array<struct<id:string,title:string,content:string>>,cases:array<struct<id:string,question:string,isAnswerable:boolean,"
    "expectedAnswer:string,expectedFacts:array<struct<fact:string,required:boolean>>,expectedCitations:array<struct<documentId:string>>,expectedRefusal:boolean,category:string>>>"
)


def load_golden(files: DataFrame, text: str = "json") -> DataFrame:
    """(case_id, question, expected_answer, expected_docs, expected_refusal) from golden JSON, citations included."""
    c = files.select(F.explode(F.from_json(F.col(text), GOLDEN)["cases"]).alias("c"))
    return c.select(F.col("c.id").alias("case_id"), "c.question", F.col("c.expectedAnswer").alias("expected_answer"), F.coalesce(F.col("c.expectedCitations.documentId"), F.array().cast("array<string>")).alias("expected_docs"), F.coalesce("c.expectedRefusal", F.lit(False)).alias("expected_refusal"))


def evaluate_cases(cases: DataFrame, k: int = TOP_K) -> DataFrame:
    """(case_id, recall, precision, faithfulness, relevance, refusal, latency_ms, passed) of rows (case_id, question,
    expected_docs, expected_refusal, retrieved_docs, retrieved_texts, answer, latency_ms). A case that should be refused
    is judged by its refusal alone."""
    top = F.array_distinct(F.slice("retrieved_docs", 1, k))
    expected = F.array_distinct("expected_docs")
    hits = F.size(F.array_intersect(top, expected))
    rec = F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.size(expected))
    prec = F.when(F.size(top) == 0, 0.0).otherwise(hits / F.size(top))
    faith, rel = faithfulness(F.col("answer"), F.col("retrieved_texts")), relevance(F.col("question"), F.col("answer"))
    skip = F.col("expected_refusal")
    one = lambda v: F.when(skip, 1.0).otherwise(v)
    refused = refuses(F.col("answer"))
    out = cases.select("case_id", one(rec).alias("recall"), one(prec).alias("precision"), one(faith).alias("faithfulness"), one(rel).alias("relevance"), F.when(skip, refused.cast("double")).otherwise(1.0).alias("refusal"), "latency_ms", F.when(skip, refused).otherwise(relevant(rel, F.col("answer"))).alias("__ok"), skip.alias("__skip"))
    passed = F.when(F.col("__skip"), F.col("__ok")).otherwise((F.col("recall") >= 0.5) & faithful(F.col("faithfulness")) & F.col("__ok"))
    return out.withColumn("passed", passed).drop("__ok", "__skip")


def report(results: DataFrame) -> DataFrame:
    """One row of means, the mean latency truncated, and whether all cases passed; an empty input is a perfect report."""
    means = [F.coalesce(F.avg(m), F.lit(1.0)).alias(m) for m, _ in THRESHOLDS]
    return results.agg(F.count("*").alias("cases"), *means, F.coalesce(F.floor(F.avg("latency_ms")), F.lit(0)).cast("long").alias("latency_ms"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def violations(reports: DataFrame) -> DataFrame:
    """(metric, value, bound) of every gate that a report misses."""
    gates = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(b).alias("bound"), (F.col(m) < b).alias("bad")) for m, b in THRESHOLDS]
    gates.append(F.struct(F.lit("latency_ms").alias("metric"), F.col("latency_ms").cast("double").alias("value"), F.lit(float(MAX_LATENCY_MS)).alias("bound"), (F.col("latency_ms") > MAX_LATENCY_MS).alias("bad")))
    return reports.select(F.explode(F.array(*gates)).alias("g")).where("g.bad").select("g.metric", "g.value", "g.bound")


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): overlap of two ranked lists' first k, over k."""
    ids = lambda df: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("chunk_id").alias("s"))
    return ids(truth).withColumnRenamed("s", "t").join(ids(found), "query_id", "left").select("query_id", (F.size(F.array_intersect("t", F.coalesce("s", F.array().cast("array<bigint>")))) / F.lit(k)).alias("recall"))
