"""The corpus pipeline: from raw documents to token files, five stages by the training-data operators.

Each stage works on all that the one before kept and returns the columns of
documents; the last returns the digest of the token files. Stages are written to
the shared folder and read again, so a lost executor never costs more than the
stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, quality, setsketch, token_files
from lodestone.llm.common import discarding, fresh, remove, scratch_path
from lodestone.llm.queries import tokenizer_path
from lodestone.session import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "__score")
    return quality.score_quality(docs, model, score=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return setsketch.drop_near_duplicates(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leak = fresh(docs, "__leak")
    return decontaminate.flag_contaminated(docs, table(spark, sf_dir, "benchmark"), leak).where(~F.col(leak)).drop(leak)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: documents as often, and as far, as they are taken."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and from them what each document's ids are."""
    return token_files.read_tokens(token_files.write_tokens(docs, tokenizer_path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-").replace("/", "-"))
        with discarding(spark):  # what a stage staged goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)  # the token files are written
    return out


#: SQL can express neither the fitted classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None
