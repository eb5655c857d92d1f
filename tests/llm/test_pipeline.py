"""The pipeline against a plain version of its stages."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, quality
from lodestone.llm.queries import tokenizer_path
from lodestone.session import table

cp = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_equal_the_plain_version(spark):
    from tokenizers import Tokenizer

    from tests.llm.test_operators import brute_components

    docs = table(spark, DATA, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit_quality(docs, table(spark, DATA, "labels"))
    import numpy as np

    good = [i for i, r in sorted(rows.items()) if model.predict(np.array([quality.text_stats(r.text)]))[0] >= quality.THRESHOLD]
    one = [c[0] for c in brute_components([(i, rows[i].text) for i in good]) if c[3]]
    items = [decontaminate.words_of(r.text) for r in table(spark, DATA, "benchmark").collect()]

    def leaks(text):
        w = decontaminate.words_of(text)
        have = decontaminate.shingles(w)
        part = lambda p: decontaminate.contained(p, have, w, {})
        return any(part(v) >= 0.75 and part(v[: len(v) // 2]) >= 0.5 and part(v[len(v) // 2 :]) >= 0.5 for v in items)

    clean = [i for i in one if not leaks(rows[i].text)]
    at = docs
    for (_, stage), want in zip(cp.STAGES[:3], (good, one, clean), strict=False):
        at = stage(spark, at, DATA)
        assert at.columns == docs.columns and sorted(r.doc_id for r in at.select("doc_id").collect()) == want
    plan = {r.doc_id: r.taken for r in mixing.mix(at).collect()}
    mixed = cp.STAGES[3][1](spark, at, DATA)
    taken = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    assert taken == {k: v for k, v in plan.items() if v}
    t = Tokenizer.from_file(tokenizer_path())
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    out = cp.run(spark, DATA).collect()
    assert sum(r.n_tokens for r in out) == want and len(out) == mixed.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, row int, __stats string, __leak int, size string, doc string, nth int"


def odd_rows(spark):
    """Nulls in any column, empty and blank texts, repeated ids and rows, a long text, columns with names used inside."""
    clean = "The quick brown fox walks over the hill and meets a friend who tells of rivers, woods and distant towns. "
    texts = [None, "", "  \n", "one", clean * 3, clean * 3 + "More of it.", "word " * 30_000, "\u00e9\u6f22\u5b57 " * 40]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, i, "x", 1, "y", "z", 3) for i, t in enumerate(texts)]
    rows += [(None, clean, "en", None, 7, 1, None, None, None, None, None), (4, clean * 3, "en", "s1", 5, 4, "x", 1, "y", "z", 3), (4, clean * 3, "en", "s1", 5, 4, "x", 1, "y", "z", 3), (4, "another text under the same id, with words enough to be a shingle or two", None, None, None, 0, "x", 1, "y", "z", 3)]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows(spark, k):
    docs = odd_rows(spark)
    name, stage = cp.STAGES[k]
    got = stage(spark, docs, DATA)
    assert got.dtypes == docs.dtypes
    rows, before = got.collect(), docs.collect()
    assert len(rows) > 0 and stage(spark, docs.limit(0), DATA).count() == 0
    plain = lambda some: sorted(str(tuple(r)) for r in some)
    if k < 3:
        assert not set(plain(rows)) - set(plain(before))
    if name == "benchmark decontamination":
        assert plain(rows) == plain(before)
    if name == "MinHash near-dedup":
        blank = [r for r in before if not (r.text or "").split()]
        assert plain(r for r in rows if not (r.text or "").split()) == plain(blank)
        texts = [r.text for r in rows if (r.text or "").split()]
        assert len(texts) == len(set(texts)) == 5  # one of the four texts that repeat the same words
    if name == "mixing sources to target weights":
        assert {r.n_chars for r in rows if r.text is not None} == {len(r.text) for r in rows}
        assert all(any(r[c] == b[c] for b in before) for r in rows for c in ("lang", "source", "row", "size", "doc"))
    again = stage(spark, docs, DATA).collect()
    assert plain(again) == plain(rows)


def test_last_stage_takes_odd_rows(spark):
    docs = odd_rows(spark)
    got = cp.STAGES[4][1](spark, docs, DATA).collect()
    assert len(got) == docs.count() and sorted(r.start for r in got)[0] == 0
    assert cp.STAGES[4][1](spark, docs.limit(0), DATA).count() == 0
