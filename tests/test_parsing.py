"""Line parsers, personal data and runs of sentences against plain Python versions over whole tables."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import pii, text, vectors
from lodestone.operators import chunking
from lodestone.plans import queries as own
from lodestone.session import table
from lodestone.sources import parsers
from tests.test_functions import iban, luhn, verhoeff

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

SPACE = "[ \\t\\n\\x0b\\f\\r]"


def strip(s):
    return re.sub(rf"^{SPACE}+|{SPACE}+$", "", s)


def plain_elements(doc):
    """(kind, text, level) by walking the lines: a heading or a blank line ends a paragraph, a table stands where it begins."""
    out, paragraph, table_at = [], None, None
    for raw in re.split(r"\r\n|\n|\r", doc):
        line = strip(raw)
        head = re.match(rf"(#{{1,6}}){SPACE}+(.+)$", line)
        if line.startswith("|") and "---" in line:
            continue
        if line.startswith("|") and line.endswith("|") and len(line) > 1:
            cells = [strip(c) for c in re.sub(r"^\||\|$", "", line).split("|")]
            if table_at is None:
                out.append(["table", None, None, [cells]])
                table_at = out[-1]
            else:
                table_at[3].append(cells)
            continue
        table_at = None
        if head:
            out.append(["heading", head[2].strip(" "), len(head[1]), None])
            paragraph = None
        elif not line:
            paragraph = None
        elif paragraph is None:
            out.append(["text", line, None, None])
            paragraph = out[-1]
        else:
            paragraph[1] += " " + line
    return [tuple(x) for x in out]


def test_text_elements_equal_the_plain_version(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    made = [(10_000, "# A\ntext one\ntext two\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n## B ##\n|x|\n\n|y|\nend"), (10_001, ""), (10_002, None), (10_003, "\r\n| only |\r\n")]
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = {}
    for r in parsers.parse_text(docs).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.text, r.level, None if r.kind != "table" else [list(r.headers), *map(list, r.rows)]))
    want = {r.doc_id: plain_elements(r.text) for r in docs.collect() if r.text}
    assert got == {k: v for k, v in want.items() if v}


def plain_spans(t):
    """Spans by regular expressions with ASCII edges and the checks of the function tests."""
    digits = lambda v: re.sub(r"[\s-]", "", v)
    ok = {
        "EMAIL": lambda v: True, "PAN": lambda v: True, "CREDIT_CARD": lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v)), "AADHAAR": lambda v: verhoeff(digits(v)), "IBAN": lambda v: 15 <= len(digits(v)) <= 34 and iban(digits(v)),
        "PHONE": lambda v: bool(re.fullmatch(r"\+91[6-9]\d{9}", digits(v)) if digits(v).startswith("+91") and len(digits(v)) == 13 else re.fullmatch(r"[6-9]\d{9}|\+\d{7,14}", digits(v))),
    }
    found = [(m.start(), -m.end(), kind) for kind, p, _ in pii.PATTERNS for m in re.finditer(p, t, re.ASCII) if ok[kind](m[0])]
    out, reach = [], -1
    for start, end, kind in sorted(found, key=lambda s: s[:2]):
        if start >= reach:
            out.append((kind, start, -end))
            reach = -end
    return out


def test_personal_data_equals_the_plain_version(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    got = {}
    for r in own.QUERIES["n1_pii_spans"](spark, DATA).collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.start, r.end))
    assert got == {k: v for k, v in ((k, plain_spans(t)) for k, t in docs.items()) if v} and sum(map(len, got.values())) >= 10


def test_a_plugged_in_detector_competes(spark):
    one = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("v").alias("value"), F.lit(0.5).alias("confidence"))
    df = spark.createDataFrame([(1, "mail jo@example.org of Jo Do"), (2, "none")], "id int, t string")
    spans = F.when(F.col("id") == 1, F.array(one("NAME", 23, 28), one("LINE", 0, 19), one("PART", 5, 7)))
    got = {r.id: [(s.kind, s.start, s.end) for s in r.s] for r in df.select("id", pii.detect(F.col("t"), lambda _: spans).alias("s")).collect()}
    assert got == {1: [("LINE", 0, 19), ("NAME", 23, 28)], 2: []}


def test_runs_of_sentences_equal_the_plain_version(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    got = {}
    for r in chunking.semantic_chunks(docs, vectors.fake_embedding, 0.7, 60).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.content, r.token_count))
    said = docs.select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "s")).withColumn("v", vectors.fake_embedding(F.col("s"))).orderBy("doc_id", "pos").collect()
    want: dict = {}
    last = None
    for r in said:
        runs = want.setdefault(r.doc_id, [])
        v = np.array(r.v)
        if last is not None and last[0] == r.doc_id:
            size = np.linalg.norm(v) * np.linalg.norm(last[1])
            alike = v @ last[1] / size if size > 0 else 0
        if not runs or alike < 0.7 or chunking.tokens(f"{runs[-1]} {r.s}") > 60:
            runs.append(r.s)
        else:
            runs[-1] += " " + r.s
        last = (r.doc_id, v)
    assert {k: [c for c, _ in v] for k, v in got.items()} == want
    assert all(n == chunking.tokens(c) for v in got.values() for c, n in v)


def test_synthetic_embeddings_equal_wrapped_integers(spark):
    ids = table(spark, DATA, "documents").select("doc_id", text.embedding_tokens(F.col("text")).alias("ids"))
    rows = ids.withColumn("v", vectors.embed_tokens(8)(F.col("ids"))).limit(60).collect()
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    for r in rows:
        want = np.zeros(8)
        for i in r.ids[:128]:
            h = wrap(i * 0x45D9F3B)
            for d in range(8):
                h = wrap((h ^ (h >> 16)) * 0x45D9F3B)
                h ^= h >> 16
                want[d] += ((h & 0xFFFF) / 32768.0 - 1.0) / len(r.ids[:128])
        assert np.allclose(r.v, want)


def test_html_elements_of_made_pages(spark):
    """Pages put together from known elements give them back in order."""
    import random

    rng = random.Random(61)
    pages, want = [], {}
    for i in range(60):
        html, elements, section = "<html><head><title>t</title></head><body>", [], None
        for _ in range(rng.randrange(1, 12)):
            n = rng.randrange(10**6)
            kind = rng.choice(["h", "p", "table", "script"])
            if kind == "h":
                level = rng.randrange(1, 7)
                html += f"<h{level} class='x'>Head &amp; {n}</h{level}>"
                section = f"Head & {n}"
                elements.append(("heading", section, level, section, None))
            elif kind == "p":
                html += f"<p>some <b>words</b>\n of {n}</p>"
                elements.append(("text", f"some words of {n}", None, section, None))
            elif kind == "table":
                rows = [[f"c{n}{r}{c}" for c in range(2)] for r in range(rng.randrange(1, 5))]
                html += "<p>before</p><table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
                elements += [("text", "before", None, section, None), ("table", None, None, section, rows)]
            else:
                html += f"<script>var x = '<p>{n}</p>';</script><!-- <p>no</p> -->"
        pages.append((i, html + "</body></html>"))
        want[i] = elements
    got: dict = {i: [] for i in want}
    for r in parsers.parse_html(spark.createDataFrame(pages, "page_id long, html string")).orderBy("doc_id", "ord").collect():
        got[r.doc_id].append((r.kind, r.text, r.level, r.section, None if r.kind != "table" else [list(r.headers), *map(list, r.rows)]))
    assert got == want
