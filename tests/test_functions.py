"""Literal cases of scalar functions, checksums, chunkers and parsers."""

import io
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import pii, text, vectors
from lodestone.operators import chunking
from lodestone.sources import parsers

def luhn(digits):
    """Every second digit from the right, beginning beside the check digit, counts double, its digits summed."""
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def verhoeff(digits):
    """The product of the permuted digits in the dihedral group, its elements being moves of a pentagon's corners."""
    turn = lambda x: [(c + x) % 5 for c in range(5)] if x < 5 else [(x - c) % 5 for c in range(5)]
    moves = [turn(x) for x in range(10)]
    after = lambda f, g: [f[c] for c in g]
    total = list(range(5))
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        for _ in range(i % 8):
            x = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[x]
        total = after(total, moves[x])
    return total == list(range(5))


def iban(raw):
    s = raw.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spaced(rng, s, n=4, gap=" -"):
    g = rng.choice(["", *gap])
    return g.join(s[i : i + n] for i in range(0, len(s), n))


def made_numbers(kind, rng):
    """(text, is valid): numbers of every kind of our own making, with every last digit or check digits tried."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "CREDIT_CARD":
        body = rng.choice("3456") + digits(rng.randrange(9, 20))
        return [(spaced(rng, body + c), 13 <= len(body) + 1 <= 19 and luhn(body + c)) for c in "0123456789"]
    if kind == "AADHAAR":
        body = rng.choice("01234567892345") + digits(rng.choice([10, 10, 10, 9]))
        return [(spaced(rng, body + c), len(body) == 11 and body[0] >= "2" and verhoeff(body + c)) for c in "0123456789"]
    if kind == "IBAN":
        tail = "".join(rng.choice("0123456789ABCXYZ") for _ in range(rng.randrange(10, 32)))
        return [(spaced(rng, f"XK{k:02}{tail}"), 11 <= len(tail) <= 30 and iban(f"XK{k:02}{tail}")) for k in range(100)]
    if kind == "PAN":
        raw = "".join(rng.choice("ABCFHLPT") for _ in range(5)) + digits(4) + rng.choice("QRS7")
        return [(raw, raw[3] in "CPHFATBLJG" and raw[-1] != "7"), (raw.lower() + " ", raw[3] in "CPHFATBLJG" and raw[-1] != "7"), (raw[:-1], False)]
    n = rng.randrange(6, 16)
    body = digits(n)
    return [(body, n == 10 and body[0] >= "6"), ("+91" + body, n == 10 and body[0] >= "6" if n == 10 else 7 <= n + 2 <= 14), ("+1" + body, 7 <= n + 1 <= 14)]


@pytest.mark.parametrize("kind", sorted(pii.VALID))
def test_checksums(spark, kind):
    rng = random.Random(kind)
    rows = [r for _ in range(120) for r in made_numbers(kind, rng)]
    assert 5 < sum(ok for _, ok in rows) < len(rows)
    df = spark.createDataFrame(rows, "raw string, want boolean")
    assert [r.raw for r in df.where(pii.VALID[kind](F.col("raw")) != F.col("want")).collect()] == []


def test_mask_round_trip(spark):
    df = spark.createDataFrame([("write to jo@example.org or +91 8123450067.",)], "t string")
    r = df.select(pii.mask(F.col("t"), pii.detect(F.col("t"))).alias("m"), "t").select("m.masked_text", "t", pii.unmask(F.col("m.masked_text"), F.col("m.token_map")).alias("u")).first()
    assert r.masked_text == "write to <PII:EMAIL:1> or <PII:PHONE:2>." and r.u == r.t


def test_quantize_rounds_half_up(spark):
    v = [0.12, -0.45, 0.98, -0.01, 0.55, -2.5 * 0.98 / 127]
    r = spark.createDataFrame([(v,)], "v array<double>").select(vectors.quantize(F.col("v")).alias("q")).select("q.*", vectors.dequantize(F.struct("q.q", "q.scale")).alias("b")).first()
    assert r.q[-1] == -2 and max(abs(a - b) for a, b in zip(v, r.b, strict=True)) <= r.scale / 2 + 1e-12


def test_blob_round_trip(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.25],)], "v array<double>").select(vectors.quantize(F.col("v")).alias("q"))
    r = df.select("q", vectors.from_blob(vectors.to_blob(F.col("q"))).alias("back")).first()
    assert list(r.back.q) == list(r.q.q) and abs(r.back.norm - r.q.norm) < 1e-6


def test_word_tokens(spark):
    df = spark.createDataFrame([("The quick brown fox jumps over the lazy dog",), ("  ",)], "t string")
    assert [r[0] for r in df.select(text.word_tokens(F.col("t"))).collect()] == [11, 0]


def test_json_problem(spark):
    cases = {'{"title":"a","summary":"b"}': None, '{"title":"a"': "no JSON delimiters", "": "empty response", '{"title":"a"}': "missing required field: summary", '{"a":[1}': "unmatched closing brace", '{"a":"}': "unterminated string"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.json_problem(F.col("t"), ["title", "summary"])).collect()} == cases


def test_fixed_chunks_of_dense_scripts_equal_the_closed_form(spark):
    plain = "word " * 300
    closed = chunking.fixed_chunks(spark.createDataFrame([(1, plain)], "doc_id long, text string"), 64, 8).orderBy("seq").collect()
    slid = list(chunking.slide(plain.strip(), 64, 8))
    assert [(r.seq, r.content, r.token_count, r.char_start, r.char_end) for r in closed] == slid
    hindi = chunking.fixed_chunks(spark.createDataFrame([(2, "नमस्ते दुनिया " * 60)], "doc_id long, text string"), 64, 8).collect()
    assert len(hindi) > 1 and all(r.token_count <= 64 for r in hindi)


def _plain_recursion(text, low, high, most, separators):
    """Places of pieces by trying every end one by one."""
    if chunking.tokens(text[low:high]) <= most or not separators:
        return [(low, high)]
    sep = separators[0]
    cuts, at = [], low
    while sep and (at := text.find(sep, at, high)) >= 0:
        cuts.append(at)
        at += len(sep)
    cuts = cuts if sep else [(low + high) // 2]
    parts = list(zip([low, *[c + len(sep) for c in cuts]], [*cuts, high], strict=True))
    out, k = [], 0
    while k < len(parts):
        start, end = parts[k]
        k += 1
        if start == end:
            continue
        if chunking.tokens(text[start:end]) > most:
            out += _plain_recursion(text, start, end, most, separators[1:])
            continue
        while k < len(parts) and chunking.tokens(text[start : parts[k][1]]) <= most:
            end = parts[k][1]
            k += 1
        out.append((start, end))
    return out


def test_recursive_chunks_equal_the_plain_version():
    rng = random.Random(41)
    bits = ["\n\n", "\n", ". ", " ", "a", "bc", "word", "नम", "..", "  ", "x" * 7, "\t"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        most = rng.randrange(1, 7)
        got = chunking.recursive_spans(t, most)
        want = [t[a:b].strip() for a, b in _plain_recursion(t, 0, len(t), most, chunking.SEPARATORS)]
        assert [t[a:b] for a, b in got] == [x for x in want if x], t
        assert all(a < b for a, b in got) and [x for span in got for x in span] == sorted(x for span in got for x in span)
    t = "First paragraph of words.\n\nSecond paragraph of words here.\n\nThird one, a little longer than the others."
    assert [t[a:b] for a, b in chunking.recursive_spans(t, 15)] == ["First paragraph of words.\n\nSecond paragraph of words here.", "Third one, a little longer than the others."]


def test_windows_cover_the_text():
    rng = random.Random(42)
    for _ in range(500):
        t = "".join(rng.choice("ab नम\n") for _ in range(rng.randrange(1, 200))).strip()
        size = rng.randrange(2, 12)
        overlap = rng.randrange(size)
        got = list(chunking.slide(t, size, overlap))
        assert all(chunking.tokens(t[a:b]) <= size and n == chunking.tokens(t[a:b]) and c == t[a:b].strip() for _, c, n, a, b in got)
        assert not t or (got[0][3] == 0 and got[-1][4] == len(t) and [w[0] for w in got] == list(range(len(got))))
        assert all(not t[x[4] : y[3]].strip() for x, y in zip(got, got[1:], strict=False))


def test_fixed_chunks_of_long_texts_take_linear_time(spark):
    began = time.monotonic()
    got = chunking.fixed_chunks(spark.createDataFrame([(1, "some words é " * 1_000_000)], "doc_id long, text string"))
    assert got.agg(F.max("char_end")).first()[0] == 12_999_999 and time.monotonic() - began < 60


def _plain_structure(elements, most):
    """(content, path, is table, start, end, pages): of each stretch between headings and tables, the longest run of texts
    and images that fits, found by joining strings, then the next."""
    out = []
    length = lambda e: len(e["text"] or "") if e["kind"] in ("heading", "text") or (e["kind"] == "image" and (e["text"] or "").strip()) else 0
    read = lambda i: sum(length(e) for e in elements[:i])
    walls = [i for i, e in enumerate(elements) if e["kind"] in ("heading", "table")]
    for low, high in zip([0, *[w + 1 for w in walls]], [*walls, len(elements)], strict=True):
        path = " > ".join(_titles(elements[:low])) or "Root"
        items = [i for i in range(low, high) if elements[i]["kind"] == "text" or (elements[i]["kind"] == "image" and length(elements[i]))]

        def shown(some):
            parts = [("\n\n", elements[i]["text"] or "") if elements[i]["kind"] == "text" else ("\n", f"[Image: {elements[i]['text']}]") for i in some]
            return "".join((glue if k else "") + x for k, (glue, x) in enumerate(parts))

        while items:
            n = next((k for k in range(1, len(items)) if elements[items[k]]["kind"] == "text" and chunking.tokens(shown(items[: k + 1])) > most), len(items))
            mine, items = items[:n], items[n:]
            paged = [i for i in mine if elements[i]["kind"] == "text" and elements[i]["page"] is not None]
            breaks = [i for i in range(paged[0], items[0] if items else len(elements)) if elements[i]["kind"] == "page_break" and elements[i]["page"] is not None and i < high] if paged else []
            pages = sorted(elements[i]["page"] for i in paged + breaks)
            if shown(mine).strip():
                out.append((shown(mine).strip(), path, False, read(mine[0]), read(mine[-1] + 1), pages[:1] + pages[-1:]))
        if high < len(elements) and elements[high]["kind"] == "table":
            e = elements[high]
            head, rows = e["headers"] or [], [" | ".join(r) for r in e["rows"] or []]
            top = " | ".join(head) + "\n" + " | ".join("---" for _ in head) + "\n" if head else ""
            while rows:
                n = max([k for k in range(1, len(rows) + 1) if chunking.tokens(top + "\n".join(rows[:k])) <= most], default=1)
                out.append((top + "\n".join(rows[:n]), path, True, None, None, [e["page"]] * 2 if e["page"] is not None else []))
                rows = rows[n:]
    return out


def _titles(before):
    """Titles of the headings above a place: the last heading, the last one before it of a lesser level, and so on."""
    found, level = [], 10**9
    for e in reversed([e for e in before if e["kind"] == "heading"]):
        if (e["level"] or 1) < level:
            found, level = [e["text"] or "", *found], e["level"] or 1
    return found


def test_structure_chunks_equal_the_plain_version():
    rng = random.Random(43)
    for _ in range(4000):
        elements = []
        for _ in range(rng.randrange(12)):
            kind = rng.choice(["heading", "text", "text", "text", "table", "image", "page_break", "other"])
            text_ = rng.choice([None, "", " ", "ab", "words of text " * rng.randrange(1, 4), "नमस्ते"])
            e = {"kind": kind, "text": text_, "level": rng.choice([None, 1, 2, 3]), "headers": rng.choice([None, [], ["h", "k"]]), "rows": rng.choice([None, [], [["1", "2"]] * rng.randrange(1, 6)]), "page": rng.choice([None, 1, 2, 3])}
            elements.append(e | {"heading": {"level": e["level"] or 1, "title": text_ or ""} if kind == "heading" else None})
        most = rng.randrange(1, 14)
        got = [(c[3], c[8], c[9], c[5], c[6], [x for x in c[10:] if x is not None]) for c in chunking.document_chunks(5, elements, most)]
        assert got == _plain_structure(elements, most), (elements, most)


def test_structure_chunks(spark):
    md = "# Architecture\nSome words on it.\n## Storage Engine\nMore words.\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    e = parsers.parse_text(spark.createDataFrame([(1, md)], "doc_id long, text string"))
    assert [r.kind for r in e.orderBy("ord").collect()].count("heading") == 2
    rows = chunking.structure_chunks(e, 40).orderBy("seq").collect()
    assert any(r.is_table and r.section_path == "Architecture > Storage Engine" for r in rows)


def test_html_modes(spark):
    page = "<html><head><style>p{}</style></head><body><script>var x = '<p>';</script><h1>Title</h1><p>One &amp; two</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = parsers.parse_html(df).orderBy("ord").collect()
    assert [r.kind for r in got] == ["heading", "text", "table"]
    assert got[1].text == "One & two" and got[2].headers == ["a", "b"] and got[2].rows == [["1", "2"]]
    assert parsers.parse_html(df, mode="line").count() == 0


def test_csv_groups(spark):
    df = spark.createDataFrame([(1, 'id,name,role\n1,"a, b",x\n2,c,y\n\n3,d,z')], "doc_id long, text string")
    t = parsers.parse_csv(df, group=2).orderBy("ord").collect()
    assert [len(r.rows) for r in t] == [2, 1] and t[0].headers == ["id", "name", "role"] and t[0].rows[0] == ["1", "a, b", "x"]


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_office_formats_and_limits(spark):
    w = 'xmlns:w="w"'
    docx = _zip(**{"word__document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    files = spark.createDataFrame([(1, bytearray(docx)), (2, bytearray(b"no zip")), (3, bytearray(_zip(**{"..__..__x": "y"})))], "doc_id long, content binary")
    good, bad = parsers.parse_binary(files, parsers.docx_elements)
    assert [(r.kind, r.text, r.level) for r in good.orderBy("ord").collect()][:2] == [("heading", "Head", 2), ("text", "Body", None)]
    assert {r.doc_id for r in bad.collect()} == {2, 3}
    xlsx = _zip(**{"xl__sharedStrings.xml": "<sst><si><t>n</t></si></sst>", "xl__worksheets__sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c></row><row><c><v>7</v></c></row></sheetData></worksheet>'})
    assert parsers.xlsx_elements(xlsx) == [{"kind": "table", "headers": ["n"], "rows": [["7"]]}]
    with pytest.raises(parsers.LimitError):
        parsers.read_zip(_zip(a="A" * 4000), lambda n: True, 1024)


def test_synthetic_vectors_repeat():
    a, b = vectors.synthesize([1, 20, 2], 8), vectors.synthesize([1, 20, 2], 8)
    assert np.array_equal(a, b) and np.all(np.abs(a) <= 1)


def test_long_html_tables_stay_whole(spark):
    from lodestone.sources.parsers import parse_html

    rows = "".join(f"<tr><td>a{i}</td><td>b{i}</td></tr>" for i in range(2500))
    page = f"<h1>Title</h1><p>before</p><table>{rows}</table><p>after one</p><h2>Next</h2><p>after two</p>"
    got = [(r.kind, r.text, r.section, len(r.rows or [])) for r in parse_html(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("ord").collect()]
    assert got == [("heading", "Title", "Title", 0), ("text", "before", "Title", 0), ("table", None, "Title", 2499), ("text", "after one", "Title", 0), ("heading", "Next", "Next", 0), ("text", "after two", "Next", 0)]
