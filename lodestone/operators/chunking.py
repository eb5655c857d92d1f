"""Chunkers: one document to many chunks.

Every chunker takes (doc_id, text) or (doc_id, elements) and returns
(doc_id, chunk_id, seq, content, token_count, char_start, char_end, content_hash)
with what more it knows. Documents without text give no chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import DENSE_SCRIPTS, quarter_tokens

CHUNK = "doc_id long, chunk_id string, seq int, content string, token_count int, char_start int, char_end int, content_hash string"
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
TABLE_RULE = "---"


DENSE = re.compile(f"[{DENSE_SCRIPTS}]")


def weight(text: str) -> int:
    """Quarters of a token: two for a character of a dense script, one for others."""
    return len(text) + len(DENSE.findall(text))


def tokens(text: str) -> int:
    """The Python twin of char_ratio_tokens."""
    return max(1, weight(text) // 4) if text else 0


def digest(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()


def trimmed(text: Column) -> Column:
    """Without white space at either end. The pattern for the end begins where a run begins, so inner runs are left at once."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"(?<!\s)\s+$", "")


def format_table(headers: Column, rows: Column) -> Column:
    """Rows of cells joined by bars; headers first with a rule below."""
    line = lambda cells: F.array_join(cells, " | ")
    head = F.when(F.size(headers) > 0, F.concat(line(headers), F.lit("\n"), line(F.transform(headers, lambda _: F.lit(TABLE_RULE))), F.lit("\n"))).otherwise("")
    return F.concat(head, F.array_join(F.transform(rows, lambda r: F.concat(line(r), F.lit("\n"))), ""))


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of `size` tokens that overlap by `overlap` tokens.

    Where every character counts a quarter token all windows are equally long, so
    one pattern, a look-ahead of a window's length that moves on by a step, reads
    them all in one pass and no row carries the whole text beside its window. Texts
    with dense scripts are windowed by an Arrow function with the same rule.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and below it")
    width = 4 * size + 3
    back = min(max(1, int(width * overlap / size)), width - 1) if overlap else 0
    step = width - back
    # Conditions look at the raw text: on the trimmed one they would trim again for every condition.
    some = docs.where(F.col("text").rlike(r"\S"))
    dense = F.col("text").rlike(f"[{DENSE_SCRIPTS}]")
    base = lambda which: some.where(which).select(F.col("doc_id").cast("long").alias("doc_id"), trimmed(F.col("text")).alias("t"))
    n = F.length("t")
    count = F.greatest(F.lit(1), F.ceil((n - width) / step) + 1).cast("int")
    windows = F.regexp_extract_all("t", F.lit(f"(?s)(?=(.{{1,{width}}})).{{1,{step}}}"), F.lit(1))
    cut = base(~dense).select("doc_id", F.posexplode(F.slice(windows, 1, count)).alias("seq", "raw"))
    cut = cut.withColumn("char_start", F.col("seq") * step).withColumn("char_end", F.col("char_start") + F.length("raw"))
    plain = cut.select("doc_id", "seq", trimmed(F.col("raw")).alias("content"), quarter_tokens(F.col("raw")).alias("token_count"), "char_start", "char_end")

    def windowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *w) for i, t in zip(b["doc_id"], b["t"], strict=True) for w in slide(t, size, overlap)]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "content", "token_count", "char_start", "char_end"])

    other = base(dense).mapInPandas(windowed, "doc_id long, seq int, content string, token_count int, char_start int, char_end int")
    out = plain.unionByName(other).where("content <> ''")
    ident = F.concat_ws("_chk_", F.col("doc_id").cast("string"), F.col("seq").cast("string"))
    return out.select("doc_id", ident.alias("chunk_id"), "seq", "content", "token_count", "char_start", "char_end", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


def page_ranges(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_start and page_end: least and greatest page whose characters [start, end) overlap the chunk's; 1 for none.
    Pages of a document meet its chunks by document only, in the order of both."""
    lists = pages.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "page")).alias("__p"))
    j = chunks.join(lists, "doc_id", "left")
    hit = F.transform(F.filter(F.col("__p"), lambda p: (p["start"] < F.col("char_end")) & (p["end"] - 1 >= F.col("char_start"))), lambda p: p["page"])
    return j.withColumns({"page_start": F.coalesce(F.array_min(hit), F.lit(1)), "page_end": F.coalesce(F.array_max(hit), F.lit(1))}).drop("__p")


def quarters(text: str) -> np.ndarray:
    """Running sums of the characters' weights in quarters of a token: entry i is that of text[:i]."""
    weight = np.ones(len(text) + 1, np.int64)
    weight[0] = 0
    weight[[m.end() for m in DENSE.finditer(text)]] = 2
    return np.cumsum(weight)


def slide(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int, int, int]]:
    """Windows of a trimmed text of any script: (seq, content, tokens, start, end). A window takes all that `size` tokens
    hold; the next begins before its end by its share `overlap` / tokens, rounded as single floats are."""
    upto, bounds, begin = quarters(text), [], 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + 4 * size + 3, side="right")) - 1)
        held = max(1, int(upto[end] - upto[begin]) // 4)
        bounds.append((begin, end, held))
        shared = min(max(1, int((end - begin) * np.float32(overlap / held))), end - begin - 1) if overlap else 0
        begin = len(text) if end == len(text) else end - shared
    full = [(text[a:b].strip(), held, a, b) for a, b, held in bounds]
    for seq, window in enumerate(w for w in full if w[0]):
        yield seq, *window


def fitting(begins: np.ndarray, ends: np.ndarray, most: int, ready: np.ndarray | None = None, heads: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of pieces, longest first from the left, that hold `most` tokens at most, or one piece.

    begins, ends: running weights where each piece begins and ends. ready: whether a
    run may end before a piece; heads: whether it may begin with one (by default any).
    """
    n = len(ends)
    heads = np.arange(n + 1) if heads is None else np.append(np.flatnonzero(heads), n)
    stops = np.arange(n + 1) if ready is None else np.append(np.flatnonzero(ready), n)
    i = int(heads[0])
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + 4 * (most + 1), side="left")))
        j = int(stops[np.searchsorted(stops, j)])
        yield i, j
        i = int(heads[np.searchsorted(heads, j)])


def recursive_spans(text: str, most: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Places of the pieces of at most `most` tokens: cut at the coarsest separator, neighbours together while they fit,
    what is still too long cut at the next one. The empty separator stands for the middle; halves may stay too long.

    Works through the separators, not through the pieces: `wide` holds the spans that are too long so far, and each
    separator cuts all of them by its places in the text and the running weights there.
    """
    if most < 1:
        raise ValueError("most must be at least 1")
    upto = quarters(text)
    wide, done = [(0, len(text))], []
    if upto[-1] < 4 * (most + 1):
        wide, done = done, wide
    for sep in separators:
        found = np.array([m.start() for m in re.finditer(re.escape(sep), text)] if sep and wide else [], np.int64)
        still = []
        for low, high in wide:
            at = found[np.searchsorted(found, low) : np.searchsorted(found, high - len(sep), side="right")] if sep else np.array([(low + high) // 2])
            begins, ends = np.concatenate([[low], at + len(sep)]), np.append(at, high)
            for i, j in fitting(upto[begins], upto[ends], most, heads=begins < ends):  # no run begins with an empty part
                a, b = int(begins[i]), int(ends[j - 1])
                (done if upto[b] - upto[a] < 4 * (most + 1) else still).append((a, b))
        wide = still
    spans = []
    for a, b in sorted(done + wide):
        piece = text[a:b]
        if piece.strip():
            spans.append((a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())))
    return spans


def per_document(docs: DataFrame, kind: str, cut: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """Chunks by a Python function of a whole text that gives their places: the shape of a user's own chunker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                for seq, (start, end) in enumerate(cut(t) if t else []):
                    rows.append((i, f"{i}_{kind}_{seq}", seq, t[start:end], tokens(t[start:end]), start, end, digest(t[start:end])))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNK.split(", ")])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, CHUNK)


def recursive_chunks(docs: DataFrame, most: int = 512) -> DataFrame:
    return per_document(docs, "rec", lambda t: recursive_spans(t, most))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), trimmed), lambda s: s != "")


def semantic_chunks(docs: DataFrame, embed: Callable[[Column], Column], threshold: float = 0.7, most: int = 512) -> DataFrame:
    """Runs of sentences: a new chunk begins where a sentence is unlike the one before or would make the chunk too long.

    embed: text column to array<double>. A document's sentences and vectors meet in
    one row, and one pass over them makes the groups.
    """
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    each = s.select("doc_id", F.posexplode("s").alias("pos", "sentence")).withColumn("v", embed(F.col("sentence")))
    rows = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence", "v"))).alias("s"))
    schema = "doc_id long, chunk_id string, seq int, content string, token_count int, content_hash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, s in zip(b["doc_id"], b["s"], strict=True):
                for seq, piece in enumerate(_similar_runs([x["sentence"] for x in s], [np.asarray(x["v"], float) for x in s], threshold, most)):
                    out.append((doc_id, f"{doc_id}_sem_{seq}", seq, piece, tokens(piece), digest(piece)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def _similar_runs(parts: list[str], vectors: list[np.ndarray], threshold: float, most: int) -> list[str]:
    out: list[str] = []
    group: list[str] = []
    size = dense = 0  # of the open group: characters and dense ones
    for i, s in enumerate(parts):
        n, heavy = len(s), weight(s) - len(s)
        if group:
            a, b = vectors[i - 1], vectors[i]
            both = float(np.linalg.norm(a) * np.linalg.norm(b))
            alike = min(1.0, max(-1.0, float(a @ b) / both)) if both > 0 else 0.0
            if alike < threshold or max(1, int((dense + heavy) / 2 + (size + 1 + n - dense - heavy) / 4)) > most:
                out.append(" ".join(group))
                group, size, dense = [], -1, 0
        else:
            size = -1
        group.append(s)
        size, dense = size + 1 + n, dense + heavy
    return [*out, " ".join(group)] if group else out


STRUCTURED = CHUNK + ", section_path string, is_table boolean, page_start int, page_end int"


def structure_chunks(elements: DataFrame, most: int = 512) -> DataFrame:
    """Chunks along a document's structure: headings end a chunk and set its section path (A > B), texts are joined
    while they fit, tables stand alone with their header repeated in every piece.

    elements: (doc_id, ord, kind, text, level, headers, rows, page). A document's
    elements are gathered in order; memory is bounded by one document.
    """
    heading = F.when(F.col("kind") == "heading", F.struct(F.coalesce(F.col("level").cast("int"), F.lit(1)).alias("level"), F.coalesce("text", F.lit("")).alias("title")))
    cols = ["ord", "kind", "text", heading.alias("heading"), "headers", "rows", "page"]
    per_doc = elements.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STRUCTURED.split(", ")]
        for b in batches:
            rows = [r for i, e in zip(b["doc_id"], b["e"], strict=True) for r in document_chunks(i, list(e), most)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_start": "Int32", "page_end": "Int32", "char_start": "Int32", "char_end": "Int32"})

    return per_doc.mapInPandas(run, STRUCTURED)


def section_paths(headings: list[dict]) -> list[str]:
    """The path that holds after each number of headings, from none on: a heading stays until one of its level or above."""
    out, open_ = ["Root"], {}
    for h in headings:
        open_ = {level: title for level, title in open_.items() if level < h["level"]} | {h["level"]: h["title"]}
        out.append(" > ".join(open_.values()) or "Root")
    return out


def table_pieces(headers: list[str], rows: list[list[str]], most: int) -> list[str]:
    """A table in pieces of whole rows, each under the header."""
    top = " | ".join(headers) + "\n" + " | ".join(TABLE_RULE for _ in headers) + "\n" if headers else ""
    lines = [" | ".join(r) for r in rows]
    # A line break stands before every row but a piece's first, so it belongs to the place where a row may follow.
    size = np.array([weight(x) + 1 for x in lines], np.int64)
    ends = np.cumsum(size) - 1
    return [top + "\n".join(lines[i:j]) for i, j in fitting(ends + 1 - size - weight(top), ends, most)]


def document_chunks(doc_id: int, elements: list[dict], most: int) -> list[tuple]:
    """The chunks of one document's elements, in order.

    Stretches between headings and tables are laid out as running sums: of the characters that the document has
    read so far (a chunk's place) and of the weights of what joins its texts (a chunk's size).
    """
    kinds = [e["kind"] for e in elements]
    text = [e["text"] or "" for e in elements]
    counts = [k in ("heading", "text") or (k == "image" and bool(t.strip())) for k, t in zip(kinds, text, strict=True)]
    read = np.concatenate([[0], np.cumsum([len(t) if c else 0 for t, c in zip(text, counts, strict=True)])]).astype(int)
    paths = section_paths([e["heading"] for e in elements if e["heading"] is not None])
    found: list[tuple] = []  # (kind, content, section path, is a table, pages, start, end)

    def joined(at: list[int], path: str, breaks: list[int]) -> None:
        """Chunks of the texts and images at the given places; breaks: places of page breaks among them."""
        is_text = np.array([kinds[i] == "text" for i in at])
        glue = ["\n\n" if t else "\n" for t in is_text]
        body = [text[i] if t else f"[Image: {text[i]}]" for i, t in zip(at, is_text, strict=True)]
        size = np.array([len(g) + weight(x) for g, x in zip(glue, body, strict=True)], np.int64)
        ends = np.cumsum(size)
        for i, j in fitting(ends - size + [len(g) for g in glue], ends, most, ready=is_text):
            content = (body[i] + "".join(g + x for g, x in zip(glue[i + 1 : j], body[i + 1 : j], strict=True))).strip()
            own = [(k, elements[k]["page"]) for k, t in zip(at[i:j], is_text[i:j], strict=True) if t and elements[k]["page"] is not None]
            until = at[j] if j < len(at) else len(elements)
            # A page break counts once a page is known.
            pages = [p for _, p in own] + [elements[k]["page"] for k in breaks if own and own[0][0] < k < until]
            if content:
                found.append(("struct", content, path, False, pages, int(read[at[i]]), int(read[at[j - 1] + 1])))

    walls = [i for i, k in enumerate(kinds) if k in ("heading", "table")]
    passed = 0
    for low, wall in zip([-1, *walls], [*walls, len(elements)], strict=True):
        inside = range(low + 1, wall)
        at = [i for i in inside if counts[i]]
        if at:
            joined(at, paths[passed], [i for i in inside if kinds[i] == "page_break" and elements[i]["page"] is not None])
        if wall < len(elements) and kinds[wall] == "heading":
            passed += 1
        elif wall < len(elements):
            e = elements[wall]
            pieces = table_pieces([] if e["headers"] is None else list(e["headers"]), [] if e["rows"] is None else [list(r) for r in e["rows"]], most)
            found += [("tbl", x, paths[passed], True, [e["page"]] if e["page"] is not None else [], None, None) for x in pieces]
    return [
        (doc_id, f"{doc_id}_{kind}_{seq}", seq, content, tokens(content), start, end, digest(content), path, table, min(pages, default=None), max(pages, default=None))
        for seq, (kind, content, path, table, pages, start, end) in enumerate(found)
    ]
