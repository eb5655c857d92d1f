"""Scalar text functions as column expressions: token estimates, hashes, sanitizers, judges, formats.

Lengths count code points. All functions give null for null unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts that take two characters to a token.
DENSE_SCRIPTS = "ऀ-ॿಀ-೿"

# Patterns that a retrieved chunk must not carry into a prompt, in the order in which they apply.
TOOL_PATTERNS = (
    r"(?is)<\s*tool_call\s*>.*?</\s*tool_call\s*>",
    r"(?is)<\s*tool_request\s*>.*?</\s*tool_request\s*>",
    r"(?is)<\s*function_call\s*>.*?</\s*function_call\s*>",
    r'(?is)\{\s*"call"\s*:\s*".*?"\s*,.*?\}',
)
INJECTION_PATTERNS = (
    r"(?i)\bignore\s+(all\s+)?previous\s+instructions?\b",
    r"(?i)\bdisregard\s+(all\s+)?(prior|system|previous)\s+(instructions?|prompts?)\b",
    r"(?i)\bsystem\s+override\b",
    r"(?i)\byou\s+are\s+now\s+in\s+(developer|dan|jailbreak)\s+mode\b",
    r"(?i)\bdo\s+anything\s+now\b",
    r"(?i)\bact\s+as\s+(an?\s+)?unrestricted\b",
    r"(?i)\bprint\s+(the\s+)?(system\s+prompt|secret\s+key|api\s+key)\b",
    r"(?i)\brepeat\s+the\s+words?\s+above\b",
)
FILTERED, NEUTRALIZED = "[UNTRUSTED_CONTENT_FILTERED]", "[COMMAND_NEUTRALIZED]"

# Words that mark a demanding question.
COMPLEX_WORDS = (
    "compare", "contrast", "analyze", "synthesize", "explain why", "evaluate", "difference between", "pros and cons",
    "step by step", "elaborate", "derive", "conclude", "implications", "relationship between", "how does", "summarize in depth",
)

# Phrases by which an answer declines; the last is the engine's own refusal.
REFUSALS = (
    "i don't know",
    "i do not know",
    "not mentioned in the context",
    "cannot answer based on",
    "insufficient information",
    "context does not contain",
    "no information provided",
    "do not have enough information to answer",
)

CITATION = r"\[([a-zA-Z0-9_-]+)\]"
SNIPPET = 200


def char_ratio_tokens(text: Column) -> Column:
    """Half a token for a character of a dense script, a quarter for others, truncated; at least 1, 0 for an empty text."""
    # Removing the few dense characters is cheap; removing all others would match nearly every character.
    dense = F.length(text) - F.length(F.regexp_replace(text, f"[{DENSE_SCRIPTS}]", ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(dense / 2.0 + (F.length(text) - dense) / 4.0).cast("int")))


def word_tokens(text: Column) -> Column:
    """Words times 1.33, truncated; at least 1, 0 for a blank text."""
    n = F.size(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"))
    return F.when(text.rlike(r"^\s*$"), 0).otherwise(F.greatest(F.lit(1), F.floor(n * 1.33).cast("int")))


def provider_tokens(text: Column) -> Column:
    """Words * 4 div 3 + 1, in integers; a blank text has no words."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    return F.floor(n * 4 / 3).cast("int") + 1


def quarter_tokens(text: Column) -> Column:
    """A quarter of the length; at least 1, 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"\s+"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' sets of lower-cased words, split at white space."""
    x, y = token_set(a), token_set(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def rrf_score(rank: Column, k: int = 60) -> Column:
    """Reciprocal rank; rank counts from 1."""
    return 1.0 / (F.lit(k) + rank)


def _codes(text: Column) -> Column:
    """Code points. ascii() reads the first character of a string."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def java_hash(text: Column) -> Column:
    """The 31-polynomial string hash modulo 2^32, as a long in [0, 2^32)."""
    return F.aggregate(_codes(text), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295)))


def embedding_tokens(text: Column, max_length: int = 128, vocabulary: int = 32_000) -> Column:
    """Begin id 1, an id from 10 upward for each word's hash (twice for words outside ASCII), end id 2."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.split(trimmed, r"\s+")

    def ids(w: Column) -> Column:
        one = (java_hash(w).bitwiseAND(F.lit(2147483647)) % (vocabulary - 10) + 10).cast("int")
        return F.when(w.rlike(r"[^\x00-\x7f]"), F.array(one, one)).otherwise(F.array(one))

    # No more words than fit can matter.
    body = F.slice(F.flatten(F.transform(F.slice(words, 1, max_length), ids)), 1, max_length - 2)
    ends = [F.array(F.lit(1)), F.array(F.lit(2))]
    return F.when(trimmed == "", F.concat(*ends)).otherwise(F.concat(ends[0], body, ends[1]))


def phrase_prefix_query(text: Column) -> Column:
    """A full-text query for the phrase as a prefix: quotes dropped, trimmed, quoted, starred; an empty phrase for none."""
    bare = F.trim(F.translate(text, "\"'", ""))
    return F.when(bare == "", '""').otherwise(F.concat(F.lit('"'), bare, F.lit('"*')))


def metadata_to_json(m: Column) -> Column:
    return F.to_json(m)


def metadata_from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def sanitize_chunk(text: Column) -> Column:
    """Tool markup is filtered first, then instructions are neutralized."""
    for p in TOOL_PATTERNS:
        text = F.regexp_replace(text, F.lit(p), F.lit(FILTERED))
    for p in INJECTION_PATTERNS:
        text = F.regexp_replace(text, F.lit(p), F.lit(NEUTRALIZED))
    return text


def wrap_chunk(chunk_id: Column, text: Column, nonce: Column) -> Column:
    """A chunk between fences that carry the caller's nonce."""
    return F.concat(F.lit('<<<RETRIEVED_CHUNK id="'), chunk_id, F.lit('" nonce="'), nonce, F.lit('">>>\n'), text, F.lit('\n<<<END_RETRIEVED_CHUNK nonce="'), nonce, F.lit('">>>'))


def cited_ids(answer: Column) -> Column:
    """Distinct ids in brackets, in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)))


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)


def citation_page(metadata: Column) -> Column:
    """The page from page_number, page or page_start, whichever is first a whole number."""
    return F.coalesce(*[metadata[k].try_cast("int") for k in ("page_number", "page", "page_start")])


def is_complex(query: Column, turns: Column, max_tokens: Column) -> Column:
    low = F.lower(query)
    word = F.lit(False)
    for w in COMPLEX_WORDS:
        word = word | low.contains(w)
    points = F.when(word, 2).otherwise(0) + (F.length(query) > 250).cast("int") + (turns >= 6).cast("int") + (max_tokens >= 800).cast("int")
    return points >= 2


def json_problem(text: Column, required: list[str] | None = None) -> Column:
    """Why a text is not acceptable as JSON output, null if it is: delimiters, nesting, then required names.

    A fold keeps the stack of open delimiters as a string, whether a string is
    open and whether the next character is escaped.
    """
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    start = F.struct(F.lit("").alias("stack"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(None).cast("string").alias("error"))

    def step(s: Column, c: Column) -> Column:
        top = F.right(s["stack"], F.lit(1))
        closes = F.when(c == "}", "{").when(c == "]", "[")
        outside = ~s["quoted"] & ~s["escaped"]
        pops = outside & closes.isNotNull()
        wrong = pops & ((s["stack"] == "") | (top != closes))
        return F.struct(
            F.when(s["error"].isNotNull(), s["stack"])
            .when(outside & c.isin("{", "["), F.concat(s["stack"], c))
            .when(pops & ~wrong, F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - 1))
            .otherwise(s["stack"])
            .alias("stack"),
            F.when(~s["escaped"] & (c == '"'), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (~s["escaped"] & s["quoted"] & (c == "\\")).alias("escaped"),
            F.coalesce(s["error"], F.when(wrong, F.when(c == "}", "unmatched closing brace").otherwise("unmatched closing bracket"))).alias("error"),
        )

    end = F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), start, step)
    objects = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    missing = F.lit(None).cast("string")
    for name in reversed(required or []):
        missing = F.when(~t.contains(f'"{name}"'), F.lit(f"missing required field: {name}")).otherwise(missing)
    return (
        F.when(t == "", "empty response")
        .when(~objects, "no JSON delimiters")
        .otherwise(F.coalesce(end["error"], F.when(end["quoted"], "unterminated string").when(end["stack"] != "", "unclosed delimiter"), missing))
    )


def context_budget(window: Column, max_output: Column, history: Column, system: int = 200, query: int = 100) -> Column:
    """Tokens left for context: the window less output, history, prompt and a margin of a tenth (128 to 512); at least 256."""
    margin = F.least(F.lit(512), F.greatest(F.lit(128), F.floor(window * 0.1)))
    return F.greatest(F.lit(256), window - (F.greatest(F.lit(256), max_output) + history + system + query + margin)).cast("int")


def model_family(model_id: Column) -> Column:
    low = F.lower(model_id)
    return F.when(low.contains("gemma"), "GEMMA").when(low.contains("gemini"), "GEMINI").when(low.contains("claude") | low.contains("anthropic"), "CLAUDE").otherwise("OPENAI")


def _judge_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-zA-Z0-9]+"), lambda w: F.length(w) > 3)


def _share_in(words: Column, text: Column) -> Column:
    hits = F.size(F.filter(words, lambda w: text.contains(w)))
    return F.when(F.size(words) == 0, 1.0).otherwise(hits / F.size(words))


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's longer words that occur in the joined context (array<string>); 0 for a blank answer."""
    return F.when(answer.rlike(r"^\s*$"), 0.0).otherwise(_share_in(_judge_words(answer), F.lower(F.array_join(context, " "))))


def faithful(score: Column) -> Column:
    return score >= 0.70


def relevance(question: Column, answer: Column) -> Column:
    """Share of the question's longer words in the answer; at least 0.85 for answers over 20 characters."""
    base = _share_in(_judge_words(question), F.lower(answer))
    return F.when(answer.rlike(r"^\s*$"), 0.0).when(F.length(answer) > 20, F.greatest(base, F.lit(0.85))).otherwise(base)


def relevant(score: Column, answer: Column) -> Column:
    return ~answer.rlike(r"^\s*$") & ((score >= 0.50) | (F.length(answer) > 20))


def refuses(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(False)
    for p in REFUSALS:
        out = out | low.contains(p)
    return out


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_")


def format_bytes(n: Column) -> Column:
    """512 B, 1.5 KB, 2.0 MB and so on, in powers of 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}B", n / float(1024**i))).otherwise(out)
    return out


def markdown_segments(text: Column) -> Column:
    """array<struct<kind, body>>: fenced code, tables (a bar line followed by a rule line) and the text around them. A bar
    line that no rule follows is text. A fold over the lines keeps the open segment."""
    lines = F.split(text, "\n")
    marked = F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.get(lines, i + 1).alias("after")))
    seg = "array<struct<kind:string,body:string>>"
    start = F.struct(F.array().cast(seg).alias("done"), F.lit("").alias("kind"), F.lit("").alias("body"))

    def step(s: Column, line: Column) -> Column:
        x, bar = line["x"], line["x"].rlike(r"^\s*\|.*\|\s*$")
        fence = F.trim(x).startswith("```")
        rule = F.coalesce(line["after"].rlike(r"^\s*\|[\s:|-]*---[\s:|-]*\|?\s*$"), F.lit(False))
        in_code = s["kind"] == "code"
        kind = F.when(in_code, "code").when(fence, "code").when(bar & (rule | (s["kind"] == "table")), "table").otherwise("text")
        closed = F.when(F.trim(s["body"]) != "", F.concat(s["done"], F.array(F.struct(s["kind"].alias("kind"), s["body"].alias("body"))))).otherwise(s["done"])
        ends = in_code & fence
        joined = F.when(s["body"] == "", x).otherwise(F.concat(s["body"], F.lit("\n"), x))
        return (
            F.when(ends, F.struct(F.concat(s["done"], F.array(F.struct(F.lit("code").alias("kind"), s["body"].alias("body")))).alias("done"), F.lit("").alias("kind"), F.lit("").alias("body")))
            .when(fence, F.struct(closed.alias("done"), F.lit("code").alias("kind"), F.lit("").alias("body")))
            .when(s["kind"] == kind, F.struct(s["done"].alias("done"), kind.alias("kind"), joined.alias("body")))
            .otherwise(F.struct(closed.alias("done"), kind.alias("kind"), x.alias("body")))
        )

    return F.aggregate(marked, start, step, lambda s: F.when(F.trim(s["body"]) != "", F.concat(s["done"], F.array(F.struct(s["kind"].alias("kind"), s["body"].alias("body"))))).otherwise(s["done"]))


def clean_html(text: Column) -> Column:
    """Tags to spaces, five entities, white space collapsed and trimmed."""
    t = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, value in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        t = F.replace(t, F.lit(entity), F.lit(value))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def signature_payload(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def retry_delay(attempt: Column, first: int = 200, most: int = 2000, factor: float = 2.0) -> Column:
    """Milliseconds before retry number `attempt` (from 1)."""
    return F.least(F.lit(most), F.floor(F.lit(first) * F.pow(F.lit(factor), attempt - 1))).cast("long")


def batch_size(thermal: Column, free_ratio: Column, base: int = 16, least: int = 1) -> Column:
    """Embedding batch under heat and memory pressure."""
    heat = F.when(thermal == "MODERATE", base * 3 // 4).when(thermal == "THROTTLED", base // 2).when(thermal == "CRITICAL", least).otherwise(base)
    memory = F.when(free_ratio < 0.15, 0.5).when(free_ratio < 0.30, 0.75).otherwise(1.0)
    return F.least(F.lit(base), F.greatest(F.lit(min(least, base)), F.floor(heat * memory).cast("int")))


def throttle_delay(thermal: Column) -> Column:
    return F.when(thermal == "MODERATE", 50).when(thermal == "THROTTLED", 250).when(thermal == "CRITICAL", 1000).otherwise(0)
