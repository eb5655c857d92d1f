"""Line dedup by a log-template tree of fixed depth. DataFrame functions only.

A line's tokens are its runs of anything but ASCII white space; tokens with a
digit become <*>. The tree's first level is the number of tokens, the next levels
are the LEADING first tokens; a leaf holds the lines that agree in all of them.
Within a leaf a token is fixed at its position if lines of MIN_DOCS documents have
it there, and a variable field, <*>, otherwise. A line's template is what is left.
Templates with at least half their tokens fixed that lines of MIN_DOCS documents
share are recurring: their lines are dropped, save the first (by doc_id, then a
hash of the text, then position), so that no passage vanishes from the corpus.
Lines with more fields than that recur only as they stand: those whose own tokens
MIN_DOCS documents share are dropped in the same way, whatever digits they hold.

Only distinct lines in leaves that hold several of them and that documents share
are ever cut into tokens; other lines pass by as hashes.

Defined results: a null text has no lines and stays null; lines without tokens are
kept; a document whose lines are all dropped has an empty text; rows with equal
doc_id and text are one document and get equal results; null doc_ids come last;
a very long text is cut into its lines and each is looked at once; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, remove, staged

LEADING = 4
MIN_DOCS = 2
FIELD = "<*>"
#: Keys of leaves, eight bytes each, go to every task up to this number; beyond it they are joined.
BROADCAST_LEAVES = 1_000_000
_GAP = r"[\x20\x09-\x0D]+"
#: A token with a digit: from a token's start, without looking at any character twice.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*"


def plain_line(line: Column) -> Column:
    """The line's tokens, joined by one space."""
    odd = line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, _GAP, " ")).otherwise(line))


def masked_line(line: Column) -> Column:
    """The line's tokens, joined by one space, with variable ones replaced."""
    plain = plain_line(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, _VARIABLE, FIELD)).otherwise(plain)


def token_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _doc_key() -> Column:
    """Rows with equal doc_id and text are one document."""
    return F.xxhash64("doc_id", "text")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, pos, raw, line, leaf, h): lines that have tokens, raw and masked, with hashes of their leaf and of the masked line."""
    rows = docs.select(_doc_key().alias("doc"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    # Blank lines go by a look at the raw line: a filter on the masked one would compute it twice.
    rows = rows.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).select("doc", "doc_id", "pos", "raw", masked_line(F.col("raw")).alias("line"))
    return rows.withColumns({"leaf": F.xxhash64(token_count(F.col("line")), F.substring_index("line", " ", LEADING)), "h": F.xxhash64("line")})


def recurring_lines(docs: DataFrame) -> tuple[DataFrame, str]:
    """(doc, doc_id, pos) of the lines to drop, and the staged table behind it.

    A line is known by the hashes of its leaf and of itself, 128 bits together. In
    a leaf with one distinct line that line is its own template, and if documents
    share it all its tokens are fixed; only leaves with several distinct lines
    are analysed token by token. Lines that are not solid have no template; exact,
    the hash of the line before masking, finds their repeats.
    """
    words = token_count(F.col("line"))
    fields = F.size(F.filter(F.split("line", " "), lambda t: t == FIELD))
    solid = F.when(F.col("line").contains(FIELD), (words - fields) * 2 >= words).otherwise(True)
    hashed, path = staged(_lines(docs).select("doc", "doc_id", "pos", "leaf", "h", F.when(~solid, F.xxhash64(plain_line(F.col("raw")))).alias("exact")), "lines")
    # Each distinct line with the least and greatest document that has it: enough to know whether there are two.
    per_line, per_line_path = staged(hashed.groupBy("leaf", "h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.bool_and(F.col("exact").isNull()).alias("solid")), "distinct-lines")
    leaves = per_line.groupBy("leaf").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b")
    several = leaves.where("n > 1").select(F.col("leaf").alias("s_leaf"))
    several, several_path = staged(several, "shared-leaves")
    single = per_line.where("solid").join(leaves.where("n = 1").select("leaf"), "leaf", "left_semi").select("leaf", "h", F.col("h").alias("template"))
    repeats = hashed.where("exact is not null").groupBy("leaf", "exact").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("leaf", F.col("exact").alias("h"), F.col("exact").alias("template"))

    wanted = F.broadcast(several) if several.count() <= BROADCAST_LEAVES else several
    texts = _lines(docs).join(wanted, F.col("leaf") == F.col("s_leaf"), "left_semi").select("leaf", "h", "line").dropDuplicates(["leaf", "h"])
    tokens = texts.join(per_line.drop("solid"), ["leaf", "h"]).select("leaf", "h", "a", "b", F.posexplode(F.split("line", " ")).alias("at", "t"))
    tokens, tokens_path = staged(tokens.select("leaf", "h", "a", "b", "at", F.xxhash64("t").alias("t"), (F.col("t") == FIELD).alias("field")), "line-tokens")
    fixed = tokens.groupBy("leaf", "at", "t").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("leaf", "at", "t", F.lit(True).alias("fixed"))
    spelled = tokens.join(fixed, ["leaf", "at", "t"], "left").withColumn("fixed", F.col("fixed").isNotNull())
    # One hash for each position, in order, is the template; a line has as many as its own tokens.
    word = F.when(F.col("fixed"), F.col("t"))
    template = F.xxhash64(F.array_sort(F.collect_list(F.struct("at", word.alias("t")))))
    per_template = spelled.groupBy("leaf", "h").agg(template.alias("template"), F.count(F.when(F.col("fixed") & ~F.col("field"), 1)).alias("k"), F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    per_template, per_template_path = staged(per_template.where("k * 2 >= n").drop("k", "n"), "templates")
    recurring = per_template.groupBy("leaf", "template").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("leaf", "template")
    analysed = per_template.join(recurring, ["leaf", "template"], "left_semi").select("leaf", "h", "template")
    of_line = analysed.unionByName(single).unionByName(repeats)
    hits, hits_path = staged(hashed.withColumn("h", F.coalesce("exact", "h")).join(of_line, ["leaf", "h"]).select("doc", "doc_id", "pos", "leaf", "template"), "recurring")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("doc"), F.col("pos"))
    firsts = hits.groupBy("leaf", "template").agg(F.min(place).alias("keep")).select(F.col("keep.doc").alias("k_doc"), F.col("keep.doc_id").alias("k_id"), F.col("keep.pos").alias("k_pos"))
    # A line's place names it alone, so a template that fills the corpus does not meet in one task.
    first = (F.col("doc") == F.col("k_doc")) & F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("pos") == F.col("k_pos"))
    drop = hits.join(firsts, first, "left_anti").select("doc", "doc_id", "pos")
    remove(docs.sparkSession, path, per_line_path, several_path, tokens_path, per_template_path)
    return drop, hits_path


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) with n_lines, n_dropped, dropped (positions from 0) and kept_text, in place of columns
    of these names; others are carried, whatever their names."""
    drop, _ = recurring_lines(docs.select("doc_id", "text"))
    per_doc = drop.groupBy(F.col("doc").alias("__d"), F.col("doc_id").alias("__d_id")).agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    rest = docs.drop("n_lines", "n_dropped", "dropped", "kept_text")
    key, of, of_id = (fresh(rest, c) for c in ("__key", "__d", "__d_id"))
    # The hash and the doc_id together: texts whose hashes meet are told apart unless their ids are equal as well.
    per_doc = per_doc.withColumnsRenamed({"__d": of, "__d_id": of_id})
    out = rest.withColumn(key, _doc_key()).join(per_doc, (F.col(key) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(of_id)), "left").drop(of, of_id, key)
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    split = F.split("text", "\n", -1)
    # An array of one struct carries the lines and the places that stay into the lambda, so that each is computed once.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), dropped)
    cut = F.transform(F.array(F.struct(split.alias("s"), stay.alias("k"))), lambda z: F.array_join(F.transform(z["k"], lambda i: F.element_at(z["s"], i + 1)), "\n"))
    kept = F.when(F.size(dropped) == 0, F.col("text")).otherwise(F.element_at(cut, 1))
    return out.withColumns({"n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(split)), F.lit(0)).cast("long"), "n_dropped": F.size(dropped).cast("long"), "kept_text": kept, "dropped": dropped})
