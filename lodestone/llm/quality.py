"""A quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of a whole text (lengths, repetition, symbols, lines) come from one
   pass over its bytes.
2. Small trees are boosted on a bounded sample of labelled rows; the path to each
   node is a rule, a conjunction of bounds on statistics.
3. A lasso logistic regression over the rules keeps few of them.
4. The kept rules are compiled to a Spark expression over the statistics.

Only labels with quality 0 or 1 count. Labels, language, source and ids are never
statistics. Fitting is deterministic: the sample is that of the smallest hashes.

The sample is the only bounded thing: MAX_LABELLED rows of labels, those with the
smallest hashes of their doc_id, and of documents with equal doc_id the one whose
text has the smallest hash. Trees split as finely as the sample allows, from two
rows of each class on; there is no size below which the model is another.

Defined results: null and empty texts have the statistics of an empty text and
get a score like others; a very long text is read whole, in one pass; equal texts
get equal scores; a label whose document is missing does not count; repeated
labels count as often as they stand; with no usable label the score is 0.5, with
one class its smoothed share; an empty table gives an empty result. Scoring keeps
the input's columns and adds only the named ones.
"""

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, release, small_batches

#: At most so many labelled rows fit the model; each gives a few hundred bytes to the driver.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 48, 0.3
#: Rows in a leaf of a tree: a twentieth of all rows, but no more than this.
LEAF = 10
LAMBDAS = (0.03, 0.01, 0.004, 0.0015, 0.0006)
THRESHOLD = 0.3

STATS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_next", "digits", "upper", "punctuation", "symbols", "exclamation",
    "bars", "non_ascii", "white", "line_words", "repeated_lines", "symbol_lines", "upper_words", "longest_word",
)

_DIGITS, _UPPER, _LOWER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_PUNCT, _SYMBOLS, _WHITE = b".,;:'\"()-?", b"#$%&*@^~<>{}[]\\_=+", b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))


def text_stats(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text, in the order of STATS."""
    b = (text or "").encode("utf-8", "replace")
    n = max(1, len(b))
    words = b.split()
    m = max(1, len(words))
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    lines = [x for x in b.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    noisy = sum(1 for x in lines if len(x) - len(x.translate(None, _SYMBOLS + b"|!")) > 0.04 * len(x))
    letters = b.translate(None, _LOWER)
    return (
        float(np.log1p(len(b))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / m,
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        share(_DIGITS),
        share(_UPPER),
        share(_PUNCT),
        share(_SYMBOLS),
        share(b"!"),
        share(b"|"),
        share(_HIGH),
        share(_WHITE),
        float(np.log1p(m / k)),
        1 - len(set(lines)) / k if lines else 0.0,
        noisy / k,
        (len(letters) - len(letters.translate(None, _UPPER))) / m,
        float(np.log1p(max(map(len, words), default=0))),
    )


_STRUCT = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])


def _stats(texts: pa.Array) -> pa.Array:
    """The statistics of a batch. One text at a time is a Python string."""
    rows = np.array([text_stats(t.as_py()) for t in texts]).reshape(-1, len(STATS))
    release()
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=list(STATS))


def stats_column(text: Column) -> Column:
    return F.arrow_udf(_stats, _STRUCT)(text)


Rule = tuple[tuple[int, float, float], ...]  # (statistic, above, up to): above < x <= up to


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self, stats: Column) -> Column:
        """The compiled ensemble: a sum of weighted conjunctions through the logistic function."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for k, low, high in rule:
                if np.isfinite(low):
                    test = test & (stats[STATS[k]] > float(low))
                if np.isfinite(high):
                    test = test & (stats[STATS[k]] <= float(high))
            z = z + F.when(test, float(w)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.intercept + rule_values(self.rules, x) @ np.array(self.weights)) if self.rules else np.full(len(x), _logistic(np.array(self.intercept)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def rule_values(rules: tuple[Rule, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, low, high in rule:
            out[:, j] *= (x[:, k] > low) & (x[:, k] <= high)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray) -> tuple[Rule, ...]:
    """The paths of boosted trees: each tree is fitted to the gradient left by those before it."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z = np.full(len(y), np.log(base / (1 - base)))
    leaf = max(1, min(LEAF, len(y) // 20))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = _logistic(z)
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        step = np.zeros(len(y))
        _grow(np.arange(len(y)), {}, 0, leaf, bins, cuts, g, h, rules, step)
        z = z + RATE * step
    return tuple(rules)


def _grow(rows: np.ndarray, bounds: dict[int, tuple[float, float]], depth: int, leaf: int, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rules: dict[Rule, None], step: np.ndarray) -> None:
    if depth:
        rules.setdefault(tuple((k, *bounds[k]) for k in sorted(bounds)))
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-3, -1, -1)
    if depth < DEPTH and len(rows) >= 2 * leaf:
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            left_g = np.cumsum(np.bincount(bins[rows, k], g[rows], len(c) + 1))[:-1]
            left_h = np.cumsum(np.bincount(bins[rows, k], h[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(bins[rows, k], minlength=len(c) + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(n < leaf) | (len(rows) - n < leaf)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), k, i)
    if best[1] < 0:
        step[rows] = total_g / (total_h + 1)
        return
    _, k, i = best
    low, high = bounds.get(k, (-np.inf, np.inf))
    cut = float(cuts[k][i])
    left = bins[rows, k] <= i
    _grow(rows[left], bounds | {k: (low, min(high, cut))}, depth + 1, leaf, bins, cuts, g, h, rules, step)
    _grow(rows[~left], bounds | {k: (max(low, cut), high)}, depth + 1, leaf, bins, cuts, g, h, rules, step)


@dataclass(frozen=True)
class Patterns:
    """Rows with equal rule values, counted: few, as the rules cut the rows into few cells."""

    values: np.ndarray
    rows: np.ndarray
    ones: np.ndarray

    @staticmethod
    def of(r: np.ndarray, y: np.ndarray) -> "Patterns":
        values, back = np.unique(r.astype(np.uint8), axis=0, return_inverse=True)
        back = back.ravel()
        return Patterns(np.hstack([np.ones((len(values), 1)), values]), np.bincount(back, minlength=len(values)).astype(float), np.bincount(back, y, len(values)))

    def loss(self, w: np.ndarray) -> float:
        p = np.clip(_logistic(self.values @ w), 1e-6, 1 - 1e-6)
        return float(-(self.ones @ np.log(p) + (self.rows - self.ones) @ np.log(1 - p)) / self.rows.sum())


def lasso_logistic(data: Patterns, lam: float, start: np.ndarray | None = None, rounds: int = 400) -> np.ndarray:
    """min mean logistic loss + lam |w|, the intercept (first) free, by accelerated proximal gradient steps."""
    a, n = data.values, data.rows.sum()
    w = np.zeros(a.shape[1]) if start is None else start
    v = np.ones(a.shape[1])
    for _ in range(30):  # the largest curvature, by power steps
        v = a.T @ (data.rows * (a @ v))
        v /= np.linalg.norm(v)
    rate = 3.8 * n / max(1e-9, float(data.rows @ (a @ v) ** 2))
    ahead, t = w, 1.0
    for _ in range(rounds):
        new = ahead - rate * (a.T @ (data.rows * _logistic(a @ ahead) - data.ones)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * lam, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """x: statistics, y: 0 or 1. Every fifth row of each class chooses the penalty; where no class has five rows, those
    that fit the rules choose it too."""
    n, ones = len(y), float(y.sum())
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleModel(float(np.log(share / (1 - share))), (), ())
    nth = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    test = nth % 5 == 0
    rules = grow_rules(x[~test], y[~test])
    if not rules:  # no statistic tells any two rows apart
        return RuleModel(float(np.log(ones / (n - ones))), (), ())
    r = rule_values(rules, x)
    _, first = np.unique(r.astype(np.uint8), axis=1, return_index=True)  # of rules that hold for the same rows, the first
    first = np.sort(first)
    rules, r = tuple(rules[j] for j in first), r[:, first]
    train = Patterns.of(r[~test], y[~test])
    check = Patterns.of(r[test], y[test]) if test.any() else train
    w, best, lam = None, np.inf, LAMBDAS[0]
    for candidate in LAMBDAS:
        w = lasso_logistic(train, candidate, w)
        if check.loss(w) < best - 1e-4:
            best, lam = check.loss(w), candidate
    w = lasso_logistic(Patterns.of(r, y), lam, rounds=1000)
    keep = np.flatnonzero(np.abs(w[1:]) > 1e-4)
    return RuleModel(float(w[0]), tuple(rules[j] for j in keep), tuple(float(w[j + 1]) for j in keep))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Fits on labelled rows that are not held out, MAX_LABELLED of them at most."""
    sample = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("__y"), F.xxhash64("doc_id").alias("__h"))
        .orderBy("__h", "__id", "__y")
        .limit(MAX_LABELLED)
    )
    # MAX_LABELLED rows of three numbers: under 1 MB, whatever the corpus. One document stands for each doc_id, so that
    # no more rows than these reach the driver, however often an id repeats.
    wanted = F.broadcast(sample.select(F.col("__id").alias("__doc")).distinct())
    texts = small_batches(docs).select(docs["doc_id"].alias("__doc"), docs["text"].alias("__text")).join(wanted, "__doc", "left_semi")
    one = texts.groupBy("__doc").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("text")))["text"].alias("__text"))
    rows = one.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("__h", "__id", "__y", stats_column(F.col("__text")).alias("s"))
    rows = rows.select("__h", "__id", "__y", "s.*").toPandas().sort_values(["__h", "__id", "__y"])
    return fit_rules(rows[list(STATS)].to_numpy(float), rows["__y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the score column to docs; other columns stay as they are, whatever their names."""
    stats = fresh(docs, "__stats")
    return small_batches(docs).withColumn(stats, stats_column(docs[text])).withColumn(score, model.score(F.col(stats))).drop(stats)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
