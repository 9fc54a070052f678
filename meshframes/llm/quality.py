"""Quality rules with an isolation forest on rule statistics.

Each document is reduced to statistics of simple quality rules (:func:`rule_stats`). Their rates
(:func:`rates`), in units of the spread among the labelled good documents, are the features of an isolation forest: trees of random splits over small random
subsamples of the good documents, in which a document that differs from them is isolated after few splits. A split is drawn from the
node's range drawn out by ``reach`` times its width on both sides, so that what lies beyond the good documents, in one rate or a little in
several, falls into empty leaves near the root. A short
mean path means an anomalous document; the anomaly score is ``2 ** (-mean path / expected path)``.
The forest comes from a bounded, hash-chosen sample of the labelled documents (``sample_docs``).
The cut is calibrated on all labelled documents that pass the base rules: the score that catches
most documents of quality 0 less ``cost`` times the share of documents of quality 1 lost.

Words are runs of other characters than space, tab and the four line breaks of ASCII, in the whole text. Base rules:
fewer than ``min_words`` words, or ``100 * n_repeat_words > max_repeat * n_words``.

Defined results: a null or empty text has no words and fails the base rules; without labels, or labels of
one class only, the method rejects nothing; with several labels for a doc_id the lowest quality counts;
null doc_ids and qualities teach nothing; repeated rows are judged each by itself; added columns replace
those of the same name, others pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from meshframes.llm.common import in_tasks, stored, with_arrow_columns

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_digits", "n_twins"]
SPACES = b" \t\n\x0b\x0c\r"
NOT_FIRST = bytes(range(0x80, 0xC0))  # second and later bytes of a character in UTF-8
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
PUNCT = b"!\"'()+,-./:;=?@[\\]^_`{}~"
WINDOW = 5
#: Texts of more words compare their windows by numbers instead of tuples, to bound memory; both ways are exact.
NUMBERED_WORDS = 200_000


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    if n > NUMBERED_WORDS:
        numbers: dict[bytes, int] = {}
        word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        m = n - WINDOW + 1
        win = word[:m]
        for i in range(1, WINDOW):  # equal windows so far have equal numbers below n, so a pair is one number
            win = np.unique(win * len(numbers) + word[i : m + i], return_inverse=True)[1]
        _, at, count = np.unique(win, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[at] > 1)
    else:
        wins = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(wins)) == len(wins):
            return 0
        seen: dict = {}
        for w in wins:
            seen[w] = seen.get(w, 0) + 1
        starts = np.flatnonzero(np.fromiter((seen[w] > 1 for w in wins), bool, len(wins)))
    return int(np.minimum(np.diff(starts, append=n), WINDOW).sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The values of :data:`STATS` for a text in UTF-8."""
    words = text.split()  # bytes.split() splits at SPACES only
    size = len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACES + NOT_FIRST)),
        size - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        size - len(text.translate(None, UPPER)),
        size - len(text.translate(None, PUNCT)),
        size - len(text.translate(None, DIGITS)),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def _stats_of(col: pa.Array) -> np.ndarray:
    raw = col.cast(pa.large_binary())
    return np.array([text_stats(x.as_py() or b"") for x in raw], np.int64).reshape(-1, len(STATS))


def rule_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the rule statistics of each whole text."""

    def make():
        return lambda col: [pa.array(x, pa.int64()) for x in np.ascontiguousarray(_stats_of(col).T)]

    return with_arrow_columns(docs, [text], [T.StructField(c, T.LongType()) for c in STATS], make, keep)


def rates(stats: np.ndarray) -> np.ndarray:
    """Features: counts per word, line or character, drawn to a common value for short texts."""
    n, chars, symbols, dup, repeat, lines, upper, punct, digits, twins = stats.astype(float).T
    return np.column_stack(
        [(chars + 250) / (n + 50), symbols / (n + 50), dup / (lines + 5), repeat / (n + 50), upper / (chars + 250), punct / (n + 50), digits / (chars + 250), twins / (n + 50)]
    )


def base_failed(stats: np.ndarray, min_words: int = 10, max_repeat: int = 20) -> np.ndarray:
    return (stats[:, 0] < min_words) | (100 * stats[:, 4] > max_repeat * stats[:, 0])


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points in a binary search tree."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays: the split feature (-1: leaf), its value, the left child (the right one follows it),
    and a leaf's path length with the part expected below it."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    subsample: int
    middle: np.ndarray
    spread: np.ndarray
    cut: float = field(default=np.inf)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) / self.spread

    def score(self, x: np.ndarray) -> np.ndarray:
        x = self.scaled(x)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                open_ = f >= 0
                if not open_.any():
                    break
                step = x[rows, np.maximum(f, 0)] >= self.value[node]
                node = np.where(open_, self.left[node] + step, node)
            total += self.path[node]
        return np.exp2(-total / max(1, len(self.roots)) / float(expected_path(self.subsample)))


#: The least width of a node's range, in spreads.
LEAST_WIDTH = 0.02


def grow(x: np.ndarray, good: np.ndarray, trees: int = 100, subsample: int = 256, reach: float = 4.0, seed: int = 7) -> Forest:
    """An isolation forest over the rows of ``x`` that are ``good`` (all, if none is)."""
    x = x[good] if good.any() else x
    first, middle, third = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    spread = np.where(third > first, third - first, np.maximum(x.std(axis=0), 1e-3))
    x = (x - middle) / spread
    rng = np.random.default_rng(seed)
    feature, value, left, path, roots = [], [], [], [], []
    size = min(subsample, len(x))
    limit = int(np.ceil(np.log2(max(2, size)))) + 2

    def node() -> int:
        feature.append(-1)
        value.append(0.0)
        left.append(0)
        path.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        roots.append(node())
        todo = [(roots[-1], x[rng.choice(len(x), size, replace=False)], 0)]
        while todo:
            at, part, depth = todo.pop()
            if depth >= limit or len(part) < 2:
                path[at] = depth + float(expected_path(len(part)))
                continue
            f = int(rng.integers(x.shape[1]))
            least, most = part[:, f].min(), part[:, f].max()
            beyond = reach * max(most - least, LEAST_WIDTH)
            v = rng.uniform(least - beyond, most + beyond)
            a = node()
            b = node()
            feature[at], value[at], left[at] = f, v, a
            right = part[:, f] >= v
            todo += [(a, part[~right], depth + 1), (b, part[right], depth + 1)]
    return Forest(np.array(feature), np.array(value), np.array(left), np.array(path), np.array(roots), max(2, size), middle, spread)


#: Scores are counted in so many equal bins between 0 and 1 when the cut is calibrated.
BINS = 10_000


def calibrate(good: np.ndarray, bad: np.ndarray, cost: float) -> float:
    """From the counts by bin of labelled documents: the cut at or above which documents are rejected."""
    if not good.sum() or not bad.sum():
        return np.inf
    lost = np.append(good[::-1].cumsum()[::-1], 0) / good.sum()
    caught = np.append(bad[::-1].cumsum()[::-1], 0) / bad.sum()
    gain = caught - cost * lost
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return np.inf if best[-1] == BINS else (best[0] + best[-1]) // 2 / BINS


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 20_000, cost: float = 20.0, trees: int = 100, subsample: int = 256) -> Forest | None:
    """A calibrated forest, or None if no labelled document passes the base rules.

    Statistics are computed before the join with the labels, so no text is shuffled; those of all
    labelled documents are stored (a narrow table). The forest grows from ``sample_docs`` of them or so, the cut counts them all."""
    known = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    found = stored(rule_stats(docs, keep=["doc_id"]).join(known, "doc_id"), "quality-stats")
    passed = found.where((F.col("n_words") >= 10) & (100 * F.col("n_repeat_words") <= 20 * F.col("n_words")))
    total = passed.count()
    if not total:
        return None
    share = min(1.0, sample_docs / total)
    sample = passed.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = sample.select("doc_id", "good", *STATS).toPandas().sort_values(["doc_id", "good", *STATS])
    if not len(rows):
        return None
    forest = grow(rates(rows[STATS].to_numpy(np.int64)), rows["good"].to_numpy(bool), trees, subsample)

    def binned(batches):
        for b in batches:
            s = np.column_stack([b.column(c).to_numpy() for c in STATS])
            at = np.minimum((forest.score(rates(s)) * BINS).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([b.column("good"), pa.array(at)], names=["good", "at"])

    counts = in_tasks(passed.select("good", *STATS), binned, "good boolean, at long").groupBy("good", "at").count().collect()
    by = {True: np.zeros(BINS), False: np.zeros(BINS)}
    for good, at, n in counts:  # BINS rows of each class at most
        by[good][at] += n
    forest.cut = calibrate(by[True], by[False], cost)
    return forest


def judge(docs: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """``docs`` with the rule statistics, ``base_failed``, ``anomaly`` (0 to 1) and ``kept``."""
    fields = [*(T.StructField(c, T.LongType()) for c in STATS), T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def make():
        def run(col: pa.Array):
            s = _stats_of(col)
            failed = base_failed(s)
            score = forest.score(rates(s)) if forest else np.zeros(len(s))
            kept = ~failed & (score < forest.cut if forest else True)
            return [*(pa.array(x) for x in np.ascontiguousarray(s.T)), pa.array(failed), pa.array(score), pa.array(kept)]

        return run

    return with_arrow_columns(docs, [text], fields, make)
