"""Language ID by language-bitmask n-gram filters.

A filter is a Bloom filter whose cell is not a bit but a bitmask of languages (the bit
slices of one Bloom filter per language, stored side by side): ANDing the cells that an
n-gram hashes to gives all languages that contain it, with one set of probes for any number
of languages. Per document the masks' bits are counted by language, the counts are corrected
for the filter's false positives, and the largest corrected count decides.

Learning (:func:`fit`) reads ``sample_docs`` documents of each language or so (a bounded,
hash-chosen sample; ``max_languages`` languages at most) and counts, in Spark, the documents that
hold each n-gram. A language contains an n-gram if it is found in ``min_docs`` of its documents
and at least ``ratio`` times as often as in the language where it is commonest. Only the
chosen n-grams reach the driver; their number is bounded by the sample. Copies of a text count once.

Prediction (:func:`detect`) is one pass over whole texts without shuffle, in blocks of about
a quarter of a million characters (a longer text makes a block of its own).

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every
text if nothing could be learnt; a text with letters but no known n-gram gets the most frequent
language with score 0; ties go to the alphabetically first language. Rows with a null doc_id are
never learnt from; repeated rows are judged each by itself; ``lang_pred``, ``score`` and ``coverage`` replace
columns of those names, other columns pass.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from meshframes.llm.common import blocks, in_tasks, with_arrow_columns

UND = "und"
#: Constants of the 64-bit mixing function splitmix64 and two odd multipliers.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MUL_A, MUL_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPACE = 32
BLOCK_CHARS = 250_000


@functools.cache
def fold_table() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case form if it is a letter or mark, else a space; is it a letter."""
    fold = np.full(0x110000, SPACE, np.uint32)
    letter = np.zeros(0x110000, bool)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            fold[cp] = ord(chr(cp).lower()[0])
            letter[cp] = kind == "L"
    return fold, letter


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position of its text) of each 3- and 4-gram, and by text whether it has a letter.

    An n-gram lies in one word, or reaches over one border of it by a space."""
    fold, letter = fold_table()
    codes = np.frombuffer(("\n" + "".join(t + "\n" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    sizes[0] += 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    has = np.logical_or.reduceat(letter[codes], starts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    codes = fold[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    codes, doc = codes[keep].astype(np.uint64), doc[keep]
    if len(codes) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int32), has
    word = codes != SPACE
    packed = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    three = word[1:-1]
    four = word[1:-2] & word[2:-1]
    h3 = mix(packed[three])
    h4 = mix(packed[:-1][four] * MUL_A + codes[3:][four] * MUL_B + np.uint64(4))
    return np.concatenate([h3, h4]), np.concatenate([doc[1:-1][three], doc[1:-2][four]]), has


@dataclass
class Model:
    """languages: by bit; cells: one array for each 64 languages; probes: cells an n-gram hashes to;
    fp: by language, the chance that an unknown n-gram seems to be in it; prior: the most frequent language."""

    languages: list[str] = field(default_factory=list)
    cells: list[np.ndarray] = field(default_factory=list)
    probes: int = 2
    fp: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: int = 0

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        at = [self._at(h, i) for i in range(self.probes)]
        out = []
        for c in self.cells:
            m = c[at[0]]
            for a in at[1:]:
                m &= c[a]
            out.append(m)
        return out

    def _at(self, h: np.ndarray, i: int) -> np.ndarray:
        size = np.uint64(len(self.cells[0]) - 1)
        return ((h >> np.uint64(21 * i)) * MUL_A >> np.uint64(24)) & size if i else h & size

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and coverage of each text; the score is the best corrected count's share of the best two's sum,
        the coverage its share of all n-grams of the text."""
        if not texts:
            return [], [], []
        h, doc, has = grams(texts)
        n = len(texts)
        if not self.languages:
            return [UND] * n, [0.0] * n, [0.0] * n
        total = np.bincount(doc, minlength=n).astype(float)
        counts = np.zeros((n, len(self.languages)))
        for w, m in enumerate(self.masks(h)):
            hit = m != 0
            m, d = m[hit], doc[hit]
            for b in range(min(64, len(self.languages) - 64 * w)):
                on = (m >> m.dtype.type(b)) & m.dtype.type(1)
                counts[:, 64 * w + b] = np.bincount(d[on.astype(bool)], minlength=n)
        fixed = np.maximum(0.0, (counts - total[:, None] * self.fp) / (1.0 - self.fp))
        best = np.where(fixed.max(axis=1) > 0, fixed.argmax(axis=1), self.prior)
        top = fixed[np.arange(n), best]
        rest = fixed.copy()
        rest[np.arange(n), best] = 0.0
        second = rest.max(axis=1)
        score = np.divide(top, top + second, out=np.zeros(n), where=top > 0)
        lang = [self.languages[b] if ok else UND for b, ok in zip(best.tolist(), has.tolist())]
        coverage = np.divide(top, total, out=np.zeros(n), where=total > 0)
        return lang, np.where(has, score, 0.0).tolist(), np.where(has, coverage, 0.0).tolist()


def build(found: dict[str, np.ndarray], docs: dict[str, int], probes: int = 2, cells_per_gram: int = 8) -> Model:
    """A filter over ``found`` (language -> n-gram hashes); ``docs`` has the number of documents by language."""
    languages = sorted(found)
    if not languages:
        return Model()
    most = max(len(x) for x in found.values())
    size = 1 << max(10, int(np.ceil(np.log2(max(1, cells_per_gram * most)))))
    model = Model(languages, [], probes, np.zeros(len(languages)), max(range(len(languages)), key=lambda i: docs[languages[i]]))
    for w in range(0, len(languages), 64):
        n = min(64, len(languages) - w)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if n <= np.dtype(k).itemsize * 8)
        model.cells.append(np.zeros(size, kind))
    for i, name in enumerate(languages):
        c = model.cells[i // 64]
        bit = c.dtype.type(1 << (i % 64))
        for p in range(probes):
            c[model._at(found[name], p)] |= bit  # repeated positions set the same bit
        model.fp[i] = np.mean((c & bit) != 0) ** probes
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True if crc32(doc_id as text) mod 5 is 0 (a null doc_id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    sample_docs: int = 2000,
    max_languages: int = 1024,
    min_docs: int = 2,
    ratio: float = 0.25,
) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()
    )
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not sizes:
        return Model()
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n) * 1_000_000)])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")])
    sample = sample.dropDuplicates(["lang", "text"])

    def count(batches):
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for s, e in blocks([len(t) for t in texts], BLOCK_CHARS):
                names = sorted(set(langs[s:e]))
                code = np.array([names.index(x) for x in langs[s:e]])
                h, doc, _ = grams(texts[s:e])
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, lang = h[first], code[doc[first]]
                for i, name in enumerate(names):
                    g, n = np.unique(h[lang == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = in_tasks(sample.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    seen = sample.groupBy("lang").count().collect()
    docs_of = {r[0]: r[1] for r in seen}
    least = {k: (min_docs if n >= 20 else 1) for k, n in docs_of.items()}
    need = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    got = counted.where(F.col("n") >= need[F.col("lang")]).toArrow()
    lang = np.asarray(got.column("lang").to_pylist(), dtype=object)
    gram = got.column("gram").to_numpy().view(np.uint64)
    rate = got.column("n").to_numpy() / np.array([docs_of[x] for x in lang.tolist()] or [1.0])[: len(lang)]
    uniq, at = np.unique(gram, return_inverse=True)
    top = np.zeros(len(uniq))
    np.maximum.at(top, at, rate)
    good = rate >= ratio * top[at]
    return build({k: gram[good & (lang == k)] for k in docs_of}, sizes)


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``coverage``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the learning sample

    def make():
        def run(col: pa.Array):
            values = col.to_pylist()
            langs, scores, coverage = [], [], []
            for s, e in blocks([len(t or "") for t in values], BLOCK_CHARS):
                a, b, c = shared.value.predict([t or "" for t in values[s:e]])
                langs += a
                scores += b
                coverage += c
            return pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(coverage, pa.float64())

        return run

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())]
    return with_arrow_columns(docs, [text], fields, make)
