"""Packing documents into sequences by lexical retrieval.

Documents are tokenized once into a stored table. Document frequencies of all token ids, the number of documents and their mean
length are counted over all documents (one number for each id of the vocabulary reaches the driver). The documents are range-partitioned by a
similarity key (a simhash of their tokens, then the smallest hash of their token pairs), so that documents of one language or kind, and near
copies, lie together, and cut into shards of at most ``SHARD_DOCS`` documents or about ``SHARD_TOKENS`` tokens. Each shard is an inverted index whose postings
hold BM25 weights; a token that many documents of the shard have is a row of weights of all of them instead, which is added as a whole. A window begins with a seed, the rest of the document cut last or else the first unused one; the index returns the
unused neighbours of the seed, best first, and they fill the window; the last is cut where the window ends and its rest begins the
next. So every sequence is full but a shard's last, which is cut into sequences at powers of two, which need no padding.

Every id of every document, with its end id, lies in exactly one piece. A partition streams: a task holds one shard at a time.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; documents that share no token with a
seed follow in the order of the similarity key; ties go to that order too; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from meshframes.llm.common import blocks, in_tasks, stored
from meshframes.llm.lang_id import mix
from meshframes.llm.tokens import encoder

SHARD_DOCS = 2_048
SHARD_TOKENS = 1_500_000
SIGN_BITS = 12
#: A token in at least one of so many documents of a shard is a row of weights, so rows hold at most this many times the shard's tokens.
COMMON = 4
#: Neighbours of a seed that are looked for one by one, before all are sorted.
FEW = 16


#: A lane of signs holds four counters of 16 bits, so runs of so many tokens are summed at once.
RUN = (1 << 16) - 1


@functools.cache
def _signs(vocabulary: int) -> np.ndarray:
    return np.random.default_rng(5).choice(np.array([-1, 1], np.int8), (vocabulary, SIGN_BITS))


@functools.cache
def _lanes(vocabulary: int) -> list[np.ndarray]:
    """The positive signs of each token, four to a 64-bit number."""
    ones = (_signs(vocabulary) > 0).astype(np.uint64)
    shift = np.uint64(1) << (np.uint64(16) * np.arange(4, dtype=np.uint64))
    return [np.ascontiguousarray((ones[:, i : i + 4] * shift[: ones[:, i : i + 4].shape[1]]).sum(axis=1, dtype=np.uint64)) for i in range(0, SIGN_BITS, 4)]


def similarity_keys(ids: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(simhash, smallest hash of a token pair) of each token sequence; sequences are not empty."""
    flat = np.concatenate(ids).astype(np.int64)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    starts = np.cumsum(sizes) - sizes
    runs = np.concatenate([np.arange(s, s + n, RUN) for s, n in zip(starts, sizes)]) if sizes.max() > RUN else starts
    lanes = [np.add.reduceat(lane[flat], runs) for lane in _lanes(vocabulary)]
    ones = np.column_stack([(x >> np.uint64(16 * k)) & np.uint64(RUN) for x in lanes for k in range(4)])[:, :SIGN_BITS].astype(np.int64)
    if len(runs) > len(starts):
        ones = np.add.reduceat(ones, np.searchsorted(runs, starts), axis=0)
    sign = (2 * ones > sizes[:, None]) @ (1 << np.arange(SIGN_BITS))
    pairs = mix((flat * vocabulary + np.append(flat[1:], 0)).astype(np.uint64)) >> np.uint64(1)
    return sign.astype(np.int32), np.minimum.reduceat(pairs, starts).astype(np.int64)


def tokenize(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """(doc_id, n, ids, sign, pair): ids as little-endian 16-bit numbers (32-bit ones for vocabularies over 65,536)."""

    def task(batches):
        enc = encoder(tokenizer)
        size = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        kind = "<u2" if size <= 65_536 else "<u4"
        for b in batches:
            doc_ids, texts = b.column("doc_id"), b.column("text")
            for s, e in blocks(pc.utf8_length(texts).to_pylist(), 2_000_000):
                raw = enc.ids(texts.slice(s, e - s).to_pylist())
                ids = [np.append(np.frombuffer(x, "<u4"), end_id).astype(kind) for x in raw]
                sign, pair = similarity_keys(ids, size)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(s, e - s), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(sign), pa.array(pair)],
                    names=["doc_id", "n", "ids", "sign", "pair"])

    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return in_tasks(read, task, "doc_id long, n long, ids binary, sign int, pair long")


@dataclass(frozen=True)
class Statistics:
    """Of all documents: idf by token id, mean length."""

    idf: np.ndarray
    mean: float
    kind: str
    end_id: int


def postings(ids: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, how often) of each distinct token of each document, ordered by document."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    kind = np.uint32 if len(ids) * vocabulary < 1 << 32 else np.int64  # shorter numbers are sorted faster
    key, n = np.unique(np.repeat(np.arange(len(ids), dtype=kind) * kind(vocabulary), sizes) + np.concatenate(ids).astype(kind), return_counts=True)
    doc = key // kind(vocabulary)
    return doc.astype(np.int64), (key - doc * kind(vocabulary)).astype(np.int64), n


def statistics(tokens: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> Statistics:
    """Counted over all documents."""
    size = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 65_536 else "<u4"

    def count(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            col = b.column("ids").to_pylist()
            for s, e in blocks([len(x) for x in col], 4_000_000):
                df += np.bincount(postings([np.frombuffer(x, kind) for x in col[s:e]], size)[1], minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["token", "df"])

    total = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("t")).first()
    df = np.zeros(size)
    for r in in_tasks(tokens.select("ids"), count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).collect():
        df[r["token"]] = r["df"]
    idf = np.log1p((total["n"] - df + 0.5) / (df + 0.5))
    idf[end_id] = 0.0
    return Statistics(idf, (total["t"] or 0) / max(1, total["n"]), kind, end_id)


class Shard:
    """The inverted index of some documents."""

    def __init__(self, ids: list[np.ndarray], stats: Statistics, k1: float = 1.2, b: float = 0.75) -> None:
        size = len(stats.idf)
        doc, token, n = postings(ids, size)
        lengths = np.fromiter(map(len, ids), float, len(ids))
        weight = stats.idf[token] * n * (k1 + 1) / (n + k1 * (1 - b + b * lengths[doc] / max(stats.mean, 1e-9)))
        used = weight > 0
        doc, token, weight = doc[used], token[used], weight[used]
        self.terms = np.split(token, np.searchsorted(doc, np.arange(1, len(ids))))
        order = np.argsort(token, kind="stable")
        doc, token, weight = doc[order].astype(np.int32), token[order], weight[order]
        self.n = len(ids)
        self.row = np.full(size, -1)
        common = np.flatnonzero(COMMON * np.bincount(token, minlength=size) >= self.n)
        self.row[common] = np.arange(len(common))
        self.rows, self.columns = np.zeros((len(common), self.n)), np.arange(self.n)
        row = self.row[token]
        rare = row < 0
        self.rows[row[~rare], doc[~rare]] = weight[~rare]
        self.doc, self.weight = doc[rare], weight[rare]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(token[rare], minlength=size))])

    def forget(self, used: np.ndarray) -> None:
        """Drops the postings of documents that are no longer asked for."""
        keep = ~used[self.doc]
        self.at = np.concatenate([[0], np.cumsum(keep)])[self.at]
        self.doc, self.weight = self.doc[keep], self.weight[keep]
        keep = ~used[self.columns]
        self.rows, self.columns = self.rows[:, keep], self.columns[keep]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the distinct tokens of ``seed``."""
        t = self.terms[seed]
        row = self.row[t]
        t = t[row < 0]
        lo, n = self.at[t], self.at[t + 1] - self.at[t]
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(t) else np.empty(0, np.int64)
        common = np.zeros(len(self.columns))
        for i in row[row >= 0].tolist():
            common += self.rows[i]
        score = np.zeros(self.n)
        score[self.columns] = common
        score += np.bincount(self.doc[where], weights=self.weight[where], minlength=self.n)
        return score


def best_first(score: np.ndarray) -> Iterator[int]:
    """Documents by falling score, ties in their order, until those below 0; changes ``score``."""
    for _ in range(FEW):
        doc = int(score.argmax())
        if score[doc] < 0:
            return
        yield doc
        score[doc] = -1.0
    order = np.argsort(-score, kind="stable")
    yield from order[: np.count_nonzero(score >= 0)].tolist()


def pack_shard(ids: list[np.ndarray], stats: Statistics, window: int = 4096) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length)."""
    lengths = [len(x) for x in ids]
    index = Shard(ids, stats)
    unused = np.ones(len(ids), bool)
    sequences: list[list[tuple[int, int, int]]] = []
    current: list[tuple[int, int, int]] = []
    room, first = window, 0
    indexed = len(ids)

    def put(doc: int, start: int) -> int:
        """Fills the window from ``start``; where the document goes on, or -1."""
        nonlocal room, current
        n = min(room, lengths[doc] - start)
        current.append((doc, start, n))
        room -= n
        if not room:
            sequences.append(current)
            current, room = [], window
        return start + n if start + n < lengths[doc] else -1

    seed, rest = -1, -1
    while True:
        if rest < 0:
            while first < len(ids) and not unused[first]:
                first += 1
            if first == len(ids):
                break
            seed, rest = first, 0
            unused[seed] = False
        while rest >= 0:  # a long document fills windows of its own
            rest = put(seed, rest)
        if not current:
            continue
        if 4 * (left := int(unused.sum())) < 3 * indexed:
            index.forget(~unused)
            indexed = left
        score = index.scores(seed)
        score[~unused] = -1.0
        for doc in best_first(score):
            unused[doc] = False
            rest = put(doc, 0)
            if not current or rest >= 0:
                seed = doc
                break
        if rest < 0 and current and not unused.any():
            break
    if current:
        sequences += cut_at_powers(current)
    return sequences


def cut_at_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences whose lengths are falling powers of two."""
    total = sum(n for _, _, n in pieces)
    out: list[list[tuple[int, int, int]]] = []
    todo = pieces[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            doc, start, n = todo.pop()
            m = min(n, room)
            out[-1].append((doc, start, m))
            room -= m
            if m < n:
                todo.append((doc, start + m, n - m))
    return out


def pack(tokens: DataFrame, stats: Statistics, window: int = 4096, partitions: int | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of ``tokens`` (see :func:`tokenize`);
    ids are little-endian unsigned 32-bit numbers."""
    spark = tokens.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(stats)  # bounded by the vocabulary
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def task(batches):
        st = shared.value
        number = TaskContext.get().partitionId() << 40
        doc_ids: list = []
        ids: list[np.ndarray] = []
        size = 0

        def full():
            nonlocal number
            rows = []
            for sequence in pack_shard(ids, st, window):
                offset = 0
                for doc, start, length in sequence:
                    piece = ids[doc][start : start + length].astype("<u4").tobytes()
                    rows.append((doc_ids[doc], start, length, len(ids[doc]), number, offset, piece))
                    offset += length
                number += 1
            for s in range(0, len(rows), 2_000):
                cols = list(zip(*rows[s : s + 2_000]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names=names)

        for b in batches:
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(x.as_py(), st.kind))
                size += len(ids[-1])
                if size >= SHARD_TOKENS or len(ids) == SHARD_DOCS:
                    yield from full()
                    doc_ids.clear()
                    ids.clear()
                    size = 0
        if ids:
            yield from full()

    keyed = tokens.select("doc_id", "ids", "sign", "pair", F.xxhash64("doc_id", "ids").alias("h"))
    ordered = keyed.repartitionByRange(n, "sign", "pair", "h").sortWithinPartitions("sign", "pair", "h", "doc_id").select("doc_id", "ids")
    return in_tasks(ordered, task, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = 4096) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text)."""
    tokens = stored(tokenize(docs, tokenizer, end_id), "packing-tokens")
    return pack(tokens, statistics(tokens, tokenizer, end_id), window)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
