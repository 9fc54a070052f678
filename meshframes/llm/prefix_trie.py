"""Conversation prefix trie with totals of all subtrees by a depth-band rollup.

A node is a distinct sequence of first d turns (role, text); members are the conversations that begin with it.

* :func:`ordered` numbers the turns of each conversation (range partitions in order of (conv_id, turn), a running count in each, and the counts of
  earlier partitions for the few conversations that lie in several), so no conversation is one task's.
* :func:`prefixes` gives each prefix a key: two 64-bit lanes, each the exclusive or of a hash of (place, turn) over the prefix. It is a running
  aggregate, so a long conversation is cut into :data:`PIECE` turns whose lanes are combined; a parent's key is the key without the last turn.
  Turns enter by their SHA-256, so texts are read once and never shuffled. Two different prefixes of one depth share a key with a chance of 2**-128.
* :func:`nodes` aggregates prefixes by key (partial aggregation, so a first turn that all conversations share is one row a task).
* :func:`rollup` adds up subtrees. A node explodes only to its ancestors within its band of ``height`` depths: a band of its smallest
  member holds the keys of all of them, ``height`` at most, and what its nodes have in common is added up there before the shuffle.
  Band roots then hold whole totals of their bands; taken as a trie of their own, with bands of ``height`` roots, they are rolled up alike until one band
  is left, and completed totals of band roots go back down, again to the ancestors within one band. Rounds are
  ``2 * log(depth, height)`` and no row explodes to more than ``height`` others, however deep a conversation is.
* :func:`end_digests` hashes, for each node, the ids of members that end there, in order: ids are joined in range partitions
  ordered by (node, id), and a node's pieces are streamed through one hash. (SHA-256 has no parallel form: the joined ids of one
  node pass one task, as a stream of strings of :data:`IDS` ids, never held together.)

Broadcast: one row a range partition at most (conversations that lie in several). The driver gets one number, the largest depth.

Defined results: a null role or text is empty; null turns come first; equal turns of a conversation are ordered by the SHA-256 of role and
text, equal ones are turns of their own; rows without conv_id belong to no conversation; an empty table gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from meshframes.llm.common import stored

HEIGHT = 32
PIECE = 1_024
IDS = 1_000
KEY = ["depth", "k1", "k2"]


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, what, bytes): the turns of each conversation, numbered from 1; ``what`` is the digest of role and text."""
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("what"), F.octet_length(text).cast("long").alias("bytes")
    )
    turns = stored(turns, "turns").withColumn("row", F.monotonically_increasing_id())  # rows alike in all are told apart by their place in the table
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "what", "row"]

    def task(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id").to_numpy()
            first = np.concatenate([[True], conv[1:] != conv[:-1]])
            at = np.arange(len(conv))
            local = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
            run = len(conv) if len(starts := np.flatnonzero(first)) == 1 else starts[1]
            if conv[0] == last:
                local[:run] += count
            last, count = conv[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.full(len(conv), part)), pa.array(local), b.column("what"), b.column("bytes")], names=["conv_id", "part", "pos", "what", "bytes"])

    ranges = turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "what", "bytes")
    numbered = stored(ranges.mapInArrow(task, "conv_id long, part long, pos long, what binary, bytes long"), "numbered-turns")
    counts = numbered.groupBy("conv_id", "part").agg(F.max("pos").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    return numbered.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "what", "bytes"
    )


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("pos").alias("n"))


def borrowed(turns: DataFrame, share: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations of :func:`ordered` turns, as (conv_id, depth, what, bytes) and (conv_id, n): each conversation c takes the first h turns of
    conversation ``c - c % share``, then its own after its first h; h is the CRC-32 of its decimal id modulo ``most``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = stored(lengths(turns), "conversation-lengths")
    convs = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % share).alias("base"), h.alias("h"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = stored(convs.join(bases, "base", "left").select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "rebuilt-lengths")
    firsts = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "what", "bytes")
    heads = convs.where("head > 0").select("conv_id", "base", "head").join(firsts, "base").where("depth <= head")
    tails = turns.where(F.col("pos") > h).join(convs.select("conv_id", (F.col("head") - F.col("h")).alias("shift")), "conv_id")
    cols = ["conv_id", "depth", "what", "bytes"]
    return heads.select(cols).unionByName(tails.withColumn("depth", F.col("pos") + F.col("shift")).select(cols)), convs.select("conv_id", "n")


def prefixes(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, what, bytes, is_end): all prefixes of all conversations with their keys and their parents', the empty one included.

    ``sequences`` is (conv_id, depth from 1 without gaps, what, bytes), ``convs`` (conv_id, n) all conversations and their numbers of turns."""
    lanes = {f"k{i}": F.xxhash64(F.lit(i), F.col("depth").cast("long"), "what") for i in (1, 2)}
    rows = sequences.select("conv_id", F.col("depth").cast("long").alias("depth"), "what", "bytes", *[v.alias(f"g{k[1]}") for k, v in lanes.items()])
    rows = stored(rows.withColumn("piece", F.floor((F.col("depth") - 1) / PIECE).cast("long")), "turns-by-depth")
    here = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    long = convs.where(F.col("n") > PIECE).select("conv_id")
    pieces = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "piece").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"))
    carried = pieces.select("conv_id", "piece", *[F.bit_xor(f"g{i}").over(earlier).alias(f"c{i}") for i in (1, 2)]).where("c1 is not null")
    rows = rows.join(carried, ["conv_id", "piece"], "left").join(convs, "conv_id")
    keys = [F.bit_xor(f"g{i}").over(here).bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))).alias(f"k{i}") for i in (1, 2)]
    rows = rows.select("conv_id", "depth", *keys, "g1", "g2", "what", "bytes", (F.col("depth") == F.col("n")).alias("is_end"))
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)]
    zero, none = F.lit(0).cast("long"), F.lit(None)
    roots = convs.select("conv_id", *[zero.alias(c) for c in KEY], none.cast("long").alias("p1"), none.cast("long").alias("p2"), none.cast("binary").alias("what"), zero.alias("bytes"), (F.col("n") == 0).alias("is_end"))
    return rows.select("conv_id", *KEY, *parents, "what", "bytes", "is_end").unionByName(roots)


def nodes(paths: DataFrame) -> DataFrame:
    """A row a node: key, parent's key, the turn's digest, conv_id (smallest member), n_convs, ends and what it adds to subtree totals."""
    found = paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("what").alias("what"), F.max("bytes").alias("bytes"), F.count_if("is_end").alias("ends"),
    )
    return found.withColumn("leaves", (F.col("ends") == F.col("n_convs")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))


TOTALS = ["leaves", "saved"]


def _to_ancestors(paths: DataFrame, values: DataFrame, step: int, height: int, back: int = 0) -> DataFrame:
    """Sums of ``values`` (conv_id, depth, TOTALS) by key of the places with depths divisible by ``step`` that are not deeper, on the path of conv_id,
    in the value's band of ``step * height`` depths (or ``back`` bands before it)."""
    number = F.floor(F.col("depth") / (step * height)).cast("long")
    place, value = F.struct(*KEY), F.struct("depth", *TOTALS)
    on_path = paths.where(F.col("depth") % step == 0).select("conv_id", number.alias("band"), place.alias("place"))
    given = values.select("conv_id", (number - back).alias("band"), value.alias("value"))
    rows = on_path.unionByName(given, allowMissingColumns=True).groupBy("conv_id", "band")
    bands = rows.agg(F.collect_list("place").alias("places"), F.collect_list("value").alias("held")).where("size(held) > 0")
    beneath = F.filter("held", lambda v: v["depth"] >= F.col("place.depth"))
    spread = bands.select(F.explode("places").alias("place"), "held").select("place", beneath.alias("held")).where("size(held) > 0")
    sums = [F.aggregate(F.transform("held", lambda v: v[t]), F.lit(0).cast("long"), lambda a, x: a + x).alias(t) for t in TOTALS]
    return spread.select("place.*", *sums).groupBy(*KEY).agg(*[F.sum(t).alias(t) for t in TOTALS])


def rollup(paths: DataFrame, found: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(key, TOTALS summed over the node's subtree) of all nodes ``found`` on ``paths``."""
    deepest = found.agg(F.max("depth")).first()[0]
    if deepest is None:
        return found.select(*KEY, *TOTALS)
    ids = found.select(*KEY, "conv_id")
    levels, values, step = [], found.select(*KEY, "conv_id", *TOTALS), 1
    while True:  # up: totals within bands, of ever fewer band roots
        sums = _to_ancestors(paths, values, step, height)
        levels.append(stored(sums.join(ids, KEY), "band-totals"))
        if step * height > deepest:
            break
        step *= height
        values = levels[-1].where(F.col("depth") % step == 0)
    total = levels[-1]
    for k in range(len(levels) - 2, -1, -1):  # down: completed totals of the next band's roots
        step //= height
        roots = total.where(f"depth > 0 and depth % {step * height} = 0")
        below = _to_ancestors(paths, roots, step, height, back=1)
        both = levels[k].select(*KEY, *TOTALS).unionByName(below).groupBy(*KEY).agg(*[F.sum(t).alias(t) for t in TOTALS])
        total = stored(both.join(ids, KEY), "subtree-totals")
    return total.select(*KEY, *TOTALS)


def end_digests(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    ends = paths.where("is_end").select(order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = [*KEY, "first", "ids"]

    def joined(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            keys = list(zip(*cols[:3]))
            rows, s = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[s] or i - s == IDS:
                    rows.append((*keys[s], cols[3][s], ",".join(map(str, cols[3][s:i]))))
                    s = i
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]), pa.array([r[4] for r in rows], pa.string())], names=names)

    def hashed(batches):
        key = state = None
        for b in batches:
            rows = []
            for *k, ids in zip(*(b.column(c).to_pylist() for c in [*KEY, "ids"])):
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:3]), pa.array([r[3] for r in rows], pa.string())], names=[*KEY, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_pydict({**{c: [v] for c, v in zip(KEY, key)}, "ends_sha256": [state.hexdigest()]})

    strings = ends.mapInArrow(joined, "depth long, k1 long, k2 long, first long, ids string")
    return strings.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(sequences: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and ``what``, the digest of its last turn."""
    paths = stored(prefixes(sequences, convs), "prefixes")
    found = stored(nodes(paths), "trie-nodes")
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = (
        found.drop(*TOTALS)
        .join(rollup(paths, found, height), KEY)
        .join(children, KEY, "left")
        .join(end_digests(paths), KEY, "left")
    )
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "what",
    )


def of_conversations(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of conversations as they are, with role and text of each node's last turn (null at the root)."""
    turns = ordered(conversations)
    grown = trie(turns.withColumnRenamed("pos", "depth"), lengths(turns), height)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = conversations.where("conv_id is not null").select(turn_digest(role, text).alias("what"), role.alias("role"), text.alias("text")).dropDuplicates(["what"])
    return grown.join(said, "what", "left").drop("what")


SQL = """
with t as (
  select cast(conv_id as bigint) as conv_id, coalesce(text, '') as text, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') as said, turn
  from conversations where conv_id is not null
), o as (
  select conv_id, text, sha256(said) as what, row_number() over (partition by conv_id order by turn nulls first, sha256(said)) as pos from t
), c as (
  select conv_id, count(*) as n, conv_id - conv_id % 5 as base,
    xor(list_reduce(flatten(list_transform(range(1, length(cast(conv_id as varchar)) + 1), lambda i:
        list_concat([cast(ascii(substr(cast(conv_id as varchar), i, 1)) as bigint)], [cast(-1 as bigint) for x in range(8)]))),
      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end, cast(4294967295 as bigint)), cast(4294967295 as bigint)) % 9 as h
  from o group by conv_id
), l as (
  select c.*, least(c.h, coalesce(b.n, 0)) as head from c left join c b on b.conv_id = c.base
), r as (
  select l.conv_id, o.pos as d, o.what, o.text from l join o on o.conv_id = l.base and o.pos <= l.head
  union all
  select l.conv_id, l.head + o.pos - l.h, o.what, o.text from l join o on o.conv_id = l.conv_id and o.pos > l.h
), p as (
  select conv_id, d, sha256(array_to_string(list(what) over (partition by conv_id order by d), '')) as k, octet_length(encode(text)) as bytes from r
  union all
  select conv_id, 0, '', 0 from c
), e as (
  select p.*, lag(k) over (partition by conv_id order by d) as pk, d = max(d) over (partition by conv_id) as last from p
), n as (
  select d, k, min(pk) as pk, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes, bool_and(last) as leaf,
    sha256(coalesce(string_agg(case when last then cast(conv_id as varchar) end, ',' order by conv_id), '')) as ends_sha256
  from e group by d, k
), s as (
  select p.d, p.k, sum(case when n.leaf then 1 else 0 end) as n_leaves, sum((n.n_convs - 1) * n.bytes) as saved_tokens
  from n join p on p.conv_id = n.conv_id and p.d <= n.d group by p.d, p.k
)
select n.conv_id, cast(n.d as bigint) as depth, u.conv_id as parent_conv_id, cast(n.n_convs as bigint) as n_convs,
  cast((select count(*) from n x where x.d = n.d + 1 and x.pk = n.k) as bigint) as n_children, cast(s.n_leaves as bigint) as n_leaves,
  cast(s.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from n join s on s.d = n.d and s.k = n.k left join n u on u.d = n.d - 1 and u.k = n.pk
"""
