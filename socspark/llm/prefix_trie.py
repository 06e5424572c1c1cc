"""The prefix trie of rebuilt conversations.

Every turn becomes a 128-bit id. Turns are numbered in their conversation by a
range-sorted pass, so that a conversation of any length spreads over tasks, and
rebuilt conversations are cut into blocks of a fixed number of turns. Blocks are
range-partitioned by what precedes them and their ids. A shard is a padded matrix
of turn ids: after a lexsort, the changes from row to row, OR-accumulated over the
columns, mark where nodes start, and reduceat aggregates every depth.

Only nodes that hold the first or last row of a shard can go on in another one.
They are few, and are recombined by their key, the exclusive or of the hashes of
(depth, turn). What they add to their ancestors follows the path of keys that
they carry. Totals of later blocks are added to earlier ones by pointer doubling,
in a number of rounds that is the logarithm of the longest conversation's blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_enough, stored

#: Conversations whose ids share all but the last so many share the first one's head, of fewer turns than ``MOST_HEAD``.
FAMILY, MOST_HEAD = 100, 6
#: Block rows and matrix cells of a shard, ids in one row of a digest, and bytes of keys that may be broadcast.
SHARD_ROWS, SHARD_CELLS, DIGEST_IDS, BROADCAST_BYTES = 1 << 16, 1 << 22, 1 << 16, 64 << 20
#: Turns of one conversation that are joined with its facts in one row, and blocks in a first-level sum.
SPAN = 4096
SALTS = 16
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, a, b, size): 128-bit ids and code points of all turns that have a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring(F.col("digest"), at, 15), 16, 10).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("size"))
    return rows.select("conv", "turn", half(1).alias("a"), half(16).alias("b"), "size")


def placed(turns: DataFrame) -> DataFrame:
    """``turns`` with ``at``, a turn's place in its conversation: by turn, null first, then by id."""
    order = ["conv", F.col("turn").asc_nulls_first(), "a", "b"]
    rows = turns.withColumn("_row", F.monotonically_increasing_id())
    sorted_rows = rows.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").select("conv", "a", "b", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            local = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                run_end = first[1] if len(first) > 1 else len(conv)
                local[:run_end] += n
            last, n = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.full(len(conv), part, dtype=np.int32))], names=["conv", "a", "b", "size", "local", "part"])

    found = stored(sorted_rows.mapInArrow(run, "conv long, a long, b long, size long, local long, part int"), "trie-turns")
    # A conversation goes on in at most as many parts as there are; in each only one can do so.
    counts = found.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("conv", "part", before.alias("before")).where("before > 0")
    return found.join(F.broadcast(offsets), ["conv", "part"], "left").select("conv", "a", "b", "size", (F.col("local") + F.coalesce("before", F.lit(0))).alias("at"))


def rebuilt_blocks(turns: DataFrame, width: int) -> DataFrame:
    """(conv, block, total, p1, p2, ids, sizes): the blocks of every rebuilt conversation.

    ``ids`` holds two longs a turn, ``total`` is the conversation's length and
    (p1, p2) the key of what precedes the block.
    """
    rows = stored(placed(turns), "trie-placed")
    head_size = F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_HEAD
    family = F.col("conv") - F.col("conv") % FAMILY
    heads = rows.where((F.col("conv") % FAMILY == 0) & (F.col("at") < MOST_HEAD - 1)).groupBy(F.col("conv").alias("family")).agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "size"))).alias("head"))
    convs = rows.groupBy("conv").agg(F.count("*").alias("own")).withColumn("h", head_size).withColumn("family", family)
    convs = convs.join(heads, "family", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,a:bigint,b:bigint,size:bigint>>")), 1, F.col("h").cast("int")))
    convs = convs.withColumn("k", F.size("head").cast("long")).withColumn("total", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("conv", "own", "h", "k", "total", "head"), "trie-conversations")

    span = lambda c: F.floor(F.col(c) / SPAN)
    facts = convs.select("conv", "h", "k", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("own") - 1) / SPAN))).alias("span"))
    own = rows.withColumn("span", span("at")).join(facts, ["conv", "span"]).where("at >= h").select("conv", "total", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "a", "b", "size")
    shared = convs.select("conv", "total", F.inline("head")).select("conv", "total", "at", "a", "b", "size")
    key = lambda seed: F.xxhash64(F.lit(seed), "at", "a", "b")
    cells = own.unionByName(shared).select("conv", "total", F.floor(F.col("at") / width).alias("block"), F.struct("at", key(1).alias("g1"), key(2).alias("g2"), "size").alias("cell"))
    blocks = cells.groupBy("conv", "block").agg(F.first("total").alias("total"), F.sort_array(F.collect_list("cell")).alias("cells"))
    blocks = blocks.select("conv", "block", "total", F.flatten(F.transform("cells", lambda x: F.array(x.g1, x.g2))).alias("ids"), F.transform("cells", lambda x: x.size).alias("sizes"))
    none = F.array().cast("array<bigint>")
    blocks = blocks.unionByName(convs.where("total = 0").select("conv", F.lit(0).cast("long").alias("block"), "total", none.alias("ids"), none.alias("sizes")))
    return stored(with_prefix(stored(blocks, "trie-blocks")), "trie-keyed")


def with_prefix(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the key of the blocks before each, summed in two levels so that no conversation meets in one task."""
    if not (blocks.agg(F.max("block")).first()[0] or 0):
        return blocks.withColumns({"p1": F.lit(0).cast("long"), "p2": F.lit(0).cast("long")})
    odd = lambda parity: F.aggregate(F.filter("ids", lambda x, i: i % 2 == parity), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    own = blocks.select("conv", "block", F.floor(F.col("block") / SPAN).alias("span"), odd(0).alias("x1"), odd(1).alias("x2"))
    past = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0).cast("long"))
    spans = own.groupBy("conv", "span").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    spans = spans.select("conv", "span", over("x1", past(["conv"], "span")).alias("s1"), over("x2", past(["conv"], "span")).alias("s2"))
    inner = own.select("conv", "span", "block", over("x1", past(["conv", "span"], "block")).alias("i1"), over("x2", past(["conv", "span"], "block")).alias("i2"))
    keys = inner.join(spans, ["conv", "span"]).select("conv", "block", F.col("i1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("i2").bitwiseXOR(F.col("s2")).alias("p2"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return blocks.join(keys, ["conv", "block"], "left").select(*blocks.columns, zero("p1"), zero("p2"))


NODE = (
    "depth long, k1 long, k2 long, q1 long, q2 long, b1 long, b2 long, conv long, parent long, n long, size long, kids long, leaves long, saved long, "
    "more boolean, edge boolean, path array<struct<depth:bigint,k1:bigint,k2:bigint>>, ends string, first_end long"
)
NAMES = [x.split()[0] for x in NODE.split(", ")]


class Shard:
    """One padded matrix of turn ids, and its nodes."""

    def __init__(self, rows: pa.Table, width: int):
        block, p1, p2, conv, total = (rows.column(n).to_numpy() for n in ("block", "p1", "p2", "conv", "total"))
        ids, sizes = (rows.column(n).combine_chunks() for n in ("ids", "sizes"))
        lens = sizes.value_lengths().to_numpy().astype(np.int64)
        n, w = len(conv), int(lens.max(initial=0))
        flat, flat_sizes = ids.flatten().to_numpy(), sizes.flatten().to_numpy()
        row = np.repeat(np.arange(n), lens)
        col = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        g1, g2, size = (np.full((n, w), fill, dtype=np.int64) for fill in (np.iinfo(np.int64).min, np.iinfo(np.int64).min, 0))
        g1[row, col], g2[row, col], size[row, col] = flat[0::2], flat[1::2], flat_sizes
        order = np.lexsort([conv, *[m[:, t] for t in range(w - 1, -1, -1) for m in (g2, g1)], p2, p1, block])
        self.block, self.p1, self.p2, self.conv, self.total, self.lens = (x[order] for x in (block, p1, p2, conv, total, lens))
        self.g1, self.g2, self.size, self.n, self.w, self.width = g1[order], g2[order], size[order], n, w, width

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``NODE``: the shard's nodes, the root of its first blocks, and the ends of nodes that may go on elsewhere."""
        n, w = self.n, self.w
        changed = np.ones((n, w + 1), dtype=bool)
        changed[1:, 0] = (self.block[1:] != self.block[:-1]) | (self.p1[1:] != self.p1[:-1]) | (self.p2[1:] != self.p2[:-1])
        changed[1:, 1:] = (self.g1[1:] != self.g1[:-1]) | (self.g2[1:] != self.g2[:-1])
        changed = np.logical_or.accumulate(changed, axis=1)[:, 1:]
        k1 = np.bitwise_xor.accumulate(np.column_stack([self.p1, np.where(np.arange(w) < self.lens[:, None], self.g1, 0)]), axis=1)
        k2 = np.bitwise_xor.accumulate(np.column_stack([self.p2, np.where(np.arange(w) < self.lens[:, None], self.g2, 0)]), axis=1)
        depth = self.block * self.width
        levels, owner = [], np.zeros((n, w), dtype=np.int64)
        for t in range(w):
            there = np.flatnonzero(self.lens > t)
            starts = np.flatnonzero(changed[there, t])
            first = there[starts]
            owner[there, t] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(there))))
            members = np.diff(np.append(starts, len(there)))
            least = np.minimum.reduceat(self.conv[there], starts)
            more = np.maximum.reduceat(self.total[there], starts) > depth[first] + t + 1
            last = there[np.append(starts[1:], len(there)) - 1]
            edge = (first == 0) | (last == n - 1)
            ended = self.total[there] == depth[there] + t + 1
            levels.append({"first": first, "n": members, "least": least, "more": more, "edge": edge, "there": there, "starts": starts, "ended": ended, "size": self.size[first, t]})
        kids = leaves = saved = np.zeros(0, dtype=np.int64)
        for t in range(w - 1, -1, -1):
            x = levels[t]
            count = len(x["first"])
            x["kids"], x["leaves"], x["saved"] = np.zeros(count, dtype=np.int64), (~x["more"] & ~x["edge"]).astype(np.int64), np.where(x["edge"], 0, (x["n"] - 1) * x["size"])
            if t + 1 < w and len(levels[t + 1]["first"]):
                parent = owner[levels[t + 1]["first"], t]
                for name, values in (("kids", (~levels[t + 1]["edge"]).astype(np.int64)), ("leaves", leaves), ("saved", saved)):
                    np.add.at(x[name], parent, values)
            leaves, saved = x["leaves"], x["saved"]
        yield from self._root(levels[0] if levels else None)
        for t, x in enumerate(levels):
            above = levels[t - 1] if t else None
            yield from self._level(t, x, above, owner, depth, k1, k2)

    def _level(self, t: int, x: dict, above: dict | None, owner: np.ndarray, depth: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> Iterator[tuple]:
        ends = np.append(x["starts"][1:], len(x["there"]))
        for i, r in enumerate(x["first"].tolist()):
            d, edge, block = int(depth[r]) + t + 1, bool(x["edge"][i]), int(self.block[r])
            keys = list(zip(k1[r, : t + 2].tolist(), k2[r, : t + 2].tolist(), strict=True))
            parent = None
            if t and not above["edge"][owner[r, t - 1]]:
                parent = int(above["least"][owner[r, t - 1]])
            deep = t == self.width - 1 and bool(x["more"][i])
            path = [(d - 1 - u, *keys[t - u]) for u in range(t + (block == 0))] if edge or deep else None
            mine = slice(x["starts"][i], ends[i])
            done = self.conv[x["there"][mine][x["ended"][mine]]]
            digest = None if edge else hashlib.sha256(",".join(map(str, done.tolist())).encode()).hexdigest() if len(done) else NOTHING
            q, b = keys[t], keys[0] if block else (None, None)
            yield (d, *keys[t + 1], *q, *b, int(x["least"][i]), parent, int(x["n"][i]), int(x["size"][i]), int(x["kids"][i]), int(x["leaves"][i]), int(x["saved"][i]), bool(x["more"][i]), edge, path, digest, None)
            if edge:
                yield from self._ends(d, keys[t + 1], done)

    def _ends(self, d: int, key: tuple, done: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(done), DIGEST_IDS):
            some = done[at : at + DIGEST_IDS].tolist()
            yield (d, *key, *[None] * 11, None, None, None, ",".join(map(str, some)), some[0])

    def _root(self, top: dict | None) -> Iterator[tuple]:
        mine = np.flatnonzero(self.block == 0)
        if not len(mine):
            return
        sums = [0, 0, 0]
        if top is not None:
            of_root = self.block[top["first"]] == 0
            sums = [int((~top["edge"] & of_root).sum()), int(top["leaves"][of_root].sum()), int(top["saved"][of_root].sum())]
        yield (0, 0, 0, None, None, None, None, int(self.conv[mine].min()), None, len(mine), 0, *sums, bool((self.total[mine] > 0).any()), True, [], None, None)
        yield from self._ends(0, (0, 0), np.sort(self.conv[mine][self.total[mine] == 0]))


def shard_nodes(blocks: DataFrame, width: int) -> DataFrame:
    """The nodes of every shard of the blocks, range-partitioned by what precedes them, their ids and their conversation."""
    order = ["block", "p1", "p2", "ids", "conv"]
    schema = T.StructType.fromDDL(NODE)
    kinds = [pa.int64()] * 14 + [pa.bool_(), pa.bool_(), pa.list_(pa.struct([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])), pa.string(), pa.int64()]

    def rows_of(shard: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        for node in Shard(pa.Table.from_batches(shard), width).nodes():
            some.append(node)
            if len(some) == 20_000:
                yield batch_of(some)
                some = []
        if some:
            yield batch_of(some)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        columns[16] = [None if p is None else [{"depth": d, "k1": a, "k2": b} for d, a, b in p] for p in columns[16]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, widest = [], 0, 1
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                wide = max(widest, int(pc.max(part.column("sizes").value_lengths()).as_py() or 0))
                if shard and (rows + len(part) > SHARD_ROWS or (rows + len(part)) * wide > SHARD_CELLS):
                    yield from rows_of(shard)
                    shard, rows, wide = [], 0, wide
                shard.append(part)
                rows, widest = rows + len(part), wide
        if rows:
            yield from rows_of(shard)

    return blocks.repartitionByRange(*order).sortWithinPartitions(*order).select("block", "p1", "p2", "conv", "total", "ids", "sizes").mapInArrow(run, schema)


def digests(chunks: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): the digest of each node's ids, streamed in their order; a row holds at most ``DIGEST_IDS`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for *mine, text in zip(*(batch.column(n).to_pylist() for n in ("depth", "k1", "k2", "ends")), strict=True):
                if mine != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = mine, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if key is not None:
            out.append((*key, state.hexdigest()))
        for at in range(0, len(out), 10_000):
            columns = list(zip(*out[at : at + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3])], names=["depth", "k1", "k2", "ends"])

    keys = ["depth", "k1", "k2"]
    return chunks.repartition(*keys).sortWithinPartitions(*keys, "first_end").select(*keys, "ends").mapInArrow(run, "depth long, k1 long, k2 long, ends string")


KEYS = ["depth", "k1", "k2"]


def recombined(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """The nodes of several shards, one row each, with what they add to each other."""
    parts = edges.groupBy(*KEYS).agg(
        *[F.first(c).alias(c) for c in ("q1", "q2", "b1", "b2", "size", "path")], F.min("conv").alias("conv"), F.max("more").alias("more"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    )
    parts = stored(parts.withColumns({"leaf": (~F.col("more")).cast("long"), "save": (F.col("n") - 1) * F.col("size")}), "trie-edges")
    up = parts.select(F.explode("path").alias("p"), "leaf", "save").groupBy(*[F.col(f"p.{c}").alias(c) for c in KEYS]).agg(F.sum("leaf").alias("up_leaves"), F.sum("save").alias("up_saved"))
    # A later block's first nodes are counted with that block.
    below = parts.where("depth > 0 and (b1 is null or q1 <> b1 or q2 <> b2)").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("up_kids"))
    some = lambda c: F.coalesce(c, F.lit(0))
    out = parts.join(up, KEYS, "left").join(below, KEYS, "left").join(digests(chunks), KEYS, "left")
    return out.select(*KEYS, "q1", "q2", "b1", "b2", "conv", F.lit(None).cast("long").alias("parent"), "n", (F.col("kids") + some("up_kids")).alias("kids"), (F.col("leaves") + F.col("leaf") + some("up_leaves")).alias("leaves"), (F.col("saved") + F.col("save") + some("up_saved")).alias("saved"), F.lit(True).alias("edge"), "path", F.coalesce("ends", F.lit(NOTHING)).alias("ends"))


def with_later_blocks(nodes: DataFrame, width: int) -> DataFrame:
    """``nodes`` with what the later blocks of their conversations add to kids, leaves and saved."""
    top = nodes.where((F.col("depth") > 1) & (F.col("depth") % width == 1)) if width > 1 else nodes.where("depth > 1")
    roots = top.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("more_kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = nodes.where("path is not null and depth > 0").where(F.col("depth") % width == 0).select(*KEYS, F.when(F.col("b1").isNotNull(), F.struct((F.col("depth") - width).alias("depth"), F.col("b1").alias("k1"), F.col("b2").alias("k2"))).alias("up"), "path")
    roots = stored(roots.join(above, KEYS), "trie-roots")
    sums, far = roots.select(*KEYS, "leaves", "saved", "up"), True
    while far:
        reach = sums.where("up is not null").groupBy(*[F.col(f"up.{c}").alias(c) for c in KEYS]).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        next_up = sums.select(F.struct(*KEYS).alias("up"), F.col("up").alias("next"))
        sums = sums.join(reach, KEYS, "left").join(next_up, "up", "left").select(*KEYS, (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("next").alias("up"))
        sums = stored(sums, "trie-sums")
        far = not sums.where("up is not null").isEmpty()
    given = roots.select(*KEYS, "path", "more_kids").join(sums.drop("up"), KEYS)
    to_all = given.select(F.explode(F.concat(F.array(F.struct(*KEYS)), "path")).alias("p"), "leaves", "saved").groupBy(*[F.col(f"p.{c}").alias(c) for c in KEYS]).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    some = lambda c: F.coalesce(c, F.lit(0))
    out = nodes.join(to_all, KEYS, "left").join(given.select(*KEYS, "more_kids"), KEYS, "left")
    return out.withColumns({"leaves": F.col("leaves") + some("l"), "saved": F.col("saved") + some("s"), "kids": F.col("kids") + some("more_kids")}).drop("l", "s", "more_kids")


def prefix_trie(conversations: DataFrame, width: int = 64) -> DataFrame:
    """Every node of the trie of rebuilt conversations, named by its smallest member and its depth.

    The columns are ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. A null role or text is
    empty, a null turn comes first, turns of equal number stand in the order of
    their hashes, repeated rows are turns of their own, and rows without a
    conversation are left out, as are further columns. An empty table gives no rows. A conversation of any
    length is cut into blocks of ``width`` turns.

    One node's digest is one sequential run over its ending conversations by
    definition; it streams rows of ids in order, so its memory stays bounded.
    """
    blocks = rebuilt_blocks(stored(turns_of(conversations), "trie-ids"), width)
    raw = stored(shard_nodes(blocks, width), "trie-nodes")
    chunks, found = raw.where("first_end is not null"), raw.where("first_end is null")
    edges = stored(recombined(found.where("edge"), chunks), "trie-shared")
    inner = found.where("not edge").select(*[c for c in edges.columns])
    nodes = inner.unionByName(edges)
    later = (blocks.agg(F.max("block")).first()[0] or 0) > 0
    if later:
        nodes = stored(with_later_blocks(nodes, width), "trie-all")
    root = edges.where("depth = 0").select("conv").first()
    if root is None:
        return nodes.select(*outcome(F.col("parent")))
    known = edges.where("depth > 0").select(*KEYS, "conv")
    if later:
        known = stored(known.unionByName(nodes.where("not edge and path is not null").where(F.col("depth") % width == 0).select(*KEYS, "conv")), "trie-parents")
    known = known.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv").alias("above"))
    if small_enough(known, BROADCAST_BYTES):
        joined = nodes.join(F.broadcast(known), ["depth", "q1", "q2"], "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = nodes.withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int")).join(salted, ["depth", "q1", "q2", "salt"], "left")
    return joined.select(*outcome(F.when(F.col("depth") == 1, F.lit(root["conv"])).otherwise(F.coalesce("parent", "above"))))


def outcome(parent) -> list:
    return [F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
