"""Near-duplicate classes by BagMinHash, banding and exact verification.

A document is the multiset of its five-word shingles. The weights of a shingle
are unit levels, cut at time zero into octaves, each with a Poisson process of
its width as rate. A point carries a time, a signature place and a level, and
counts where its level lies below the shingle's count. At its point a process
splits into two of half its range, which go on from that time with numbers of
their own, down to single levels; halves above the count are dropped. A place
holds the earliest time, so two signatures agree in a place with the
probability of the weighted Jaccard similarity. A process that cannot beat its
document's latest place any more stops and splits no further.

Equal texts are one node. Nodes that share a band of signature places are a
bucket. In a star round every bucket picks a leader, and the others are verified
against it on the shingle multisets themselves; a bucket whose nodes are of one
class by then is done. What the star rounds leave is cut into blocks, and pairs
of blocks whose classes differ are compared exactly, so that no task holds a
bucket, a hot leader is dealt to many tasks, and no text links in vain to a
class that it already belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from socspark.operators.components import connected_components

from .decontaminate import words_of
from .shared import chunks, stored

SHINGLE = 5
LEAST = 0.8
PLACES = 128
BANDS, ROWS = 25, 5
#: Constants that tell the numbers of a process apart: its next time, its point, and its two halves.
NEXT, POINT, LOWER, UPPER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
#: Nodes of a bucket that one part of it holds at most, about; the number of parts is a power of two.
PART_ROWS = 256
#: Tasks that the nodes of one family meet its shape in.
SHAPE_COPIES = 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class WordHashes(dict):
    """64-bit hashes of words, kept for the words that come again."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(docs: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted by document and shingle. A text of fewer than five words, but not none, is one shingle."""
    numbers: list[int] = []
    sizes = np.empty(len(docs), dtype=np.int64)
    for i, words in enumerate(docs):
        numbers += map(hashes.__getitem__, words)
        short = SHINGLE - len(words) if 0 < len(words) < SHINGLE else 0
        numbers += [0] * short
        sizes[i] = len(words) + short
    h = np.array(numbers + [0] * (SHINGLE - 1), dtype=np.uint64)
    n = len(numbers)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        value = value * np.uint64(0x9E3779B97F4A7C15) + _mix(h[k : n + k] + np.uint64(k))
    value = _mix(value)
    owner = np.repeat(np.arange(len(docs)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    whole = left >= SHINGLE
    owner, value = owner[whole], value[whole]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value)))


def signatures(n_docs: int, owner: np.ndarray, value: np.ndarray, count: np.ndarray, places: int = PLACES) -> np.ndarray:
    """BagMinHash signatures, one row of ``places`` times for each document; infinite where a document has no shingle.

    The processes of a shingle form a tree that depends on the shingle alone, so documents of
    different counts see the same points. All processes whose next point can still be earlier than
    the latest place of their document take it together.
    """
    parts = [(owner, value, count, np.zeros(len(owner), dtype=np.int64), np.ones(len(owner), dtype=np.int64))]
    low = 1
    while (more := count > low).any():
        octave = np.full(int(more.sum()), low, dtype=np.int64)
        parts.append((owner[more], _mix(value[more] + np.uint64(low)), count[more], octave, octave))
        low *= 2
    owner, seed, count, low_end, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(owner))
    sig = np.full(n_docs * places, np.inf)
    latest = np.full(n_docs, np.inf)
    while len(owner):
        seed = _mix(seed + NEXT)
        time = time - np.log(_uniform(seed)) / width
        early = time < latest[owner]
        owner, seed, count, low_end, width, time = (x[early] for x in (owner, seed, count, low_end, width, time))
        draw = _mix(seed ^ POINT)
        level = low_end + (width * _uniform(_mix(draw + np.uint64(1)))).astype(np.int64)
        hit = level < count
        np.minimum.at(sig, owner[hit] * places + (draw[hit] % np.uint64(places)).astype(np.int64), time[hit])
        latest = sig.reshape(n_docs, places).max(axis=1)
        half = width // 2
        upper = (half > 0) & (low_end + half < count)
        if (split := half > 0).any():
            right = (owner[upper], _mix(seed[upper] ^ UPPER), count[upper], (low_end + half)[upper], half[upper], time[upper])
            left = (owner, np.where(split, _mix(seed ^ LOWER), seed), count, low_end, np.where(split, half, width), time)
            owner, seed, count, low_end, width, time = (np.concatenate(x) for x in zip(left, right, strict=True))
    return sig.reshape(n_docs, places)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """BANDS numbers for each document."""
    bits = np.ascontiguousarray(sig).view(np.uint64)
    out = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        out = _mix(out * np.uint64(31) + bits[:, k : BANDS * ROWS : ROWS] + np.uint64(k))
    return _mix(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, chunk_chars: int = 1_000_000) -> DataFrame:
    """(id, text_hash, key, weight, bands): ``key`` is equal for texts of equal words and null for texts without a word; ``weight`` counts shingles."""
    fields = [("text_hash", T.LongType()), ("key", T.BinaryType()), ("weight", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(*f) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for first, after in chunks(texts, chunk_chars):
                words = [words_of(t) for t in texts[first:after]]
                owner, value, count = shingles(words, hashes)
                bands = band_hashes(signatures(len(words), owner, value, count))
                keys = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
                weight = np.bincount(owner, count, len(words)).astype(np.int64)
                offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * BANDS)
                part = [c.slice(first, after - first) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*part, pa.array(keys, pa.binary()), pa.array(weight), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))], names=schema.names)

    return docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col).mapInArrow(run, schema)


BAG = [T.StructField("value", T.ArrayType(T.LongType())), T.StructField("count", T.ArrayType(T.IntegerType()))]


def bags_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, chunk_chars: int = 1_000_000) -> DataFrame:
    """(node, value, count): the shingles of the texts that ``nodes`` (node, id, text_hash) names, joined by sort and merge at every size."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = rows.join(nodes.hint("merge"), ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, after in chunks(texts, chunk_chars):
                owner, value, count = shingles([words_of(t) for t in texts[first:after]], hashes)
                offsets = pa.array(np.searchsorted(owner, np.arange(after - first + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (value.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, after - first), *lists], names=["node", "value", "count"])

    return rows.select("node", "text").mapInArrow(run, T.StructType([T.StructField("node", T.BinaryType()), *BAG]))


Bag = tuple[np.ndarray, np.ndarray]


def _bags(value: pa.ListArray, count: pa.ListArray) -> list[Bag]:
    """The rows of two Arrow columns as pairs of arrays, the values sorted as they were made."""
    bounds = value.offsets.to_numpy()
    values, counts = value.values.to_numpy().view(np.uint64), count.values.to_numpy()
    return [(values[s:e], counts[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def similar(a: Bag, b: Bag, least: float = LEAST) -> bool:
    """Whether the weighted Jaccard similarity of two bags is ``least`` or more."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return both >= least * (int(a[1].sum()) + int(b[1].sum()) - both)


def verified_stars(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(src, dst): the pairs (leader, node, parts) that are similar enough.

    A pair comes once, with the number of parts of the largest bucket that it
    shares, and is dealt by its node to one of them, so no join has to count a
    leader's nodes first. A part holds about PART_ROWS nodes of each bucket of
    its leader, at most BANDS times that; they pass by one copy of the leader's
    bag one at a time.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    leaders = dealt.select("leader", "parts", "part", F.lit(0).alias("turn"), F.col("leader").alias("node")).distinct()
    wanted = dealt.select("leader", "parts", "part", F.lit(1).alias("turn"), "node").unionByName(leaders)
    rows = wanted.join(bags, "node").select("leader", "part", "turn", "node", "value", "count", "parts")
    rows = rows.repartition("leader", "parts", "part").sortWithinPartitions("leader", "parts", "part", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            src, dst = [], []
            columns = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for leader, turn, node, bag in zip(*columns, _bags(batch.column(4), batch.column(5)), strict=True):
                if turn == 0:
                    lead = bag
                elif similar(lead, bag):
                    src.append(leader)
                    dst.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], names=["src", "dst"])

    return rows.mapInArrow(run, "src binary, dst binary")


def prefix_mates(n: int, owner: np.ndarray, value: np.ndarray, count: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """For each of ``n`` documents a mask of the others that can be ``least`` similar to it; no pair that is gets lost.

    A multiset is a set of numbered units. Two sets of at least ``least``
    similarity share ``least`` of the larger one's units, so in one order of all
    units, rare ones first, they share one among the first of both.
    """
    total = np.bincount(owner, count, n).astype(np.int64)
    first = np.cumsum(count) - count
    number = (np.arange(int(count.sum())) - np.repeat(first, count)).astype(np.uint64)
    doc = np.repeat(owner, count)
    _, unit, known = np.unique(_mix(np.repeat(value, count) + _mix(number)), return_inverse=True, return_counts=True)
    order = np.lexsort((unit, known[unit], doc))
    doc, unit = doc[order], unit[order]
    place = np.arange(len(doc)) - (np.cumsum(total) - total)[doc]
    use = (place <= total[doc] - np.ceil(least * total - 1e-9).astype(np.int64)[doc]) & (known[unit] > 1)
    doc, unit = doc[use], unit[use]
    by_unit = np.argsort(unit, kind="stable")
    docs_of, units = doc[by_unit], unit[by_unit]
    start, end = np.searchsorted(units, unit), np.searchsorted(units, unit, side="right")
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for i in range(n):
        mates = np.zeros(n, dtype=bool)
        for k in range(bounds[i], bounds[i + 1]):
            mates[docs_of[start[k] : end[k]]] = True
        yield mates


def links_within(nodes: list, classes: list, side: list[int], bags: list[Bag], least: float = LEAST) -> list[tuple]:
    """Links of at least ``least`` similarity that connect all classes that are connected here, a spanning forest.

    ``side`` holds the block of each node; where there are two blocks, only
    pairs across them are compared. Pairs already connected are skipped.
    """
    n = len(nodes)
    owner = np.repeat(np.arange(n), [len(v) for v, _ in bags])
    value, count = (np.concatenate(x) for x in zip(*bags, strict=True))
    weight = np.array([c.sum() for _, c in bags])
    side_of = np.array(side)
    across = side_of.min() != side_of.max()
    first: dict = {}
    head, found = [first.setdefault(c, i) for i, c in enumerate(classes)], []

    def top(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, mates in enumerate(prefix_mates(n, owner, value, count, least)):
        mates[: i + 1] = False
        if across:
            mates &= side_of != side_of[i]
        # The similarity is at most the smaller weight over the larger.
        mates &= np.minimum(weight, weight[i]) >= least * np.maximum(weight, weight[i])
        for j in np.flatnonzero(mates).tolist():
            a, b = top(i), top(j)
            if a != b and similar(bags[i], bags[j], least):
                head[max(a, b)] = min(a, b)
                found.append((nodes[i], nodes[j]))
    return found


def verified_blocks(live: DataFrame, bags: DataFrame, block_rows: int = 128) -> DataFrame:
    """(src, dst): verified links between the classes of each bucket family of ``live`` (band, node, class, parts).

    The nodes of a family's largest class and all its others are cut into blocks
    of about ``block_rows`` by a hash of the node; every block of others meets
    every block, and blocks of the largest class do not meet each other.
    """
    heads = live.groupBy("band").agg(F.min("node").alias("src"), F.first("parts").alias("parts"))
    stars = by_bucket(live, heads).select("src", F.col("node").alias("dst")).distinct()
    nodes = live.select("node", "class").distinct().join(connected_components(stars), "node")
    sizes = nodes.groupBy("component", "class").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("component").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.ceil(F.max("n") / block_rows).cast("int").alias("a"), F.ceil((F.sum("n") - F.max("n")) / block_rows).cast("int").alias("b"))
    # A hot family is dealt to several tasks, each with a copy of its one row of shape.
    copies = shape.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SHAPE_COPIES - 1))))
    parts = nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SHAPE_COPIES)).cast("int")).join(copies, ["component", "part"]).drop("part").where("b > 0").withColumn("is_main", F.col("class") == F.col("main"))
    parts = parts.withColumn("side", F.when(F.col("is_main"), F.pmod(F.xxhash64("node"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("node"), F.col("b"))).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.when(F.col("is_main"), F.col("a")).otherwise(0), F.col("a") + F.col("b") - 1)))
    units = parts.select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "class")
    rows = units.join(bags, "node").select("component", "i", "j", "side", "node", "class", "value", "count")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, ([], [], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if len(set(group[1])) > 1 and (found := links_within(*group)):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["src", "dst"])

        for batch in batches:
            columns = (c.to_pylist() for c in batch.columns[:6])
            for component, i, j, side, node, klass, bag in zip(*columns, _bags(batch.column(6), batch.column(7)), strict=True):
                if (component, i, j) != last:
                    yield from flush()
                    last, group = (component, i, j), ([], [], [], [])
                for to, x in zip(group, (node, klass, side, (bag[0].copy(), bag[1].copy())), strict=True):
                    to.append(x)
        yield from flush()

    return rows.mapInArrow(run, "src binary, dst binary")


def by_bucket(live: DataFrame, found: DataFrame) -> DataFrame:
    """``live`` joined to ``found``, a row for each bucket; a large bucket is dealt in ``parts``, each with a copy of that row."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    copies = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return live.withColumn("part", part).join(copies, ["band", "part"]).drop("part")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 1) -> DataFrame:
    """(id, class_id, is_representative, text_hash) for each row of ``docs``.

    A class is a connected component of the links of 0.8 or more weighted
    Jaccard similarity on five-word shingles, words being runs of letters,
    digits and non-ASCII characters in lower case; its id is its smallest
    document id. Texts without a word, null among them, and rows with a null id
    are each a class of their own and represent it. Rows that repeat an id are
    documents of their own where their texts differ, so that their classes may
    share an id; ``text_hash`` (of the raw text) tells them apart, and the
    smallest (id, text_hash) of a class represents it. Rows that repeat both
    are alike in every result. Other columns are left out, and an empty table
    gives no rows. ``star_rounds`` shifts work between stars and blocks; the
    classes are the same.
    """
    rows = docs.select(id_col, text_col)
    sketches = stored(sketch(rows, id_col, text_col), "sketches")
    usable = sketches.where(F.col("key").isNotNull() & F.col(id_col).isNotNull())
    first = F.min(F.struct(F.col(id_col).alias("id"), "text_hash"))
    reps = stored(usable.groupBy(F.col("key").alias("node")).agg(first.alias("rep"), F.first("bands").alias("bands"), F.first("weight").alias("weight")), "distinct-texts")
    banded = reps.select("node", "weight", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / PART_ROWS, F.lit(1.0))))).cast("int").alias("parts"))
    live = stored(banded.join(shared, "band").select("band", "node", "weight", F.col("node").alias("class"), "parts"), "buckets")
    bags = stored(bags_of(rows, reps.join(live.select("node").distinct(), "node").select("node", "rep.*"), id_col, text_col), "shingles")
    links: DataFrame | None = None
    classes: DataFrame | None = None
    for n in range(star_rounds + 1):
        if live.isEmpty():
            break
        if n < star_rounds:
            order = F.struct(F.xxhash64(F.lit(n), "node").alias("h"), "node", "class", "weight")
            led = by_bucket(live, live.groupBy("band").agg(F.min(order).alias("to"), F.first("parts").alias("parts")))
            fits = F.least("weight", "to.weight") >= LEAST * F.greatest("weight", "to.weight")
            pairs = led.where((F.col("class") != F.col("to.class")) & fits).groupBy(F.col("to.node").alias("leader"), "node").agg(F.max("parts").alias("parts"))
            new = stored(verified_stars(stored(pairs, "stars"), bags), "links")
        else:
            new = stored(verified_blocks(live, bags), "links")
        links = new if links is None else links.unionByName(new)
        classes = stored(connected_components(links), "classes")
        known = live.drop("class").join(classes.withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
        if n < star_rounds:
            open_bands = known.groupBy("band").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.first("parts").alias("parts")).where("a <> b").select("band", "parts")
            live = stored(by_bucket(known, open_bands).select("band", "node", "weight", "class", "parts"), "buckets")
    named = reps.select("node", "rep")
    named = named.withColumn("class", F.col("node")) if classes is None else named.join(classes.withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    heads = named.join(named.groupBy("class").agg(F.min("rep").alias("head")), "class").select(F.col("node").alias("key"), "head")
    out = sketches.select(id_col, "text_hash", "key").join(heads, "key", "left")
    alone = F.col("key").isNull() | F.col(id_col).isNull()
    return out.select(
        id_col,
        F.when(alone, F.col(id_col)).otherwise(F.col("head.id")).alias("class_id"),
        (alone | ((F.col(id_col) == F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash")))).alias("is_representative"),
        "text_hash",
    )
