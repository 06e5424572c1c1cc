"""Benchmark decontamination with suffix arrays over shards of the training text.

Each Arrow batch of documents is a shard: its words become numbers of the
benchmark's vocabulary (other words 0), and the suffixes that can still match a
window are sorted into a suffix array. Every benchmark suffix is then located
in it by binary search, which gives all verbatim occurrences, and occurrences
at consecutive places join to the longest matches. Documents stay where they
are; only the benchmark, cut into blocks of bounded size, goes to the tasks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import annotate, chunks, set_aside, stored

WINDOW = 10
#: Bytes to word characters: A-Z become lower case; what is no letter, digit or non-ASCII byte becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Block:
    """The windows of some benchmark items over their own vocabulary; items of equal words are one."""

    def __init__(self, named: list[tuple[str | None, list[bytes]]], window: int):
        alike: dict[bytes, list[str]] = {}
        for name, words in named:
            alike.setdefault(b" ".join(words), []).extend([name] if name is not None else [])
        items = [(names, words.split()) for words, names in alike.items()]
        self.window, self.names = window, [sorted(set(names)) for names, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        low, high, self.item, self.place, self.length = [], [], [], [], []
        shortest: dict[int, int] = {}
        for k, (_, words) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for p in range(len(ids) - size + 1 if ids else 0):
                low.append(ids[p : p + size] + [0] * (window - size))
                high.append(ids[p : p + size] + [2**32 - 1] * (window - size))
                self.item.append(k)
                self.place.append(p)
                self.length.append(size)
                shortest[ids[p]] = min(size, shortest.get(ids[p], size))
        as_bytes = lambda rows: np.array(rows, dtype=">u4").reshape(len(rows), window).view(f"S{4 * window}").ravel()
        self.low, self.high = as_bytes(low), as_bytes(high)
        self.item, self.place, self.length = (np.array(x, dtype=np.int64) for x in (self.item, self.place, self.length))
        self.least = np.full(len(self.vocabulary) + 1, 1 << 30, dtype=np.int64)
        for i, n in shortest.items():
            self.least[i] = n

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``ids``, windows of the block) of all occurrences; 0 in ``ids`` ends a match."""
        ids = np.concatenate([ids, np.zeros(self.window, dtype=ids.dtype)])
        gaps = np.flatnonzero(ids == 0)
        starts = np.flatnonzero(self.least[ids] <= self.window)
        run = gaps[np.searchsorted(gaps, starts)] - starts
        starts = starts[run >= self.least[ids[starts]]]
        if not len(starts):
            return starts, starts
        suffixes = np.ascontiguousarray(ids[starts[:, None] + np.arange(self.window)].astype(">u4")).view(f"S{4 * self.window}").ravel()
        order = np.argsort(suffixes, kind="stable")
        array, starts = suffixes[order], starts[order]
        first = np.searchsorted(array, self.low, side="left")
        after = np.searchsorted(array, self.high, side="right")
        found = np.maximum(after - first, 0)
        window = np.repeat(np.arange(len(found)), found)
        at = np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(first, found)
        return starts[at], window


def _longest(place: np.ndarray, window: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, item) of the maximal matches: windows that follow each other in text and item are one."""
    item, shift = block.item[window], place - block.place[window]
    order = np.lexsort((place, shift, item))
    place, item, shift, size = place[order], item[order], shift[order], block.length[window][order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] != place[:-1] + 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(place)) - 1
    return place[start], place[last] + size[last], item[start]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most_chars: int) -> Iterator[Block]:
    """The benchmark in blocks of at most ``most_chars`` characters, or one longer item; one empty block if it has no text.

    Tasks form the blocks and write them to the shared folder; the driver passes one at a time on to the broadcast.
    """
    rows = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda items: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block(items, window))], pa.binary())], names=["block"])
        items, size = [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if items and size + len(text) > most_chars:
                    yield made(items)
                    items, size = [], 0
                items.append((name, words_of(text)))
                size += len(text)
        if items:
            yield made(items)

    blocks = stored(rows.repartition(max(1, math.ceil(chars / most_chars))).mapInArrow(form, "block binary"), "benchmark-blocks")
    if not chars:
        yield Block([], window)
    for row in blocks.toLocalIterator():
        yield pickle.loads(bytes(row["block"]))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = 4_000_000,
    shard_chars: int = 16_000_000,
    blocks_at_once: int = 4,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items, longest_match, longest_at, contaminated``.

    A window is ``window`` consecutive words of an item; a shorter item is one
    window, and an item with no words has none. ``n_hit`` counts document words
    inside occurrences, ``items`` lists the item ids with occurrences as sorted
    distinct strings (a null id counts for ``n_hit`` alone), and
    ``longest_match`` is the length in words of the longest verbatim match,
    which starts at word ``longest_at`` (-1 if there is none). Null and empty
    texts have no words; an empty benchmark hits nothing; repeated rows and
    items count once each for their row or id; other columns pass through, save
    those with the new names, which are replaced. The benchmark goes to the
    tasks in blocks of ``block_chars``; after every ``blocks_at_once`` of them
    the documents are written and the blocks leave the memory, so that what is
    broadcast does not grow with the benchmark.
    """
    spark = docs.sparkSession
    fields = [T.StructField("_ranges", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.StringType()))]
    counts = [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "longest_match", "longest_at")]
    docs, back = set_aside(docs.drop("n_items", "items", "contaminated"), "_ranges", "_items")
    out = docs.withColumns({"_ranges": F.array().cast("array<long>"), "_items": F.array().cast("array<string>")})

    def scan(shared):
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            block: Block = shared.value
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ranges = batch.column(batch.schema.get_field_index("_ranges")).to_pylist()
            items = batch.column(batch.schema.get_field_index("_items")).to_pylist()
            rows = []
            get = block.vocabulary.get
            for first, after in chunks(texts, shard_chars):
                ids: list[int] = []
                begins, sizes = [], []
                for text in texts[first:after]:
                    words = words_of(text)
                    begins.append(len(ids))
                    sizes.append(len(words))
                    ids += [get(w, 0) for w in words]
                    ids.append(0)
                place, window_no = block.search(np.array(ids, dtype=np.int64))
                if len(place):
                    start, end, item = _longest(place, window_no, block)
                    owner = np.searchsorted(begins, start, side="right") - 1
                    for d, s, e, k in zip(owner.tolist(), start.tolist(), end.tolist(), item.tolist(), strict=True):
                        ranges[first + d] += [s - begins[d], e - begins[d]]
                        items[first + d] += block.names[k]
                rows += sizes
            hit, longest, at = [], [], []
            for k, bounds in enumerate(ranges):
                n, far, best, where = 0, 0, 0, -1
                for s, e in sorted(zip(bounds[::2], bounds[1::2], strict=True)):
                    n += max(0, e - max(s, far))
                    far = max(far, e)
                    if e - s > best:
                        best, where = e - s, s
                hit.append(n)
                longest.append(best)
                at.append(where)
                items[k] = sorted(set(items[k]))
            return {
                "_ranges": pa.array(ranges, pa.list_(pa.int64())),
                "_items": pa.array(items, pa.list_(pa.string())),
                "n_words": pa.array(rows, pa.int64()),
                "n_hit": pa.array(hit, pa.int64()),
                "longest_match": pa.array(longest, pa.int64()),
                "longest_at": pa.array(at, pa.int64()),
            }

        return run

    held = []
    for block in benchmark_blocks(benchmark, item_id_col, item_text_col, window, block_chars):
        if len(held) == blocks_at_once:
            out = stored(out, "decontamination")
            for old in held:
                old.destroy()
            held = []
        held.append(spark.sparkContext.broadcast(block))
        out = annotate(out, scan(held[-1]), fields + counts)
    out = out.withColumns({"items": F.array_sort("_items"), "n_items": F.size("_items").cast("long"), "contaminated": F.col("n_hit") > 0})
    return back(out.drop("_ranges", "_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; the columns of ``docs``."""
    return find_contamination(docs, benchmark, **options).where(~F.col("contaminated")).select(*docs.columns)
