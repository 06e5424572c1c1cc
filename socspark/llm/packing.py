"""Sequence packing by minimum bin slack.

A document's token ids are cut into whole sequences and a remainder. Remainders
wait in a window of bounded size. For each bin, the longest remainder seeds it
and a subset-sum over the multiset of waiting lengths, held as a bitset in one
integer, finds the fill closest to the capacity; backtracking through the
recorded bitsets gives the count of each length. A pattern that fills a bin
exactly is repeated as often as the counts allow. What no pattern fills exactly
is cut at the sequence bound, so that only the last sequence of a task can be
short.

Packing is local to a task and needs no shuffle; ``sequence_id`` holds the
partition in its high bits. A partition re-read after a lost executor gives the
same pieces.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

END_OF_DOCUMENT = 1
SPECIAL = "<|endoftext|>"


class CachedEncoder:
    """Token ids, as little-endian unsigned 32-bit bytes, of a byte-level BPE.

    A single space before a visible character always starts a new pre-token, and
    a single line feed between visible characters is one by itself. So a text
    with no other white space is encoded word by word, from a bounded cache.
    Other texts are encoded whole; texts that hold the special token's string go
    to the tokenizer file's own library, which gives them its id.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, most_words: int = 300_000):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.whole, self.most_words = json_path, None, most_words
        self.first, self.later = self._cache(""), self._cache(" ")
        self.line_feed = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        ids = self.encoding.encode_ordinary(text)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _cache(self, before: str) -> dict:
        ids = self._ids

        class Cache(dict):
            def __missing__(self, word):
                self[word] = out = ids(before + word)
                return out

        return Cache()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])
        lines = text.split("\n")
        if " ".join(text.split()) != " ".join(lines):
            return self._ids(text)
        if len(self.later) > self.most_words:
            self.later.clear()
        if len(self.first) > self.most_words:
            self.first.clear()
        out = []
        for line in lines:
            words = line.split(" ")
            out.append(self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:])))
        return self.line_feed.join(out)


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of waiting lengths whose sum comes closest to ``room`` from below, as counts by length.

    ``lengths`` ascends and holds the lengths with a count above 0.
    """
    if room <= 0:
        return {}
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for i in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        length = lengths[i]
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int, int]]:
    """(counts by length of one bin, number of such bins, slack) until ``counts`` is used up."""
    counts = {n: c for n, c in counts.items() if c}
    lengths = sorted(counts)
    while lengths:
        seed = lengths[-1]
        counts[seed] -= 1
        pattern = fill(lengths, counts, capacity - seed)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        slack = capacity - sum(n * c for n, c in pattern.items())
        times = min(counts[n] // c for n, c in pattern.items()) if not slack else 1
        for n, c in pattern.items():
            counts[n] -= c * times
            if not counts[n]:
                del lengths[bisect_left(lengths, n)]
        yield pattern, times, slack


class Packer:
    """Packs the pieces of one task; ``rows`` gathers (doc, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, window: int, first_sequence: int):
        self.capacity, self.window, self.next = capacity, window, first_sequence
        self.waiting: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        n, step = len(ids) // 4, self.capacity
        for start in range(0, n - step + 1, step):
            self._emit([(doc, start, ids[start * 4 : (start + step) * 4], n)])
        if rest := n % step:
            self.waiting.append((doc, n - rest, ids[(n - rest) * 4 :], n))
            if len(self.waiting) >= self.window:
                self.pack(last=False)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            length = len(ids) // 4
            self.rows.append((doc, start, length, zlib.crc32(ids), n, self.next, offset))
            offset += length
        self.next += 1

    def pack(self, last: bool) -> None:
        by_length: dict[int, list[tuple]] = {}
        for piece in self.waiting:
            by_length.setdefault(len(piece[2]) // 4, []).append(piece)
        loose: list[tuple] = []
        for pattern, times, slack in patterns({n: len(x) for n, x in by_length.items()}, self.capacity):
            for _ in range(times):
                pieces = [by_length[n].pop() for n, c in pattern.items() for _ in range(c)]
                if slack:
                    loose += pieces
                else:
                    self._emit(pieces)
        self.waiting, room = [], self.capacity
        for doc, start, ids, n in loose:
            while ids:
                self.waiting.append((doc, start, ids[: room * 4], n))
                taken = min(room, len(ids) // 4)
                start, ids, room = start + taken, ids[taken * 4 :], room - taken
                if not room:
                    self._emit(self.waiting)
                    self.waiting, room = [], self.capacity
        if last and self.waiting:
            self._emit(self.waiting)
            self.waiting = []


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    window: int = 8192,
    tokenizer: tuple[str, str] = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"),
) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most ``capacity`` tokens.

    Each document is its token ids and one end id. A null or empty text is the
    end id alone. Repeated rows are packed each for itself, a null id stays
    null, other columns are left out, and an empty table gives no rows.
    ``window`` bounds the remainders that wait in a task.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as files

        encoder = CachedEncoder(files.path(tokenizer[0]), files.path(tokenizer[1]), files.PATTERN)
        packer = Packer(capacity, window, TaskContext.get().partitionId() << 36)
        end = END_OF_DOCUMENT.to_bytes(4, "little")
        id_type = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=[f.name for f in fields])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            id_type = ids.type
            for doc, text in zip(ids, texts, strict=True):
                packer.add(doc.as_py(), encoder.encode(text.as_py() or "") + end)
                if len(packer.rows) >= 50_000:
                    yield flush()
        packer.pack(last=True)
        if packer.rows:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
