"""Byte pair encoding with word ends by speculation and check, and decoding.

Texts are normalised, cut at white space and then into words; ids of a chunk
come from a bounded cache. New words of a batch are encoded together: greedy
longest match proposes their tokens, and each proposal is checked by its adjacent
pairs alone. Merges act on the symbols of a word in the order of their rank, so
inside two neighbouring tokens they are those of the two tokens alone, as long as
none crosses an outer border. A word's first crossing merge would therefore also
happen in the pair by itself: tokens are the word's encoding exactly if no pair
of neighbours merges across its border. Only words with a pair that fails (or a
token that merging does not yield, or whose ranks do not rise from part to whole)
are merged step by step.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import annotate, chunks

#: A word's last byte is a symbol of its own: the byte and this.
WORD_END = 256
#: Longer chunks leave the cache with the batch that brought them.
LONGEST_CACHED = 64
#: Characters of text that are encoded at once, and chunks or words that a cache may hold.
RUN_CHARS, MOST_CACHED = 1 << 22, 600_000
#: Words of more symbols are merged with a heap. No merge has this rank.
SHORT_WORD, NEVER = 40, 1 << 60


def byte_symbols() -> dict[str, int]:
    """The byte of each character of the byte-level alphabet: visible Latin-1 as it is, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Table:
    """A map from whole numbers to whole numbers, looked up for many keys at once; -1 where there is none."""

    def __init__(self, entries: dict[int, int]):
        self.keys = np.array(sorted(entries), dtype=np.int64)
        self.values = np.array([entries[k] for k in self.keys.tolist()], dtype=np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class WordBpe:
    """Encodes words given as symbols: bytes, the last one plus ``WORD_END``."""

    def __init__(self, vocab: dict[str, int], merges: list, end_of_word: str):
        alphabet, n = byte_symbols(), max(vocab.values()) + 1
        self.strings = [""] * n
        self.base = np.full(2 * WORD_END, -1, dtype=np.int64)
        steps, self.token_at, size = {}, {}, 1
        for string, token in vocab.items():
            self.strings[token] = string
            symbols = [alphabet[c] for c in string.removesuffix(end_of_word)]
            if string.endswith(end_of_word):
                symbols[-1] += WORD_END
            if len(symbols) == 1:
                self.base[symbols[0]] = token
            state = 0
            for s in symbols:
                key = state * 2 * WORD_END + s
                if key not in steps:
                    steps[key] = size
                    size += 1
                state = steps[key]
            self.token_at[state] = token
        self.step, self.token_of = Table(steps), np.full(size, -1, dtype=np.int64)
        self.token_of[list(self.token_at)] = list(self.token_at.values())
        self._rank_merges(vocab, merges, end_of_word, n)

    def _rank_merges(self, vocab: dict[str, int], merges: list, end_of_word: str, n: int) -> None:
        self.left, self.right, self.rank = (np.full(n, -1, dtype=np.int64) for _ in range(3))
        self.n, self.ranks, made, doubtful = n, {}, [], set()
        self.wholes = [-1] * len(merges)
        for rank, merge in enumerate(merges):
            a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = vocab[self.strings[a] + self.strings[b]]
            if a * n + b in self.ranks:
                continue
            self.ranks[a * n + b], self.wholes[rank] = rank, whole
            if self.rank[whole] >= 0:
                doubtful.add(whole)
            self.left[whole], self.right[whole], self.rank[whole] = a, b, rank
            made.append(whole)
        self.crossing = Table(self.ranks)
        self.symbol_tokens = self.base.tolist()
        made = np.array(made, dtype=np.int64)
        whole = np.ones(n, dtype=bool)
        whole[made] = self.keep_apart(self.left[made], self.right[made], self.rank[made])
        # A token stands for itself if merging its own symbols makes it, by ranks that rise from part to whole.
        self.sound = np.zeros(n, dtype=bool)
        self.sound[self.base[self.base >= 0]] = True
        for t in made.tolist():
            a, b = self.left[t], self.right[t]
            self.sound[t] = t not in doubtful and whole[t] and self.sound[a] and self.sound[b] and self.rank[t] > max(self.rank[a], self.rank[b])

    def keep_apart(self, first: np.ndarray, second: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the symbols of each pair of sound tokens gives the same two tokens.

        The merges are undone from the last to the first. Between two of them the
        symbols at the border stay, and a merge across it of a lower rank than the
        next one would have come before that one. Of equal ranks the left one comes
        first. With ``limit`` only crossing merges of a lower rank count.
        """
        out = np.ones(len(first), dtype=bool)
        rows, x, y = np.arange(len(first)), first.copy(), second.copy()
        limit = np.full(len(first), np.iinfo(np.int64).max) if limit is None else limit.copy()
        while len(rows):
            across = self.crossing(x * self.n + y)
            crosses = (across >= 0) & (across < limit)
            out[rows[crosses]] = False
            go = ~crosses & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            rows, x, y = rows[go], x[go], y[go]
            undo_left = self.rank[x] > self.rank[y]
            limit = np.where(undo_left, self.rank[x], self.rank[y] + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return out

    def propose(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over concatenated words: (token at each of its places, these places)."""
        n = len(symbols)
        longest, token = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        at, state, depth = np.arange(n), np.zeros(n, dtype=np.int64), 0
        while len(at):
            state = self.step(state * 2 * WORD_END + symbols[at + depth])
            depth += 1
            at, state = at[state >= 0], state[state >= 0]
            found = self.token_of[state]
            longest[at[found >= 0]], token[at[found >= 0]] = depth, found[found >= 0]
            more = (symbols[at + depth - 1] < WORD_END) & (at + depth < n)
            at, state = at[more], state[more]
        taken, place = np.zeros(n, dtype=bool), starts
        while len(place):
            taken[place] = True
            place = (place + longest[place])[symbols[place + longest[place] - 1] < WORD_END]
        places = np.flatnonzero(taken)
        return token[places], places

    def merge(self, symbols: list[int]) -> list[int]:
        """The tokens of one word, merged pair by pair in the order of ranks, the left one first."""
        tokens, get, n = [self.symbol_tokens[s] for s in symbols], self.ranks.get, self.n
        if len(tokens) > SHORT_WORD:
            return self._merge_long(tokens)
        ranks = [get(a * n + b, NEVER) for a, b in pairwise(tokens)]
        while ranks and (rank := min(ranks)) != NEVER:
            i = ranks.index(rank)
            tokens[i : i + 2] = [self.wholes[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(tokens[i - 1] * n + tokens[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(tokens[i] * n + tokens[i + 1], NEVER)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """As ``merge``, with a heap of pairs: for a word of n symbols about n log n steps."""
        get, n, size = self.ranks.get, self.n, len(tokens)
        after, before = [*range(1, size), -1], [-1, *range(size - 1)]
        heap = [(rank, i) for i in range(size - 1) if (rank := get(tokens[i] * n + tokens[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j < 0 or get(tokens[i] * n + tokens[j]) != rank:
                continue
            tokens[i], tokens[j], after[i] = self.wholes[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (found := get(tokens[k] * n + tokens[after[k]], NEVER)) != NEVER:
                    heapq.heappush(heap, (found, k))
        return [t for t in tokens if t >= 0]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """The tokens of non-empty words on end, the number of each word's tokens, and how many words were merged."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        if not len(sizes):
            return np.empty(0, dtype=np.int64), sizes, 0
        ends = np.cumsum(sizes)
        starts = ends - sizes
        symbols = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        symbols[ends - 1] += WORD_END
        tokens, places = self.propose(symbols, starts)
        word = np.searchsorted(ends, places, side="right")
        fails = np.zeros(len(words), dtype=bool)
        fails[word[~self.sound[tokens]]] = True
        joined = (word[:-1] == word[1:]) & self.sound[tokens[:-1]] & self.sound[tokens[1:]]
        pairs, which = np.unique(tokens[:-1][joined] * self.n + tokens[1:][joined], return_inverse=True)
        apart = self.keep_apart(pairs // self.n, pairs % self.n)
        fails[word[:-1][joined][~apart[which]]] = True
        counts = np.bincount(word, minlength=len(words))
        wrong = np.flatnonzero(fails)
        if len(wrong):
            all_symbols = symbols.tolist()
            exact = [self.merge(all_symbols[a:b]) for a, b in zip(starts[wrong].tolist(), ends[wrong].tolist(), strict=True)]
            right = tokens[~fails[word]]
            counts[wrong] = [len(x) for x in exact]
            merged = np.repeat(fails, counts)
            tokens = np.empty(len(merged), dtype=np.int64)
            tokens[~merged], tokens[merged] = right, [t for x in exact for t in x]
        return tokens, counts, len(wrong)


class TextEncoder:
    """Token ids of whole texts, from a tokenizer file with word ends, lower case and words by a pattern."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.path, self.library = path, None
        self.bpe = WordBpe(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        strings = self.bpe.strings + [""] * (max([*self.special.values(), 0]) + 1 - len(self.bpe.strings))
        for content, token in self.special.items():
            strings[token] = content
        self.strings = pa.array(strings, pa.string())
        self.cache: dict[str, bytes] = {s: np.array([t], dtype="<u4").tobytes() for s, t in self.special.items()}
        self.fixed, self.words = len(self.cache), {}

    def pieces(self, text: str) -> list[str]:
        """The chunks of a text between white space, normalised, with the special tokens' strings as chunks of their own."""
        out = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += part.split() if not SEPARATORS.search(part) else re.split(WHITE_SPACE, part.strip(" "))
        return out

    def _by_library(self, chunk: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = True  # lower-casing may have made such a string; it is ordinary text
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Puts the ids of new chunks into the cache."""
        known, words, spans = self.words, [], []
        for chunk in new:
            if chunk.isalpha():
                mine = [chunk]
            elif chunk.isascii() or all(map(settled, set(chunk))):
                mine = self.pattern.findall(chunk)
            else:
                self.cache[chunk] = self._by_library(chunk)
                continue
            words += [w for w in mine if w not in known]
            spans.append((chunk, mine))
        words = list(dict.fromkeys(words))
        tokens, counts, _ = self.bpe.encode([w.encode() for w in words])
        raw, ends = tokens.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        known.update(zip(words, [raw[a:b] for a, b in pairwise([0, *ends])], strict=True))
        for chunk, mine in spans:
            self.cache[chunk] = known[mine[0]] if len(mine) == 1 else b"".join([known[w] for w in mine])
        for word in words:
            if len(word) > LONGEST_CACHED:
                del known[word]

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and the bounds of each text's ids; null is an empty text."""
        if len(self.cache) > MOST_CACHED:
            self.cache = dict(list(self.cache.items())[: self.fixed])
        if len(self.words) > MOST_CACHED:
            self.words = {}
        split = [self.pieces(t) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.cache))
        self.learn(new)
        ids = [b"".join(map(self.cache.__getitem__, x)) for x in split]
        for chunk in new:
            if len(chunk) > LONGEST_CACHED:
                del self.cache[chunk]
        bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
        return np.frombuffer(b"".join(ids), dtype="<u4"), bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The strings of each text's tokens, with a space between."""
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.strings.take(pa.array(ids)))
        return pc.binary_join(lists, " ")


#: Python, but not the tokenizer, takes these for white space; then the tokenizer's own class is spelt out (fixed values: Unicode White_Space).
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@functools.lru_cache(maxsize=1 << 16)
def settled(char: str) -> bool:
    """Whether all libraries agree on the class of a character: it is assigned, and long since."""
    return unicodedata.category(char) not in ("Cn", "Co")


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str) -> TextEncoder:
    """The encoder of a public tokenizer's file, one for each Python worker."""
    import public_tokenizers as files

    return TextEncoder(files.path(tokenizer))


def encode_documents(docs: DataFrame, text_col: str = "text", tokenizer: str = "word_bpe_49k.json", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """``docs`` with its texts' token ids and what these decode to.

    ``outputs`` names the new columns: ``n_tokens``, ``ids`` (array of int),
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers, lower-case
    hex), ``decoded`` and ``decoded_sha256`` (of the text in UTF-8). A null or empty text, or one
    of white space, has no ids and decodes to the empty text. Rows stay as they
    are, repeated ones and null ids included; an empty table gives none. A column
    of ``docs`` with a new one's name is replaced. A text of any length is encoded whole,
    in memory in proportion to it.
    """
    types = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType(), False), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}
    arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.field("element", pa.int32(), False)), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, found = batch.column(text_col).to_pylist(), {name: [] for name in outputs}
        mine = encoder(tokenizer)
        for a, b in chunks(texts, RUN_CHARS):
            ids, bounds = mine.encode(texts[a:b])
            for name, values in outcome(mine, ids, bounds, outputs):
                found[name].append(values)
        return {name: pa.chunked_array([v.cast(arrow[name]) for v in found[name]], arrow[name]).combine_chunks() for name in outputs}

    return annotate(docs, run, [T.StructField(name, types[name]) for name in outputs])


def outcome(mine: TextEncoder, ids: np.ndarray, bounds: np.ndarray, outputs: tuple[str, ...]) -> Iterator[tuple[str, pa.Array]]:
    """The named columns of a run of texts."""
    decoded = mine.decode(ids, bounds) if any(n.startswith("decoded") for n in outputs) else None
    for name in outputs:
        if name == "n_tokens":
            yield name, pa.array(np.diff(bounds), pa.int64())
        elif name == "ids":
            yield name, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
        elif name == "ids_sha256":
            raw, at = memoryview(ids.astype("<u4").tobytes()), (bounds * 4).tolist()
            yield name, pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())
        elif name == "decoded":
            yield name, decoded
        else:
            yield name, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded.to_pylist()], pa.string())
