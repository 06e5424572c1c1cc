"""Language identification by prediction by partial matching.

For every language a byte context tree of depth 3 is counted on a bounded sample
of labelled rows, then frozen. A byte's probability comes from the longest
context that was seen; its escape probability (method C: kinds seen / (bytes
seen + kinds seen)) is shared out over the bytes not seen there, in proportion
to the next shorter context, so the probabilities of each context sum to 1 over
all 256 bytes and the code lengths are exact. The code lengths of all four-byte
strings of the samples, in all languages at once, stand in one sorted table;
what it lacks is worked out from the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import annotate, chunks, hashed_share

UNDETERMINED = "und"
DEPTH = 3
PAD = b" " * DEPTH


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """The contexts of one language: for every order the strings seen, with their probability, and the contexts, with what an escape leaves to a byte."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        first = np.bincount(gram & 255, weights=n, minlength=256)
        kinds, total = np.count_nonzero(first), first.sum()
        escape = kinds / (total + kinds) if 0 < kinds < 256 else 0.0
        rest = np.where(first > 0, 0, escape / max(1, 256 - kinds)) if total else np.full(256, 1 / 256)
        self.bytes = first / max(total, 1) * (1 - escape) + rest
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(1, DEPTH + 1):
            seen, at = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(at, weights=n)
            context, of = np.unique(seen >> 8, return_inverse=True)
            kinds, total = np.bincount(of), np.bincount(of, weights=count)
            left = np.maximum(1 - np.bincount(of, weights=self.probability(seen)), 1e-12)
            escape = np.where(kinds < 256, kinds / (total + kinds), 0.0)
            self.orders.append((seen, count / total[of] * (1 - escape[of]), context, escape / left))

    def probability(self, gram: np.ndarray) -> np.ndarray:
        """Probability of the last byte of each string after the bytes before it, by the orders known so far."""
        out = self.bytes[gram & 255]
        for k, (seen, own, context, escape) in enumerate(self.orders, 1):
            key = gram & ((1 << 8 * (k + 1)) - 1)
            at, known = _find(context, key >> 8)
            out = np.where(known, out * escape[at] if len(escape) else out, out)
            at, known = _find(seen, key)
            out = np.where(known, own[at] if len(own) else out, out)
        return out


@dataclass
class Model:
    """Frozen code lengths of languages, and of the background: bytes of all languages without their order."""

    languages: list[str]
    trees: list[Tree]
    background: np.ndarray
    gram: np.ndarray
    bits: np.ndarray

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-byte string, by language."""
        at, known = _find(self.gram, gram)
        out = self.bits[at]
        if not known.all():
            new, back = np.unique(gram[~known], return_inverse=True)
            out[~known] = np.stack([-np.log2(t.probability(new)) for t in self.trees], axis=1)[back]
        return out

    def code_lengths(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and by the background."""
        whole = np.frombuffer(PAD + PAD.join(texts), dtype=np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        starts = np.cumsum(sizes + DEPTH) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        cost = self.costs(((whole[at - 3] << 8 | whole[at - 2]) << 8 | whole[at - 1]) << 8 | whole[at])
        sums = np.stack([np.bincount(owner, cost[:, k], len(texts)) for k in range(len(self.languages))], axis=1)
        return sums, np.bincount(owner, self.background[whole[at]], len(texts))


def _count_grams(labelled: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(language, four bytes as one number, count) over ``labelled``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(_bytes(text))
            for lang, texts in parts.items():
                for first, after in chunks(texts, 4_000_000):
                    b = np.frombuffer(PAD + PAD.join(texts[first:after]), dtype=np.uint8).astype(np.int64)
                    if len(b) > 3:
                        gram, n = np.unique(((b[:-3] << 8 | b[1:-2]) << 8 | b[2:-1]) << 8 | b[3:], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    grams = labelled.select(lang_col, text_col).mapInArrow(run, "lang string, gram long, n long")
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows_per_language: int = 1500) -> Model | None:
    """The model of the languages in ``labelled``; None if it has no usable row.

    It is fitted on about ``rows_per_language`` rows of each language, chosen by
    a hash of the id: that is the documented bound of the sample, of which every
    byte and every context counts. Rows with a null language or an empty text
    are left out, equal rows count each, and the order of rows does not matter.
    The driver holds the distinct four-byte strings of the samples.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    sizes = {lang: n for lang, n in usable.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    chosen: Column = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col(lang_col) == lang) & hashed_share(id_col, min(1.0, rows_per_language / n)))
    table: pd.DataFrame = _count_grams(usable.where(chosen), lang_col, text_col).toPandas()
    if not len(table):
        return None
    return model_of({lang: (part["gram"].to_numpy(), part["n"].to_numpy().astype(float)) for lang, part in table.groupby("lang")})


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of the four-byte strings, with their counts, of each language."""
    languages = sorted(counts)
    trees = [Tree(*counts[lang]) for lang in languages]
    gram = np.unique(np.concatenate([counts[lang][0] for lang in languages]))
    bits = np.stack([-np.log2(t.probability(gram)) for t in trees], axis=1).astype(np.float32)
    return Model(languages, trees, -np.log2(np.mean([t.bytes for t in trees], axis=0)), gram, bits)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", chunk_chars: int = 400_000) -> DataFrame:
    """``docs`` with ``lang_pred`` (string), ``score`` (0 to 1) and ``bits_per_byte``.

    The language with the shortest code length wins, the first in order on a
    tie; the score is its posterior probability under equal priors, among all
    languages and the background, so a text that no language describes better
    than bytes without order do has a small score. A null text, or one without
    a letter, is ``und`` with score 0, as is every text without a model. Long
    texts are read whole, repeated rows each for themselves; other columns pass
    through, save those with the new names.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        model = shared.value
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        lang, score, rate = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
        known = [i for i, t in enumerate(texts) if t and model and any(map(str.isalpha, t))]
        for first, after in chunks([texts[i] for i in known], chunk_chars):
            own = known[first:after]
            data = [_bytes(texts[i]) for i in own]
            bits, background = model.code_lengths(data)
            best = bits.argmin(axis=1)
            gap = np.concatenate([bits, background[:, None]], axis=1) - bits[np.arange(len(own)), best][:, None]
            posterior = 1 / np.exp2(-np.clip(gap, -1000, 1000)).sum(axis=1)
            for i, k, p, total, x in zip(own, best.tolist(), posterior.tolist(), bits.min(axis=1).tolist(), data, strict=True):
                lang[i], score[i], rate[i] = model.languages[k], p, total / len(x)
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "bits_per_byte": pa.array(rate, pa.float64())}

    return annotate(docs, run, fields)


def training_fold(id_col: str = "doc_id") -> Column:
    """Whether a row may be learned from: crc32 of its id as text, mod 3, is not 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 != 1
