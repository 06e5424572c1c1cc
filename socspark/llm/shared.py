"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from socspark.plans.storage import shared_path, shared_root, stored

__all__ = ["annotate", "chunks", "fresh", "hashed_share", "set_aside", "shared_path", "shared_root", "small_enough", "stored"]


def annotate(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField], drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with new columns that ``fn`` computes for each Arrow batch.

    The other columns pass through; a column of ``df`` named as a new one is
    replaced. ``drop`` leaves columns out of the result.
    """
    gone = {f.name for f in fields} | set(drop)
    keep = [f for f in df.schema.fields if f.name not in gone]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [new[f.name] for f in fields], names=names + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(keep + fields))


def chunks(texts: list, most_chars: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of ``texts`` of about ``most_chars`` characters; a longer text stands alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > first and size + n > most_chars:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def hashed_share(col: str, share: float, seed: int = 0):
    """A condition that holds for about ``share`` of the rows, chosen by a hash of ``col``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(col)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, each lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of the given names renamed, and a function that gives them their names back."""
    wanted = {n.lower() for n in names}
    moved = [c for c in df.columns if c.lower() in wanted]
    to = dict(zip(moved, fresh(df, *moved), strict=True))
    return df.withColumnsRenamed(to), lambda out: out.withColumnsRenamed({v: k for k, v in to.items()})


def small_enough(df: DataFrame, most_bytes: int) -> bool:
    """Whether the text of all rows of a stored table is at most ``most_bytes`` long, so that it may be broadcast."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"]
    return (size or 0) <= most_bytes
