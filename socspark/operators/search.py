"""Many patterns in many texts: one pass over a text, however many patterns there are."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from socspark.plans.storage import stored

#: Bytes of patterns in one automaton; more patterns make more shards, each with a pass of its own.
SHARD_BYTES = 16 << 20
#: What an automaton needs for each pattern besides its bytes.
PATTERN_BYTES = 32


def automaton(patterns: Iterable[str]) -> ahocorasick.Automaton:
    """The Aho-Corasick automaton of the patterns, each of which is its own value."""
    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


class Held:
    """A broadcast value as an argument that caches do not compare."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    def __eq__(self, other) -> bool:
        return isinstance(other, Held)

    def __hash__(self) -> int:
        return 0


@functools.lru_cache(maxsize=1)
def _built(key: str, patterns: "Held") -> ahocorasick.Automaton:
    """The automaton of a shard, built once in each Python worker; ``key`` tells shards apart."""
    return automaton(patterns.broadcast.value)


def occurrences(texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``texts`` without their text, once for each pattern that lies anywhere in it, with the pattern.

    Null and empty texts and patterns meet nothing, and a pattern that is listed or
    occurs repeatedly counts once a row. Upper and lower case differ. The
    patterns' size is measured; what exceeds ``shard_bytes`` goes to further
    automata, so no task holds more at a time.
    """
    spark = texts.sparkSession
    listed = stored(patterns.select(F.col(pattern_col).alias("p")).where(F.length("p") > 0).distinct(), "patterns")
    size = listed.agg(F.sum(F.octet_length("p") + PATTERN_BYTES)).first()[0] or 0
    kept = [f for f in texts.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(pattern_col, T.StringType())])
    if not size:
        return spark.createDataFrame([], schema)
    shards, out = math.ceil(size / shard_bytes), None
    rows = texts.select(*[f.name for f in kept], text_col)
    for shard in range(shards):
        some = listed if shards == 1 else listed.where(F.pmod(F.xxhash64("p"), F.lit(shards)) == shard)
        patterns_of, key = spark.sparkContext.broadcast([r[0] for r in some.collect()]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], patterns_of=patterns_of, key=key) -> Iterator[pa.RecordBatch]:
            machine = _built(key, Held(patterns_of))
            for batch in batches:
                met = [(i, p) for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if text for p in {p for _, p in machine.iter(text)}]
                at = pa.array([i for i, _ in met], pa.int64())
                columns = [c.take(at) for c in batch.columns[:-1]] + [pa.array([p for _, p in met], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
