"""Which of many names occur inside texts: an Aho-Corasick automaton over the names.

A text is read once whatever the number of names, and every name that ends at a sign of it is
reported, also names inside names. While all names are few bytes, they travel with the tasks and no
text is moved. Beyond that they are cut into shards by hash, and every block of texts meets every
shard in a task of its own, so no task holds more than one shard and one block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 4 << 20
BLOCK_ROWS = 50_000


def _automaton(names: Iterable[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    made.make_automaton()
    return made


def _found(automaton: ahocorasick.Automaton, texts: Iterable[str], schema: pa.Schema) -> pa.Table:
    pairs = [(text, name) for text in texts for name in {name for _, name in automaton.iter(text)}]
    return pa.Table.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs)], schema=schema) if pairs else schema.empty_table()


def names_in(texts: DataFrame, names: DataFrame, text: str, name: str, shard_bytes: int = SHARD_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(text, name) of distinct texts and the distinct names that occur in them. Empty and null
    names and texts match nothing."""
    outer = texts.select(F.col(text).cast("string").alias(text)).where(F.length(text) > 0).distinct()
    inner = names.select(F.col(name).cast("string").alias(name)).where(F.length(name) > 0).distinct()
    schema = pa.schema([(text, pa.string()), (name, pa.string())])
    ddl = f"`{text}` string, `{name}` string"
    size = inner.agg(F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()[0]
    if size == 0:
        return outer.sparkSession.createDataFrame([], ddl)
    if size <= shard_bytes:
        held = [r[0] for r in inner.collect()]  # at most shard_bytes

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(held)
            for batch in batches:
                yield from _found(automaton, batch.column(0).to_pylist(), schema).to_batches()

        return outer.mapInArrow(search, ddl)

    shards = -(-size // shard_bytes)
    blocks = max(1, -(-outer.count() // block_rows))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = outer.select(text, F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int").alias("_block"), spread(shards).alias("_shard"))
    right = inner.select(name, F.pmod(F.xxhash64(name), F.lit(shards)).cast("int").alias("_shard"), spread(blocks).alias("_block"))

    def meet(block: pa.Table, shard: pa.Table) -> pa.Table:
        if not block.num_rows or not shard.num_rows:
            return schema.empty_table()
        return _found(_automaton(shard[name].to_pylist()), block[text].to_pylist(), schema)

    return left.groupBy("_block", "_shard").cogroup(right.groupBy("_block", "_shard")).applyInArrow(meet, ddl)
