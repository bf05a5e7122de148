"""Problem 8: texts in training sequences of a fixed number of tokens.

Bounded-space online packing. A partition holds at most OPEN windows; a text goes into the open window that it fills
best, and where none has room the fullest is emitted and a new one opened. The windows that are still open when the
partitions end are merged in the same way, the fullest first, whole windows being the items.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.session import materialize, table

CAPACITY, OPEN = 2048, 64
#: Open windows per task when they are merged.
MERGED = 4096
#: The folder of the vocabulary is read by the driver, which sends the file to the workers.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
# fixed value: the pattern that splits a text before the merges of the rank files
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Windows:
    """Open windows by room; ``put`` gives (window, place) of an item and the windows that it made leave."""

    def __init__(self, base: int, capacity: int, limit: int):
        self.base, self.capacity, self.limit = base, capacity, limit
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        k = bisect.bisect_left(self.rooms, (size, -1))
        if k < len(self.rooms):
            room, window = self.rooms.pop(k)
        else:
            if len(self.rooms) == self.limit:
                self.rooms.pop(0)
            room, window = self.capacity, self.base + self.made
            self.made += 1
        if room > size:
            bisect.insort(self.rooms, (room - size, window))
        return window, self.capacity - room


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which the workers find a file of the driver."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _packer(name: str, capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(SparkFiles.get(name)).encode_ordinary
        windows = Windows(TaskContext.get().partitionId() << 40, capacity, limit)
        for batch in batches:
            docs, parts, sizes, starts, seqs, places = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, start, part = len(count(text)) if text else 0, 0, 0
                while True:
                    size = min(n - start, capacity)
                    window, place = windows.put(size)
                    docs.append(doc), parts.append(part), starts.append(start), sizes.append(size), seqs.append(window), places.append(place)
                    start, part = start + size, part + 1
                    if start >= n:
                        break
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(parts, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(seqs, pa.int64()), pa.array(places, pa.int32())],
                    names=["doc_id", "part", "first_token", "n_tokens", "window", "place"],
                )

    return run


def _merger(capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows((1 << 62) + (TaskContext.get().partitionId() << 40), capacity, limit)
        for batch in batches:
            put = [windows.put(size) for size in batch.column("filled").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("window"), pa.array([w for w, _ in put], pa.int64()), pa.array([p for _, p in put], pa.int32())], names=["window", "merged", "shift"])

    return run


def packed_texts(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, first_token, n_tokens, seq_id, place): where each text, or part of a long one, stands.

    Only a text of more than capacity tokens is divided, into parts of capacity tokens and a rest. A null or empty text
    has no tokens and stands in some sequence all the same; every row of the input comes out exactly once, and so do
    its tokens. place is the position of the first token in the sequence seq_id.
    """
    rows = documents.select(documents.doc_id.cast("long").alias("doc_id"), "text")
    placed = materialize(rows.mapInArrow(_packer(shipped(documents.sparkSession, f"{tokenizers}/{vocabulary}"), capacity, OPEN), "doc_id long, part int, first_token long, n_tokens int, window long, place int"), narrow=True)
    filled = placed.groupBy("window").agg(F.sum("n_tokens").cast("int").alias("filled"))
    # windows that were emitted are nearly full; all the others, the open ones among them, are merged
    loose = materialize(filled.where(F.col("filled") < capacity - capacity // 32), narrow=True)
    tasks = max(1, -(-loose.count() // MERGED))
    laid = loose.repartition(tasks, "window").sortWithinPartitions(F.desc("filled"), "window")
    moved = laid.select("window", "filled").mapInArrow(_merger(capacity, MERGED), "window long, merged long, shift int")
    joined = placed.join(moved, "window", "left")
    return joined.select("doc_id", "part", "first_token", "n_tokens", F.coalesce("merged", "window").alias("seq_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_texts(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequences, texts, tokens, fill): how full the sequences are."""
    rows = p8_packed(spark, sf_dir)
    seq = rows.groupBy("seq_id").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"))
    return seq.agg(F.count(F.lit(1)).alias("sequences"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * CAPACITY), 4).alias("fill"))
