"""Packing: shortest-pack-first over the length histogram.

Documents become token ids followed by id 0, and are cut at multiples of the sequence length; the last
piece is what is left. Only the histogram of piece lengths (at most `width` rows) reaches the driver.
There, lengths are placed longest first, each into the open packs with most room, as counts of packing
patterns. Pieces then find their place by their rank among pieces of the same length. Ranks come from
hash buckets and a table of bucket offsets, so no task holds all pieces of a common length.

Cases: a null or empty text is the single id 0; repeated rows and ids are separate documents, and which of
equal pieces gets which of their places is a tie without meaning; a null doc_id stays null; a text of any
length is encoded whole and cut; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.llm.scratch import partitions, stash

WIDTH = 1024

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, equal to those of `tokenizers`.

    The vocabulary file is that of `tokenizers`; its byte-level merges run in tiktoken, several times
    faster, in one call a text: remembering the ids of words costs more than it spares, as so many words
    are rare. Added tokens (such as an end-of-text mark) are cut out first, wherever they stand in a text,
    and have their own id.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte_of.values())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special = {k: int(v).to_bytes(4, "little") for k, v in special.items()}
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _encode(self, text: str) -> bytes:
        return self._bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._marks is not None and any(k in text for k in self._special):
            return b"".join([self._special[part] if part in self._special else self._encode(part) for part in self._marks.split(text) if part])
        return self._encode(text)


@lru_cache(2)
def coder_of(vocabulary: str) -> Ids:
    """One coder serves all tasks of a worker."""
    return Ids(vocabulary)


def pieces(docs: DataFrame, vocabulary: str, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: PIECES, and with_ids the ids of each (array of int)."""
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary)
        for batch in source:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = coder.of(text.as_py()) + b"\0\0\0\0"
                total = len(data) // 4
                for start in range(0, total, width):
                    own = data[4 * start : 4 * (start + width)]
                    for column, value in zip(rows, (doc, start, len(own) // 4, zlib.crc32(own), total)):
                        column.append(value)
                    if with_ids:
                        rows[5].append(np.frombuffer(own, "<u4").astype(np.int32))
            arrays = [pa.array(c, pa.int64()) for c in rows[:5]] + ([pa.array(rows[5], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns as (count, lengths). Longest lengths first, each into the packs with most room."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    order: list[int] = []

    def put(space: int, count: int, pattern: tuple[int, ...]) -> None:
        if not room.get(space):
            room[space] = []
            heapq.heappush(order, -space)
        room[space].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed = []
        while left:
            while order and not room[-order[0]]:
                heapq.heappop(order)
            space = -order[0] if order else 0
            if space < length:
                fit = max(1, width // length)
                for n, times in ((left // fit, fit), (int(left % fit > 0), left % fit)):
                    if n:
                        placed.append((width - times * length, n, (length,) * times))
                break
            count, pattern = room[space].pop()
            times = min(space // length, max(1, left // count))
            used = min(count, left // times)
            if used < count:
                room[space].append((count - used, pattern))
            placed.append((space - times * length, used, pattern + (length,) * times))
            left -= used * times
        for item in placed:
            put(*item)
    return sorted((item for items in room.values() for item in items), key=lambda x: x[1], reverse=True)


def places(found: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each slot, in order of rank."""
    ranks: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for count, pattern in found:
        offset = 0
        for length in pattern:
            first = ranks.get(length, 0)
            slots.setdefault(length, []).append((first, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}


def assign(cut: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds sequence_id and offset to pieces. `cut` is read several times: give a written table."""
    spark = cut.sparkSession
    buckets = max(64, 4 * partitions(spark))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = places(patterns(histogram, width))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cut.withColumn("_row", within).join(starts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).select(*[c for c in cut.columns if c != "_bucket"], "_rank")
    schema = T.StructType([*[f for f in ranked.schema.fields if f.name != "_rank"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                mine = length == one
                first, begins, offsets = slots[int(one)]
                slot = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = begins[slot] + rank[mine] - first[slot]
                offset[mine] = offsets[slot]
            kept = [batch.column(n) for n in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH) -> DataFrame:
    """One row per piece: PIECES, sequence_id, offset. Texts are encoded once; the narrow pieces are written."""
    return assign(stash(pieces(docs, vocabulary or default_vocabulary(), width), "pieces"), width)


def sequences(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH, pad: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (padded to width, or to no more at a power of two)."""
    cut = stash(pieces(docs, vocabulary or default_vocabulary(), width, with_ids=True), "pieces")
    grouped = assign(cut, width).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    n = F.size(ids)
    padded = F.concat(ids, F.array_repeat(F.lit(pad), F.lit(width) - n))
    return grouped.select("sequence_id", F.when(F.bit_count(n) == 1, ids).otherwise(padded).alias("ids"))
