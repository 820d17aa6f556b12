"""Packing of documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.base import cut, salts, whole

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def padding(used: int, capacity: int) -> int:
    """A sequence is padded to its capacity, but for one whose length is a power of two."""
    return 0 if used & (used - 1) == 0 else capacity - used


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest one in it that leaves least padding.

    Sums that can be reached are the bits of an integer. Lengths join from the largest
    to the smallest, and the search ends at the first that makes a full sequence; the
    multiset is found by going back, with as few of the small ones as will do.
    """
    largest = max(counts)
    room = capacity - largest
    mask, reached, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == largest), room // length)
        if left <= 0:
            continue
        steps.append((length, left, reached))
        bit = 1
        while left:
            take = min(bit, left)
            reached |= (reached << (take * length)) & mask
            left, bit = left - take, bit * 2
        if reached >> room & 1:
            break
    sums = [i for i, x in enumerate(bin(reached)[:1:-1]) if x == "1"]
    at = min(sums, key=lambda s: (padding(largest + s, capacity), -s))
    chosen = {largest: 1}
    for length, left, before in reversed(steps):
        k = next(k for k in range(left + 1) if at >= k * length and before >> (at - k * length) & 1)
        if k:
            chosen[length] = chosen.get(length, 0) + k
            at -= k * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Multisets of lengths, and how many sequences are filled by each.

    Each is used until one of its lengths runs short, so that the plan's size depends
    on the number of distinct lengths and not on that of documents.
    """
    counts, found = {k: n for k, n in counts.items() if n}, []
    while counts:
        chosen = fullest(counts, capacity)
        times = min(counts[length] // k for length, k in chosen.items())
        found.append((chosen, times))
        for length, k in chosen.items():
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
    return found


def slots(found: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, number in each sequence, first offset), sorted."""
    used, rows, sequence = {}, [], 0
    for chosen, times in found:
        offset = 0
        for length, k in sorted(chosen.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, k, offset))
            used[length] = used.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each document cut at multiples of the capacity, with the checksum of each piece's ids."""

    def run(batches):
        from spanveil.llm.pieces import word_ids

        words, end = word_ids(tokenizer_path), array("I", [end_id]).tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids = memoryview(words.of(text.as_py()) + end)
                n, doc_id = len(ids) // 4, doc_id.as_py()
                out += [(doc_id, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: PIECES, sequence_id, offset.

    A document's ids end with end_id. It is cut at multiples of the capacity; full
    pieces are sequences of their own, and the rest of each document is put with others
    by minimum bin slack. The search works on how many rests there are of each length
    (at most `capacity` numbers, whatever the size of the corpus) and gives its answer
    by rank within a length. Ranks are dealt in salted parts, so that one frequent
    length does not meet in one task.

    Null texts are empty; an empty document is its end_id alone. Ids may be null or
    repeat. An empty table gives an empty result. Other columns are not looked at.
    """
    pieces = cut(tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    counts = {x.length: x["count"] for x in pieces.groupBy("length").count().collect()}
    found = slots(plan(counts, capacity))
    parts = salts(max(counts.values(), default=1))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches):
        keys = (found[:, 0] << 44) + found[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            at = found[np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, "right") - 1]
            nth = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at[:, 2] + nth // at[:, 3]), pa.array(at[:, 4] + nth % at[:, 3] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
