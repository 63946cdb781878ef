"""Documents packed into sequences of fixed length, as few as possible.

Texts become ids; a text longer than a sequence is cut into pieces. What fits with what
depends on lengths only, and there are no more lengths than a sequence has places, so
the packing is planned on the number of pieces per length and has the same size for any
number of documents:

* pieces above a third of a sequence: no more than two go into one, so they are paired
  greedily, the longest left with the longest that still fits beside it;
* shorter ones, the longest first, go where they leave the smallest gap; a new sequence is
  begun when none has room.

The plan is a list of runs: so many sequences with the same lengths at the same places. A
piece finds its place by its number among the pieces of its length. That number is the
pieces of this length in the parts before plus its number inside its own part, which
the task that encoded it has counted, so no piece is shuffled and no length gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import table, whole
from facetry.llm.tokenids import default_tokenizer, encoder_of, id_kind, text_groups
from facetry.operators.lookup import attach
from facetry.session import stage

CAPACITY = 4096
PIECES = "piece long, start long, length int, ids binary, ids_crc32 long, local long"


@dataclass
class Plan:
    """Where the pieces of a length go, in the order of their numbers, and how many sequences there are.

    Pieces number ``first[i]`` and on of ``length[i]`` lie ``each[i]`` to a sequence from
    ``sequence[i]`` on, one after the other from ``offset[i]``.
    """

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given their lengths and numbers."""
        span = int(max(number.max(initial=0), self.first.max(initial=0))) + 1
        at = np.searchsorted(self.length * span + self.first, length * span + number, "right") - 1
        before, within = np.divmod(number - self.first[at], self.each[at])
        return self.sequence[at] + before, self.offset[at] + within * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of ``counts[length]`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be 1 to capacity")
    taken: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: first sequence, sequences
    gaps: list[int] = []  # those that have runs, ascending
    sequences = 0

    def begin(gap: int, number: int) -> None:
        nonlocal sequences
        keep(gap, sequences, number)
        sequences += number

    def keep(gap: int, first: int, number: int) -> None:
        if gap and number:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((first, number))

    def put(length: int, each: int, first: int, number: int, offset: int) -> None:
        """``each`` pieces into each of ``number`` sequences."""
        if each and number:
            rows.append((length, taken[length], each, first, offset))
            taken[length] += each * number
            left[length] -= each * number

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        one = large[-1]
        at = bisect_left(large, capacity - one + 1) - 1
        if at >= 0 and (large[at] != one or left[one] > 1):
            other = large[at]
            pairs = left[one] // 2 if other == one else min(left[one], left[other])
            first = sequences
            begin(capacity - one - other, pairs)
            if other == one:
                put(one, 2, first, pairs, 0)
            else:
                put(one, 1, first, pairs, 0)
                put(other, 1, first, pairs, one)
        elif at > 0:  # a single one of its length, which fits beside itself: the next shorter one
            other, first = large[at - 1], sequences
            begin(capacity - one - other, 1)
            put(one, 1, first, 1, 0)
            put(other, 1, first, 1, one)
        else:
            first, number = sequences, left[one]
            begin(capacity - one, number)
            put(one, 1, first, number, 0)
        large = [n for n in large if left[n]]

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no room anywhere
                each = capacity // length
                begin(capacity, -(-left[length] // each))
                continue
            gap = gaps[at]
            first, number = runs[gap].pop()
            if not runs[gap]:
                gaps.pop(at)
            each = gap // length  # the smallest gap stays the smallest that fits until it is used up
            full = min(number, left[length] // each)
            put(length, each, first, full, capacity - gap)
            keep(gap - each * length, first, full)
            if full < number and left[length]:
                rest = left[length]
                if rest < each:
                    put(length, rest, first + full, 1, capacity - gap)
                    keep(gap - rest * length, first + full, 1)
                    full += 1
            keep(gap, first + full, number - full)
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(columns[0], columns[1], columns[2], columns[3], columns[4], sequences)


def cut_pieces(
    docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = CAPACITY, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``key, piece, start, length, ids, ids_crc32, local``: every text's ids in pieces of at most ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers, ``local`` numbers the pieces of a length
    within a task. A null text is empty; a text without any id makes no piece, which
    happens only without an end id.
    """
    kind = id_kind(tokenizer, end_id)
    end = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(tokenizer, kind), np.zeros(capacity + 1, np.int64)
        for keys, texts in text_groups(batches):
            of, number, starts, lengths, pieces, local = [], [], [], [], [], []
            for row, data in enumerate(encoder.encode(texts)):
                ids = np.frombuffer(data + end, kind).astype("<u4")
                for i, start in enumerate(range(0, len(ids), capacity)):
                    some = ids[start : start + capacity]
                    of.append(row)
                    number.append(i)
                    starts.append(start)
                    lengths.append(len(some))
                    pieces.append(some.tobytes())
                    local.append(int(seen[len(some)]))
                    seen[len(some)] += 1
            columns = [
                keys.take(pa.array(of, pa.int64())), pa.array(number, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()),
                pa.array(pieces, pa.binary()), pa.array(list(map(zlib.crc32, pieces)), pa.int64()), pa.array(local, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids", "ids_crc32", "local"])

    rows = docs.select(F.col(key), whole(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {PIECES}")


def pack(
    docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = CAPACITY, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``key, piece, start, length, ids, ids_crc32, sequence_id, offset``: every piece and its place.

    Sequences are numbered from 0 without gaps, their pieces lie without gaps from offset
    0. Null texts are empty (one piece with the end id), null keys are packed like others,
    repeated rows each on their own; an empty table gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = cut_pieces(docs, tokenizer, end_id, capacity, key, text_col)
    # A written part keeps the numbers that one attempt of its task has given.
    pieces = stage(cut.withColumn("part", F.spark_partition_id()), "pieces")
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    shared = spark.sparkContext.broadcast(plan(total, capacity))  # its size depends on the lengths, not on their counts
    before = (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("_before")
    numbered = attach(pieces, stage(counts.select("length", "part", before), "before"), ["length", "part"], "inner", spread_by="local")
    rows = numbered.select(key, "piece", "start", "length", "ids", "ids_crc32", (F.col("local") + F.col("_before")).alias("number"))
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.places(batch.column(3).to_numpy().astype(np.int64), batch.column(6).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(sequence), pa.array(offset), batch.column(4)], names=names)

    schema = f"`{key}` {dict(docs.dtypes)[key]}, piece long, start long, length int, ids_crc32 long, sequence_id long, offset long, ids binary"
    return rows.mapInArrow(run, schema)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``sequence_id, ids, parts``: each sequence's ids as one binary, and which piece begins where; a sequence has at most its capacity in pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(key), "piece", "length", "ids")))
    found = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return found.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))


def op12_packing(spark, folder, tokenizer: str | None = None):
    """Every document's pieces and their places in sequences of 4096 ids."""
    found = pack(table(spark, folder, "documents"), tokenizer or default_tokenizer())
    return found.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
