"""Benchmark decontamination by pigeonhole edit matching.

An item occurs in a text if some part of the text is within its error budget, in edits,
of the item. Split into one piece more than the budget, the item keeps at least one
piece untouched in every such part. So exact hits of the pieces, found with one
automaton for all items, give all places that can match, and each of them is verified
by the bit-parallel edit distance of Myers. Case and the amount of white space don't
count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from facetry.llm.common import table
from facetry.session import stage

#: Characters of benchmark text matched in one pass over the documents.
BLOCK_CHARS = 8_000_000
MATCHES = ArrayType(StructType().add("item_id", LongType()).add("distance", IntegerType()).add("end", IntegerType()))


def plain(text: str) -> str:
    """Lower case, single spaces."""
    return " ".join(text.lower().split())


def budget(length: int, rate: float) -> int:
    return int(rate * length)


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their places; fewer if the item is shorter."""
    parts = min(errors + 1, len(item))
    ends = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def masks_of(item: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        found[c] |= 1 << i
    return dict(found)


def closest(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the item to any part of ``text``, and the first end of such a part."""
    full, top = (1 << length) - 1, 1 << length - 1
    plus, minus, score = full, 0, length
    best, end = length, 0
    for at, c in enumerate(text, 1):
        same = masks.get(c, 0)
        x = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(across | plus), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, at
        up, down = up << 1, down << 1
        plus, minus = (down | ~(x | up)) & full, up & x & full
    return best, end


class Matcher:
    """All items of a block; finds those that occur in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        self.masks: dict[int, dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, errors) in enumerate(self.items):
            for at, piece in cut(text, errors):
                pieces[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """``item_id, distance, end`` of the items that occur; ``end`` is where the closest part ends in the plain text."""
        if not self.items:
            return []
        text = plain(text)
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for last, (size, places) in self.automaton.iter(text):
            for n, at in places:
                _, item, errors = self.items[n]
                start = last + 1 - size - at - errors
                end = start + len(item) + 2 * errors
                seen = windows[n]
                if seen and start <= seen[-1][1] and end >= seen[-1][0]:  # windows that overlap are verified as one
                    seen[-1] = [min(start, seen[-1][0]), max(end, seen[-1][1])]
                else:
                    seen.append([start, end])
        found = []
        for n, spans in windows.items():
            key, item, errors = self.items[n]
            masks = self.masks.setdefault(n, {}) or masks_of(item)
            self.masks[n] = masks
            best = min((d, max(a, 0) + e) for a, b in spans for d, e in [closest(masks, len(item), text[max(a, 0) : max(b, 0)])])
            if best[0] <= errors:
                found.append({"item_id": key, "distance": best[0], "end": best[1]})
        return sorted(found, key=lambda m: m["item_id"])


def blocks(items: DataFrame, key: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items as (key, plain text), at most ``BLOCK_CHARS`` characters at a time; null and empty texts left out.

    An item without a key gets a negative one, made from its text.
    """
    block, size = [], 0
    named = F.coalesce(F.col(key).cast("long"), -1 - F.pmod(F.xxhash64(text_col), F.lit(1 << 62)))
    rows = items.select(named.alias("key"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    for r in rows.toLocalIterator():
        text = plain(r["text"])
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["key"], text))
        size += len(text)
    if block:
        yield block


def find_items(
    docs: DataFrame, items: DataFrame, rate: float = 0.08, text_col: str = "text", item_key: str = "item_id", item_text: str = "text", name: str = "matches",
) -> DataFrame:
    """The columns of ``docs`` and ``name``: array of (item_id, distance, end) of the items in its text.

    The budget of an item is ``rate`` times its length in edits, rounded down. One map pass per block of items, no
    shuffle; a pass is written before the next one, so that one block at a time is held. A null or empty
    text has no items; of repeated item keys the closest counts; an item without a key is matched under a
    negative one made from its text.
    """
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*kept).schema.add(name, MATCHES)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))
    place, found = kept.index(text_col), docs.select(*kept).withColumn(name, F.array().cast(MATCHES))
    shared = None
    for block in blocks(items, item_key, item_text):
        if shared is not None:
            found = stage(found, "matched")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast((block, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                rows = []
                for text, before in zip(batch.column(place), batch.column(batch.num_columns - 1).to_pylist()):
                    best = {m["item_id"]: m for m in sorted([*before, *matcher.find(text.as_py() or "")], key=lambda m: -m["distance"])}
                    rows.append([best[i] for i in sorted(best)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=[*kept, name])

        found = found.mapInArrow(run, schema)
    return found


def op8_benchmark_matches(spark, folder):
    """Pairs of a document and a benchmark item that occurs in it, with the number of edits."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.inline("matches"))
