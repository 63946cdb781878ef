"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles is summed up in a signature of ``chunks * symbols`` min-hashes
of 16 bits. Two signatures that differ in at most ``2 * chunks - 1`` symbols have, by
pigeonhole, a chunk in which they differ in at most one. So each chunk is written once
per symbol left out, and texts meet where such a key is equal: every pair under the
distance threshold does.

Equal sets are one class from the start. Among classes that share a key, the one that
meets most others is the key's hub; classes are gathered by hub, not by key, which holds
every pair that shares a key and far fewer copies. Groups of a hub are cut into
blocks, and each pair of blocks counts the shared shingles of its members exactly and
returns a star for each set of members that links connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import kept, table, whole
from facetry.llm.components import components
from facetry.operators.lookup import salted_join
from facetry.session import stage

#: Word hashes remembered by one Python worker; shingles hashed at once; members of a block; columns multiplied at once.
CACHE = 400_000
SLICE = 8192
BLOCK = 256
COLUMNS = 16_384



@dataclass(frozen=True)
class Sketch:
    """Shingles of ``words`` words; links at ``percent`` of the union or more; ``chunks`` of ``symbols`` min-hashes."""

    words: int = 5
    percent: int = 80
    chunks: int = 15
    symbols: int = 5
    seed: int = 0

    @property
    def least(self) -> int:
        """Size from which a set can be linked with a different one: it must hold all but one shingle of the union."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n

    def numbers(self, *shape: int) -> np.ndarray:
        """Odd 64-bit multipliers."""
        draw = np.random.default_rng([self.seed, *shape]).integers(0, 2**63, shape, dtype=np.uint64)
        return draw * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    known = kept("shingled words", dict)
    found = list(map(known.get, words))
    if None in found:
        if len(known) > CACHE:
            known.clear()
        for i, h in enumerate(found):
            if h is None:
                found[i] = known[words[i]] = xxhash.xxh64_intdigest(words[i])
    return np.array(found, np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles. A-Z are lower-cased, ASCII white space separates words; fewer words than asked for are one shingle."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes, size = _hashes(found), min(words, len(found))
    total = np.zeros(len(found) - size + 1, np.uint64)
    for i in range(size):
        total = _mix(total + hashes[i : i + len(total)] + np.uint64(size))
    return np.unique(total)


def signature(items: np.ndarray, sketch: Sketch) -> np.ndarray:
    factor = sketch.numbers(sketch.chunks * sketch.symbols)[:, None]
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), SLICE):
        least = np.minimum(least, (items[None, at : at + SLICE] * factor).min(1))
    return _mix(least) & np.uint64(0xFFFF)


def chunk_keys(symbols: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Keys of signatures, a row each: per chunk one for every symbol left out."""
    grid = symbols.reshape(-1, sketch.chunks, sketch.symbols)
    weighted = grid * sketch.numbers(1, sketch.symbols)
    rest = weighted.sum(2, dtype=np.uint64)[:, :, None] - weighted
    return _mix(rest + sketch.numbers(sketch.chunks, sketch.symbols, 1)[None, :, :, 0]).reshape(len(grid), -1)


def _sketched(docs: DataFrame, key: str, text_col: str, sketch: Sketch) -> DataFrame:
    """``key, n_shingles, set_id`` (null for the empty set), ``keys`` (empty if no different set can be linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(t.as_py(), sketch.words) for t in part.column(1)]
                large = [i for i, s in enumerate(sets) if len(s) >= sketch.least]
                keys: list = [None] * len(sets)
                if large:
                    for i, row in zip(large, chunk_keys(np.stack([signature(sets[i], sketch) for i in large]), sketch).view(np.int64)):
                        keys[i] = row
                ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_shingles", "set_id", "keys"])

    rows = docs.select(F.col(key), whole(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_shingles long, set_id binary, keys array<long>")


def stars(names: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Members with the least member that links connect them to, from exact counts of shared shingles."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, flat, seen = np.unique(flat, return_inverse=True, return_counts=True)
    common = seen > 1  # a shingle of one member is shared with none
    column = np.cumsum(common) - 1
    keep = common[flat]
    flat, of = column[flat[keep]], of[keep]
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    shared = np.zeros((n, n), np.float64)
    width = int(common.sum())
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(flat, [at, at + COLUMNS])
        x = np.zeros((n, min(COLUMNS, width - at)), np.float32)
        x[of[a:b], flat[a:b] - at] = 1
        shared += x @ x.T
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    left, found = set(range(n)), []
    while left:
        reach, front = set(), [left.pop()]
        while front:
            i = front.pop()
            reach.add(i)
            near = [j for j in np.flatnonzero(linked[i]).tolist() if j in left]
            left.difference_update(near)
            front += near
        least = min(names[i] for i in reach)
        found += [(names[i], least) for i in reach if names[i] != least]
    return found


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Stars of every pair of blocks, from rows ``hub, a, b, rep, items`` dealt by ``hub, a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = stars(names, sets, percent) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            groups = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for group, name, items in zip(groups, batch.column(3).to_pylist(), batch.column(4)):
                if group != current:
                    if current is not None:
                        yield links()
                    current, names, sets = group, [], []
                names.append(name)
                sets.append(np.frombuffer(items.as_py(), np.uint64))
        if current is not None:
            yield links()

    dealt = rows.repartition("hub", "a", "b").sortWithinPartitions("hub", "a", "b", "rep")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, sketch: Sketch = Sketch(), key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    A component is named by its smallest key, whose row is kept. Empty sets are linked with nothing. The key
    is an integer; rows with equal keys count as one document. A row with a null key has a null component
    and is kept. Copies are never paired: equal sets are one class by a count.
    """
    spark = docs.sparkSession
    sketched = stage(_sketched(docs, key, text_col, sketch).withColumn(key, F.col(key).cast("long")), "sketches")
    named = sketched.filter(F.col(key).isNotNull() & F.col("set_id").isNotNull())
    classes = stage(named.groupBy("set_id").agg(F.min(key).alias("rep")), "classes")
    firsts = named.filter(F.col("keys").isNotNull()).join(classes.select("set_id", "rep"), "set_id").filter(F.col(key) == F.col("rep"))
    keys = firsts.select("rep", F.explode("keys").alias("key"))
    meets = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stage(keys.join(meets, "key").distinct(), "members")
    # The hub of a key is its member that meets most others over all keys.
    often = members.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("met"))
    hubs = members.join(often, "rep").groupBy("key").agg(F.max(F.struct("met", F.col("rep").alias("hub"))).alias("top"))
    gathered = stage(members.join(hubs, "key").select("rep", F.col("top.hub").alias("hub")).distinct(), "gathered")
    needed = gathered.select(F.col("rep").alias("_rep")).distinct()
    # A merge join at every size: the list grows with the table, so that it would be broadcast for small tables only.
    texts = docs.select(F.col(key).cast("long").alias("_rep"), whole(text_col).alias("_text")).join(needed.hint("merge"), "_rep", "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                items = [shingles(t.as_py(), sketch.words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], names=["rep", "items"])

    sets = texts.mapInArrow(full, "rep long, items binary").groupBy("rep").agg(F.min("items").alias("items"))
    sizes = gathered.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = salted_join(gathered, sizes, ["hub"], "inner", spread_by="rep").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b")))
    rows = placed.join(sets, "rep").select("hub", "rep", "items", F.inline(pairs))
    found = components(_block_links(rows.select("hub", "a", "b", "rep", "items"), sketch.percent), "u", "v")
    named_classes = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    result = sketched.select(key, "n_shingles", "set_id").join(named_classes, "set_id", "left")
    component = F.when(F.col(key).isNotNull(), F.coalesce("component", F.col(key)))
    result = result.select(key, "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op6_near_duplicates(spark, folder):
    """Components of documents whose 3-word shingles overlap by 85 percent or more."""
    return near_duplicates(table(spark, folder, "documents"), Sketch(words=3, percent=85, chunks=11, symbols=6))
