"""Negatives: for every item, other items that differ on all attributes.

The result is a long table ``(item_id, pos, neg_id)``. Position 0 is the item itself,
positions 1..k its negatives. An item draws ranks in its pool, the rows that differ on every
attribute, and each rank is turned into the row that has it:

* ranks: a keyed Feistel permutation of ``0 .. pool-1``, so ranks of an item are distinct and
  nothing is drawn twice or thrown away. It depends on item, seed and position only;
* rows: valid items are sorted by their attributes, so the rows of a key (its attribute
  values) are one range and the keys are numbered. Over the key numbers stands a tree of fixed
  fan-out. How many rows below a node differ from a key on every attribute follows from counts per
  node and attribute values by inclusion-exclusion. A rank goes down the tree with these
  counts: a join per level, and one more for the row. Keys are never paired with keys.

This is one way for every pool, large or small. A table of up to FAN_OUT keys has one level,
and its counts are broadcast after their size was measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions import vectors
from facetry.functions.hashing import md5_long
from facetry.operators.lookup import HOT_KEY_ROWS, attach, salted_join
from facetry.operators.ordinals import with_ordinal
from facetry.session import stage

#: Children of a node of the tree of keys.
FAN_OUT = 32
#: Rounds of the permutation, and the prime of its round function.
ROUNDS = 8
#: Bits that are permuted at least: on few bits such a network is far from even.
LEAST_BITS = 8
PRIME = 2**31 - 1
FACTOR = 48271


def _all_differ(left: str, right: str, attributes: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [~F.col(f"{left}.{a}").eqNullSafe(F.col(f"{right}.{a}")) for a in attributes])


def key_text(column: str, kind: T.DataType) -> Column:
    """A value as text, different for different values of its type; null is a value of its own."""
    value = F.col(column)
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, T.BinaryType):
        value = F.hex(value)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        value = F.to_json(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0)  # -0.0 equals 0.0
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def pool_sizes(items: DataFrame, attributes: list[str]) -> DataFrame:
    """Per distinct key: its rows ``n`` and the rows that differ on every attribute, ``pool``.

    A null attribute is a value of its own. Inclusion-exclusion over attribute subsets: rows
    are counted once per key, the rest works on those counts.
    """
    names = [f"_k{i}" for i in range(len(attributes))]
    texts = [key_text(a, items.schema[a].dataType).alias(n) for a, n in zip(attributes, names)]
    values = [F.first(a).alias(a) for a in attributes]
    keys = stage(items.select(*attributes, *texts).groupBy(*names).agg(F.count("*").alias("n"), *values), "keys")
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    out = keys.join(F.broadcast(total))
    pool = F.col("total")
    for size in range(1, len(names) + 1):
        for subset in combinations(range(len(names)), size):
            on, name = [names[i] for i in subset], "_n_" + "_".join(map(str, subset))
            out = out.join(keys.groupBy(*on).agg(F.sum("n").alias(name)), on)
            pool = pool + (-1) ** size * F.col(name)
    singles = [F.col(f"_n_{i}").alias(f"n_{a}") for i, a in enumerate(attributes)]
    return out.select(*attributes, "n", "total", *singles, pool.alias("pool"))


def compatible_keys(some: DataFrame, keys: DataFrame, attributes: list[str]) -> DataFrame:
    """Pairs of a key of ``some`` and a key of ``keys`` that differ on every attribute.

    Works on distinct keys, never on rows. ``some`` is broadcast; the caller bounds it.
    """
    left, right = F.broadcast(some.alias("a")), keys.alias("b")
    pair = [F.col(f"a.{a}").alias(a) for a in attributes] + [F.col(f"b.{a}").alias(f"other_{a}") for a in attributes]
    return right.join(left, _all_differ("a", "b", attributes)).select(*pair, F.col("b.n").alias("n"))


def brute_force_pool(items: DataFrame, item_id: str, anchor, attributes: list[str]) -> DataFrame:
    """Every possible negative of one item, straight from the definition."""
    one = items.filter(F.col(item_id) == anchor).select(*[F.col(a).alias(f"_{a}") for a in attributes])
    differs = reduce(lambda a, b: a & b, [~F.col(a).eqNullSafe(F.col(f"_{a}")) for a in attributes])
    return items.join(F.broadcast(one), differs).select(item_id)  # one row is broadcast


def permuted(x: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of ``0 .. size-1`` takes each ``x``; one size and four keys per row.

    A Feistel network permutes the numbers of as many bits as ``size - 1`` has; what lands
    beyond ``size`` is permuted again until it does not.
    """
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.int64), LEAST_BITS)
    bits += (size - 1) >> bits > 0  # the logarithm of a very large number may be rounded
    right_bits = bits - bits // 2
    masks = [(1 << (bits // 2)) - 1, (1 << right_bits) - 1]
    keys = keys % PRIME
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        halves = [out[todo] >> right_bits[todo], out[todo] & masks[1][todo]]
        for i in range(ROUNDS):
            key = keys[todo, i % 4] + i
            mixed = (halves[1 - i % 2] + key) % PRIME
            mixed = (mixed * mixed % PRIME * FACTOR + key) % PRIME
            halves[i % 2] = halves[i % 2] ^ (mixed & masks[i % 2][todo])
        out[todo] = halves[0] << right_bits[todo] | halves[1]
        todo = todo[out[todo] >= size[todo]]
    return out


def _draws(anchors: DataFrame, k: int, seed: int) -> DataFrame:
    """``item_id, pos, key_no, rank``: k ranks of each anchor ``(item_id, key_no, pool)``, distinct if the pool has k."""
    digest = F.md5(F.concat_ws(":", F.col("item_id").cast("string"), F.lit(str(seed))))
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"k{i}") for i in range(4)]
    repeated = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.pmod(md5_long(F.col("item_id"), seed, j), F.col("pool")))
    small = F.when(F.col("pool") < k, repeated).alias("small")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size = len(batch), batch.column(2).to_numpy()
            keys = np.stack([batch.column(3 + i).to_numpy() for i in range(4)], 1)
            pos = np.tile(np.arange(k, dtype=np.int64), n)
            rows = np.repeat(np.arange(n), k)
            rank = np.zeros(n * k, np.int64)
            some = size[rows] >= k
            rank[some] = permuted(pos[some], size[rows][some], keys[rows][some])
            rank[~some] = [r for ranks in batch.column(7).to_pylist() if ranks is not None for r in ranks]
            at = pa.array(rows)
            columns = [batch.column(0).take(at), pa.array((pos + 1).astype(np.int32)), batch.column(1).take(at), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "pos", "key_no", "rank"])

    id_type = dict(anchors.dtypes)["item_id"]
    return anchors.select("item_id", "key_no", "pool", *words, small).mapInArrow(run, f"item_id {id_type}, pos int, key_no long, rank long")


def _subsets(keys: DataFrame, names: list[str]) -> DataFrame:
    """``key_no, n, subset, sign, value``: the values of each key on every set of attributes, the empty one included."""
    entries, number = [], 0
    for size in range(len(names) + 1):
        for subset in combinations(names, size):
            value = F.array(*subset) if subset else F.array().cast("array<string>")
            entries.append(F.struct(F.lit(number).alias("subset"), F.lit((-1) ** size).alias("sign"), value.alias("value")))
            number += 1
    return keys.select("key_no", "n", F.inline(F.array(*entries)))


def _children(subsets: DataFrame, level: int) -> DataFrame:
    """``subset, value, node, counts``: rows with these values below each child of a node of this level."""
    below, child = FAN_OUT ** (level - 1), F.expr(f"key_no div {FAN_OUT ** (level - 1)} % {FAN_OUT}")
    counts = [F.sum(F.when(child == i, F.col("n")).otherwise(0)) for i in range(FAN_OUT)]
    node = F.expr(f"key_no div {below * FAN_OUT}")
    return subsets.groupBy("subset", "value", node.alias("node")).agg(F.array(*counts).alias("counts"))


def _allowed(visited: DataFrame, subsets: DataFrame, level: int) -> DataFrame:
    """``key_no, node, upto``: for each key at a node, the rows it may draw below the first child, the first two.. children."""
    asked = stage(visited.join(subsets.select("key_no", "subset", "sign", "value"), "key_no"), "asked")
    found = salted_join(asked, stage(_children(subsets, level), "children"), ["subset", "value", "node"], "inner", "key_no")
    sums = [F.sum(F.col("sign") * F.col("counts")[i]).alias(f"c{i}") for i in range(FAN_OUT)]
    found = found.groupBy("key_no", "node").agg(*sums)
    for i in range(1, FAN_OUT):
        found = found.withColumn(f"c{i}", F.col(f"c{i}") + F.col(f"c{i - 1}"))
    return stage(found.select("key_no", "node", F.array(*[f"c{i}" for i in range(FAN_OUT)]).alias("upto")), "allowed")


def _descend(ranks: DataFrame, allowed: DataFrame) -> DataFrame:
    """One level: the child in which each rank lies, and the rank among the rows allowed there."""
    found = attach(ranks, allowed, ["key_no", "node"], "inner", spread_by="item_id")
    passed = [F.col("upto")[i] <= F.col("rank") for i in range(FAN_OUT - 1)]
    child = reduce(lambda a, b: a + b, [p.cast("long") for p in passed])
    before = F.greatest(F.lit(0).cast("long"), *[F.when(p, F.col("upto")[i]) for i, p in enumerate(passed)])
    return found.select("item_id", "pos", "key_no", (F.col("node") * FAN_OUT + child).alias("node"), (F.col("rank") - before).alias("rank"))


def sample_negatives(
    items: DataFrame,
    attributes: list[str],
    item_id: str = "item_id",
    vector: str | None = "embedding",
    mini_batch_size: int = 10,
    seed: int = 42,
    width: int | None = None,
) -> DataFrame:
    """Negatives table of all items, ``mini_batch_size - 1`` per item, seeded.

    Distinct negatives when the pool has that many, otherwise drawn with replacement; an item
    with an empty pool fills its positions itself. Items without a valid vector, of
    ``width`` entries if that is given, are no negatives, and their ``neg_id`` is null. A null
    attribute is a value of its own. Item ids must be unique and not null.
    """
    k = mini_batch_size - 1
    attributes = sorted(attributes)
    names = [f"_k{i}" for i in range(len(attributes))]
    texts = [key_text(a, items.schema[a].dataType).alias(n) for a, n in zip(attributes, names)]
    ok = vectors.valid(F.col(vector), width) if vector else F.lit(True)
    rows = stage(items.select(F.col(item_id).alias("item_id"), *texts, F.coalesce(ok, F.lit(False)).alias("_ok")), "items")
    numbered = stage(with_ordinal(rows.filter("_ok").drop("_ok"), [*names, "item_id"], "row_no"), "numbered")
    keys = numbered.groupBy(*names).agg(F.count("*").alias("n"), F.min("row_no").alias("base"))
    keys = stage(with_ordinal(keys, names, "key_no"), "keys")
    placed = attach(numbered, keys, names, "inner", spread_by="item_id")
    placed = stage(placed.select("item_id", "key_no", (F.col("row_no") - F.col("base")).alias("place")), "placed")
    subsets = stage(_subsets(keys, names), "subsets")
    count, levels = keys.count(), 1
    while FAN_OUT**levels < count:
        levels += 1

    allowed = _allowed(keys.select("key_no", F.lit(0).cast("long").alias("node")), subsets, levels)
    pools = allowed.select("key_no", F.col("upto")[FAN_OUT - 1].alias("pool"))
    anchors = stage(attach(placed.select("item_id", "key_no"), pools, ["key_no"], "inner", spread_by="item_id"), "anchors")
    ranks = _draws(anchors.filter("pool > 0"), k, seed).withColumn("node", F.lit(0).cast("long"))
    for level in range(levels, 0, -1):
        ranks = _descend(ranks, allowed)
        if level > 1:
            ranks = stage(ranks, "ranks")
            allowed = _allowed(ranks.select("key_no", "node").distinct(), subsets, level - 1)
    drawn = stage(ranks.select("item_id", "pos", F.col("node").alias("key_no"), F.col("rank").alias("place")), "drawn")
    others = placed.select(F.col("item_id").alias("neg_id"), "key_no", "place")
    # No row is drawn more often than all rows together draw from pools that hold it, on average over each pool.
    most = anchors.filter("pool > 0").agg(F.sum(k / F.col("pool"))).first()[0] or 0
    if most > HOT_KEY_ROWS:  # small pools of very many items: each of their rows is a hot key
        found = salted_join(drawn, others, ["key_no", "place"], "inner", "item_id")
    else:
        found = drawn.join(others, ["key_no", "place"])

    slots = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("pos")
    all_slots = F.explode(F.sequence(F.lit(0), F.lit(k))).alias("pos")
    parts = [
        placed.select("item_id", F.lit(0).alias("pos"), F.col("item_id").alias("neg_id")),
        rows.filter("NOT _ok").select("item_id", all_slots, F.lit(None).cast(rows.schema["item_id"].dataType).alias("neg_id")),
        anchors.filter("pool = 0").select("item_id", slots, F.col("item_id").alias("neg_id")),
        found.select("item_id", "pos", "neg_id"),
    ]
    return reduce(DataFrame.unionByName, parts).select(F.col("item_id").alias(item_id), F.col("pos").cast("int").alias("pos"), "neg_id")


def check_negatives(negatives: DataFrame, width: int, item_id: str = "item_id") -> DataFrame:
    """One row about a negatives table: items, slots, valid and zero anchors, size as a dense cube."""
    stats = negatives.agg(
        F.count_if(F.col("pos") == 0).alias("n_items"),
        (F.max("pos") + 1).cast("bigint").alias("slots"),
        F.count_if((F.col("pos") == 0) & F.col("neg_id").isNotNull()).alias("valid_anchors"),
        F.count_if((F.col("pos") == 0) & F.col("neg_id").isNull()).alias("zero_anchors"),
        F.count_if((F.col("pos") > 0) & (F.col("neg_id") == F.col(item_id))).alias("self_slots"),
    )
    cells = F.col("n_items") * F.col("slots") * width
    return stats.withColumn("width", F.lit(width).cast("bigint")).withColumn("memory_mb", cells * 4 / F.lit(2.0**20))
