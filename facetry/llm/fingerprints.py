"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A fingerprint is a table of cells. Each distinct paragraph (line that isn't blank) has a
64-bit digest, which is added to one cell of each of three rows: a cell holds how many
digests it got and the exclusive or of them and of their check values. Subtracting the
cells of two versions cancels what they share. A cell left with one digest, which its
check value proves, gives that digest away; taking it out of its other cells frees more
of them. If this peeling gets stuck, the tables are built again with rows twice as wide.

The digests of long texts are dealt to lanes by their hash, each lane a small table of
its own, so work and size grow in step with the text. Everything is Spark SQL within a row; the
texts are shuffled once, to bring each next to its successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import let, table, task_count, whole

#: Digests that a lane is meant for, rows of cells, cells of a row, and how often a stuck table is widened.
LANE = 8
ROWS = 3
WIDTH = 3
RETRIES = 8
CELL = "struct<n:int,key:bigint,check:bigint>"
SIGNED = "struct<key:bigint,sign:int>"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text, blank ones left out."""
    lines = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def check(key: Column) -> Column:
    return F.xxhash64(F.lit("check"), key)


def lane_bits(n: Column) -> Column:
    """Bits of a lane number for ``n`` digests."""
    return F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)) / float(LANE))), F.lit(0)).cast("int")


def lanes(keys: Column, bits: Column) -> Column:
    """The digests by lane, dealt in two steps so that no step looks at each digest once per lane."""
    high = (bits / 2).cast("int")
    low = bits - high
    numbers = lambda b: F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), b) - 1)
    part = lambda k, skip, b: F.call_function("shiftrightunsigned", k, skip).bitwiseAND(F.call_function("shiftleft", F.lit(1), b) - 1)
    inner = lambda some: F.transform(numbers(low), lambda j: F.filter(some, lambda k: part(k, high, low) == j))
    return F.flatten(F.transform(numbers(high), lambda i: let(F.filter(keys, lambda k: part(k, F.lit(0), high) == i), inner)))


def _cell_of(key: Column, row: Column, width: int) -> Column:
    """Place of a digest in a row; lanes use the low bits of a digest, places a hash of all of them."""
    return F.pmod(F.call_function("shiftrightunsigned", F.xxhash64(F.lit("cell"), key), row * 20), F.lit(width)).cast("int")


def _add(cell: Column, key: Column, sign) -> Column:
    return F.struct((cell["n"] + sign).cast("int").alias("n"), cell["key"].bitwiseXOR(key).alias("key"), cell["check"].bitwiseXOR(check(key)).alias("check"))


def cells(keys: Column, width: int) -> Column:
    """Table of one lane: ``ROWS`` rows of ``width`` cells, row after row."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))
    placed = F.transform(keys, lambda k: F.struct(k.alias("key"), F.array(*[_cell_of(k, F.lit(r), width) + r * width for r in range(ROWS)]).alias("at")))
    fill = lambda items: F.transform(
        F.sequence(F.lit(0), F.lit(ROWS * width - 1)),
        lambda c: F.aggregate(items, empty, lambda acc, k: F.when(F.array_contains(k["at"], c), _add(acc, k["key"], 1)).otherwise(acc)))
    return let(placed, fill)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct(
        (a["n"] - b["n"]).cast("int").alias("n"), a["key"].bitwiseXOR(b["key"]).alias("key"), a["check"].bitwiseXOR(b["check"]).alias("check")))


def peel(table_: Column, width: int) -> Column:
    """The digests in a difference as (key, sign): 1 for the left side only, -1 for the right; null if stuck."""
    start = F.struct(table_.alias("cells"), F.array().cast(f"array<{SIGNED}>").alias("found"))

    def step(state, _):
        alone = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == check(c["key"])))
        pure = F.array_distinct(F.transform(alone, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("sign"), F.array(
            *[_cell_of(c["key"], F.lit(r), width) + r * width for r in range(ROWS)]).alias("at"))))
        take = lambda items: F.struct(
            F.transform(state["cells"], lambda c, i: F.aggregate(items, c, lambda acc, p: F.when(F.array_contains(p["at"], i), _add(acc, p["key"], -p["sign"])).otherwise(acc))).alias("cells"),
            F.concat(state["found"], F.transform(items, lambda p: F.struct(p["key"].alias("key"), p["sign"].alias("sign")))).alias("found"))
        return let(pure, lambda items: F.when(F.size(items) > 0, take(items)).otherwise(state))

    def finish(state):
        clean = F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))
        return F.when(clean, state["found"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROWS * width)), start, step, finish)


def lane_difference(left: Column, right: Column) -> Column:
    """Digests by which two lanes differ; rows are widened until peeling succeeds."""
    tries = [peel(subtract(cells(left, w), cells(right, w)), w) for w in (WIDTH << i for i in range(RETRIES))]
    return F.coalesce(*tries)


def difference(left: Column, right: Column) -> Column:
    """Signed digests by which two arrays of digests differ, found from their tables.

    Null if a lane is still stuck after ``RETRIES`` widenings, where a row has 384 cells for about 8 digests.
    """
    bits = lane_bits(F.greatest(F.size(left), F.size(right)))
    both = let(bits, lambda b: F.zip_with(lanes(left, b), lanes(right, b), lambda a, c: F.struct(a.alias("a"), c.alias("b"))))
    return F.flatten(F.transform(both, lambda p: F.when((F.size(p["a"]) + F.size(p["b"]) == 0) | (p["a"] == p["b"]), F.array().cast(f"array<{SIGNED}>"))
                                 .otherwise(lane_difference(p["a"], p["b"]))))


def likeness(left: Column, right: Column, differing: Column) -> Column:
    """Shared over all distinct paragraphs, from their numbers and the number that differ; 1 if neither text has any."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - F.size(differing)) / (total + F.size(differing)).cast("double"))


def fingerprint(keys: Column) -> Column:
    """A text's own table as a string: digests, lanes, then per cell its count and the hexadecimal sums of digests and checks."""
    bits = lane_bits(F.size(keys))
    word = lambda v, n: F.right(F.lpad(F.lower(F.hex(v)), 16, "0"), F.lit(n))
    text = lambda lane: F.array_join(F.transform(cells(lane, WIDTH), lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(F.concat(
        c["n"].cast("string"), F.lit("."), word(c["key"], 16), word(c["check"], 8)))), ",")
    return let(bits, lambda b: F.concat_ws(";", F.concat_ws(":", F.size(keys), F.call_function("shiftleft", F.lit(1), b)), F.transform(lanes(keys, b), text)))


def with_next(docs: DataFrame, key: str, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``key``, ``columns`` and the struct ``next`` of the same columns of the following row, after the last row those of the first.

    Rows are in ascending order of the key (null first), then of the columns. They are shuffled
    once, to ranges of keys of about equal numbers of rows; a range also gets the first
    row of the range after it.
    """
    low = -(2**63)
    rows = docs.withColumn("_order", F.coalesce(F.col(key).cast("long"), F.lit(low)))
    buckets = buckets or 4 * task_count(docs.sparkSession)
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx("_order", shares, 10_000).alias("cuts")).first()["cuts"] or []))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("_bucket", F.size(F.filter(bounds, lambda b: b <= F.col("_order"))))
    firsts = sorted((r["_bucket"], r["_first"]) for r in rows.groupBy("_bucket").agg(F.min("_order").alias("_first")).collect())  # one row per range
    guards = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guard"))
    guard = F.lit(None).cast("int")
    if guards:
        of = F.array_position(F.array(*[F.lit(f).cast("long") for f in guards]), F.col("_order"))
        guard = F.when(of > 0, F.get(F.array(*[F.lit(b) for b in guards.values()]), of.cast("int") - 1))
    places = F.when(guard.isNull(), F.array(own)).otherwise(F.array(own, F.struct(guard.alias("bucket"), F.lit(1).alias("guard"))))
    dealt = rows.select(key, "_order", *columns, F.explode(places).alias("_at"))
    order = Window.partitionBy("_at.bucket").orderBy("_at.guard", "_order", *columns)
    after = dealt.withColumn("next", F.lead(F.struct(*columns)).over(order))
    return after.filter("_at.guard = 0").select(key, *columns, "next")


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, and how alike they and the next text are.

    The edited text is the text with its second half replaced by the start of the next text. A null text
    is empty; an empty text has no digests. Equal texts have equal fingerprints.
    """
    rows = docs.select(F.col(key).alias("_key"), whole(text_col).alias("_text"))
    rows = rows.withColumn("_keys", digests(F.col("_text")))
    rows = with_next(rows, "_key", ["_text", "_keys"])
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring(F.col("next._text"), F.lit(1), half))
    rows = rows.select("_key", n.cast("long").alias("n_chars"), "_keys", F.col("next._keys").alias("_next_keys"), edited.alias("_edited"))
    rows = rows.select("_key", "n_chars", "_keys", "_next_keys", F.sha2("_edited", 256).alias("edited_sha256"), digests(F.col("_edited")).alias("_edited_keys"))
    rows = rows.select("*", difference(F.col("_keys"), F.col("_edited_keys")).alias("_changed"), difference(F.col("_keys"), F.col("_next_keys")).alias("_other"))
    return rows.select(
        F.col("_key").alias(key), "n_chars", "edited_sha256", fingerprint(F.col("_keys")).alias("fingerprint"), fingerprint(F.col("_edited_keys")).alias("edited_fingerprint"),
        likeness(F.col("_keys"), F.col("_edited_keys"), F.col("_changed")).alias("near_edited"), likeness(F.col("_keys"), F.col("_next_keys"), F.col("_other")).alias("near_next"))


def op1_fingerprints(spark, folder):
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_edited(table(spark, folder, "documents"))
