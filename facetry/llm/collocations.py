"""Phrases that occur together more often than their parts, per language.

Counts are kept as streams of phrases with their number of occurrences. Phrases grow word
by word: an (n+1)-gram is counted only where both n-grams inside it may be frequent, which
loses nothing, since a phrase never occurs more often than its parts. A bitmap of fixed
size says which n-grams may be; a wrong yes costs time only.

The frequent phrases of all lengths then form one stream in prefix order (sorted by their
words) and one in suffix order (sorted by their reversed words). In prefix order a phrase
comes right after its beginnings and right before its extensions, so one walk that
remembers the last count at each length gives every phrase the counts of its first words
and the largest count among its extensions; suffix order gives the same for the last words. The streams are
dealt by ranges, so a first word with a third of all phrases is spread over tasks; a task
starts with the counts of the beginnings of its first phrase.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import table, task_count, whole
from facetry.session import stage

#: Words gathered by a task before their n-grams are counted and handed on.
FLUSH_WORDS = 4_000_000
#: Bits of the map of n-grams that may be frequent, whatever the number of n-grams: 16 MB.
MAP_BITS = 1 << 27
BLOCK_BITS = 1 << 15
#: Characters split at once, so that a very long text makes no very long list.
SPLIT_CHARS = 1 << 23
#: A to Z become lower case, every byte that ends a piece becomes a full stop.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 10)
END = 0
COUNTS = "lang string, phrase string, n long"


def _cuts(data: bytes) -> Iterator[bytes]:
    """The bytes in parts that end between two words."""
    at = 0
    while at < len(data):
        to = at + SPLIT_CHARS
        if to < len(data):
            ends = [x for x in (data.find(b, to) for b in (b" ", b"\t", b".")) if x >= 0]
            to = min(ends) if ends else len(data)
        yield data[at:to]
        at = to


class Words:
    """Numbers of words, by language: runs of them, with END between pieces and texts."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(lambda: len(self.numbers))
        self.numbers[b"."]  # END
        self.runs: dict[str, list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        number = self.numbers.__getitem__
        for part in _cuts(b".".join([*texts, b""]).translate(FOLD)):
            found = part.replace(b".", b" . ").split()
            self.runs[lang].append(np.fromiter(map(number, found), np.int64, len(found)))
            self.size += len(found)

    def names(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.binary()).cast(pa.string())

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, self.numbers), np.uint64, len(self.numbers))


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _map_places(lang: str, words: list[np.ndarray], bits: int) -> np.ndarray:
    """Places in a bitmap of n-grams, given the hashes of their first, second.. words."""
    h = np.full(len(words[0]), zlib.crc32(lang.encode()), np.uint64)
    for word in words:
        h = _mix(h, word)
    return (h >> np.uint64(7)) % np.uint64(bits)


def _counted(ids: np.ndarray, chosen: np.ndarray, order: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams that start at ``chosen`` places: their words, and how often each occurs."""
    if order == 1:
        found, n = np.unique(ids[chosen], return_counts=True)
        return [found], n
    if order == 2:
        beginning, known = ids[chosen], None
    else:  # numbers of distinct beginnings keep the key within 64 bits
        key = ids[chosen]
        known, beginning = [], None
        for i in range(1, order - 1):
            distinct, key = np.unique(key * size + ids[chosen + i], return_inverse=True)
            known.append(distinct)
        beginning = key
    key = np.sort(beginning * size + ids[chosen + order - 1])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(key)])
    at, last = np.divmod(key[first], size)
    words = [last]
    for distinct in reversed(known or []):
        at, last = np.divmod(distinct[at], size)
        words.insert(0, last)
    return [at, *words], n


def _rows(lang: str, words: list[pa.Array], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), 100_000):
        parts = [w.slice(at, 100_000) for w in words]
        phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(phrase)), phrase, pa.array(n[at : at + 100_000])], names=["lang", "phrase", "n"])


def _count_words_and_pairs(words: Words) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs; the empty phrase has the number of all words of a language."""
    names = words.names()
    for lang, runs in words.runs.items():
        ids = np.concatenate(runs)
        n = np.bincount(ids, minlength=len(names))
        n[END] = 0
        used = np.flatnonzero(n)
        yield from _rows(lang, [pa.array([""])], np.array([n.sum()]))
        yield from _rows(lang, [names.take(pa.array(used))], n[used])
        pairs = np.flatnonzero((ids[:-1] != END) & (ids[1:] != END))
        found, n = _counted(ids, pairs, 2, len(names))
        yield from _rows(lang, [names.take(pa.array(w)) for w in found], n)


def _count_longer(words: Words, order: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams of ``order`` words both of whose inner n-grams may be frequent."""
    names, hashes = words.names(), words.hashes()
    for lang, runs in words.runs.items():
        ids = np.concatenate(runs)
        last = len(ids) - order + 1
        if last < 1:
            continue
        inside = np.ones(last + 1, bool)  # no END in the n-gram one word shorter that starts here
        for i in range(order - 1):
            inside &= ids[i : i + last + 1] != END
        at = np.flatnonzero(inside)
        hit = np.zeros(last + 1, bool)
        for some in np.array_split(at, len(at) // 1_000_000 + 1):
            places = _map_places(lang, [hashes[ids[some + i]] for i in range(order - 1)], 8 * len(bitmap))
            hit[some] = (bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1
        found, n = _counted(ids, np.flatnonzero(hit[:-1] & hit[1:]), order, len(names))
        yield from _rows(lang, [names.take(pa.array(w)) for w in found], n)


def _counts(rows: DataFrame, order: int, bitmap: np.ndarray | None, least: int) -> DataFrame:
    """``lang, phrase, n`` of phrases that occur at least ``least`` times, and of the empty phrase.

    A task adds up its own occurrences first, so a phrase makes one row per task, however
    common it is.
    """
    shared = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(bitmap)  # of one size, however many phrases

    def handed_on(words: Words) -> Iterator[pa.RecordBatch]:
        return _count_words_and_pairs(words) if shared is None else _count_longer(words, order, shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts, size = defaultdict(list), 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts[lang].append(text.as_buffer().to_pybytes())
                size += len(texts[lang][-1])
                if size > SPLIT_CHARS:
                    for some, found in texts.items():
                        words.add(some, found)
                    texts, size = defaultdict(list), 0
                    if words.size >= FLUSH_WORDS:
                        yield from handed_on(words)
                        words = Words()
            for some, found in texts.items():
                words.add(some, found)
            if words.size >= FLUSH_WORDS:
                yield from handed_on(words)
                words = Words()
        if words.size:
            yield from handed_on(words)

    partial = rows.mapInArrow(run, COUNTS).repartition("lang", "phrase")  # the rows of a task are distinct already
    total = partial.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return total.filter((F.col("n") >= least) | (F.col("phrase") == "")).filter("n > 0")


def _bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of all ``phrases``, put together block by block; of one length at every size."""
    block_bits = min(bits, BLOCK_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang[lang].append([zlib.crc32(w) for w in phrase.encode().split(b" ")])
            for lang, rows in by_lang.items():
                found = np.unique(_map_places(lang, list(np.array(rows, np.uint64).T), bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found // block_bits), pa.array(found % block_bits)], names=["block", "bit"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}  # at most all blocks, each a bit per place
        for batch in batches:
            block, bit = (c.to_numpy() for c in batch.columns)
            for b in np.unique(block).tolist():
                data = blocks.setdefault(b, np.zeros(block_bits, bool))
                data[bit[block == b]] = True
        packed = [np.packbits(d, bitorder="little").tobytes() for d in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(packed, pa.binary())], names=["block", "data"])

    found = phrases.select("lang", "phrase").mapInArrow(places, "block long, bit long")
    out = np.zeros(bits // 8, np.uint8)
    for r in found.repartition("block").mapInArrow(marked, "block long, data binary").collect():
        at = r["block"] * block_bits // 8
        out[at : at + block_bits // 8] |= np.frombuffer(r["data"], np.uint8)
    return out


def _walk(stream: DataFrame, longest: int, name: str) -> DataFrame:
    """``lang, words, inner, wider`` from a stream of ``lang, words, n`` that holds each phrase's beginnings.

    ``inner``: the counts of its first 1, 2.. words; ``wider``: the largest count among the
    phrases one word longer that begin with it. A phrase may have several rows; all but one
    have no ``inner``, and the largest ``wider`` counts.
    """
    spark = stream.sparkSession
    dealt = stream.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    ordered = stage(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), name)
    first = ordered.groupBy("part").agg(F.min_by(F.struct("lang", "words"), "place").alias("head")).select("part", "head.*")
    heads = first.select("part", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda i: F.slice("words", 1, i))).alias("words"))
    heads = heads.join(first.select("part", F.col("words").alias("_all")), "part").filter(F.size("words") < F.size("_all")).drop("_all").distinct()
    # One row per partition and length: the counts a task begins with.
    begin = ordered.select("lang", "words", "n").join(F.broadcast(heads), ["lang", "words"]).select("part", "words", "n").collect()
    starts: dict[int, dict[int, tuple[list[str], int]]] = defaultdict(dict)
    for r in begin:
        starts[r["part"]][len(r["words"])] = (r["words"], r["n"])
    shared = spark.sparkContext.broadcast(dict(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = None, {}
        for batch in batches:
            parts = batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if parts[a] != part:
                    part = int(parts[a])
                    last = dict(shared.value.get(part, {}))
                yield walked(batch.slice(a, b - a), last)

    def walked(batch: pa.RecordBatch, last: dict[int, tuple[list[str], int]]) -> pa.RecordBatch:
        """Counts for the rows of a slice; ``last`` has the latest phrase of each length and is brought up to date."""
        langs, words, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        size = pc.list_value_length(words).to_numpy()
        rows, wider = len(n), np.zeros(len(n), np.int64)
        inner = np.zeros((rows, longest - 1), np.int64)
        carried, before = [], {}
        for d in range(1, longest):
            at = np.maximum.accumulate(np.where(size == d, np.arange(rows), -1))
            # Of lengths whose latest phrase lies in an earlier slice, that phrase counts.
            inner[:, d - 1] = np.where(at >= 0, n[at], last[d][1] if d in last else 0)
            longer = np.flatnonzero(size == d + 1)
            if len(longer):
                parent = at[longer]
                start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
                most = np.maximum.reduceat(n[longer], start)
                own = parent[start] >= 0
                wider[parent[start][own]] = most[own]
                if not own.all():
                    carried.append((langs[int(longer[0])].as_py(), last[d][0], int(most[~own][0])))
            if at[-1] >= 0:
                before[d] = (words[int(at[-1])].as_py(), int(n[at[-1]]))
        last.update(before)
        keep = size > 1
        lists = [inner[i, : size[i] - 1].tolist() for i in np.flatnonzero(keep)]
        columns = [
            pa.array([*langs.filter(pa.array(keep)).to_pylist(), *(c[0] for c in carried)], pa.string()),
            pa.array([*words.filter(pa.array(keep)).to_pylist(), *(c[1] for c in carried)], pa.list_(pa.string())),
            pa.array([*lists, *([None] * len(carried))], pa.list_(pa.int64())),
            pa.array([*wider[keep].tolist(), *(c[2] for c in carried)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "inner", "wider"])

    # A written partition is read back as it was sorted; its rows may be split, never mixed, so they are dealt and sorted anew by place.
    again = ordered.repartition("part").sortWithinPartitions("part", "place").select("lang", "words", "n", "part")
    return again.mapInArrow(run, "lang string, words array<string>, inner array<long>, wider long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exact for counts up to 10^15."""
    big = [x.cast("decimal(18,0)") for x in (a, left, right)]
    return F.call_function("div", big[0] * big[0] * F.lit(1_000_000).cast("decimal(7,0)"), big[1] * big[2])


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, map_bits: int = MAP_BITS
) -> DataFrame:
    """``lang, phrase, n`` of all phrases of up to ``longest`` words that occur at least ``least`` times.

    The empty phrase has the number of words of a language. Rows without a language count
    as ``und``, null texts as empty; repeated rows count each time. ``map_bits`` is the size of
    the bitmap, a multiple of 8 and a power of two; fewer bits cost time, never phrases.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), whole(text_col).alias("text"))
    found = [stage(_counts(rows, 2, None, least), "words-and-pairs")]
    shorter = found[0].filter(F.col("phrase").contains(" "))
    for order in range(3, longest + 1):
        shorter = stage(_counts(rows, order, _bitmap(shorter, map_bits), least), f"phrases-{order}")
        found.append(shorter)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, top: int | None = 2000,
    map_bits: int = MAP_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: phrases of 2 to ``longest`` words by falling score.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of the two parts at the cut with
    the lowest score ``floor(1000000 a a / (l r))``, the first such cut on ties; ``n`` the words
    of the language. A phrase inside a longer one with at least ``inside`` percent of its count
    is left out. Ties in score go to the more frequent phrase, then to the one first in byte
    order. With ``top`` None every phrase is returned and ``rank`` is null.

    Null languages are ``und``, null texts are empty, repeated rows count each time, an empty
    table gives no row; other columns are not read.
    """
    counts = frequent_phrases(docs, text_col, lang_col, longest, least, map_bits)
    phrases = counts.filter((F.col("phrase") != "") & (F.col("n") >= least)).select("lang", F.split("phrase", " ").alias("words"), "n")
    prefix = _walk(phrases, longest, "prefix-order")
    suffix = _walk(phrases.withColumn("words", F.reverse("words")), longest, "suffix-order")
    none = F.lit(None).cast("array<bigint>")
    facts = prefix.select("lang", "words", F.col("inner").alias("first"), none.alias("last"), "wider", F.lit(None).cast("long").alias("n"))
    facts = facts.unionByName(suffix.select("lang", F.reverse("words").alias("words"), none.alias("first"), F.col("inner").alias("last"), "wider", F.lit(None).cast("long").alias("n")))
    facts = facts.unionByName(phrases.filter(F.size("words") > 1).select("lang", "words", none.alias("first"), none.alias("last"), F.lit(0).cast("long").alias("wider"), "n"))
    facts = facts.groupBy("lang", "words").agg(*[F.max(c).alias(c) for c in ("first", "last", "wider", "n")])  # a few rows a phrase
    facts = facts.filter((F.size("words") > 1) & ((F.col("wider") < least) | (100 * F.col("wider") < inside * F.col("n"))))

    def cut(k: Column) -> Column:
        left, right = F.col("first")[k - 1], F.col("last")[F.size("words") - k - 1]
        return F.struct(_score(F.col("n"), left, right).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))
    scored = facts.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), best.alias("best"))
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    total = counts.filter("phrase = ''").select("lang", F.col("n").alias("n"))
    rank = F.lit(None).cast("long")
    if top is not None:
        order = [F.desc("score"), F.desc("a"), "phrase"]
        salt = F.pmod(F.xxhash64("phrase"), F.lit(task_count(docs.sparkSession)))
        first = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
        scored = scored.withColumn("_salt", salt).withColumn("rank", first).filter(F.col("rank") <= top)
        scored = scored.drop("_salt", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        scored, rank = scored.filter(F.col("rank") <= top), F.col("rank")
    return scored.join(total, "lang").select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, folder):
    """The first 2000 phrases of each language."""
    return collocations(table(spark, folder, "documents"))


SQL = {
    "op13_collocations": r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
pieces AS (SELECT d, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM texts),
lists AS (SELECT d, p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT d, p, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM lists),
runs AS (
  SELECT lang, x, lead(x) OVER (PARTITION BY d, p ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY d, p ORDER BY i) AS z FROM words),
f AS (
  SELECT lang, 1 AS k, x AS phrase, count(*) AS n FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM runs WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM runs WHERE z IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:c.k], ' ') AS rp
  FROM c, (VALUES (1), (2)) AS t(j) WHERE j < c.k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, j, x.n AS l, y.n AS r,
    CAST(1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS pick FROM scored),
wider AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a AS n FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3)
  GROUP BY ALL),
ranked AS (
  SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN wider v ON b.k = 2 AND v.lang = b.lang AND v.phrase = b.phrase
  WHERE pick = 1 AND (v.n IS NULL OR 100 * v.n < 50 * a))
SELECT ranked.lang, rank, phrase, a, l, r, total.n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""
}
