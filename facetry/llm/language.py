"""Language ID by prediction by partial matching over bytes.

Each language has a context tree: how often each byte followed each context of up to
``order`` bytes in its training texts. A byte costs ``-log2`` of its share in the longest
known context; where the context doesn't know the byte, an escape is paid (share of the
distinct successors, method C) and the next shorter context asked, down to an even
choice of 256 bytes. Statistics are frozen, so the code length of a text is the exact sum over
its words; a word starts at the space before it, which is where contexts end. The
language with the shortest code wins.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import is_held_out, kept, table, whole
from facetry.llm.piecetable import PieceTable, enlarged, pieces_of
from facetry.llm.tokenids import _groups
from facetry.operators.lookup import attach
from facetry.session import stage

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Words remembered by one Python worker, and bytes of the long ones; bits per byte that halve the score of a language.
CACHE = 600_000
HELD = 64_000_000
SHARPNESS = 4.0
#: A gram of up to seven bytes is a number: its bytes, the last one lowest, and its length above them.
LENGTH_AT = 56
MOST = 7


@dataclass
class LanguageModel:
    languages: list[str]
    order: int
    #: Per language: grams (context and byte) in ascending order and their bits, contexts and the bits of the escape from them.
    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    #: Tells fits apart in the memory of a Python worker.
    name: str


def positions(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte of the words and of the space after each: the last bytes up to it, the size of its context, its word.

    A context begins at the space before the word at the earliest.
    """
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    at = np.arange(1, len(data))
    space = np.maximum.accumulate(np.where(data == 32, np.arange(len(data)), 0))
    size = np.minimum(order, at - space[:-1])
    last = np.zeros(len(at), np.int64)
    for back in range(order, -1, -1):
        last = last << 8 | np.where(at >= back, data[np.maximum(at - back, 0)], 0)
    return last, size, np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])


def gram(last: np.ndarray, size: int) -> np.ndarray:
    """The numbers of the last ``size`` bytes."""
    return (last & ((1 << 8 * size) - 1)) | size << LENGTH_AT


def look_up(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the ascending ``known``, and which of them are there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def code_lengths(model: LanguageModel, words: list[bytes]) -> np.ndarray:
    """Bits of every word in each language."""
    last, size, of = positions(words, model.order)
    # The same byte after the same context costs the same: one computation for all of them.
    keys, back = np.unique((last & ((1 << 8 * (model.order + 1)) - 1) & ((1 << 8 * (size + 1)) - 1)) | (size + 1) << LENGTH_AT, return_inverse=True)
    size, last = (keys >> LENGTH_AT) - 1, keys & ((1 << LENGTH_AT) - 1)
    out = np.empty((len(words), len(model.languages)))
    for i in range(len(model.languages)):
        cost, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for n in range(model.order, -1, -1):
            now = open_[size[open_] >= n]
            at, found = look_up(gram(last[now], n + 1), model.grams[i])
            cost[now[found]] += model.bits[i][at[found]]
            left = now[~found]
            at, found = look_up(gram(last[left] >> 8, n), model.contexts[i])
            cost[left[found]] += model.escapes[i][at[found]]
            open_ = np.concatenate([open_[size[open_] < n], left])
        cost[open_] += 8.0
        out[:, i] = np.bincount(of, cost[back], len(words))
    return out


class Scorer:
    """Code lengths of texts; remembers words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.table = PieceTable()
        self.costs = np.zeros((1024, len(self.model.languages)), np.float32)

    def lengths(self, texts: list[str]) -> np.ndarray:
        if self.table.size > CACHE or self.table.held > HELD:
            self._forget()
        joined, starts, stops, counts = pieces_of([" ".join(t.lower().split()).encode("utf-8", "replace") for t in texts])
        numbers, new = self.table.number(joined, starts, stops)
        if new:
            self.costs = enlarged(self.costs, self.table.size)
            first = self.table.size - len(new)
            for at in range(0, len(new), 100_000):
                self.costs[first + at : first + at + 100_000][: len(new) - at] = code_lengths(self.model, new[at : at + 100_000])
        out = np.empty((len(texts), len(self.model.languages)))
        for i in range(out.shape[1]):
            total = np.concatenate([[0.0], np.cumsum(self.costs[numbers, i], dtype=np.float64)])[counts]
            out[:, i] = np.diff(total, prepend=0.0)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.model.languages else []
        found = [texts[i] for i in some]
        for part in _groups(found):
            bits = self.lengths(found[part])
            best = bits.argmin(1)
            size = np.array([len(t.encode("utf-8", "replace")) for t in found[part]])
            more = (bits - bits.min(1)[:, None]) / size[:, None]
            scores = 1.0 / np.exp2(-SHARPNESS * more).sum(1)
            for i, b, s in zip(some[part], best.tolist(), scores.tolist()):
                out[i] = (self.model.languages[b], s)
        return out


def fit(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, per_language: int = 2_000
) -> LanguageModel:
    """Learn from rows outside the held-out fold whose language is not null.

    About ``per_language`` rows of each language are used, those whose key and text hash lowest,
    so rows without a key draw by their texts; counting them is a map-side aggregate, so a
    language with most rows makes no large group. What reaches the driver are the grams of the
    sample as arrays.
    """
    if not 0 <= order < MOST:
        raise ValueError(f"order must be 0 to {MOST - 1}")
    rows = docs.select(F.col(key).alias("_key"), whole(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.filter(~is_held_out("_key") & F.col("_lang").isNotNull() & (F.col("_lang") != UNKNOWN))
    sizes = stage(rows.groupBy("_lang").agg(F.count("*").alias("_n")), "languages")
    languages = sorted(r["_lang"] for r in sizes.collect())
    if not languages:
        return LanguageModel([], order, [], [], [], [], "")
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("_key"), F.col("_text")), F.lit(1 << 20)) / float(1 << 20)
    chosen = attach(rows, sizes, ["_lang"], "inner", spread_by="_text").filter(draw < per_language / F.col("_n")).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[lang].update(text.lower().split())
            for lang, counter in words.items():
                last, size, of = positions([w.encode("utf-8", "replace") for w in counter], order)
                weight = np.fromiter(counter.values(), np.float64, len(counter))[of]
                for n in range(order + 1) if len(counter) else ():
                    grams, back = np.unique(gram(last[size >= n], n + 1), return_inverse=True)
                    total = np.bincount(back, weight[size >= n], len(grams)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(total)], names=["lang", "gram", "n"])

    found = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    length, body = F.shiftright("gram", LENGTH_AT), F.col("gram").bitwiseAND((1 << LENGTH_AT) - 1)
    context = F.shiftleft(length - 1, LENGTH_AT).bitwiseOR(F.shiftright(body, 8))
    found = stage(found.withColumn("context", context), "grams")
    after = found.groupBy("lang", "context").agg(F.count("*").alias("d"), (F.sum("n") + F.count("*")).alias("total"))  # at most 256 bytes each
    after = stage(after, "contexts")
    bits = found.join(after, ["lang", "context"]).select("lang", "gram", (-F.log2(F.col("n") / F.col("total"))).alias("bits"))
    grams = _arrays(bits, languages, "gram", "bits")
    contexts = _arrays(after.select("lang", "context", (-F.log2(F.col("d") / F.col("total"))).alias("bits")), languages, "context", "bits")
    return LanguageModel(languages, order, *grams, *contexts, uuid.uuid4().hex)


def _arrays(df: DataFrame, languages: list[str], key: str, value: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per language the keys in ascending order, and their values; rows of a bounded sample."""
    keys, values = [], []
    for lang in languages:
        rows = df.filter(F.col("lang") == lang).select(key, value).toArrow()
        found, bits = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        order = np.argsort(found)
        keys.append(found[order])
        values.append(bits[order])
    return keys, values


def identify(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns of ``docs`` in ``keep`` (by default the key), then language and score under ``names``, in one map pass.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if no
    language was learned. Ties go to the language that sorts first. Repeated rows are all
    returned, with the same language; null keys stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [key] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(f"language {shared.value.name}", lambda: Scorer(shared.value))
        for batch in batches:
            found = scorer.predict(batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return rows.mapInArrow(run, schema)


def op10_language(spark, folder):
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, folder, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
