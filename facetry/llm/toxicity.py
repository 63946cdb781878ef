"""Toxicity by a factorization machine over hashed terms.

The score of a text adds a weight per term and, for every pair of its terms, the product
of their factor vectors: what an insult means next to the mention of a group is learned
as an interaction, which a sum of weights can't express. Every word is hashed into one of a
fixed number of buckets, each with a weight and a factor, so a pair counts even where neither
word means anything by itself; decay keeps those that don't help near zero. Words and
stems that show evidence by themselves have a place of their own besides. Training is a small solve
on a bounded sample; scoring is one map pass.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import is_held_out, kept, table, whole
from facetry.llm.piecetable import PieceTable, enlarged, pieces_of
from facetry.llm.tokenids import _groups
from facetry.session import stage

WORD = re.compile(r"\w+")
#: Words remembered by one Python worker, and bytes of the long ones.
CACHE = 600_000
HELD = 64_000_000

#: Rows that a term must be in to be tried for a place of its own.
LEAST_ROWS = 3
#: Steps of the buckets after terms of their own were learned, as a share of those.
LATER = 0.3
#: Lengths of the stems that count as terms beside the word, so that endings don't hide one.
STEMS = (4, 5, 6)


def hashed(text: str) -> int:
    """A hash of 32 bits."""
    return zlib.crc32(text.encode("utf-8", "replace"))


def terms_of(word: str) -> list[int]:
    """Hashes of a word and its stems."""
    return [hashed(w) for w in (word, *[f"{word[:n]}*" for n in STEMS if len(word) >= n])]


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # hashes of the terms with a place of their own; the buckets come after them
    buckets: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    name: str

    def logits(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of rows, and the sums of their factors; row i has the distinct positions ``flat[starts[i]:starts[i + 1]]``."""
        n = len(starts) - 1
        of = np.repeat(np.arange(n), np.diff(starts))
        v = self.factors[flat]
        sums = np.stack([np.bincount(of, v[:, f], n) for f in range(v.shape[1])], 1)
        squares = np.bincount(of, (v * v).sum(1), n)
        return self.bias + np.bincount(of, self.weights[flat], n) + ((sums**2).sum(1) - squares) / 2, sums

    def score(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.logits(flat, starts)[0], -50, 50)))


class Terms:
    """Positions of texts' terms in a model, with a bounded memory of words."""

    def __init__(self, terms: np.ndarray, buckets: int):
        self.place, self.buckets = {int(t): i for i, t in enumerate(terms)}, buckets
        self._forget()

    def _forget(self) -> None:
        self.table = PieceTable()
        self.flat, self.begin = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64)

    def of_word(self, word: str) -> list[int]:
        """The bucket of a word, and the places of its own."""
        own = [self.place[t] for t in terms_of(word) if t in self.place] if self.place else []
        return [len(self.place) + hashed(word) % self.buckets, *own]

    def positions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct positions of every text one after the other, and where each text's begin."""
        if self.table.size > CACHE or self.table.held > HELD:
            self._forget()
        joined, starts, stops, counts = pieces_of([" ".join(WORD.findall(t.lower())).encode("utf-8", "replace") for t in texts])
        numbers, new = self.table.number(joined, starts, stops)
        if new:
            found = [self.of_word(w.decode("utf-8", "replace")) for w in new]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            first, at = self.table.size - len(new), int(self.begin[self.table.size - len(new)])
            self.flat, self.begin = enlarged(self.flat, at + int(sizes.sum())), enlarged(self.begin, self.table.size + 1)
            self.flat[at : at + int(sizes.sum())] = [i for row in found for i in row]
            self.begin[first + 1 : self.table.size + 1] = at + np.cumsum(sizes)
        of = np.repeat(np.arange(len(texts)), np.diff(counts, prepend=0))
        begin = self.begin[numbers]
        sizes = self.begin[numbers + 1] - begin
        total = np.cumsum(sizes) - sizes
        flat = self.flat[np.repeat(begin - total, sizes) + np.arange(int(sizes.sum()))]
        width = len(self.place) + self.buckets
        keys = np.unique(np.repeat(of, sizes) * width + flat)
        return keys % width, np.searchsorted(keys, np.arange(len(texts) + 1) * width)


def informative(terms: np.ndarray, seen: np.ndarray, hits: np.ndarray, n: int, positive: int, n_terms: int) -> np.ndarray:
    """The terms with most evidence, sorted: in ``seen`` of ``n`` rows and in ``hits`` of the ``positive`` ones.

    Evidence is the log likelihood ratio (G squared) of the counts against independence. What
    chance alone reaches grows with the number of terms tried, so the bar does too.
    """
    tried = seen >= LEAST_ROWS
    terms, seen, hits = terms[tried], seen[tried].astype(float), hits[tried].astype(float)
    share = positive / n
    parts = [(hits, seen * share), (seen - hits, seen * (1 - share))]
    parts += [(positive - hits, positive - seen * share), (n - positive - seen + hits, (n - positive) - seen * (1 - share))]
    evidence = sum(2 * a * np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12)) for a, b in parts)
    chosen = np.lexsort((terms, -evidence))[:n_terms]
    return np.sort(terms[chosen[evidence[chosen] > 2 * np.log(max(len(terms), 2))]])


def train(
    terms: np.ndarray, buckets: int, flat: np.ndarray, starts: np.ndarray, labels: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.1,
    decay: float = 1e-4, seed: int = 0,
) -> FactorizationMachine:
    """Fit on rows of distinct positions, as ``logits`` takes them: logistic loss, adaptive gradient steps, L2 decay.

    ``epochs`` with the terms that have a place of their own; then as many that move only the
    buckets, so that these learn what those terms leave unexplained, in smaller steps.
    """
    rng = np.random.default_rng(seed)
    n, positive, width = len(labels), int(labels.sum()), len(terms) + buckets
    prior = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    model = FactorizationMachine(terms, buckets, prior, np.zeros(width), rng.normal(0, 0.02, (width, rank)), uuid.uuid4().hex)
    if not 0 < positive < n:
        model.factors[:] = 0
        return model
    g_w, g_f, g_b = np.full(width, 1e-4), np.full((width, rank), 1e-4), 1e-4
    own = flat < len(terms)
    phases = [(flat, starts, rate, 0)]
    if own.any():
        phases = [(flat[own], np.concatenate([[0], np.cumsum(own)])[starts], rate, 0), (flat, starts, LATER * rate, len(terms))]
    for flat, starts, rate, first in [p for p in phases for _ in range(epochs)]:
        order = rng.permutation(n)
        for at in range(0, n, 256):
            some = order[at : at + 256]
            sizes = starts[some + 1] - starts[some]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cols = flat[np.repeat(starts[some] - ends[:-1], sizes) + np.arange(ends[-1])]
            logit, sums = model.logits(cols, ends)
            error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[some]) / len(some)
            used, place = np.unique(cols, return_inverse=True)
            of = np.repeat(np.arange(len(some)), sizes)
            line = np.bincount(place, error[of], len(used))
            moved = used >= first
            v = model.factors[used]
            d_w = line + decay * model.weights[used]
            d_f = np.stack([np.bincount(place, (error * sums[:, f])[of], len(used)) for f in range(rank)], 1) - v * line[:, None] + decay * v
            used, d_w, d_f = used[moved], d_w[moved], d_f[moved]
            g_w[used] += d_w**2
            g_f[used] += d_f**2
            model.weights[used] -= rate * d_w / np.sqrt(g_w[used])
            model.factors[used] -= rate * d_f / np.sqrt(g_f[used])
            if not first:
                g_b += error.sum() ** 2
                model.bias -= float(rate * error.sum() / np.sqrt(g_b))
    return model


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000,
    n_terms: int = 4096, buckets: int = 1 << 16, **options,
) -> FactorizationMachine:
    """Learn from at most ``sample`` labelled rows outside the held-out fold, those whose keys hash lowest.

    A key with several labels counts as positive if one of them is; copies of a text count once. Terms are
    counted by Spark; the driver gets those in three or more rows, and the positions of each
    row, at most ``buckets`` and ``n_terms``. Without labels of both kinds every text gets the prior.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label_col).cast("int").alias("_label")).filter("_key IS NOT NULL AND _label IS NOT NULL")
    known = known.filter(~is_held_out("_key")).groupBy("_key").agg(F.max((F.col("_label") > 0).cast("int")).alias("_label"))
    chosen = known.orderBy(F.xxhash64(F.lit("toxicity"), "_key"), "_key").limit(sample)
    texts = docs.select(F.col(key).alias("_key"), whole(text_col).alias("_text")).join(F.broadcast(chosen), "_key")
    texts = stage(texts.groupBy("_text").agg(F.max("_label").alias("_label")), "labelled-texts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [list({h for w in set(WORD.findall(t.as_py().lower())) for h in terms_of(w)}) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["label", "terms"])

    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("positive")).first()
    if not 0 < size["positive"] < size["n"]:
        labels = np.repeat([1.0, 0.0], [size["positive"], size["n"] - size["positive"]])
        return train(np.zeros(0, np.int64), buckets, np.zeros(0, np.int64), np.zeros(len(labels) + 1, np.int64), labels, **options)
    each = texts.mapInArrow(counted, "label int, terms array<long>").select("label", F.explode("terms").alias("term"))
    counts = each.groupBy("term").agg(F.count("*").alias("seen"), F.sum("label").alias("hits")).filter(F.col("seen") >= LEAST_ROWS).toArrow()
    terms = informative(*[counts[c].to_numpy() for c in ("term", "seen", "hits")], size["n"], size["positive"], n_terms)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Terms(terms, buckets)
        for batch in batches:
            for part in _groups(texts := batch.column(0).to_pylist()):
                flat, starts = found.positions(texts[part])
                rows = [flat[a:b].astype("<i4").tobytes() for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1)[part], pa.array(rows, pa.binary())], names=["label", "at"])

    rows = texts.mapInArrow(placed, "label int, at binary").toArrow()
    order = sorted(zip(rows["at"].to_pylist(), rows["label"].to_pylist()))  # however the rows were dealt
    flat = np.frombuffer(b"".join([at for at, _ in order]), "<i4")
    starts = np.concatenate([[0], np.cumsum([len(at) // 4 for at, _ in order])])
    return train(terms, buckets, flat, starts, np.array([label for _, label in order], float), **options)


def score(docs: DataFrame, model: FactorizationMachine, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, score`` per row; null and empty texts get the score of no terms, repeated rows are all scored, null keys stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        terms = kept(f"toxicity {model.name}", lambda: Terms(model.terms, model.buckets))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [model.score(*terms.positions(texts[part])) for part in _groups(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())], names=[key, "score"])

    rows = docs.select(F.col(key), whole(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double")


def op4_toxicity(spark, folder):
    """Toxicity of every document, learned outside the held-out fold."""
    docs = table(spark, folder, "documents")
    found = score(docs, fit(docs, table(spark, folder, "labels")))
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
