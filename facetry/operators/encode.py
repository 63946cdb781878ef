"""Text to vectors through a user's encoder, called in batches inside the tasks.

The encoder is any ``list[str] -> 2-d array``; ``make_encoder`` builds it once per task.
"""

from __future__ import annotations

import hashlib
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import text as text_functions
from facetry.operators.lookup import salted_join
from facetry.session import stage

Encoder = Callable[[list[str]], np.ndarray]

# Texts per call by mode, retries after the first attempt, first delay.
BATCH_SIZE = {"service": 1024, "local": 32}
MAX_RETRIES = 3
INITIAL_DELAY = 1.0

CLEANERS = {"service": text_functions.clean_for_service, "local": text_functions.clean_for_local}
RETRYABLE = (ConnectionError, TimeoutError)


def encode_batch(encoder: Encoder, texts: list[str], retryable=RETRYABLE, max_retries: int = MAX_RETRIES,
                 delay: float = INITIAL_DELAY) -> tuple[list | None, str]:
    """Vectors and status of one batch. A failure is a status, never a failed task."""
    for attempt in range(max_retries + 1):
        try:
            vectors = list(encoder(texts))
            return (vectors, "ok") if len(vectors) == len(texts) else (None, "count_mismatch")
        except retryable:
            if attempt < max_retries:
                time.sleep(delay)
                delay *= 2
        except Exception:
            return None, "failed"
    return None, "retries_exhausted"


def encode_texts(
    df: DataFrame,
    item_id: str,
    text: str,
    make_encoder: Callable[[], Encoder],
    mode: str = "service",
    batch_size: int | None = None,
    retryable: tuple = RETRYABLE,
    max_retries: int = MAX_RETRIES,
    initial_delay: float = INITIAL_DELAY,
    concurrency: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """``(item_id, embedding, status)``: each distinct cleaned text is encoded once.

    Failed texts and vectors whose length is not the common one (``width`` or the most
    frequent) have a null vector and say why. Raises when no text could be encoded.
    ``concurrency`` sets how many tasks call the encoder at once, by default one per core.
    """
    if mode not in CLEANERS:
        raise ValueError(f"unknown mode {mode!r}: use one of {sorted(CLEANERS)}")
    size = batch_size or BATCH_SIZE[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors, status = encode_batch(encoder, part.column(1).to_pylist(), retryable, max_retries, initial_delay)
                out = [None] * part.num_rows if vectors is None else [
                    None if v is None or len(v) == 0 else np.asarray(v, dtype=np.float32) for v in vectors]
                state = [status if vectors is None else "ok" if v is not None else "empty" for v in out]
                columns = [part.column(0), pa.array(out, pa.list_(pa.float32())), pa.array(state, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "embedding", "status"])

    cleaned = df.select(F.col(item_id), CLEANERS[mode](F.col(text)).alias("text"))
    # The narrow table spares later steps reading and hashing the texts again.
    keyed = stage(cleaned.select(item_id, F.sha2("text", 256).alias("digest")), "digests")
    first = keyed.groupBy("digest").agg(F.min(item_id).alias(item_id))
    unique = cleaned.join(first, item_id).select("digest", "text")
    # Encoding costs far more than moving the texts, so they are dealt out evenly.
    unique = unique.repartition(concurrency or df.sparkSession.sparkContext.defaultParallelism)
    encoded = stage(unique.mapInArrow(run, "digest string, embedding array<float>, status string"), "encoded")

    if width is None:
        common = encoded.filter("status = 'ok'").groupBy(F.size("embedding").alias("w")).count()
        row = common.orderBy(F.desc("count"), F.desc("w")).first()
        if row is None:
            raise ValueError("no text could be encoded")
        width = row["w"]
    fits = F.size("embedding") == width
    status = F.when((F.col("status") == "ok") & ~fits, "wrong_length").otherwise(F.col("status"))
    checked = encoded.select("digest", F.when(fits, F.col("embedding")).alias("embedding"), status.alias("status"))
    # A text shared by very many items would make its digest a hot join key.
    return salted_join(keyed, checked, ["digest"], "inner", item_id).drop("digest")


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


#: Tokens whose place the stand-in encoder remembers; the rest are hashed again.
REMEMBERED = 2**16


class HashingEncoder:
    """Deterministic stand-in encoder: signed token buckets, scaled to unit length.

    A token adds +1 or -1, by one bit of its md5, to the bucket given by other bits.
    """

    def __init__(self, width: int = 64):
        self.width = width
        self.seen: dict[str, tuple[int, int]] = {}

    def _place(self, token: str) -> tuple[int, int]:
        place = self.seen.get(token)
        if place is None:
            digest = hashlib.md5(token.encode()).hexdigest()
            place = int(digest[:8], 16) % self.width, 1 if int(digest[8], 16) % 2 == 0 else -1
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[token] = place
        return place

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, text in enumerate(texts):
            for token, n in Counter(text.split(" ")).items():
                if token:
                    bucket, sign = self._place(token)
                    out[i, bucket] += sign * n
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)
