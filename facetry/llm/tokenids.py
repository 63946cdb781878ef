"""Token ids of documents in Huffman-coded files.

``encode_texts`` writes the ids of every text once. ``write_ids`` counts them globally,
derives one canonical code, puts the documents in key order by one range shuffle and
writes pages: whole documents, their keys and sizes, the coded ids and a bit offset for
every block of ids. ``read_ids`` decodes pages anywhere, in any order.

The tokenizer drops white space, so what stands between two white spaces is encoded by
itself; each task encodes a piece once and looks it up again after that.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import kept, table, whole
from facetry.llm.huffman import Code, code_lengths, limit_for
from facetry.llm.piecetable import PieceTable, enlarged, pieces_of
from facetry.operators.lookup import attach
from facetry.session import scratch_path, stage

#: A page is closed when it has this many ids.
PAGE_IDS = 65_536
#: Decoded together: pages of a batch, as far as they have this many ids.
DECODE_IDS = 1_000_000
#: Pieces remembered by one Python worker, bytes of those among them that are long, and words that make up new pieces.
CACHE = 1_000_000
HELD = 32_000_000
WORDS = 300_000


#: Punctuation that may end a piece.
TAIL = ".,;:!?"


def is_sure(word: str) -> bool:
    """Whether a tokenizer surely makes one word of it: Latin-1 letters, or nothing."""
    return not word or (word.isalpha() and (word.isascii() or max(word) <= "\xff"))


def byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTES = byte_characters()


def spelled(word: str) -> str:
    """A lower-case word in byte characters."""
    return word if word.isascii() else "".join([BYTES[b] for b in word.encode()])


def folded(text: str) -> str:
    """The text in lower case if that surely changes no id: Latin-1, where each letter has its own, and no special token."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class PieceEncoder:
    """Ids of texts through a memory of pieces.

    Pieces are split at plain spaces and line breaks only; anything else inside a piece
    is left to the tokenizer. A tokenizer for which white space matters is refused. Words
    that are sure in any tokenizer of this kind go straight to its model, many in one call.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        vocabulary = self.tokenizer.get_vocab(True)
        if self._plain("a b\n c") != self._plain("a") + self._plain("b") + self._plain("c"):
            raise ValueError("the tokenizer must drop white space")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        sample = "Straße, Été ÀÏÇ ende."
        cores = [(p.rstrip(TAIL), p) for p in sample.split(" ")]
        lower = [w for core, p in cores for w in (core.lower(), p[len(core) :]) if w]
        #: Whether the tokenizer lower-cases, spells in bytes and cuts words as the short way does.
        self.short = self._plain(sample) == self.model.encode(" ".join(map(spelled, lower)), add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, bytes] = {"": b""}
        self.table = PieceTable()
        self.ids = np.zeros(1 << 16, self.kind)  # of all pieces, one after the other
        self.begin = np.zeros(1 << 16, np.int64)  # where the ids of each piece begin

    def _plain(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _learn_words(self, words: list[str]) -> None:
        width = np.dtype(self.kind).itemsize
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(self.model.encode_batch_fast([" ".join(map(spelled, some))], add_special_tokens=False)[0].ids)
            cuts = np.flatnonzero(self.ends[ids]) + 1  # the last id of a word is marked as such
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                raise ValueError("words can't be told apart in the ids")
            data, to = ids.astype(self.kind).tobytes(), (cuts * width).tolist()
            self.words.update(zip(some, map(data.__getitem__, map(slice, [0, *to], to))))

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, without the memory of pieces."""
        cores = [p.rstrip(TAIL) for p in pieces] if self.short else pieces
        sure = list(map(is_sure, cores)) if self.short else [False] * len(pieces)
        parts = [(c.lower(), p[len(c) :]) for p, c, ok in zip(pieces, cores, sure) if ok]
        if len(self.words) > WORDS:
            self.words = {"": b""}
        self._learn_words([w for w in {w for part in parts for w in part} if w not in self.words])
        rest = self.tokenizer.encode_batch_fast([p for p, ok in zip(pieces, sure) if not ok], add_special_tokens=False)
        parts, rest = iter(parts), iter(rest)
        out = []
        for ok in sure:
            if ok:
                core, tail = next(parts)
                out.append(self.words[core] + self.words[tail])
            else:
                out.append(np.array(next(rest).ids, self.kind).tobytes())
        return out

    def _remember(self, pieces: list[bytes]) -> None:
        """Keep the ids of the pieces that the table has just numbered."""
        encoded = self._encoded([p.decode() for p in pieces])
        first = self.table.size - len(encoded)
        new = np.frombuffer(b"".join(encoded), self.kind)
        at = int(self.begin[first])
        self.ids = enlarged(self.ids, at + len(new))
        self.ids[at : at + len(new)] = new
        self.begin = enlarged(self.begin, self.table.size + 1)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // new.itemsize
        self.begin[first + 1 : self.table.size + 1] = at + np.cumsum(sizes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text. What stands between breaks is looked up for all texts at once."""
        if self.table.size > CACHE or self.table.held > HELD:
            self._forget()
        rows = [(folded(t) if self.short else t).encode() for t in texts]
        joined, starts, stops, counts = pieces_of(rows)
        numbers, new = self.table.number(joined, starts, stops)
        if new:
            self._remember(new)
        begin = self.begin[numbers]
        sizes = self.begin[numbers + 1] - begin
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        cuts = (total[counts] * self.ids.itemsize).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]


def _groups(texts: list[str], limit: int = 1 << 21) -> Iterator[slice]:
    """Runs of texts of about ``limit`` characters, at least one text each."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def text_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of batches (key, text), about as many characters at a time as ``_groups`` says."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            texts = some.column(1).to_pylist()
            for part in _groups(texts):
                yield some.column(0)[part], texts[part]


def id_kind(tokenizer: str, end_id: int | None) -> str:
    """Two bytes an id if all ids fit, else four; little-endian and unsigned."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(True), (end_id or 0) + 1) <= 1 << 16 else "<u4"


def encoder_of(tokenizer: str, kind: str) -> PieceEncoder:
    """The encoder of this Python worker."""
    return kept(f"encoder {tokenizer} {kind}", lambda: PieceEncoder(tokenizer, kind))


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int | None, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, ids``: little-endian unsigned ids as binary, two bytes each if all ids fit, else four.

    A null text is empty; the end id follows every text. Special tokens are not added.
    """
    kind = id_kind(tokenizer, end_id)
    end = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, kind)
        for keys, texts in text_groups(batches):
            ids = [x + end for x in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary())], names=[key, "ids"])

    rows = docs.select(F.col(key), whole(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids binary").withMetadata("ids", {"kind": kind})


def count_ids(encoded: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in the whole table; as long as the largest id needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column(0)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            ids = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)  # of all rows
            for at in range(0, len(ids), 1 << 22):
                found = np.bincount(ids[at : at + (1 << 22)])
                if len(found) > len(total):
                    found, total = total, found
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:  # one row per id of the vocabulary
        counts[r["id"]] = r["n"]
    return counts


def write_ids(encoded: DataFrame, path: str, kind: str, key: str = "doc_id") -> None:
    """Write a table of encoded texts, as ``encode_texts`` makes it, in ascending order of ``key``.

    ``path/code`` has the length of each id's code, ``path/pages`` the pages: ``part, page``
    give their order, ``before`` the ids of the part's pages before. Null keys come first.
    """
    spark = encoded.sparkSession
    counts = count_ids(encoded, kind)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    lengths[used] = code_lengths(counts[used], limit_for(len(used)))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code = TaskContext.get().partitionId(), Code(shared.value)
        number = before = size = 0
        keys: list = []
        texts: list[np.ndarray] = []

        def page() -> pa.RecordBatch:
            data, offsets = code.encode(np.concatenate(texts))
            columns = {
                "part": pa.array([part], pa.int32()), "page": pa.array([number], pa.int64()), "before": pa.array([before], pa.int64()),
                "keys": pa.array([keys], pa.list_(key_type)), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                "data": pa.array([data], pa.binary()), "offsets": pa.array([offsets.tolist()], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            key_type = batch.column(0).type
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                texts.append(np.frombuffer(ids.as_py(), kind))
                size += len(texts[-1])
                if size >= PAGE_IDS:
                    yield page()
                    number, before, size, keys, texts = number + 1, before + size, 0, [], []
        if keys:
            yield page()

    schema = f"part int, page long, before long, keys array<{dict(encoded.dtypes)[key]}>, sizes array<long>, data binary, offsets array<long>"
    ordered = encoded.select(key, "ids").repartitionByRange(key).sortWithinPartitions(key, "ids")
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{path}/pages")


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids``: ids as little-endian unsigned 32-bit numbers, ``start`` the ids before them."""
    rows = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        lengths[r["id"]] = r["length"]
    shared = spark.sparkContext.broadcast(lengths)
    pages = spark.read.parquet(f"{path}/pages")
    key_kind = dict(pages.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    sizes = pages.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("_n"))
    totals = sorted((r["part"], r["_n"]) for r in sizes.collect())  # one row per file partition
    first = np.concatenate([[0], np.cumsum([n for _, n in totals])]).astype(int).tolist()
    offsets = spark.createDataFrame([(p, a) for (p, _), a in zip(totals, first)], "part int, first long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            rows, sizes = batch.num_rows, [np.asarray(s, np.int64) for s in batch.column(2).to_pylist()]
            at = 0
            while at < rows:
                to, n = at + 1, int(sizes[at].sum())
                while to < rows and n + sizes[to].sum() <= DECODE_IDS:
                    n += int(sizes[to].sum())
                    to += 1
                counts = [int(s.sum()) for s in sizes[at:to]]
                data = [batch.column(3)[i].as_py() for i in range(at, to)]
                marks = [batch.column(4)[i].values.to_numpy() for i in range(at, to)]
                raw = code.decode(data, marks, counts).astype("<u4").tobytes()
                lens = np.concatenate(sizes[at:to])
                ends = np.cumsum(lens)
                start = np.concatenate([batch.column(0)[i].as_py() + np.cumsum(sizes[i]) - sizes[i] for i in range(at, to)])
                keys = [k for i in range(at, to) for k in batch.column(1)[i].as_py()]
                ids = [raw[4 * (e - s) : 4 * e] for s, e in zip(lens.tolist(), ends.tolist())]
                columns = [pa.array(keys, batch.schema.field(1).type.value_type), pa.array(start, pa.int64()), pa.array(lens, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids"])
                at = to

    placed = attach(pages, offsets, ["part"], "inner", spread_by="page")
    placed = placed.select((F.col("before") + F.col("first")).alias("before"), "keys", "sizes", "data", "offsets")
    return placed.mapInArrow(run, f"`{key}` {key_kind}, start long, n_tokens long, ids binary")


def store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, key: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the files. Only key and text are read; repeated rows are all written."""
    encoded = encode_texts(docs, tokenizer, end_id, key, text_col)
    write_ids(stage(encoded, "ids"), path, encoded.schema["ids"].metadata["kind"], key)


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write the ids of ``docs`` and read them back: place, number and checksum of each document's ids."""
    path = scratch_path(docs.sparkSession, "token-files")
    store(docs, path, tokenizer, end_id)
    found = read_ids(docs.sparkSession, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_files(spark, folder, tokenizer: str | None = None):
    """Ids of every document through the files: start, number and checksum."""
    return token_table(table(spark, folder, "documents"), tokenizer or default_tokenizer())
