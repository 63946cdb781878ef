"""Secret scans: fixed patterns, and two character Markov models.

The patterns find values that stand in an assignment, access keys and long hex runs.
The models are first-order chains over the characters of a token, one of random strings
and one of ordinary identifiers. A run of token characters is a secret if the log
likelihood ratio of the two exceeds a threshold. Both are learned from labelled samples:
the values that the patterns find, and the runs of the same texts that they don't touch.
Everything is Spark SQL on one row per document; only the bigram counts of the samples
are shuffled.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import let, table, whole

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A run of token characters long enough to be a secret, and one long enough to learn from.
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
KINDS = ["assign", "access", "hex", "markov"]
SPANS = "array<struct<start:int,end:int,kind:int,value:string>>"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class 0 stands for the edge of a token and for any other character.
CLASSES = len(ALPHABET) + 1


def _found(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose value has ``least`` characters, in code points.

    The pieces between the matches and the matches themselves add up to the places.
    """
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    cells = F.arrays_zip(gaps.alias("gap"), lengths.alias("len"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPANS).alias("spans"))
    start = start.withField("spans", F.array().cast(SPANS))

    def step(acc, cell):
        at = acc["at"] + cell["gap"]
        end = at + cell["len"]
        span = F.struct(at.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), cell["value"].alias("value"))
        keep = cell["len"].isNotNull() & (F.length(cell["value"]) >= least)
        return F.struct(F.coalesce(end, at).alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(cells, start, step, lambda acc: acc["spans"])


def _none() -> Column:
    return F.array().cast(SPANS)


def base_spans(text: Column) -> Column:
    """All pattern spans of a text, by start and then by kind."""
    marks = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    # Only texts with a match pay for the places. Hex runs below 24 characters can't be part of a longer
    # match, and an access run that is too short has no longer one inside, so both patterns carry their length.
    assign = F.when(marks & text.rlike(ASSIGN), _found(text, ASSIGN, 0, 2, 6)).otherwise(_none())
    access_key = ACCESS.replace("+", "{16,}")
    access = F.when(F.contains(text, F.lit("AKIA")) & text.rlike(access_key), _found(text, access_key, 1, 0, 20)).otherwise(_none())
    hex_run = HEX.replace("+", "{24,}")
    hexes = F.when(text.rlike(hex_run), _found(text, hex_run, 2, 0, 24)).otherwise(_none())
    return F.array_sort(F.concat(assign, access, hexes))


def token_spans(text: Column, least: int) -> Column:
    pattern = RUN % least
    return F.when(text.rlike(pattern), _found(text, pattern, 3, 0, least)).otherwise(_none())


def apart(span: Column, others: Column) -> Column:
    """A span overlaps none of the others."""
    return ~F.exists(others, lambda o: (span["start"] < o["end"]) & (o["start"] < span["end"]))


def _classes(value: Column) -> Column:
    """Character classes of a token, with an edge on either side."""
    inner = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.lit(0)))


def _steps(value: Column) -> Column:
    """Numbers of the transitions of a token."""
    return let(_classes(value), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * CLASSES + b))


@dataclass
class SecretModel:
    """Per transition, 1000 times the log likelihood ratio of random to ordinary."""

    ratio: list[int]
    threshold: float
    least: int

    def score(self, value: Column) -> Column:
        """Log likelihood ratio of a token, in nats."""
        ratio = F.from_json(F.lit(json.dumps(self.ratio)), "array<int>")
        return F.aggregate(_steps(value), F.lit(0).cast("long"), lambda acc, s: acc + F.get(ratio, s)) / 1000.0


def fit(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", sample: int = 20_000, learn_from: int = 8,
    least: int = 20, threshold: float = 12.0, smooth: float = 0.5,
) -> SecretModel:
    """Learn both chains from at most ``sample`` documents, those with the lowest hashes of their keys.

    Positive tokens are the values of pattern spans, as they stand and in capitals,
    negative ones all other runs of at least ``learn_from`` characters. Without any positive token nothing scores above 0.
    """
    chosen = docs.select(F.col(key).alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(sample).distinct()
    texts = docs.select(F.col(key).alias("_key"), whole(text_col).alias("_text")).join(F.broadcast(chosen), "_key", "left_semi")
    spans = texts.select("_text", base_spans(F.col("_text")).alias("_base"))
    runs = F.filter(token_spans(F.col("_text"), learn_from), lambda s: apart(s, F.col("_base")))
    spans = spans.select(F.col("_base"), runs.alias("_runs"))
    tokens = F.concat(
        F.transform("_base", lambda s: F.struct(F.lit(1).alias("label"), s["value"].alias("value"))),
        F.transform("_base", lambda s: F.struct(F.lit(1).alias("label"), F.upper(s["value"]).alias("value"))),
        F.transform("_runs", lambda s: F.struct(F.lit(0).alias("label"), s["value"].alias("value"))),
    )
    rows = spans.select(F.inline(tokens)).groupBy("label", "value").count()  # equal tokens once: copies don't weigh more
    steps = rows.select("label", F.explode(_steps(F.col("value"))).alias("step"))
    counts = [[smooth] * CLASSES**2 for _ in range(2)]
    seen = [0, 0]
    for row in steps.groupBy("label", "step").count().collect():  # at most 2 * CLASSES ** 2 rows
        counts[row["label"]][row["step"]] += row["count"]
        seen[row["label"]] += row["count"]
    if not all(seen):
        return SecretModel([0] * CLASSES**2, threshold, least)
    logs = []
    for c in counts:
        sums = [sum(c[i * CLASSES : (i + 1) * CLASSES]) for i in range(CLASSES)]
        logs.append([math.log(c[i] / sums[i // CLASSES]) for i in range(CLASSES**2)])
    return SecretModel([round(1000 * (a - b)) for a, b in zip(logs[1], logs[0])], threshold, least)


def scan(docs: DataFrame, model: SecretModel, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, base, added``: arrays of (start, end, kind, value), places in code points, end exclusive.

    A null or empty text has no spans. Repeated rows give repeated rows; other columns are ignored.
    """
    rows = docs.select(F.col(key), whole(text_col).alias("_text"))
    rows = rows.select(key, "_text", base_spans(F.col("_text")).alias("base"))
    runs = F.filter(token_spans(F.col("_text"), model.least), lambda s: apart(s, F.col("base")) & (model.score(s["value"]) >= model.threshold))
    return rows.select(key, "base", runs.alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op9_secrets(spark, folder):
    """Spans of secrets in every document: pattern spans and those that the Markov models add."""
    docs = table(spark, folder, "documents")
    found = scan(docs, fit(docs))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
