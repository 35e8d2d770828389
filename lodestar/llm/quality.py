"""Quality rules: boosted trees over statistics of whole documents.

One pass reads the texts, counts and scores; nothing is shuffled. The trees are
trained on a bounded sample of labelled rows (``Settings.most_rows``), which is
all that the driver ever holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lodestar.llm import boosting, bytetext
from lodestar.llm.bytetext import U64, Texts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, with the direction in which each may move the score.
FEATURES = {"n_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "digit_share": -1, "upper_share": 0, "words_per_line": 0}

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_CODES = np.arange(256)
LEAD = (_CODES & 0xC0) != 0x80
DIGIT = (_CODES >= 48) & (_CODES <= 57)
UPPER = (_CODES >= 65) & (_CODES <= 90)


@dataclass(frozen=True)
class Settings:
    """A document is rejected below ``least_probability`` of being good; ``most_rows`` bounds the training sample."""

    least_words: int = 10
    most_repeat_pct: int = 20
    least_probability: float = 0.5
    most_rows: int = 20_000
    n_trees: int = 40
    depth: int = 3


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes occur twice or more in their text, and which of them are not the first."""
    keys = bytetext.mix(hashes + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    any_of = same.copy()
    any_of[:-1] |= same[1:]
    often, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    often[order], later[order] = any_of, same
    return often, later


def count(texts: Texts) -> dict[str, np.ndarray]:
    data, bounds, n = texts.data, texts.bounds, len(texts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    space = bytetext.IS_SPACE[data]
    starts, ends = texts.words()
    n_words, owner = texts.owners(starts)
    grams, at = bytetext.ngram_hashes(texts.span_hashes(starts, ends), owner, 5)
    often, _ = _repeated(grams, owner[at])
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, at[often], 1)
    np.add.at(cover, at[often] + 5, -1)
    repeats = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n)

    line_starts, line_ends = texts.runs(data != 10)
    words_before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~space, out=words_before[1:])
    with_word = words_before[line_ends] > words_before[line_starts]
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    n_lines, line_owner = texts.owners(line_starts)
    _, later = _repeated(texts.span_hashes(line_starts, line_ends), line_owner)
    return {
        "n_words": n_words,
        "word_chars": per_text(LEAD[data] & ~space),
        "n_symbols": per_text(SYMBOL[data]),
        "n_dup_lines": np.bincount(line_owner[later], minlength=n),
        "n_repeat_words": repeats,
        "n_lines": n_lines,
        "n_digits": per_text(DIGIT[data]),
        "n_upper": per_text(UPPER[data]),
    }


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([c["n_words"], chars / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_digits"] / chars, c["n_upper"] / chars, words / lines], 1).astype(np.float64)


def _measure(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        for first, last, texts in bytetext.batches(batch.column(1)):
            x = features(count(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), target: str = "quality") -> boosting.Trees:
    """Train on at most ``most_rows`` labelled documents, those with the smallest hash of their id.

    Null ids and labels are left out; of several labels of an id the lowest
    counts, of several texts one. Without labels the model accepts everything.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.most_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    x = own.mapInArrow(_measure, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = x.join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("x", "y").toPandas()
    table = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return boosting.train(table, rows["y"].to_numpy(dtype=np.float64), list(FEATURES.values()), settings.n_trees, settings.depth)


def _judge(model: boosting.Trees, settings: Settings, text_at: int, through: list[int]):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for first, last, texts in bytetext.batches(batch.column(text_at)):
                c = count(texts)
                failed = (c["n_words"] < settings.least_words) | (100 * c["n_repeat_words"] > settings.most_repeat_pct * c["n_words"])
                good = model.probability(features(c))
                kept = ~failed & (good >= settings.least_probability)
                columns = [batch.column(i).slice(first, last - first) for i in through] + [pa.array(c[k], pa.int64()) for k in COUNTS]
                names = [f"c{i}" for i in range(len(columns))] + ["base_failed", "probability", "kept"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(good), pa.array(kept)], names)

    return run


VERDICT = StructType([*(StructField(n, LongType()) for n in COUNTS), StructField("base_failed", BooleanType()), StructField("probability", DoubleType()), StructField("kept", BooleanType())])


def judge(docs: DataFrame, model: boosting.Trees, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, five counts, base_failed, probability, kept.

    Null and empty texts have no words and so fail the base rules. Repeated rows
    and null ids are judged each on its own; extra columns are not read. No rows
    in, no rows out.
    """
    shape = StructType([docs.schema["doc_id"], *VERDICT.fields])
    return docs.select("doc_id", "text").mapInArrow(_judge(model, settings, 1, [0]), shape)


def keep_good(docs: DataFrame, model: boosting.Trees, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that the rules and the model keep, with all their columns, whatever these are called."""
    names = docs.columns
    numbered = docs.toDF(*(f"d{i}" for i in range(len(names))))
    shape = StructType([*numbered.schema.fields, *VERDICT.fields])
    judged = numbered.mapInArrow(_judge(model, settings, names.index("text"), list(range(len(names)))), shape)
    return judged.filter("kept").select(*(F.col(f"d{i}").alias(n) for i, n in enumerate(names)))
