"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a bounded sample of its labelled text
recognises every substring of that sample. A text is parsed greedily into
longest matches; the number of phrases times the bits that name a place in the
sample, for each symbol, estimates the cross entropy, and the lowest wins.

Transitions of all automata are one integer table whose missing entries hold
the state after a restart, complemented: a parse is a walk of look-ups, and
numpy walks many blocks of text and all languages in step. All blocks are walked
at once from a guess of the state in which the one before ends, and those again
whose guess was wrong, until none is: the phrases are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lodestar.llm import bytetext, quality

UNKNOWN = "und"
GAP, OTHER = 0, 1


@dataclass(frozen=True)
class Settings:
    """The labelled rows that each language is learned from, whole: at most ``sample_docs``, of ``sample_chars`` characters in all.

    They are drawn by a hash of their ids, rows of at most a sixteenth of
    ``sample_chars`` before longer ones; a language without a row that fits is
    learned from its shortest. ``block``: symbols walked in one go.
    """

    sample_docs: int = 400
    sample_chars: int = 64_000
    block: int = 1024


@dataclass(frozen=True)
class Model:
    languages: list[str]
    roots: np.ndarray
    bits: np.ndarray
    alphabet: np.ndarray
    table: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is none."""
    out = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (char := chr(c)).isalpha():
            low = char.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of some UTF-8 texts, runs of anything else as one 0, with the texts' new bounds."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(quality.LEAD[data], out=lead[1:])
    bounds = lead[bounds]
    found = _letters()[points]
    keep = found != GAP
    starts = bounds[:-1][bounds[:-1] < len(found)]
    first = np.zeros(len(found), dtype=bool)
    first[starts] = True
    after_letter = np.zeros(len(found), dtype=bool)
    after_letter[1:] = keep[:-1]
    keep |= after_letter & ~first
    kept = np.zeros(len(found) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    return found[keep], kept[bounds]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``text``; state 0 is its root."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def build(samples: dict[str, str]) -> Model:
    texts = {}
    for lang in sorted(samples):
        raw = np.frombuffer(samples[lang].encode(), np.uint8)
        found, _ = symbols(raw, np.array([0, len(raw)]))
        if (found != GAP).any():
            texts[lang] = found
    known = np.unique(np.concatenate([t[t != GAP] for t in texts.values()])) if texts else np.zeros(0, np.int32)
    alphabet = np.full(0x110000, OTHER, dtype=np.int32)
    alphabet[GAP] = GAP
    alphabet[known] = np.arange(len(known)) + 2
    width = len(known) + 2
    pieces, roots, bits, offset = [], [], [], 0
    for text in texts.values():
        moves = suffix_automaton(alphabet[text].tolist())
        lost = len(moves)  # the state within a phrase of one letter that the sample lacks
        rows = np.full((lost + 1, width), -1, dtype=np.int64)
        for state, out in enumerate(moves):
            if out:
                rows[state, list(out)] = list(out.values())
        rows[0] = np.where(rows[0] >= 0, rows[0], lost)
        pieces.append(np.where(rows >= 0, (rows + offset) * width, ~((rows[0] + offset) * width)))
        roots.append(offset * width)
        bits.append(np.log2(len(text) + 1))
        offset += len(rows)
    table = np.concatenate(pieces).ravel() if pieces else np.zeros(0, np.int64)
    return Model(list(texts), np.array(roots, np.int32), np.array(bits), alphabet, table.astype(np.int32 if offset * width < 1 << 31 else np.int64))


def _walk(model: Model, code: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each lane's end state and restarts when it goes from ``state`` over ``length`` symbols of ``code`` from ``start``."""
    order = np.argsort(-length, kind="stable")
    start, length, state = start[order], length[order], state[order]
    misses = np.zeros(len(order), dtype=np.int32)
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    shift = 8 * model.table.itemsize - 1
    for step, m in enumerate(active):
        now = model.table.take(state[:m] + code[start[:m] + step])
        missed = now >> shift
        misses[:m] -= missed
        state[:m] = now ^ missed
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return state[back], misses[back]


def phrases(model: Model, found: np.ndarray, bounds: np.ndarray, block: int) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns); ``block`` has no part in the result.

    A lane is a block of a text in a language. Greedy parses from different
    places soon fall into step, so few lanes are walked more than twice. Where
    they don't, as in a text of one repeated letter, lanes are settled from the
    first of each text on, one a round.
    """
    n_langs, sizes = len(model.languages), np.diff(bounds)
    n_blocks = -(-sizes // block)
    text = np.repeat(np.arange(len(sizes)), n_blocks)
    index = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = bounds[text] + index * block
    length = np.minimum(bounds[text + 1] - start, block)
    n, kind = len(text), model.table.dtype
    code = model.alphabet[found].astype(kind)
    start, length, first = np.tile(start, n_langs), np.tile(length, n_langs), np.tile(index == 0, n_langs)
    entry = np.repeat(model.roots.astype(kind), n)
    end, misses = _walk(model, code, start, length, entry.copy())

    def wrong() -> np.ndarray:
        """Lanes that were not entered in the state in which the one before ends."""
        return np.flatnonzero(~first[1:] & (entry[1:] != end[:-1])) + 1

    lanes = wrong()
    for turn in count():
        if not len(lanes):
            break
        if turn > 1:  # of each run of lanes of one text the first
            owner = lanes // max(n, 1) * len(sizes) + text[lanes % max(n, 1)]
            lanes = lanes[np.concatenate([[True], owner[1:] != owner[:-1]])]
        entry[lanes] = end[lanes - 1]
        end[lanes], misses[lanes] = _walk(model, code, start[lanes], length[lanes], entry[lanes])
        lanes = wrong()
    out = np.zeros((len(sizes), n_langs))
    for k in range(n_langs):
        out[:, k] = np.bincount(text, misses[k * n : (k + 1) * n], minlength=len(sizes)) + (sizes > 0)
    return out


def _predict(shared: Broadcast, settings: Settings):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in incoming:
            for first, last, texts in bytetext.batches(batch.column(2)):
                found, bounds = symbols(texts.data, texts.bounds)
                letters = np.zeros(len(found) + 1, dtype=np.int64)
                np.cumsum(found != GAP, out=letters[1:])
                some = letters[bounds[1:]] > letters[bounds[:-1]]
                best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
                if model.languages:
                    cost = phrases(model, found, bounds, settings.block) * model.bits
                    ranked = np.sort(cost, axis=1)
                    best = np.where(some, cost.argmin(1), best)
                    total = ranked[:, 0] + ranked[:, 1] if cost.shape[1] > 1 else ranked[:, 0]
                    score = np.where(some, (ranked[:, 1] if cost.shape[1] > 1 else ranked[:, 0]) / np.maximum(total, 1e-9), 0.0)
                columns = [batch.column(i).slice(first, last - first) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out():
    """True for the fold that is never learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from a sample of labelled documents outside the held-out fold, spread over them by a hash of their ids."""
    rows = docs.filter(~held_out() & F.col("doc_id").isNotNull()).filter("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("d"), "lang", "text")
    rows = rows.withColumn("n", F.length("text"))
    most = F.lit(settings.sample_chars)
    sizes = rows.groupBy("lang").agg(F.count(F.when(F.col("n") <= most, 1)).alias("fit"), F.greatest(most, F.min("n")).alias("most"))
    spread = F.pmod(F.xxhash64("d"), F.lit(1 << 40)) / float(1 << 40)
    wanted = (F.col("n") <= F.col("most")) & ((F.col("fit") == 0) | (spread < 3.0 * settings.sample_docs / F.col("fit")))
    drawn = rows.join(F.broadcast(sizes), "lang").filter(wanted).groupBy("lang", "d").agg(F.min_by("text", F.struct("n", "text")).alias("text"), F.min("n").alias("n"))
    drawn = drawn.selectExpr("lang", "text", "n", f"row_number() over (partition by lang order by n > {settings.sample_chars // 16}, xxhash64(d), d) as k").filter(F.col("k") <= settings.sample_docs)
    taken = drawn.selectExpr("lang", "text", "k", "sum(n) over (partition by lang order by k) as total").filter((F.col("total") <= most) | (F.col("k") == 1))
    samples: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (r.lang, r.k)):
        samples.setdefault(r.lang, []).append(r.text)
    return build({k: " ".join(v) for k, v in samples.items()})


def predict(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Only the text, whole, decides. Null texts and texts without letters, or any
    text when nothing was learned, are ``und`` with score 0. Ties go to the
    first language in alphabetical order. score is the runner-up's share of the
    two lowest costs: 0.5 is a tie; 1.0 with a single language. Repeated rows are
    predicted each; columns other than doc_id and text are not read.
    """
    shape = StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(shared, settings), shape)
