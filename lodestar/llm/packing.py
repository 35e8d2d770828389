"""Packing by concatenate and cut.

Documents are encoded where they are read and written with their offset inside
their partition. The partitions' token totals, one number for each task, are
summed up on the driver; with them each document has its global offset, and
cutting at multiples of the window needs no shuffle. A document that crosses a
boundary gives one record on either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lodestar.llm import bytetext, scratch

#: Lead bytes up to this one are characters below U+0240. On these, both encoders split words alike.
PLAIN_LEAD = 0xC8
#: Partition totals are broadcast up to this many; one for each task that read documents.
BROADCAST_PARTITIONS = 500_000
#: Arrow batches of texts; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=2)
def _encoder(path: str, ranks_path: str | None) -> tuple[Callable, Callable]:
    """An encoder for any text and one for plain texts, which is faster when the vocabulary's ranks are at hand."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    any_text = lambda text: whole.encode(text, add_special_tokens=False).ids
    if not ranks_path:
        return any_text, any_text
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return any_text, plain.encode_ordinary


def encode(texts: pa.Array, path: str, ranks_path: str | None) -> Iterator[list[int]]:
    any_text, plain = _encoder(path, ranks_path)
    for first, last, piece in bytetext.batches(texts):
        data, bounds = piece.data, piece.bounds
        for i in range(last - first):
            raw = data[bounds[i] : bounds[i + 1]]
            text = raw.tobytes().decode("utf-8", "replace")
            yield (plain if not len(raw) or raw.max() <= PLAIN_LEAD else any_text)(text)


def _tokens(path: str, ranks_path: str | None, end_id: int, narrow: bool):
    kind = np.uint16 if narrow else np.uint32

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in incoming:
            rows: list[tuple] = []
            held, first = 0, 0

            def flush(last: int, rows=rows, batch=batch) -> pa.RecordBatch:
                starts, sizes, ids = zip(*rows, strict=True)
                columns = [batch.column(0).slice(first, last - first), pa.array([part] * len(rows), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "doc_tokens", "ids"])

            for i, found in enumerate(encode(batch.column(1), path, ranks_path)):
                found.append(end_id)
                rows.append((at, len(found), np.array(found, dtype=kind).tobytes()))
                at += len(found)
                held += len(found)
                if held > 4 << 20:
                    yield flush(i + 1)
                    rows.clear()
                    held, first = 0, i + 1
            if rows:
                yield flush(first + len(rows))

    return run


def _cut(window: int, narrow: bool):
    kind = np.uint16 if narrow else np.uint32

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            offsets, sizes = (np.asarray(batch.column(i)) for i in (1, 2))
            first = offsets // window
            n = (offsets + sizes - 1) // window - first + 1
            owner = np.repeat(np.arange(len(n)), n)
            sequence = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
            start = np.maximum(sequence * window - offsets[owner], 0)
            stop = np.minimum((sequence + 1) * window - offsets[owner], sizes[owner])
            for low in range(0, len(owner), 4096):
                cut = slice(low, low + 4096)
                pieces = [np.frombuffer(batch.column(3)[int(o)].as_buffer(), kind)[a:b].astype("<u4").tobytes() for o, a, b in zip(owner[cut], start[cut], stop[cut], strict=True)]
                numbers = (start[cut], (stop - start)[cut], sizes[owner][cut], sequence[cut], ((offsets[owner] + start) % window)[cut])
                columns = [batch.column(0).take(pa.array(owner[cut])), *(pa.array(x, pa.int64()) for x in numbers), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, end_id: int = 1, window: int = 2048, vocabulary: int = 50_257) -> DataFrame:
    """Cut the concatenation of all encoded documents into sequences of ``window`` tokens.

    One row for each piece: doc_id, start, length, doc_tokens (with the end id),
    sequence_id, offset, ids (binary, little-endian unsigned 32-bit). Every
    sequence but the last is full. A null or empty text is the end id alone; each
    of several equal rows is packed; a null id stays null. Extra columns are not
    read. No rows in, no rows out. Which sequence a document is in depends on how
    the input was split; it is settled when the encoded table is written.
    """
    narrow = max(vocabulary, end_id + 1) <= 1 << 16
    id_field = docs.schema["doc_id"]
    numbers = lambda *names: [StructField(n, LongType()) for n in names]
    shape = StructType([id_field, *numbers("part", "at", "doc_tokens"), StructField("ids", BinaryType())])
    encoded = scratch.table(docs.select("doc_id", "text").mapInArrow(_tokens(tokenizer, ranks, end_id, narrow), shape), "tokens", BATCH_BYTES)
    totals = sorted((r.part, r.tokens) for r in encoded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")).collect())
    bases = list(accumulate((t for _, t in totals), initial=0))
    base = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, bases, strict=False)], "part long, base long")
    base = F.broadcast(base) if len(totals) <= BROADCAST_PARTITIONS else base
    placed = encoded.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("place"), "doc_tokens", "ids")
    out = StructType([id_field, *numbers("start", "length", "doc_tokens", "sequence_id", "offset"), StructField("ids", BinaryType())])
    return placed.mapInArrow(_cut(window, narrow), out)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
