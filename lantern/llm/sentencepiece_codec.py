"""SentencePiece encoding and decoding through a table of distinct chunks.

In the model's vocabulary no piece has a whitespace marker after another character, so no merge crosses
the start of a marked word: a text is the concatenation of chunks "markers, then other characters", each
of which can be segmented on its own. Every task keeps a table from chunk to ids: of a batch of texts it
collects the distinct chunks that the table lacks, segments each of them once with the library, and joins
the ids back by position. The table takes no more chunks beyond ``TABLE_BYTES``, which bounds its
memory and costs nothing but segmenting a chunk again in a later batch, and goes with its task. No shuffle takes place; a word of
a third of all texts is segmented once a task. ``crossing_pieces`` checks the condition; with a vocabulary that fails it,
whole texts are segmented.

Defined results: a null or empty text has no ids and decodes to the empty text; a null id list decodes to
the empty text; a very long text goes through by itself, whole; ties between merges are the library's; repeated rows give repeated results; an empty table gives an empty result; columns of the
input with the names of the outputs are replaced.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm.common import table

MARK = "▁"
#: About the bytes that a task's table takes, and those of an entry beside its characters.
TABLE_BYTES, ENTRY = 48_000_000, 200
#: Texts and characters that go through Python at once.
SLICE_ROWS, SLICE_CHARS = 512, 500_000


@functools.cache
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@functools.cache
def crossing_pieces(model: str) -> int:
    """How many pieces have a whitespace marker after another character."""
    p = processor(model)
    return sum(MARK in p.id_to_piece(i).lstrip(MARK) for i in range(p.get_piece_size()) if not p.is_control(i) and not p.is_unknown(i))


class ChunkTable:
    """Distinct chunk -> its ids as 32-bit numbers. Chunks are spelled without their first marker, which the library adds."""

    def __init__(self, model: str, limit: int = TABLE_BYTES):
        self.p, self.limit, self.held, self.ids = processor(model), limit, 0, {}
        self.mark = self.p.piece_to_id(MARK)
        self.whole = bool(crossing_pieces(model))

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.whole:
            return [text]
        words = text.replace(MARK, " ").split(" ")
        return words if "" not in words else re.findall(r"(?:\A| ) *[^ ]+|(?:\A| ) *\Z", " " + " ".join(words))

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of those chunks that the table lacks; as many of them as it has room for are kept."""
        new = sorted(chunks - self.ids.keys())
        # a chunk found by the pattern keeps its markers as spaces: the first is the one that the library adds
        found = self.p.encode([c.removeprefix(" ") for c in new], num_threads=1)
        more = {c: array("i", ids or [self.mark]).tobytes() for c, ids in zip(new, found, strict=True)}
        for chunk, ids in more.items():
            if self.held > self.limit:
                break
            self.ids[chunk] = ids
            self.held += len(chunk) + ENTRY
        return more

    def encode(self, texts: list[str]) -> pa.ListArray:
        cut = [self.chunks(x) for x in texts]
        more = self.learn(set().union(*cut))
        kept = self.ids.get
        joined = [b"".join([kept(c) or more[c] for c in chunks]) for chunks in cut]
        offsets = np.cumsum([0, *(len(x) // 4 for x in joined)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(joined), np.int32)))


def lists(ids: pa.ListArray) -> list[list[int]]:
    """The lists of numbers; empty ones for nulls."""
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False).tolist(), ids.offsets.to_numpy()
    return [flat[a:b] for a, b in itertools.pairwise((ends - ends[0]).tolist())]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows that are few and hold few characters (one long text goes alone)."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (size + n > SLICE_CHARS or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield batch.slice(start)


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the library's ids of each whole text, without begin or end ids: ``array<int>``."""
    keep = [c for c in df.columns if c != ids]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    where = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkTable(model)
        for batch in batches:
            for part in slices(batch, where):
                found = known.encode([x or "" for x in part.column(where).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the library's text of each list of ids."""
    keep = [c for c in df.columns if c != decoded]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(decoded, T.StringType())])
    where = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(model)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = p.decode(lists(part.column(where)), num_threads=1) if part.num_rows else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)


def encode_decode(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the tasks: ``ids`` and ``decoded``; the text itself is dropped.

    ``decoded`` comes from the library's ``decode`` of the whole list of ids.
    """
    keep = [c for c in df.columns if c not in ("ids", "decoded")]
    rest = [c for c in keep if c != text]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    where, kept = keep.index(text), [keep.index(c) for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkTable(model)
        for batch in batches:
            for part in slices(batch, where):
                ids = known.encode([x or "" for x in part.column(where).to_pylist()])
                columns = [ids, pa.array(known.p.decode(lists(ids), num_threads=1) if len(ids) else [], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *columns], names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """Count and digest of ``ids``, digest of ``decoded``, beside the columns ``keep``."""
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return encoded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every row of ``documents``."""
    return digests(encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), model_path()), "doc_id")
