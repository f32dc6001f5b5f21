"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once on the driver and broadcast (under a megabyte); each Python worker builds its encoder once.
Long texts are encoded piece by piece, so that the library never holds one whole: a piece may end only before a white
space character that follows another character, where no match of the pattern can reach across. The ids of the pieces
together are the ids of the text. Long runs of white space, on which the library's pattern engine overflows, are matched
here: the pattern takes a run but for its last character, or all of it at the end of the text, as one match. Decoding joins the raw bytes of the ids, so that ids which cut a character in two give
the bytes they stand for, not replacement characters.

Scale: one pass, no shuffle, memory bounded by an Arrow batch.

A null text counts as empty and gives no ids and no bytes. Null ids decode to no bytes. Special tokens are not used: their
strings are ordinary text. Columns of the input stay, but for those named like a result column.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import as_row, replace_columns

#: Code points from which a piece ends at the next safe place, and longest run of white space that the pattern engine is given.
PIECE = 1 << 16
#: White_Space of Unicode, which is ``\s`` in the pattern; Python's ``\s`` takes four control characters more (fixed values).
_WHITE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_RUN = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{PIECE},}}")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces that end where the pattern always splits; a run without white space stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= PIECE:
            return self.encoding.encode_ordinary(text)
        return [i for piece in pieces(text) for i in self._encode_piece(piece)]

    def _encode_piece(self, piece: str) -> list[int]:
        """The ids of a piece; only the last piece of a text can end with white space."""
        ids, at = [], 0
        for run in _RUN.finditer(piece):
            end = run.end() if run.end() == len(piece) else run.end() - 1
            ids += self.encoding.encode_ordinary(piece[at : run.start()])
            ids += self.encoding._encode_single_piece(piece[run.start() : end])
            at = end
        return ids + self.encoding.encode_ordinary(piece[at:])

    def decode(self, ids: list[int] | None) -> bytes:
        return self.encoding.decode_bytes(ids) if ids else b""


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def _map(df: DataFrame, column: str, added: T.StructType, ranks, make) -> DataFrame:
    """df's rows with new columns that ``make`` (a codec and an Arrow column to Arrow columns) gives."""
    rows = df.select(as_row(df), F.col(f"`{column}`").alias("value"))
    schema = T.StructType([T.StructField("__row", rows.schema["__row"].dataType), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(batch.column(1))], names=schema.names)

    return replace_columns(rows.mapInArrow(run, schema), "__row", {f.name: F.col(f"`{f.name}`") for f in added.fields})


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """df with ids, an array of ints, and if asked decoded, the bytes that these ids give."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def make(texts: pa.Array) -> list[pa.Array]:
        codec = _codec(ranks, pattern)
        ids = [codec.encode(t) for t in texts.to_pylist()]
        out = [pa.array(ids, pa.list_(pa.int32()))]
        return [*out, pa.array([codec.decode(i) for i in ids], pa.binary())] if decoded else out

    added = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _map(df, text, added.add("decoded", T.BinaryType()) if decoded else added, ranks, make)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded, the bytes that the ids stand for."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def make(values: pa.Array) -> list[pa.Array]:
        codec = _codec(ranks, pattern)
        return [pa.array([codec.decode(i) for i in values.to_pylist()], pa.binary())]

    return _map(df, ids, T.StructType([T.StructField("decoded", T.BinaryType())]), ranks, make)
