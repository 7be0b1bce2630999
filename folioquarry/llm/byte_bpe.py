"""Operator 2: byte-level BPE encoding and decoding.

Each text is cut by the public pattern; every match is mapped byte by byte to printable characters and
encoded by the ``tokenizers`` BPE model; decoding reverses the byte table, so characters that are split
over tokens come back whole.  A bounded per-process table remembers encoded matches.

Defined results: null is the empty text (no ids); special-token strings are ordinary text; repeated rows
give repeated results; an empty table gives no rows; further columns are kept unless their names clash
with a result's, which then wins.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioquarry.llm.common import char_starts, over_texts, small_batches

#: Encoded matches that a process remembers before it starts anew.
CACHE_ENTRIES = 250_000


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from 256 on in order."""
    table, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table.append(chr(b))
        else:
            table.append(chr(spare))
            spare += 1
    return table


class Codec:
    """Encoder and decoder over one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, vocabulary: str, pattern: str):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(vocabulary)
        self.model = own.model
        self.find = regex.compile(pattern).findall
        table = byte_table()
        self.to_chars = {b: c for b, c in enumerate(table)}
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of: dict[int, bytes] = {}
        for word, i in own.get_vocab(with_added_tokens=False).items():
            if all(c in back for c in word):
                self.bytes_of[i] = bytes(back[c] for c in word)
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, match: str) -> tuple[int, ...]:
        ids = self.known.get(match)
        if ids is None:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            chars = match.encode().decode("latin-1").translate(self.to_chars)
            ids = tuple(t.id for t in self.model.tokenize(chars))
            if len(match) <= 64:
                self.known[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        piece = self.piece
        return [i for m in self.find(text) for i in piece(m)]

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Code points [start, end) that each id's bytes touch; a split character belongs to each of its ids."""
        starts = char_starts(np.frombuffer(text.encode(), np.uint8))
        number = np.cumsum(starts) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids])
        begins = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        return [(int(number[a]), int(number[b - 1]) + 1) for a, b in zip(begins, ends, strict=True)]


@lru_cache(maxsize=4)
def codec(vocabulary: str, pattern: str) -> Codec:
    """One codec a process, loaded where it runs."""
    return Codec(vocabulary, pattern)


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, with_offsets: bool = False) -> DataFrame:
    """Kept columns, token_ids array<int>, n_tokens, and with ``with_offsets`` token_starts and token_ends (code points)."""
    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    if with_offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("token_starts", "token_ends")]

    def kernel(texts: list[str | None]) -> list[list]:
        c = codec(vocabulary, pattern)
        ids = [c.encode(t or "") for t in texts]
        out = [ids, [len(i) for i in ids]]
        if with_offsets:
            spans = [c.offsets(t or "", i) for t, i in zip(texts, ids, strict=True)]
            out += [[[s[k] for s in x] for x in spans] for k in (0, 1)]
        return out

    return over_texts(df, text_col, kernel, T.StructType(fields), df.columns if keep is None else keep)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns and decoded (binary): the bytes of the ids; null ids give empty bytes, unknown ids an error."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    at = df.columns.index(ids_col)
    schema = T.StructType([f for f in df.schema if f.name != "decoded"] + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for batch in batches:
            c = codec(vocabulary, pattern)
            names = batch.schema.names
            cols = [batch.column(i) for i, n in enumerate(names) if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([c.decode(i or []) for i in batch.column(at).to_pylist()], pa.binary())], schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded, in one pass."""
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def kernel(texts: list[str | None]) -> list[list]:
        c = codec(vocabulary, pattern)
        counts, ids_sha, decoded_sha = [], [], []
        for t in texts:
            ids = c.encode(t or "")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [counts, ids_sha, decoded_sha]

    return over_texts(df, text_col, kernel, fields, df.columns if keep is None else keep)
