"""Packing: each document is cut into pieces of binary lengths, and equal lengths share a bucket.

A document of n tokens gives n // LONGEST pieces of LONGEST tokens and one piece
for each binary digit of the rest, so every piece fills a sequence of its own
length: no padding, and no sequence crosses documents.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrado.llm.common import slices, texts_of

LONGEST = 2048
#: The id after each document's own.
END = 1
#: Chunks of text whose ids a worker keeps.
MAX_KEPT = 400_000
SPECIAL = "<|endoftext|>"


def tokenizer_paths() -> tuple[str, str]:
    """The vocabulary as `tokenizers` reads it, and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def binary_pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens, longest first. longest: a power of two."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    for bit in range(longest.bit_length() - 2, -1, -1):
        if (n - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def encoder(json_path: str, ranks_path: str | None = None) -> Callable[[str], bytes]:
    """Text to its ids as little-endian unsigned 32-bit numbers.

    The ids are those of the `tokenizers` file. With the ranks of the same
    vocabulary a faster way gives them: the vocabulary's pattern always starts
    a new pre-token at a single space between other characters, so what stands
    between such spaces is encoded once and kept. Texts with longer runs of
    white space around a space, or with the special token, are encoded whole.
    """
    whole_by_file = None

    def by_file(text: str) -> bytes:
        nonlocal whole_by_file
        if whole_by_file is None:
            from tokenizers import Tokenizer

            whole_by_file = Tokenizer.from_file(json_path)
        return np.array(whole_by_file.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    if ranks_path is None:
        return by_file
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    unsafe = re.compile(r"\s \s").search

    class Kept(dict):
        def __missing__(self, chunk: str) -> bytes:
            if len(self) >= MAX_KEPT:
                self.clear()
            ids = self[chunk] = np.array(fast.encode_ordinary(" " + chunk), dtype="<u4").tobytes()
            return ids

    kept = Kept()

    def encode(text: str) -> bytes:
        if SPECIAL in text:
            return by_file(text)
        if "  " in text or unsafe(text):
            return np.array(fast.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(fast.encode_ordinary(first), dtype="<u4").tobytes() + b"".join([kept[x] for x in rest])

    return encode


_encoders: dict[tuple, Callable[[str], bytes]] = {}


def pack(
    docs: DataFrame,
    *,
    json_path: str | None = None,
    ranks_path: str | None = None,
    longest: int = LONGEST,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, tokens (binary: little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, bucket.

    Each document is its ids and then `end`; null and empty texts have that id
    alone. A sequence is one piece, as long as its bucket says. Repeated rows
    are packed each. sequence_id is unique, not consecutive.
    """
    paths = (json_path, ranks_path) if json_path else tokenizer_paths()
    last = np.array([end], dtype="<u4").tobytes()
    schema = "doc_id long, start long, length long, tokens binary, doc_tokens long"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _encoders:
            _encoders[paths] = encoder(*paths)
        encode = _encoders[paths]
        for batch in slices(batches):
            ids, starts, lengths, tokens, totals = [], [], [], [], []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encode(text.as_py() or "") + last
                n = len(got) // 4
                for start, length in binary_pieces(n, longest):
                    ids.append(doc_id)
                    starts.append(start)
                    lengths.append(length)
                    tokens.append(got[4 * start : 4 * (start + length)])
                    totals.append(n)
                held += len(got)
                if held > 16_000_000:
                    yield _batch(ids, starts, lengths, tokens, totals)
                    ids, starts, lengths, tokens, totals, held = [], [], [], [], [], 0
            yield _batch(ids, starts, lengths, tokens, totals)

    pieces = texts_of(docs, id_col, text_col).mapInArrow(over, schema)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"))


def _batch(ids: list, starts: list, lengths: list, tokens: list, totals: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(tokens, pa.binary()), pa.array(totals, pa.int64())],
        names=["doc_id", "start", "length", "tokens", "doc_tokens"],
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Packed pieces as Parquet, a folder for each length: a batch of one bucket has sequences of one length, and is read without the others."""
    packed.write.partitionBy("bucket").parquet(path)


def checksum(tokens: bytes) -> int:
    return zlib.crc32(tokens)


def piece_digests(packed: DataFrame) -> DataFrame:
    """Packed pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
