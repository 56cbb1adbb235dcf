"""What several operators of this folder share."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the byte-level vocabulary cuts a text before merging.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this go to the tokenizers library itself, whose splitter needs no stack for long runs.
LONG_TEXT = 1_000_000


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and that byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Ids of whole texts under a byte-level vocabulary file, equal to those of the tokenizers library.

    The bulk goes through tiktoken, which has the same merges and is several times faster; texts that hold a special
    token, or are very long, go through the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["model"]["vocab"].items()
                 if all(c in symbols for c in token)}
        self.special = [t["content"] for t in model["added_tokens"]]
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) > LONG_TEXT or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_LOADED: dict = {}


def loaded(kind, *args):
    """One object of a kind per Python worker, made at first use."""
    key = (kind, args)
    if key not in _LOADED:
        _LOADED[key] = kind(*args)
    return _LOADED[key]


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def crc_of(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def packed(values) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(values, "<u4").tobytes()


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
