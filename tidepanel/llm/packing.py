"""Packing by power-of-two decomposition.

Each document's ids (its tokens and one end id) are cut into pieces of 1024 and then into
the binary digits of the rest. Every piece is a sequence of its own, so no sequence
crosses documents, none needs padding, and batches are drawn from the bucket of one
length (column ``bucket``, the exponent).

Documents are independent: the work is one scan with a tokenizer in each task, without a
shuffle; a lost task is simply run again. ``sequence_id`` numbers the rows by partition.
The tokenizer's ids are produced by the byte-pair ranks of the same vocabulary file
family; a text that this encoder refuses is encoded by the JSON tokenizer itself.

Defined results: null or empty text is the single end id; repeated documents are packed
again as rows of their own; very long texts are encoded whole; an empty table gives no
rows; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import text as T

SEQUENCE = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary as ranks
SPECIAL = {"<|endoftext|>": 50256}  # fixed value: the vocabulary's only added token


@cache
def _fast(ranks: str):
    import public_tokenizers as files
    import tiktoken

    with open(files.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=files.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)


@cache
def _exact(vocabulary: str):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    return Tokenizer.from_file(files.path(vocabulary))


def token_ids(text: str, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> list[int]:
    """Ids of a text, equal to the JSON tokenizer's without added special tokens."""
    try:
        return _fast(ranks).encode(text, allowed_special="all")
    except BaseException as e:  # the encoder's panics are no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return _exact(vocabulary).encode(text, add_special_tokens=False).ids


def piece_lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """``n`` as full sequences followed by the binary digits of the rest, largest first."""
    full, rest = divmod(n, sequence)
    return [sequence] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _pieces(sequence: int, vocabulary: str, ranks: str):
    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, starts, lengths, sums, totals = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.array([*token_ids(text.as_py() or "", vocabulary, ranks), END_ID], dtype="<u4")
                at = 0
                for n in piece_lengths(len(tokens), sequence):
                    ids.append(doc_id)
                    starts.append(at)
                    lengths.append(n)
                    sums.append(zlib.crc32(tokens[at:at + n]))
                    totals.append(len(tokens))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, starts, lengths, sums, totals)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
         vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """One row per piece: its document, place, checksum, sequence and bucket."""
    if sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    rows = T.documents(docs, id_col, text_col).mapInArrow(
        _pieces(sequence, vocabulary, ranks),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    return rows.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                       F.log2(F.col("length")).cast("int").alias("bucket"))
