"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents are tokenized where they are read. A document longer than a sequence is cut into full
pieces and a rest; what moves between tasks is a few numbers per piece. Pieces meet in groups
chosen by a hash, whose number grows with the rows so that a group stays small; within a group
the longest piece goes first, each into the first open sequence with room. The tree over the
room left in each sequence finds that one in log time.

Definitions: a null or empty text is the end id alone. Every row is packed, repeated rows each
for themselves. Equal lengths go by doc_id (null first), then start. An empty table gives none.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polynya.llm.base import pieces


@dataclass(frozen=True)
class Settings:
    """``model`` and ``ranks`` are paths of the same vocabulary for the two tokenizer libraries."""

    capacity: int = 2048
    end_id: int = 1
    model: str | None = None
    ranks: str | None = None
    docs_per_group: int = 4000
    with_ids: bool = False


def public_vocabulary() -> Settings:
    import public_tokenizers

    return Settings(
        model=public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


@lru_cache(maxsize=1)
def encoder(model: str, ranks: str) -> Callable[[str], np.ndarray]:
    """Token ids of a text.

    The rank file's encoder takes texts whole; texts with the text of a special token, or with a run
    of blanks too long for its pattern, go through the JSON vocabulary's own. A worker process keeps
    its encoder for all its tasks.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(model)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return fast.encode_to_numpy(text)
            except ValueError:  # the pattern's stack is full
                pass
        return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def tokenized_pieces(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every piece."""
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind)] + [
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")
    ]
    if s.with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(s.model, s.ranks)
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(s.end_id)).astype("<u4")
                for at in range(0, len(ids), s.capacity):
                    part = ids[at : at + s.capacity]
                    owner.append(i)
                    rows.append((at, len(part), zlib.crc32(part.tobytes()), len(ids), part))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [batch.column(0).take(pa.array(owner, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[:4]]
            if s.with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in columns[4]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, T.StructType(fields))


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, taken in the order given; tournament tree over the room."""
    n = 1
    while n < max(len(lengths), 1):
        n *= 2
    room = [capacity] * (2 * n)
    bins, offsets = [], []
    for length in lengths.tolist():
        at = 1
        while at < n:
            at *= 2
            if room[at] < length:
                at += 1
        bins.append(at - n)
        offsets.append(capacity - room[at])
        room[at] -= length
        at //= 2
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            most = left if left >= right else right
            if room[at] == most:
                break
            room[at] = most
            at //= 2
    return bins, offsets


def pack(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """Every piece with the sequence it lies in and its offset there, gapless from 0.

    ``sequence_id`` is the group's number times 2**32 plus the sequence's number in the group.
    A sequence is padded to the capacity unless what it holds is already a power of two.
    """
    s = s or public_vocabulary()
    groups = pieces(docs.count(), s.docs_per_group)
    cut = tokenized_pieces(docs, s)
    place = F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long")
    schema = T.StructType(
        [*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first"
        )
        bins, offsets = first_fit(ordered["length"].to_numpy(), s.capacity)
        first = int(key[0]) << 32
        return ordered.drop(columns="_group").assign(
            sequence_id=np.array(bins, np.int64) + first, offset=np.array(offsets, np.int64)
        )

    return cut.withColumn("_group", place).groupBy("_group").applyInPandas(fill, schema)


def op9_packing(docs: DataFrame) -> DataFrame:
    return pack(docs).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
