"""Sum-of-squares packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import array
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, trimmed

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
_TWO_SPACES = re.compile(r"\s\s")


class ByteBpe:
    """The ids of byte_bpe_50k.json (the tests compare them), by the faster of two patterns.

    The usual pattern looks ahead only to tell how a run of white space ends.
    Where no two white-space characters meet, one without it gives the same words.
    """

    def __init__(self, tokens: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokens, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
            self.special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.border = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        plain = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")
        self.whole, self.fast = (tiktoken.Encoding("byte_bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (public_tokenizers.PATTERN, plain))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; a special token that the text spells out is that token."""
        if any(t in text for t in self.special):
            out = array.array("I")
            for part in self.border.split(text):
                out.extend([self.special[part]] if part in self.special else self.bpe(part).encode_ordinary(part))
            return out.tobytes()
        return array.array("I", self.bpe(text).encode_ordinary(text)).tobytes()

    def bpe(self, text: str):
        return self.whole if _TWO_SPACES.search(text) else self.fast


def tokenize(docs: DataFrame, tokens: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every whole document.

    A document is its ids, then END_ID.  A longer one is cut so that all pieces
    but the first are full.  Null and empty texts are one piece of END_ID.  Rows
    with equal doc_id are packed each; other columns than doc_id and text are
    not read.
    """
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokens)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.ids(text.as_py() or "") + end
                n, at = len(ids) // 4, 0
                for piece in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if piece == 0 else capacity
                    crc = zlib.crc32(ids[4 * at : 4 * (at + size)])
                    for column, value in zip(out, (doc, piece, at, size, crc)):
                        column.append(value)
                    at += size
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given.

    N[g] counts the open bins with g places left.  A length s goes where the sum
    of N[g]**2 becomes smallest: moving a bin from gap g to g - s changes it by
    2 * (N[g - s] - N[g] + 1), filling one up by 1 - 2 * N[s].  Of equally good
    gaps the smallest is taken; a bin is opened only where no open one has room,
    which with the longest first leaves the fewest bins.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        k = -1
        if s < capacity:
            here = counts[s:capacity]
            cost = 2 * (counts[: capacity - s] - here + 1)
            cost[0] = 1 - 2 * here[0]
            cost[here == 0] = far
            k = int(cost.argmin())
        if k < 0 or cost[k] == far:
            gap, b = capacity, made
            made += 1
        else:
            gap = s + k
            b = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = 20_000) -> DataFrame:
    """Place every piece in a sequence; each group of about ``group`` pieces packs on its own.

    Groups are dealt by a hash of the piece, so each has the lengths of the whole
    in like shares, and as many groups run at once as there are tasks.  A group
    takes its longest pieces first; waste is at most a few sequences a group.
    """
    columns = [c for c in pieces.columns if c != "_group"]
    n = pieces.count()
    groups = max(1, math.ceil(n / group))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="_group").assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    schema = pieces.select(columns).schema.add("sequence_id", "long").add("offset", "long")
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokens: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack ``docs``; an empty table gives no rows."""
    return pack(durable(tokenize(docs, tokens, capacity)), capacity)
