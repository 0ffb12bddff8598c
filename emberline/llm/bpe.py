"""Byte-level BPE: a segment tree over the ranks of adjacent pairs.

A pre-token's bytes are the leaves; each inner node holds the lowest (rank, position) below it, so the root names the
leftmost merge of lowest rank. A merge changes the pair to its left and right and removes one: three point updates of
logarithmic cost, until no pair has a rank. So a pre-token of n bytes takes O(n log n), however long it is. Pre-tokens
repeat; a bounded table keeps the ids of short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short pre-tokens whose ids a worker keeps, and their greatest length in bytes.
KEPT, KEPT_BYTES = 500_000, 64


class SegmentTreeBpe:
    """Encodes pre-tokens by ranks of byte strings; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.kept: dict[str, list[int]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        size = 1
        while size < n:
            size *= 2
        shift = size.bit_length()  # a key is rank << shift | position: lowest rank first, then leftmost
        none = 1 << 62
        tree = [none] * (2 * size)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))  # start of the part to the left
        get = ranks.get
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << shift | i
        for k in range(size - 1, 0, -1):
            x, y = tree[2 * k], tree[2 * k + 1]
            tree[k] = x if x < y else y

        def put(at: int, key: int) -> None:
            k = size + at
            tree[k] = key
            k >>= 1
            while k:
                x, y = tree[2 * k], tree[2 * k + 1]
                low = x if x < y else y
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        def pair(i: int) -> int:
            middle = end[i]
            if middle >= n:
                return none
            rank = get(piece[i : end[middle]])
            return none if rank is None else rank << shift | i

        mask = (1 << shift) - 1
        while tree[1] != none:
            i = tree[1] & mask
            j = end[i]
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, pieces: list[str]) -> list[int]:
        """The ids of a text's pre-tokens."""
        out: list[int] = []
        kept = self.kept
        for piece in pieces:
            ids = kept.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                ids = self.encode_piece(raw)
                if len(raw) <= KEPT_BYTES:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> tuple[SegmentTreeBpe, object]:
    """The encoder of a rank file (a base64 token and its rank in each line) and the compiled pre-token pattern."""
    import base64

    import regex

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return SegmentTreeBpe(ranks), regex.compile(pattern)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    """The pre-token pattern of the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encode(path: str | None, name: str, pattern: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pre = load(path or tokenizer_path(name), pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [bpe.encode(pre.findall(t)) if t else [] for t in texts]
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            if counts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["doc_id", "tokens"])
                continue
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in ids)]), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return run


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.tiktoken", path: str | None = None, counts: bool = False) -> DataFrame:
    """``doc_id bigint`` with ``ids array<int>``, or with ``tokens int`` if only ``counts`` are wanted.

    ``tokenizer`` names a rank file of the installed public tokenizers; ``path`` gives another place of such a file.
    Text that looks like a special token is ordinary text and no special token is added. Empty and null texts give an
    empty list (0 tokens); a null key stays null; repeated rows are each encoded; an empty table gives no rows; other
    columns are dropped. Texts are encoded in whole, each by one task; the work of a text of n characters is O(n log n).
    """
    pattern = default_pattern()
    columns = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return columns.mapInArrow(_encode(path, tokenizer, pattern, counts), "doc_id bigint, tokens int" if counts else "doc_id bigint, ids array<int>")
