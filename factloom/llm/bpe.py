"""Encoding of texts with a public byte-level vocabulary (problem 6).

A text is split by the vocabulary's pattern; a piece's bytes are merged, always the leftmost pair of least rank first. The
least rank over all byte positions stands at the root of a segment tree; a merge changes the pairs of at most
three live positions, each by a point update up the tree, so a piece of n bytes takes O(n log n) steps however long
it is. Pieces repeat, so a worker remembers those of up to 64 bytes, up to a fixed number.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, and the file of byte_bpe_50k as ranks.
FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: The pattern that splits text before merges: a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of texts. remembered: most pieces kept; remembered_bytes: longest of them."""

    def __init__(self, ranks_file: bytes, pattern: str = PATTERN, remembered: int = 300_000, remembered_bytes: int = 64) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern)
        self.memory: dict[str, tuple[int, ...]] = {}
        self.remembered, self.remembered_bytes = remembered, remembered_bytes

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        n, ranks, longest = len(piece), self.ranks, self.longest
        if n == 1:
            return (ranks[piece],)
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        get = ranks.get
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(i: int, end: int) -> None:
            """The pair that begins at live position i and ends before `end` (0: no pair)."""
            r = get(piece[i:end]) if end and end - i <= longest else None
            at = size + i
            v = none if r is None else r * size + i
            if tree[at] == v:
                return
            tree[at] = v
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                v = a if a < b else b
                if tree[at] == v:
                    break
                tree[at] = v
                at >>= 1

        while (top := tree[1]) != none:
            i = top & (size - 1)
            j = after[i]
            k = after[j]
            after[i] = k
            put(j, 0)
            if k < n:
                before[k] = i
                put(i, after[k])
            else:
                put(i, 0)
            if i:
                h = before[i]
                put(h, k)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty and a null text give an empty list."""
        ids: list[int] = []
        if not text:
            return ids
        memory = self.memory
        for piece in self.split.findall(text):
            got = memory.get(piece)
            if got is None:
                raw = piece.encode("utf-8", "surrogatepass")
                got = self.merge(raw)
                if len(raw) <= self.remembered_bytes:
                    if len(memory) >= self.remembered:
                        memory.clear()
                    memory[piece] = got
            ids += got
        return ids


_encoders: dict[tuple, Encoder] = {}


def encoder(ranks_file: bytes, pattern: str = PATTERN) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    key = (hash(ranks_file), len(ranks_file), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks_file, pattern)
    return _encoders[key]


def token_ids(documents: DataFrame, text: str = "text", key: str = "doc_id", path: str = f"{FOLDER}/{RANKS}", pattern: str = PATTERN) -> DataFrame:
    """(key, ids array<int>), one row for each row of `documents`.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list. The file of
    ranks (under 1 MB, of fixed size) is read once by the driver and sent to the workers."""
    with open(path, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [e.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
