"""Whole texts as token ids of a public byte-level BPE vocabulary.

The pieces that the vocabulary's split pattern cuts are deduplicated within a partition. New ones are encoded
together over a pair occurrence index: every adjacent pair of symbols is mapped to all its positions in the
pieces, the active ranks are taken in ascending order, all positions of the pair are merged, and the lists
of the pairs to the left and right are updated. Ids are then looked up piece by piece; no shuffle.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; files are named as in its README.
TOKENIZERS = os.environ.get("LODEWORKS_TOKENIZERS", "/opt/tokenizers")
#: The split pattern of the byte-level vocabularies. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept in a task's memory; beyond that the table of known pieces is started anew.
KEPT_PIECES = 400_000
#: Code points encoded in one round over a pair index.
ROUND_BYTES = 4_000_000


def encode_pieces(pieces: Iterable[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of every piece, all encoded together over one pair occurrence index.

    Symbols of all pieces lie in one array with links to their neighbours; a piece never links to the next.
    Equal pairs of one rank are merged from left to right, as byte pair encoding demands.
    """
    symbol: list[bytes] = []
    left: list[int] = []
    right: list[int] = []
    heads: list[int] = []
    for piece in pieces:
        start = len(symbol)
        heads.append(start if piece else -1)
        n = len(piece)
        symbol += [piece[i : i + 1] for i in range(n)]
        left += range(start - 1, start + n - 1)
        right += range(start + 1, start + n + 1)
        if n:
            left[start] = right[-1] = -1
    places: dict[int, list[int]] = {}
    get = ranks.get
    for i, r in enumerate(right):
        if r >= 0 and (rank := get(symbol[i] + symbol[r])) is not None:
            places.setdefault(rank, []).append(i)
    active = list(places)
    heapq.heapify(active)
    alive = bytearray(b"\1") * len(symbol)
    while active:
        rank = heapq.heappop(active)
        held = places.pop(rank, None)
        if held is None:
            continue
        held.sort()
        for i in held:
            r = right[i]
            if not alive[i] or r < 0 or get(whole := symbol[i] + symbol[r]) != rank:
                continue
            symbol[i], alive[r] = whole, 0
            after = right[r]
            right[i] = after
            if after >= 0:
                left[after] = i
                if (new := get(whole + symbol[after])) is not None:
                    if new not in places:
                        places[new] = []
                        heapq.heappush(active, new)
                    places[new].append(i)
            before = left[i]
            if before >= 0 and (new := get(symbol[before] + whole)) is not None:
                if new not in places:
                    places[new] = []
                    heapq.heappush(active, new)
                places[new].append(before)
    out = []
    for at in heads:
        ids = []
        while at >= 0:
            ids.append(ranks[symbol[at]])
            at = right[at]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts by one vocabulary, keeping the pieces it has met."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def _learn(self, pieces: Iterable[str]) -> None:
        new = list(pieces)
        direct = [p for p in new if p.encode() in self.ranks]
        self.known.update((p, [self.ranks[p.encode()]]) for p in direct)
        held, size = [], 0
        for p in new:
            if p not in self.known:
                held.append(p)
                size += len(p)
                if size > ROUND_BYTES:
                    self.known.update(zip(held, encode_pieces((x.encode() for x in held), self.ranks), strict=True))
                    held, size = [], 0
        if held:
            self.known.update(zip(held, encode_pieces((x.encode() for x in held), self.ranks), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give an empty list. Special tokens' strings are plain text."""
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        cut = [self.find(t) if t else [] for t in texts]
        self._learn({p for pieces in cut for p in pieces if p not in self.known})
        known = self.known
        return [[i for p in pieces for i in known[p]] for pieces in cut]


@lru_cache(2)
def encoder(name: str, folder: str = TOKENIZERS) -> Encoder:
    """One encoder a process."""
    return Encoder(f"{folder}/{name}.tiktoken")


def _slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row. Whole texts of any length; null and empty texts give an empty list."""
    kind = documents.schema[key].dataType.simpleString()
    schema = pa.schema([(key, pa.int64() if kind == "bigint" else pa.string()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, folder)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids = own.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).cast(schema.field(0).type), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    source = documents.select(key if kind == "bigint" else documents[key].cast("string").alias(key), text)
    return source.mapInArrow(encode, f"{key} {'bigint' if kind == 'bigint' else 'string'}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; ids never leave the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, folder)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = [len(ids) for a, b in _slices(texts) for ids in own.encode_batch(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32())], names=[*keep, "n_tokens"])

    chosen = documents.select(*keep, documents[text].alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)
    return chosen.mapInArrow(count, f"{kinds}, n_tokens int")
