"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of symbols. Each merge rank has a bucket of list positions at which that
merge may be made, and a two-level bitmap over the ranks has a bit for each bucket that isn't empty. The next
merge is found by find-first-set in the top word, then in the word it names; positions in a bucket are taken from left to right,
and entries whose symbols have changed since are skipped. Every merge adds two entries at most, so a pre-token
of n bytes takes O(n log n) steps, however long it is.

Words repeat, so each worker keeps the ids of short pre-tokens, up to ``CACHE`` of them; the cache is emptied
when full and never changes a result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import held, text_bytes

CACHE = 800_000
CACHED_BYTES = 64


BITS = 8  # a word of the lower bitmap covers 2^BITS ranks; words are Python integers of any width
MASK = (1 << BITS) - 1


class ByteBpe:
    """Encodes and decodes by a rank table; ``pattern`` splits a text into the matches that are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing}")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.table = [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]  # ranks of two bytes
        self.split = regex.compile(pattern).findall
        self.cache = _Cache(self)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        The queue is written out here, as this is the inner loop: ``buckets`` has a heap of positions for each rank,
        ``low`` a bit for each bucket and ``top`` a bit for each word of ``low`` that isn't zero.
        """
        find, table = self.ranks.get, self.table
        if (whole := find(piece)) is not None:
            return [whole]
        n = len(piece)
        # by the position at which a symbol starts: its id (-1: none starts there), its end, the symbol before it, and the rank of its merge with the next one
        ids, end, before, wanted = [self.single[b] for b in piece], list(range(1, n + 1)), list(range(-1, n - 1)), []
        buckets, low, top = {}, {}, 0
        row = table[piece[0]]
        for i in range(1, n):
            b = piece[i]
            r = row[b]
            row = table[b]
            wanted.append(r)
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i - 1)  # positions rise, so the list is a heap
                else:
                    buckets[r] = [i - 1]
                    w = r >> BITS
                    low[w] = low.get(w, 0) | 1 << (r & MASK)
                    top |= 1 << w
        wanted.append(-1)
        while top:
            w = (top & -top).bit_length() - 1  # find first set
            bits = low[w]
            r = (w << BITS) + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                low[w] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if wanted[i] != r:
                continue  # stale: a neighbour has been merged since
            j = end[i]
            k = end[i] = end[j]
            ids[i], ids[j], wanted[j] = r, -1, -1
            h = before[i]
            if k < n:
                before[k] = i
                s = wanted[i] = find(piece[i : end[k]], -1)
                if s >= 0:
                    if s in buckets:
                        heappush(buckets[s], i)
                    else:
                        buckets[s] = [i]
                        w = s >> BITS
                        low[w] = low.get(w, 0) | 1 << (s & MASK)
                        top |= 1 << w
            else:
                wanted[i] = -1
            if h >= 0:
                s = wanted[h] = find(piece[h:k], -1)
                if s >= 0:
                    if s in buckets:
                        heappush(buckets[s], h)
                    else:
                        buckets[s] = [h]
                        w = s >> BITS
                        low[w] = low.get(w, 0) | 1 << (s & MASK)
                        top |= 1 << w
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.split(text))), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class _Cache(dict):
    """Pre-token to the bytes of its ids."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        found = self.bpe.merge(raw)
        ids = pack(f"<{len(found)}I", *found)
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


def loaded(path: str, pattern: str) -> ByteBpe:
    """One table for each worker process, until another operator's tasks run there."""
    return held((ByteBpe, path, pattern), lambda: ByteBpe.from_file(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again: id, ids array<int>, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the digests of no bytes. Null and repeated ids give a row for each
    row. Bytes that are no UTF-8 are read as U+FFFD. Other columns of ``docs`` are not read. ``path`` is opened by each worker, so it must exist on them all.
    ``keep_ids=False`` leaves the ids out.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for ids, texts in text_bytes(batches, "id", "raw"):
            rows, n, sha, back = [], [], [], []
            for raw in texts:
                got = bpe.encode(raw.decode(errors="replace"))
                n.append(len(got))
                sha.append(hashlib.sha256(got.tobytes()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                if keep_ids:
                    rows.append(got.astype("i4"))
            out = [ids, pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out.append(pa.array(rows, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
