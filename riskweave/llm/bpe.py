"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap.

The pairs of a pre-token wait in one bucket per merge rank, each bucket a heap of positions in a
linked list of tokens. A bitmap of 256 groups of 256 ranks, the lowest at its top, says which buckets
hold anything: the last set bit of the group map and then of the group, which is a number's length, is the
next rank. A merge leaves entries behind whose pair has changed; they are skipped when they come up. So a pre-token of n bytes takes
about n log n steps, also one of a million letters.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import short_batches

#: Pre-tokens of which a worker starts to forget, and the longest that it remembers. The most
#: are twice as many, of about 250 bytes each.
REMEMBERED, LONGEST = 250_000, 64
#: Characters of text whose ids make one Arrow batch.
BATCH_CHARS = 4 << 20
BIT = [1 << i for i in range(256)]
#: The slot of rank 0: a lower rank has a higher slot, so that the next one is a bitmap's length.
SLOTS = 65535


class BytePairs:
    """The merges of one rank file (base64 token, space, rank; ranks below 65,536 are the ids)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(self.ranks.values()) >= 65536:
            raise ValueError("ranks must be below 65,536")
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self.slots = {
            left << 16 | right: SLOTS - rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        }
        self.byte_slots = [self.slots.get(left << 16 | right, -1) for left in self.single for right in self.single]
        self.find = regex.compile(pattern).findall
        self.groups, self.known, self.old = [0] * 256, {}, {}

    @staticmethod
    def add(buckets: dict, slot: int, position: int) -> None:
        """One more position in a slot that holds some."""
        held = buckets[slot]
        if type(held) is int:
            buckets[slot] = [held, position] if held < position else [position, held]
        else:
            heappush(held, position)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: lowest rank first, leftmost first among equals."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pair_slot, bit, groups = self.slots.get, BIT, self.groups
        ids = [*map(self.single.__getitem__, piece)]
        size = len(ids)
        byte_slot = self.byte_slots
        slot_at = [byte_slot[left << 8 | right] for left, right in zip(piece, piece[1:])]
        # The rank queue: positions by slot, slots with positions by group, groups with slots. A position alone
        # in its slot stands there as a number, further ones make a heap.
        buckets, top = {}, 0
        for i, slot in enumerate(slot_at):
            if slot >= 0:
                if slot in buckets:
                    held = buckets[slot]
                    if type(held) is int:
                        buckets[slot] = [held, i]
                    else:
                        held.append(i)
                else:
                    buckets[slot] = i
                    group = slot >> 8
                    groups[group] |= bit[slot & 255]
                    top |= bit[group]
        if not top:
            return ids
        # The slot of the pair that starts at a position tells a stale entry; no pair is -1.
        slot_at.append(-1)
        after, before = [*range(1, size + 1)], [*range(-1, size - 1)]
        while top:
            group = top.bit_length() - 1
            bits = groups[group]
            low = bits.bit_length() - 1
            slot = group << 8 | low
            i = buckets[slot]
            if type(i) is int:
                del buckets[slot]
                groups[group] = bits = bits ^ bit[low]
                if not bits:
                    top ^= bit[group]
            elif len(i) > 1:
                i = heappop(i)
            else:
                buckets[slot] = i[0]
                continue
            if slot_at[i] != slot:
                continue  # stale
            j = after[i]
            ids[i] = rank = SLOTS - slot
            ids[j] = slot_at[j] = -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                slot_at[i] = found = pair_slot(rank << 16 | ids[k], -1)
                if found >= 0:
                    if found in buckets:
                        self.add(buckets, found, i)
                    else:
                        buckets[found] = i
                        group = found >> 8
                        groups[group] |= bit[found & 255]
                        top |= bit[group]
            else:
                slot_at[i] = -1
            h = before[i]
            if h >= 0:
                slot_at[h] = found = pair_slot(ids[h] << 16 | rank, -1)
                if found >= 0:
                    if found in buckets:
                        self.add(buckets, found, h)
                    else:
                        buckets[found] = h
                        group = found >> 8
                        groups[group] |= bit[found & 255]
                        top |= bit[group]
        return [t for t in ids if t >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers, one after another."""
        known, pieces = self.known, self.find(text)
        new = set(pieces).difference(known)
        if not new:
            return b"".join(map(known.__getitem__, pieces))
        if len(known) > REMEMBERED:
            # What is not met again while as many new ones come is forgotten.
            self.old, self.known = known, {}
            known, new = self.known, set(pieces)
        long, old = {}, self.old
        for piece in new:
            if piece in old:
                known[piece] = old[piece]
                continue
            ids = array("i", self.merge(piece.encode())).tobytes()
            (known if len(piece) <= LONGEST else long)[piece] = ids
        if long:
            return b"".join([known[p] if p in known else long[p] for p in pieces])
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One per worker, so that what it remembers serves all its tasks."""
    return BytePairs(path, pattern)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _id_batch(docs: list, encoded: list[bytes]) -> pa.RecordBatch:
    offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32))
    ids = pa.ListArray.from_arrays(pa.array(offsets), values)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), ids], schema=_IDS)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text; other columns are not read.

    Each match of ``pattern`` is encoded by itself and nothing is read as a special token. A null
    or empty text has no ids; a repeated row comes out again; an empty table gives an empty one.
    ``path`` must be readable on the executors. Rows keep their partition; there is no shuffle.
    """

    def run(batches):
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            docs, done, chars = [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                docs.append(batch.column(0)[i].as_py())
                done.append(pairs.encode(text))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield _id_batch(docs, done)
                    docs, done, chars = [], [], 0
            if docs:
                yield _id_batch(docs, done)

    short_batches()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the bytes that the ids stand for; null ids are none."""
    schema = pa.schema([*_IDS, ("decoded", pa.binary())])

    def run(batches):
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.int32()))
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for start in range(0, batch.num_rows, 512):
                stop = min(start + 512, batch.num_rows)
                decoded = [pairs.decode(values[offsets[i] : offsets[i + 1]].tolist()) for i in range(start, stop)]
                columns = [batch.column(0).slice(start, 512), lists.slice(start, 512), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` of the ids in one pass over the texts: ``doc_id``, ``ids``, ``decoded``."""
    schema = pa.schema([*_IDS, ("decoded", pa.binary())])

    def run(batches):
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start = chars = 0
            done = []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                done.append(pairs.encode(text))
                chars += len(text)
                if chars >= BATCH_CHARS or i + 1 == batch.num_rows:
                    ids = _id_batch(keys.slice(start, len(done)).to_pylist(), done)
                    decoded = [pairs.decode(np.frombuffer(d, dtype=np.int32).tolist()) for d in done]
                    yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(decoded, pa.binary())], schema=schema)
                    start, chars, done = i + 1, 0, []

    short_batches()
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per document: number of ids, digest of the ids as decimals joined by commas, digest of the
    decoded bytes; with ``keep_ids`` the ids as well."""
    return round_trip(docs, path, pattern).select(
        "doc_id",
        *["ids"] * keep_ids,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
