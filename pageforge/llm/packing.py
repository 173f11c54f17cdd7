"""Hierarchical multi-length packing of token ids.

Documents are tokenised and packed where they are read: each task packs its own
rows with bounded state, so nothing is shuffled and no group can grow. A
document's whole windows are cut off first; what is left is routed to the
smallest context tier that holds it. Tiers are packed from the longest down: a
piece opens a window of its tier, the gap is filled with pieces of shorter
tiers that fit whole, and the last bit with a cut of one more piece, so that
windows come out exactly full. What is left at a task's end is cut at powers of
two, which need no padding.

Sequences of a tier form step groups of equal token budget; inside a group each
goes to the lane with the least attention work so far.

Defined results: a null or empty text is the end id alone; repeated rows are
packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

TOKENIZER = "byte_bpe_50k.json"
TIERS = (1024, 512, 256, 128)
STEP_TOKENS, LANES = 65_536, 8
END_ID = 0
# Tokens that wait for a better fit before a task packs them, and remembered pieces of text.
WAITING, REMEMBERED = 65_536, 150_000
# Fixed value: how byte-level BPE files of this family cut texts into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = (
    "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, tier long, step_group long, lane int"
)


def byte_bpe(path: str):
    """A fast encoder with the vocabulary of a byte-level BPE file of ``tokenizers``; it gives the same ids.

    In such a file ids follow the order of merges, so they serve as merge ranks.
    Bytes stand in it as printable characters: visible Latin-1 as themselves,
    the others in order from code point 256 on.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Ids:
    """Ids of texts as little-endian bytes, remembered per piece of text.

    A single space between two other characters always begins a new piece, so
    the parts between such spaces are encoded once each and joined.
    """

    def __init__(self, path: str):
        self.encoder = byte_bpe(path)
        self.lengths = np.array([len(self.encoder.decode_single_token_bytes(i)) for i in range(self.encoder.n_vocab)])
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, allowed_special="all"), "<u4")

    def of(self, text: str) -> bytes:
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return self._encode(text).tobytes()
        first, *rest = text.split(" ")
        got = list(map(self.known.get, rest))
        fresh = [i for i, g in enumerate(got) if g is None]
        if fresh:
            # All new parts in one call; where a part ends is seen from the tokens' lengths in bytes.
            parts = [rest[i] for i in fresh]
            ids = self._encode(" " + " ".join(parts))
            ends = np.cumsum([len(p.encode()) + 1 for p in parts])
            cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1).tolist()
            raw, at = ids.tobytes(), 0
            for i, p, to in zip(fresh, parts, cuts):
                got[i], at = raw[4 * at : 4 * to], to
                if len(self.known) < REMEMBERED:
                    self.known[p] = got[i]
        return self._encode(first).tobytes() + b"".join(got)


class Packer:
    """Windows of one task. A piece is (doc_id, doc_tokens, start, ids)."""

    def __init__(self, partition: int, tiers=TIERS):
        self.tiers, self.partition = tiers, partition
        self.pools = {t: deque() for t in tiers}
        self.waiting, self.sequences = 0, 0
        self.steps: dict[int, list] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, window = len(ids) // 4, self.tiers[0]
        for start in range(0, n - n % window, window):
            self._emit([(doc_id, n, start, ids[4 * start : 4 * (start + window)])])
        if n % window:
            self._route((doc_id, n, n - n % window, ids[4 * (n - n % window) :]))

    def _route(self, piece) -> None:
        n = len(piece[3]) // 4
        self.pools[min(t for t in self.tiers if t >= n)].append(piece)
        self.waiting += n

    def _emit(self, pieces: list) -> None:
        total = sum(len(p[3]) for p in pieces) // 4
        tier = 1 << (total - 1).bit_length()
        group, used, work = self.steps.get(tier, (0, 0, [0] * LANES))
        lane = work.index(min(work))
        work[lane] += sum((len(p[3]) // 4) ** 2 for p in pieces)
        step = (self.partition << 40) | (tier.bit_length() << 32) | group
        self.steps[tier] = (group, used + tier, work) if used + tier < STEP_TOKENS else (group + 1, 0, [0] * LANES)
        offset, sequence = 0, (self.partition << 40) | self.sequences
        self.sequences += 1
        for doc_id, n, start, ids in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, zlib.crc32(ids), n, sequence, offset, total, tier, step, lane))
            offset += length

    def _take(self, pool: deque, room: int):
        """The pool's next piece, or as much of it as there is room for; the rest is routed anew."""
        doc_id, n, start, ids = pool.popleft()
        self.waiting -= len(ids) // 4
        if len(ids) // 4 > room:
            self._route((doc_id, n, start + room, ids[4 * room :]))
            ids = ids[: 4 * room]
        return doc_id, n, start, ids

    def pack(self, keep: int) -> None:
        """Fill windows, longest tier first, while more than ``keep`` tokens wait."""
        for tier in self.tiers:
            while self.pools[tier] and self.waiting > max(keep, tier):
                window, room = [self._take(self.pools[tier], tier)], tier
                room -= len(window[0][3]) // 4
                while room:
                    fits = next((self.pools[t] for t in self.tiers if self.pools[t] and len(self.pools[t][0][3]) // 4 <= room), None)
                    pool = fits or next(self.pools[t] for t in reversed(self.tiers) if self.pools[t])
                    window.append(self._take(pool, room))
                    room -= len(window[-1][3]) // 4
                self._emit(window)

    def finish(self) -> None:
        """Pack everything; the last tokens become sequences of powers of two."""
        self.pack(0)
        rest = deque(p for t in self.tiers for p in self.pools[t])
        left = sum(len(p[3]) for p in rest) // 4
        while left:
            room = min(1 << (left.bit_length() - 1), self.tiers[0])
            left, window = left - room, []
            while room:
                doc_id, n, start, ids = rest.popleft()
                if len(ids) // 4 > room:
                    rest.appendleft((doc_id, n, start + room, ids[4 * room :]))
                    ids = ids[: 4 * room]
                window.append((doc_id, n, start, ids))
                room -= len(ids) // 4
            self._emit(window)


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece; ``tokenizer`` is the path of the tokenizer's file on every executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ids, packer = Ids(tokenizer), Packer(TaskContext.get().partitionId())

        def out():
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = list(zip(*packer.rows)) if packer.rows else [[]] * len(names)
            packer.rows = []
            kinds = [key_type] + [pa.int64()] * 9 + [pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        key_type = pa.int64()
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            key_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 256):
                for key, text in zip(keys[at : at + 256], batch.column(1).slice(at, 256)):
                    packer.add(key, ids.of(text.as_py() or "") + end)
                packer.pack(WAITING)
                if len(packer.rows) > 20_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(kind))
