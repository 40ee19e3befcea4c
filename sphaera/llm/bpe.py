"""Byte-level BPE as a monoid: halves are encoded alone and joined at their border.

Two levels use the same scheme.

*Matches.*  A text is cut into blocks, every block is split by the tokenizer's pattern, and neighbours are joined: the
last matches of the left block that could still change are dropped and the pattern runs on from there until one of its
matches starts where a match of the right block starts.  The pattern looks ahead but never behind, so everything after
that point is the right block's own result.

*Merges inside one match.*  A long match is halved down to leaves that are merged directly.  To join two token lists,
a window of tokens around the border is re-encoded and grown until the pairs (token before the window, first token of
the window) and (last token of the window, token after it) are each left alone by the merge rules.  A token list whose
neighbouring pairs are all stable is the canonical encoding, so the tokens outside the window are final.

Nulls are empty texts; an empty text has no tokens.  Rows are treated one by one: repeated rows and repeated or null ids
come through as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sphaera.llm.common import doc_texts

LEAF_BYTES = 32
LEAF_CHARS = 8192
#: Characters that a match of the pattern may need to see beyond its own end.
LOOKAHEAD = 3
CACHED_PIECES = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.by_id[i] = token
        self.decimal = [str(i) for i in range(len(self.by_id))]
        self._stable: dict[tuple[bytes, bytes], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    # merges inside one match

    def merge(self, piece: bytes) -> list[bytes]:
        """The direct merge: always the pair of least rank, the leftmost of equals."""
        if len(piece) > 2 * LEAF_BYTES:
            return self._merge_by_heap(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        pair = [rank(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pair:
            least = min(pair)
            if least == 1 << 60:
                break
            i = pair.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = rank(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pair[i - 1] = rank(parts[i - 1] + parts[i], 1 << 60)
        return parts

    def _merge_by_heap(self, piece: bytes) -> list[bytes]:
        n, rank = len(piece), self.ranks.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = after[i]
        return out

    def stable(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > CACHED_PIECES:
                self._stable.clear()
            known = self._stable[key] = self.merge(a + b) == [a, b]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right:
            return left or right
        i, j, step_l, step_r = len(left) - 1, 1, 1, 1
        while True:
            window = self.merge(b"".join(left[i:] + right[:j]))
            fits_l = i == 0 or self.stable(left[i - 1], window[0])
            fits_r = j == len(right) or self.stable(window[-1], right[j])
            if fits_l and fits_r:
                return left[:i] + window + right[j:]
            if not fits_l:
                i, step_l = max(0, i - step_l), 2 * step_l
            if not fits_r:
                j, step_r = min(len(right), j + step_r), 2 * step_r

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        known = self._pieces.get(piece)
        if known is None:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            known = (whole,) if whole is not None else tuple(self.ranks[t] for t in self.tree(raw))
            if len(raw) <= 64:
                if len(self._pieces) > CACHED_PIECES:
                    self._pieces.clear()
                self._pieces[piece] = known
        return known

    # matches of the pattern

    def split(self, text: str, lo: int = 0, hi: int | None = None) -> list[str]:
        hi = len(text) if hi is None else hi
        if hi - lo <= LEAF_CHARS:
            return self.pattern.findall(text, lo, hi)
        mid = (lo + hi) // 2
        left, right = self.split(text, lo, mid), self.split(text, mid, hi)
        at = mid
        while left and at > mid - LOOKAHEAD:
            at -= len(left.pop())
        k, start = 0, mid
        for m in self.pattern.finditer(text, at, hi):
            while start < m.start() and k < len(right):
                start += len(right[k])
                k += 1
            if start == m.start():
                return left + right[k:]
            left.append(m[0])
        return left

    def encode(self, text: str) -> list[int]:
        known = self._pieces.get
        return list(chain.from_iterable([known(p) or self.piece_ids(p) for p in self.split(text)]))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up a tree: runs of tokens at the leaves, neighbours joined level by level."""
        token = self.by_id
        level = [b"".join([token[i] for i in ids[k : k + 4096]]) for k in range(0, len(ids), 4096)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str) -> TreeBpe:
    return TreeBpe(load_ranks(path), pattern)


OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and the chosen outputs.

    ids are the token ids, decoded the bytes that these ids give back; the digests are taken of just those two values.
    """
    schema = "doc_id long, " + ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        arrow = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in outputs}
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                decoded = codec.decode(ids) if "decoded" in cols or "decoded_sha256" in cols else b""
                for c in outputs:
                    if c == "ids":
                        cols[c].append(ids)
                    elif c == "n_tokens":
                        cols[c].append(len(ids))
                    elif c == "ids_sha256":
                        cols[c].append(hashlib.sha256(",".join([codec.decimal[i] for i in ids]).encode()).hexdigest())
                    elif c == "decoded":
                        cols[c].append(decoded)
                    else:
                        cols[c].append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[c], arrow[c]) for c in outputs)], names=["doc_id", *outputs])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, schema)
