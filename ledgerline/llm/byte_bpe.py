"""Byte-level BPE encoding and decoding by backtracking.

Bytes are read as Latin-1 characters, so that pyahocorasick can hold the vocabulary. For each position of
a piece the automaton gives the longest token that starts there. Encoding goes from left to right with
these; where a token can't stand beside the one before it, the next shorter prefix token is tried, and
where none is left the token before is given up. Two tokens can stand side by side when no merge across
their border would have come before the merges that made them; this is remembered by pair. Each
position is ruled out at most once, so the time is linear in the length, and the result is the one that
merging by rank gives.

Null and empty texts have no tokens (the digest of the empty string) and decode to nothing.
"""

from __future__ import annotations

import base64
import hashlib
import math
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts
from .encoding import ChunkTable, decoded


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BacktrackingBpe:
    """Exact BPE over the ranks of a vocabulary. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 500_000):
        self.ranks, self.remember = ranks, remember
        self.token = {i: t for t, i in ranks.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        reachable: dict[bytes, int] = {}
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        for word, rank in by_rank:
            if len(word) == 1:
                reachable[word] = rank
        for word, rank in by_rank:
            if len(word) == 1:
                continue
            for cut in range(len(word) - 1, 0, -1):
                a, b = reachable.get(word[:cut]), reachable.get(word[cut:])
                if a is not None and b is not None and max(self._made(a), self._made(b)) < rank and self._compatible(a, b):
                    self.left[rank], self.right[rank] = a, b
                    self.merged[a, b] = rank
                    reachable[word] = rank
                    break
        # A token that no merges lead to can only be a whole piece.
        self.automaton = ahocorasick.Automaton()
        for word, rank in reachable.items():
            self.automaton.add_word(word[::-1].decode("latin-1"), (rank, len(word)))
            self.shorter[rank] = next((reachable[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in reachable), -1)
        self.automaton.make_automaton()
        self.beside.clear()
        self.length = {rank: len(word) for word, rank in reachable.items()}

    def _made(self, token: int) -> int:
        return token if token in self.left else -1

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges inside a and b come before any merge over their border."""
        before = math.inf
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < before:
                return False
            a_parts, b_parts = a in self.right, b in self.left
            if not a_parts and not b_parts:
                return True
            # Undo the later merge; of equal ones, the left would have been made first.
            if a_parts and (not b_parts or a > b):
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]

    def can_stand(self, a: int, b: int) -> bool:
        known = self.beside.get((a, b))
        if known is None:
            if len(self.beside) > self.remember:
                self.beside.clear()
            known = self.beside[a, b] = self._compatible(a, b)
        return known

    def longest_at(self, piece: bytes) -> list[int]:
        """For each position, the longest token that starts there."""
        n = len(piece)
        longest, size = [-1] * n, [0] * n
        for end, (token, length) in self.automaton.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if length > size[at]:
                longest[at], size[at] = token, length
        return longest

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest, n = self.longest_at(piece), len(piece)
        open_ = bytearray(b"\1" * (n + 1))  # positions at which a token may end
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + self.length[token]
                if open_[end] and (not out or self.can_stand(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                last = out.pop()
                at -= self.length[last]
                token = self.shorter[last]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=4)
def loaded(path: str, pattern: str) -> tuple[BacktrackingBpe, ChunkTable, list[str]]:
    """The coder of a rank file with its chunk table, one for each worker process."""
    bpe = BacktrackingBpe(read_ranks(path))
    find = regex.compile(pattern).findall

    @lru_cache(maxsize=100_000)
    def piece(p: str) -> list[int]:
        return bpe.encode_piece(p.encode())

    def encode(chunks: list[str]) -> list[bytes]:
        return [array("I", [i for p in find(c) for i in piece(p)]).tobytes() for c in chunks]

    return bpe, ChunkTable(encode, pattern), [str(i) for i in range(max(bpe.token, default=0) + 1)]


def encode_texts(texts: list[bytes], path: str, pattern: str) -> list[np.ndarray]:
    _, table, _ = loaded(path, pattern)
    return [np.frombuffer(b, dtype="<u4") for b in table.many(decoded(texts))]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of each whole text."""
    return map_texts(docs, "ids array<int>", lambda texts: {"ids": [x.astype(np.int32) for x in encode_texts(texts, path, pattern)]})


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each whole text, decode the ids, and give the digests of both."""

    def work(texts: list[bytes]) -> dict:
        out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        step = 1_000
        for k in range(0, len(texts), step):
            some = encode_texts(texts[k : k + step], path, pattern)
            bpe, _, decimal = loaded(path, pattern)
            for ids in some:
                ids = ids.tolist()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return out

    return map_texts(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
