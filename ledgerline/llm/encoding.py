"""Encoding of whole texts by chunks that are encoded once.

The pieces that a byte-level tokenizer's pattern cuts never join a character to white space that follows
it. Where every white-space character of a text stands alone and is a blank or a line feed, the text can
be cut before each blank and around each line feed, and the ids of the chunks, put together, are the
ids of the text. Any other text goes through the pattern as a whole.

Chunks repeat much more than texts: those of a group of texts are dictionary-encoded in Arrow, only the distinct ones are looked up
in a bounded table of the worker or encoded, and the ids of all texts are gathered from theirs in numpy.

A text that holds the content of a special token is encoded uncut, as that token is found before anything else.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import worker_tables

#: White space, by any reading of the word, other than the blank and the line feed.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　\0]")
#: A capital that may be one character with what follows it.
_MARKED_CAPITAL = re.compile("[A-Z][̀-\U0010ffff]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _lone_blanks(text: str) -> bool:
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text))


class ChunkTable:
    """Text -> the ids of the text as little-endian unsigned 32-bit numbers, joined.

    ``encode`` gives the ids of each of a list of chunks. ``pattern`` cuts those texts to pieces that can't
    be cut at each blank; without it, texts are put into NFC and lower case, white space has no ids, and cutting at blanks is always right.
    Texts that hold one of ``special`` are not cut.

    ``limit`` bounds the chunks remembered in each of two generations: when the young one is full it becomes the old one,
    so that chunks still in use are found there again. Chunks over ``longest`` characters are not kept.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str | None, limit: int = 300_000, longest: int = 40, special: tuple[str, ...] = ()):
        self.encode, self.limit, self.longest, self.special = encode, limit, longest, special
        self.special_low = tuple(s.lower() for s in special)
        self.pattern = regex.compile(pattern) if pattern else None
        self.separator = "\0" if pattern else " "
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def prepared(self, text: str) -> str | list[str]:
        """The text with ``separator`` where it is to be cut, or its chunks where that does not do."""
        if any(s in text for s in self.special):
            return [text]
        if self.pattern is None:
            return self._lowered(text).replace("\n", " ")
        if _lone_blanks(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        return self.pattern.findall(text)

    def _lowered(self, text: str) -> str:
        """The text with A-Z lowered, so that chunks repeat more. The file lowers them as well, but only after its NFC step, so
        a text stays as it is where a capital may be joined to a mark, or where lowering would make the content of a special token."""
        if text.isascii():
            low = text.lower()
        elif _MARKED_CAPITAL.search(text):
            return text
        else:
            low = text.encode().translate(_LOWER).decode()
        return text if any(s in low for s in self.special_low) else low

    def many(self, texts: list[str], each: int = 3_000_000) -> list[bytes]:
        """The ids of each text; texts are taken in groups of about ``each`` characters to bound memory."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= each):
                size += len(texts[j])
                j += 1
            out += self._group(texts[i:j])
            i = j
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        made = [self.prepared(t) for t in texts]
        whole = pc.split_pattern(pa.array([m for m in made if isinstance(m, str)], type=pa.large_string()), self.separator)
        lists = [m for m in made if not isinstance(m, str)]
        chunks, counts = whole.flatten(), np.diff(whole.offsets.to_numpy())
        if lists:
            chunks = pa.concat_arrays([chunks, pa.array([c for m in lists for c in m], type=pa.large_string())])
            counts = np.concatenate([counts, [len(m) for m in lists]])
        named = chunks.dictionary_encode()
        known = self._ids(named.dictionary.to_numpy(zero_copy_only=False).tolist())
        pool, length = np.frombuffer(b"".join(known), dtype="<u4"), np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        start, code = np.cumsum(length) - length, named.indices.to_numpy()
        n = length[code]
        end = np.cumsum(n)
        ids = pool[np.repeat(start[code] - (end - n), n) + np.arange(int(n.sum()))]
        # where each text ends: those that were split in Arrow come first
        ends = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]
        parts = [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        simple, other = iter(parts[: len(made) - len(lists)]), iter(parts[len(made) - len(lists) :])
        return [next(simple if isinstance(m, str) else other) for m in made]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        found = list(map(self.young.get, chunks))
        missing = [k for k, f in enumerate(found) if f is None]
        new = []
        for k in missing:
            if (before := self.old.get(chunks[k])) is None:
                new.append(k)
            else:
                found[k] = before
        for k, ids in zip(new, self._encoded([chunks[k] for k in new])):
            found[k] = ids
        self.young.update((chunks[k], found[k]) for k in missing if len(chunks[k]) <= self.longest)
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return found

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of new chunks. A full stop or comma behind a letter or digit is a piece of its own, so that the rest is encoded once
        with and without it; where NFC or lower case may leave a mark at the end of a letter, this holds for ASCII only."""
        bare = [t[:-1] if t[-1:] in (".", ",") and t[-2:-1].isalnum() and (self.pattern is not None or t[-2].isascii()) else t for t in texts]
        ids: dict[str, bytes] = {}
        for b in (*bare, ".", ","):
            if b not in ids and (known := self.young.get(b) or self.old.get(b)) is not None:
                ids[b] = known
        new = [b for b in dict.fromkeys((*bare, ".", ",")) if b not in ids]
        ids.update(zip(new, self.encode(new)))
        return [ids[b] if len(b) == len(t) else ids[b] + ids[t[-1]] for b, t in zip(bare, texts)]


_LOADED: dict[tuple[str, str | None], ChunkTable] = {}
worker_tables.kind("chunks", _LOADED.clear)


def _in_lines(encode_batch: Callable[[list[str]], list[list[int]]], separator: str, unfit: Callable[[str], bool], each: int = 500) -> Callable[[list[str]], list[bytes]]:
    """Encodes many chunks with one call for several: joined by a separator that is a piece by itself with one id of its own.

    ``unfit`` tells chunks with which the separator would not stay apart; these are encoded singly.
    """
    (mark,) = encode_batch([separator])[0]

    def encode(chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)
        fit, single = [], []
        for k, c in enumerate(chunks):
            (single if not c or unfit(c) else fit).append(k)
        groups = [fit[k : k + each] for k in range(0, len(fit), each)]
        for group, ids in zip(groups, encode_batch([separator.join([chunks[k] for k in g]) for g in groups])):
            ids = np.array(ids, dtype="<u4")
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) != len(group) - 1:  # not met so far; any chunk that breaks the rule costs time only
                single += group
                continue
            raw, edges = ids.tobytes(), [-1, *cuts.tolist(), len(ids)]
            for k, a, b in zip(group, edges, edges[1:]):
                out[k] = raw[4 * (a + 1) : 4 * b]
        for k, ids in zip(single, encode_batch([chunks[k] for k in single])):
            out[k] = np.array(ids, dtype="<u4").tobytes()
        return out

    return encode


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the bytes that can't be printed: those from 256 on, in the bytes' order."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


def _by_words(tokenizer, plain: re.Pattern, rest: Callable[[list[str]], list[bytes]]) -> Callable[[list[str]], list[bytes]]:
    """Gives chunks that are one word of plain letters to the tokenizer's model itself, as its steps before that change nothing in
    them but write bytes as letters; and the others to ``rest``."""
    model, letters = tokenizer.model, _byte_letters()

    def word(c: str) -> bytes:
        return array("I", [t.id for t in model.tokenize(c.encode().decode("latin-1").translate(letters))]).tobytes()

    def encode(chunks: list[str]) -> list[bytes]:
        out = [word(c) if plain.fullmatch(c) else None for c in chunks]
        other = [k for k, o in enumerate(out) if o is None]
        for k, ids in zip(other, rest([chunks[k] for k in other])):
            out[k] = ids
        return out

    return encode


def library_table(path: str, pattern: str | None) -> ChunkTable:
    """The chunk table of a tokenizers-library file, one for each worker process."""
    worker_tables.only("chunks")
    if (path, pattern) not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = tuple(a.content for a in t.get_added_tokens_decoder().values())

        def encode(pieces: list[str]) -> list[list[int]]:
            return [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)]

        # a line feed parts words like any white space where the pattern keeps it, a mark between blanks where white space goes
        spaced = re.compile(r"\s")
        held = lambda c: any(s in c for s in special)
        if pattern:
            apart = _in_lines(encode, "\n", lambda c: c == " " or c[0] != " " and c[0].isspace() or bool(spaced.search(c, 1)) or held(c))
            words = _by_words(t, re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"), apart)
        else:
            apart = _in_lines(encode, " ~ ", lambda c: "~" in c or held(c))
            words = _by_words(t, re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+"), apart)  # small letters that no step changes
        _LOADED[path, pattern] = ChunkTable(words, pattern, special=special)
    return _LOADED[path, pattern]


def decoded(texts: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts]


def library_ids(path: str, pattern: str | None, texts: list[bytes]) -> list[bytes]:
    """The 32-bit ids of whole texts by a tokenizers-library file; no special tokens are added, those in a text have their ids."""
    return library_table(path, pattern).many(decoded(texts))
