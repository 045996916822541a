"""Exact byte-level BPE encoding of whole texts with the tokenizers library, with a bounded cache of encoded pieces.

The pre-tokenizer of byte-level BPE never lets a token run from a non-space character into the white space after it, nor from
the letters at a word's beginning into an ASCII mark or digit after them, so a text may be cut there and each piece encoded
alone. Pieces are found, hashed and looked up in whole arrays; the library sees a piece once, as long as the cache holds it.
Pieces are told apart by 64 hashed bits (a million of them share any with a probability of 3e-8). Texts that hold a special
token's string, or a wide space (near which a cut would not be safe), go to the library whole.

What is held at once is a slice of the texts and the cache, both bounded in bytes.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import xxhash

from psephos.llm.common import BYTE_VALUES, mix, powers

UNSAFE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Most pieces and ids that the cache holds (20 and 4 bytes each).
CACHE_PIECES = 1 << 20
CACHE_IDS = 4 << 20
#: Pieces that the table of new ones takes before it is merged with the rest.
RECENT = 1 << 15
#: Bytes of text that are cut into pieces at once.
SLICE = 1 << 18
#: Longest piece that is hashed by array arithmetic.
SHORT = 64
#: Ends a segment; no byte of UTF-8.
STOP = 0xFF

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LATIN = np.zeros(256, bool)  # second bytes of the letters from U+00C0 to U+00FF
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def byte_characters() -> dict[int, str]:
    """How byte-level BPE writes each byte: printable Latin-1 characters stand for themselves, the rest follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def segments(data: bytes) -> list[bytes]:
    """The text in parts of at most a slice, cut before white space; a longer part has no white space to cut at."""
    out, at = [], 0
    while len(data) - at > SLICE:
        end = max(data.rfind(b" ", at + 1, at + SLICE), data.rfind(b"\n", at + 1, at + SLICE))
        while end > at and _BLANK[data[end - 1]]:
            end -= 1
        if end <= at:
            found = [k for c in (b" ", b"\n") if (k := data.find(c, at + SLICE)) >= 0]
            end = min(found, default=len(data))
            while end < len(data) and _BLANK[data[end - 1]]:  # in the middle of white space
                end += 1
        out.append(data[at:end])
        at = end
    out.append(data[at:])
    return out


def piece_starts(raw: np.ndarray) -> np.ndarray:
    """Where the pieces of a slice begin; segments in it end with STOP, which is a piece of its own."""
    blank, stop = _BLANK[raw], raw == STOP
    letter = _LETTER[raw]
    letter[1:] |= (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
    first = np.ones(len(raw), bool)  # first byte of a segment or after white space
    first[1:] = blank[:-1] | stop[:-1]
    mark = stop.copy()
    mark[0] = True
    mark[1:] |= stop[:-1] | (blank[1:] & ~blank[:-1])
    words = np.flatnonzero(first & letter)
    if len(words):
        ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1  # raw ends with STOP, so each run has an end
        ends = ends[np.searchsorted(ends, words, side="right")]
        after = raw[ends]
        mark[ends[(after < 0x80) & ~_BLANK[after]]] = True
    return np.flatnonzero(mark)


class PieceCache:
    """Ids of pieces by hash, as sorted arrays of bounded size; emptied when full. New pieces go to a small table first."""

    def __init__(self) -> None:
        self.begin, self.size = np.empty(CACHE_PIECES, np.int32), np.empty(CACHE_PIECES, np.int32)
        self.ids = np.empty(CACHE_IDS, np.uint32)
        self.clear()

    def clear(self) -> None:
        none = (np.empty(0, np.uint64), np.empty(0, np.int32))
        self.tables = [none, none]
        self.pieces = self.filled = 0

    def make_room(self, pieces: int, ids: int) -> None:
        """Empty the cache if it cannot take so many more pieces and ids."""
        if self.pieces + pieces > CACHE_PIECES or self.filled + ids > CACHE_IDS:
            self.clear()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of sorted keys, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        for known, slots in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                np.copyto(out, slots[at], where=known[at] == keys)
        return out

    def add(self, keys: np.ndarray, values: list[list[int]]) -> None:
        """Take in sorted keys that are not there yet."""
        to, flat = self.pieces + len(keys), [i for v in values for i in v]
        sizes = np.fromiter(map(len, values), np.int32, len(values))
        self.size[self.pieces : to] = sizes
        self.begin[self.pieces : to] = self.filled + np.cumsum(sizes) - sizes
        self.ids[self.filled : self.filled + len(flat)] = flat
        large, (known, slots) = self.tables
        at = np.searchsorted(known, keys)
        small = np.insert(known, at, keys), np.insert(slots, at, np.arange(self.pieces, to, dtype=np.int32))
        if len(small[0]) > RECENT:
            known, slots = (np.concatenate(x) for x in zip(large, small, strict=True))
            order = np.argsort(known, kind="stable")
            self.tables = [(known[order], slots[order]), (known[:0], slots[:0])]
        else:
            self.tables = [large, small]
        self.pieces, self.filled = to, self.filled + len(flat)


class WordBpe:
    """Encodes texts to ids."""

    def __init__(self, path: str, specials_are_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = specials_are_text
        added = [] if specials_are_text else [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.bytes = byte_characters()
        self.tokenize = self.model.model.tokenize if self.plain() else None
        self.cache = PieceCache()

    def plain(self) -> bool:
        """Whether a run of letters is one pre-token that goes to the model as its bytes."""
        import json

        spec = json.loads(self.model.to_str())
        pre = spec["pre_tokenizer"] or {}
        return spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre.get("add_prefix_space", True)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        text = raw.decode()
        word = text[1:] if text[0] == " " else text
        if self.tokenize and word.isalpha() and len(text) < SHORT:  # a single pre-token
            if word.isascii():
                return [t.id for t in self.tokenize(self.bytes[32] + word if word is not text else word)]
            if len(raw) < 2 * len(text) and max(word) < "\u0100":
                return [t.id for t in self.tokenize(raw.decode("latin-1").translate(self.bytes))]
        return self.model.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0
        for k, t in enumerate(texts):
            if UNSAFE.search(t) or (self.special and self.special.search(t)):
                out[k].append(self.whole(t))
                continue
            for part in segments(t.encode()):
                if held and size + len(part) > SLICE:
                    self._slice(held, out)
                    held, size = [], 0
                if len(part) > SLICE:
                    out[k].append(self.whole(part.decode()))
                else:
                    held.append((k, part))
                    size += len(part)
        if held:
            self._slice(held, out)
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in out]

    def _slice(self, held: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
        """Encode segments and hand each one's ids to its text."""
        data = b"".join(x for _, part in held for x in (part, b"\xff"))
        raw = np.frombuffer(data, dtype=np.uint8)
        start = piece_starts(raw)
        end = np.append(start[1:], len(raw))
        up, down = powers(len(raw))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], dtype=np.uint64)])
            key = mix((total[end] - total[start]) * down[start])
        for k in np.flatnonzero(end - start > SHORT).tolist():
            key[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]])
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        keys = ordered[new]
        self.cache.make_room(len(keys), len(raw))
        slots = self.cache.find(keys)
        if len(missing := np.flatnonzero(slots < 0)):
            one = order[new][missing]
            self.cache.add(keys[missing], [[] if raw[a] == STOP else self.piece(data[a:b]) for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
            slots = self.cache.find(keys)
        slot = np.empty(len(key), np.int32)
        slot[order] = slots[np.cumsum(new) - 1]
        sizes = self.cache.size[slot]
        ends = np.cumsum(sizes)
        ids = self.cache.ids[np.repeat(self.cache.begin[slot] - ends + sizes, sizes) + np.arange(int(ends[-1]))]
        cuts = ends[np.flatnonzero(raw[start] == STOP)]
        for (k, _), part in zip(held, np.split(ids, cuts[:-1]), strict=True):
            out[k].append(part)


@lru_cache(maxsize=4)
def word_bpe(path: str, specials_are_text: bool = False) -> WordBpe:
    """One encoder for a worker process."""
    return WordBpe(path, specials_are_text)
