"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece of text encoded once a task.

A text is cut where the pre-tokenizer cuts in any case, so the ids of the pieces, one after another, are the ids of the
text: before a space that follows or precedes a visible character, around a single line feed between visible
characters, and between an ASCII letter, digit or Latin-1 letter and ASCII punctuation other than the apostrophe. Doubtful
places (other white space, apostrophes, other scripts) are not cut.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd

from .textops import _LOWER, U64, span_hashes

#: Pieces that a worker remembers in each of two generations: when the young one is full, it becomes the old one, and pieces
#: that are met again move on to the next young one. So frequent pieces stay and rare ones are forgotten.
REMEMBERED = 400_000
#: Bytes of text that are best encoded at once: a piece is looked up once for all its occurrences there.
ENCODED = 4 << 20

#: What a byte may be, in one table: a visible ASCII character; the first byte of one that is surely no white space; an ASCII
#: letter or digit; punctuation but the apostrophe; a space; a line feed; 0xC3; after that, the second byte of a letter.
VISIBLE, LEAD, ALNUM, PUNCTUATION, SPACE, FEED, C3, LATIN = (1 << i for i in range(8))
_BITS = np.zeros(256, np.uint8)
_BITS[0x21:0x7F] |= VISIBLE | LEAD | PUNCTUATION
_BITS[0xC3:0xE0] |= LEAD
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BITS[_a:_b] ^= ALNUM | PUNCTUATION
_BITS[ord("'")] ^= PUNCTUATION
_BITS[32] |= SPACE
_BITS[10] |= FEED
_BITS[0xC3] |= C3
_BITS[0x80:0xC0] |= LATIN
_BITS[[0x97, 0xB7]] ^= LATIN
#: ASCII without white space, and runs of visible ASCII.
_SOLID, _RUNS = re.compile(r"[\x00-\x08\x0e-\x1b!-\x7f]+"), re.compile("[!-~]+")


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces; each ends where the next one starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    one = np.zeros(n + 3, np.uint8)  # one[i + 2] is of data[i]; zeros around stand for "no character"
    here = one[2 : n + 2]
    here[:] = _BITS[data]
    back, back2, ahead = one[1 : n + 1].copy(), one[0:n].copy(), one[3 : n + 3].copy()
    back[first[:n]] = 0
    back2[first[:n]] = 0
    inner = offsets[(offsets > 0) & (offsets < n)]
    back2[np.minimum(inner + 1, n - 1)] = 0
    ahead[inner - 1] = 0

    def some(x: np.ndarray, flag: int) -> np.ndarray:
        return (x & np.uint8(flag)) != 0

    at = some(here, SPACE) & (some(back, VISIBLE) | some(ahead, LEAD))
    at |= some(here, FEED) & some(back, VISIBLE)
    at |= some(back, FEED) & some(back2, VISIBLE) & some(here, LEAD)
    at |= some(here, PUNCTUATION) & (some(back, ALNUM) | (some(back2, C3) & some(back, LATIN)))
    return np.flatnonzero(at | first[:n])


class Generation:
    """Pieces by their hash (never 0), in a table of open places, with their ids one after another."""

    def __init__(self):
        self.bits, self.n, self.used = 14, 0, 0
        self.hashes, self.slots = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
        self.ids, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def _put(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        at, last = (hashes >> U64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(hashes):
            free = self.hashes[at] == 0
            self.hashes[at[free]] = hashes[free]
            won = free & (self.hashes[at] == hashes)
            self.slots[at[won]] = slots[won]
            hashes, slots, at = hashes[~won], slots[~won], (at[~won] + 1) & last

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """``hashes``: different ones that are not known yet."""
        n = self.n
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(hashes) + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(hashes)] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.n += len(hashes)
        if 2 * self.n > 1 << self.bits:
            held = self.hashes != 0
            hashes_, slots = self.hashes[held], self.slots[held]
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.hashes, self.slots = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
            self._put(hashes_, slots)
        self._put(hashes, np.arange(n, self.n, dtype=np.int32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slots of the pieces; -1 for unknown ones."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        at, last = (hashes >> U64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(left):
            met = self.hashes[at]
            hit = met == hashes[left]
            out[left[hit]] = self.slots[at[hit]]
            go = ~hit & (met != 0)
            left, at = left[go], (at[go] + 1) & last
        return out

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in these slots, one after another, and how many each has."""
        start = self.starts[slots]
        length = self.starts[slots + 1] - start
        before = np.cumsum(length) - length
        return self.ids[np.repeat(start - before, length) + np.arange(length.sum())], length


def _byte_letters() -> dict[int, int]:
    """What the byte-level step makes of each byte: itself where visible, else a character from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}


#: The steps before the model for which words of Latin-1 letters can be prepared here: composed forms are kept, letters made
#: small, white space is left out, a run of letters is a word. (Some contractions begin with an apostrophe.)
_FOLDED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_LETTERS = {k: v for k, v in _byte_letters().items() if k != 32}


class Encoder:
    """``separator`` is put between pieces that are encoded together, ``mark`` is its id; pieces with a character of
    ``avoid`` (after their first, where it is a space) are encoded alone. Where the tokenizer's own steps before its model are
    those of ``_FOLDED``, ``bare`` is the model without them: words of Latin-1 letters go straight to it, and ASCII pieces that
    differ by capitals or a space before them are one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        line, zero = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("\n", "0"))
        if len(line) == 1:
            self.separator, self.mark, self.avoid = "\n", line[0], " \n\t\r\x0b\x0c"
        elif not line and len(zero) == 1:
            self.separator, self.mark, self.avoid = " 0 ", zero[0], "0"
        else:
            self.separator = None
        self.bare = None
        # what the tokenizer looks for in a text before anything else, wherever it may lie
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        steps = json.loads(self.tokenizer.to_str())
        if all(steps[k] == v for k, v in _FOLDED.items()) and self.separator == " 0 " and not any(x["content"].isalnum() for x in steps["added_tokens"]):
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        self.forget()

    def forget(self) -> None:
        self.young, self.old = Generation(), Generation()

    def _plain(self, piece: str) -> bool:
        if self.separator is None or not piece.strip():
            return False
        if self.separator == "\n":
            rest = piece[1:] if piece[0] == " " else piece
            if _SOLID.fullmatch(rest):
                return True
            left = _RUNS.sub("", rest)
            return not left or left.isalpha()
        return "0" not in piece

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.bare is not None:
            ascii_ = np.bitwise_or.reduceat(data, starts) < 0x80
            starts = starts + (ascii_ & (data[starts] == 32) & (ends > starts + 1))
            data = np.where(np.repeat(ascii_, np.diff(ends, prepend=0)), _LOWER[data], data)
        h = span_hashes(data, starts, ends)
        return h + (h == 0)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        alone: list[int] = []
        groups: list[tuple[list[int], str, bool]] = []  # pieces, what is encoded, whether by the bare model
        kinds: list[list[int]] = [[], [], []]  # ASCII words, Latin-1 words, others that are plain
        for i, t in enumerate(texts):
            word = t[1:] if t[0] == " " else t
            if self.bare is not None and word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                kinds[not word.isascii()].append(i)
            else:
                (kinds[2] if self._plain(t) else alone).append(i)
        for kind, many in enumerate(kinds):
            for low in range(0, len(many), 512):
                g = many[low : low + 512]
                if kind == 2:
                    groups.append((g, self.separator.join([texts[i] for i in g]), False))
                    continue
                joined = " 0 ".join([texts[i].lstrip(" ") for i in g]).lower()
                groups.append((g, joined.encode().decode("latin-1").translate(_LETTERS) if kind else joined, True))
        for low in range(0, len(groups), 64):
            part = groups[low : low + 64]
            encoded = {}
            for bare in (True, False):
                some = [k for k, g in enumerate(part) if g[2] == bare]
                if some:
                    encoded.update(zip(some, (self.bare if bare else self.tokenizer).encode_batch_fast([part[k][1] for k in some], add_special_tokens=False), strict=True))
            learnt, flat, lengths = [], [], []
            for k, (g, _, _) in enumerate(part):
                ids = np.array(encoded[k].ids, np.int32)
                mark = ids == self.mark
                ends = np.flatnonzero(mark)
                if len(ends) != len(g) - 1:
                    alone += g
                    continue
                learnt += g
                flat.append(ids[~mark])
                lengths.append(np.diff(ends, prepend=-1, append=len(ids)) - 1)
            if learnt:
                self.young.add(hashes[learnt], np.concatenate(flat), np.concatenate(lengths))
        if alone:
            found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False)]
            self.young.add(hashes[alone], np.concatenate(found), np.array([len(f) for f in found], np.int64))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many lie before each text. A text that holds an added token is encoded as a whole."""
        ids, first = self._by_pieces(data, offsets)
        raw = data.tobytes()
        if not any(a in raw for a in self.added):
            return ids, first
        parts = np.split(ids, first[1:-1])
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if any(raw.find(x, a, b) >= 0 for x in self.added):
                parts[i] = np.array(self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        code, unique = pd.factorize(self._hashes(data, starts, ends))
        if self.young.n > REMEMBERED:
            self.young, self.old = Generation(), self.young
        slots = self.young.find(unique)
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            before = self.old.find(unique[unknown])
            again, new = before >= 0, unknown[before < 0]
            if again.any():
                self.young.add(unique[unknown[again]], *self.old.of(before[again]))
            if len(new):
                where = np.zeros(len(unique), np.int64)
                where[code[::-1]] = np.arange(len(code))[::-1]
                raw = data.tobytes()
                spots = where[new]
                self._learn(unique[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)])
            slots[unknown] = self.young.find(unique[unknown])
        ids, length = self.young.of(slots[code])
        before = np.concatenate(([0], np.cumsum(length)))
        return ids, before[np.searchsorted(starts, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder, kept between tasks with the pieces that it knows (some 100 MB at most)."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Gives up the worker's encoder, for steps that need its memory."""
    _encoders.clear()
