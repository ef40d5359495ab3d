"""Encoding distinct runs of pre-tokens once with the tokenizers library.

Byte-level BPE splits a text into pre-tokens before it merges, and no merge
crosses a pre-token. A single space between two characters that are not white
space always begins a pre-token, so a text may be cut there (cut). The units so
cut are runs of whole pre-tokens, and their ids do not depend on what stands
around them. A text with other runs of white space is cut at the same places by
a regular expression instead of str.split.

An Encoder cuts UTF-8 bytes at more such places (begins), looks all units of a block
up in a table of arrays, and asks the library for those that are not there.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_ODD = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Longest unit, in bytes, and most ids of a unit that the table holds.
UNIT, IDS = 15, 8
#: Places of the table, and how many of them a unit may take.
SLOTS, WAYS = 1 << 20, 4
#: Bytes of whole texts that are cut at once, and units that are looked up at once.
BLOCK, AT_ONCE = 1 << 19, 1 << 16

# kinds of bytes: those from _Q on are certainly not white space
_W, _SPACE, _LINE, _Q, _LETTER, _DIGIT, _MARK, _OTHER = range(8)
#: Letters that are letters in any version of Unicode; so are both bytes of C3 to C9, D0 and D1, less those of two signs.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ\u0400-\u047f"
#: What is one pre-token by itself.
_ONE = re.compile(rf"\n| ?(?:[{_LETTERS}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)")


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[[*range(9, 14), *range(28, 32)]] = _W
    kinds[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
    kinds[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA), 0xD0, 0xD1]] = _LETTER
    kinds[range(48, 58)] = _DIGIT
    kinds[[10, 32, 39]] = _LINE, _SPACE, _Q
    return kinds


def _rules() -> np.ndarray:
    """For the kinds of three bytes: 1 if a unit begins at the second, plus 2 if one begins at the third."""
    pairs = {(_LETTER, _DIGIT), (_LETTER, _MARK), (_LETTER, _Q), (_DIGIT, _LETTER), (_DIGIT, _MARK), (_DIGIT, _Q), (_MARK, _LETTER), (_MARK, _DIGIT)}
    rules = np.zeros((8, 8, 8), np.uint8)
    for a, b in pairs:
        rules[a, b] = 1
    rules[_Q:, _SPACE, _Q:] = 1
    rules[_Q:, _LINE, _Q:] = 3
    return rules.reshape(-1)


def _alphabet() -> dict[int, str]:
    """The public alphabet of byte-level BPE: printable bytes stand for themselves, others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


_KINDS, _RULES, _ALPHABET = _kinds(), _rules(), _alphabet()
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def cut(text: str) -> list[str]:
    """Chunks of a text; each but the first stands for itself with a space before it."""
    if text[:1].isspace() or text[-1:].isspace() or _ODD.search(text):
        return _CUT.split(text)
    return text.split(" ")


def library(path: str):
    """The tokenizers library's tokenizer of a file, if texts may be cut as here."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if not splits_by_bytes(tokenizer):
        raise ValueError(f"{path} is no byte-level BPE with the usual word pattern")
    return tokenizer


def begins(raw: np.ndarray) -> np.ndarray:
    """Where a unit certainly begins in UTF-8 bytes: no pre-token reaches over these places.

    These are: single spaces and line feeds between other characters, the end of such a
    line feed, and borders of letters, digits and marks, but not after an apostrophe (it
    may begin a pre-token such as 's). Characters not known here, and white space beyond
    ASCII, only ever keep bytes together.
    """
    kinds = np.zeros(len(raw) + 4, np.uint8)  # one before, three after
    kinds[1 : len(raw) + 1] = _KINDS[raw]
    if len(raw) and raw.max() >= 0x80:
        wide = np.concatenate([raw, np.zeros(3, np.uint8)])
        at = np.flatnonzero((raw >= 0xC3) & (raw <= 0xD1) & (kinds[1 : len(raw) + 1] == _LETTER))
        kinds[at + 2] = _LETTER
        at = at[(wide[at] == 0xC3) & ((wide[at + 1] == 0x97) | (wide[at + 1] == 0xB7))]
        kinds[at + 1] = kinds[at + 2] = _OTHER
        at = np.flatnonzero((raw == 0xC2) | (raw >= 0xE1) & (raw <= 0xE3))
        a, b, c = wide[at], wide[at + 1], wide[at + 2]
        at2 = at[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        general = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81) & (c == 0x9F))
        at3 = at[general | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)]
        for i in (at2 + 1, at2 + 2, at3 + 1, at3 + 2, at3 + 3):
            kinds[i] = _W
    code = kinds[: len(raw)].astype(np.uint16) << 6
    code |= kinds[1 : len(raw) + 1].astype(np.uint16) << 3
    code |= kinds[2 : len(raw) + 2]
    rule = _RULES[code]
    out = (rule & 1).view(bool)
    out[1:] |= rule[:-1] > 1
    return out


class Table:
    """ids of short units, in arrays of a fixed size; a new unit may take the place of another.

    A unit is two integers: its first eight bytes, and the others with its length in
    the highest byte; so units are compared whole, and a hash only says where they lie.
    """

    def __init__(self, kind: type) -> None:
        self.first, self.second = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.n, self.ids = np.zeros(SLOTS, np.uint8), np.zeros((SLOTS, IDS), kind)
        self.turn = 0

    @staticmethod
    def slots(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(SLOTS - WAYS)).view(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place of each unit, or -1."""
        at = self.slots(h)
        out = np.where((self.first[at] == first) & (self.second[at] == second), at, -1)
        left = np.flatnonzero(out < 0)
        for way in range(1, WAYS):
            here = at[left] + way
            same = (self.first[here] == first[left]) & (self.second[here] == second[left])
            out[left[same]] = here[same]
            left = left[~same]
        return out

    def put(self, first: np.ndarray, second: np.ndarray, h: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Distinct units that are not in the table, to free places or else in turn."""
        left, at = np.arange(len(h)), self.slots(h)
        self.turn += 1
        for way in [*range(WAYS), None]:
            here = at[left] + (self.turn % WAYS if way is None else way)
            place, one = np.unique(here, return_index=True)
            if way is not None:
                free = self.second[place] == 0
                place, one = place[free], one[free]
            new = left[one]
            self.first[place], self.second[place], self.n[place], self.ids[place] = first[new], second[new], n[new], ids[new]
            left = np.delete(left, one)


class Encoder:
    """ids of texts by the tokenizers library, which is asked for units that are not remembered."""

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # what is asked here is asked once: its own memory of words only costs
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        most = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.none = 0xFFFF if most < 0xFFFF else 0xFFFFFFFF
        self.table = Table(np.uint16 if most < 0xFFFF else np.uint32)
        self.known = common.Memory(common.MEMORY_BYTES // 8)

    def asked(self, units: list[bytes]) -> list[list[int]]:
        """ids of units by the library; those of one pre-token go to its model at once."""
        texts = [x.decode() for x in units]
        one = [_ONE.fullmatch(t) is not None and not any(a in x for a in self.added) for t, x in zip(texts, units, strict=True)]
        whole = iter(self.tokenizer.encode_batch_fast([t for t, o in zip(texts, one, strict=True) if not o], add_special_tokens=False))
        spelt = b"".join(x for x, o in zip(units, one, strict=True) if o).decode("latin-1").translate(_ALPHABET)  # a character for each byte
        out, start, tokenize = [], 0, self.model.tokenize
        for x, o in zip(units, one, strict=True):
            if o:
                end = start + len(x)
                out.append([t.id for t in tokenize(spelt[start:end])])
                start = end
            else:
                out.append(next(whole).ids)
        return out

    def learn(self, units: list[bytes]) -> list[list[int]]:
        """ids of distinct units that the table does not hold; those that it cannot hold are remembered here."""
        known: dict[bytes, bytes] = {}
        self.known.take(set(units), known)
        made = {k: np.frombuffer(v, "<u4").tolist() for k, v in known.items()}
        new = [x for x in units if x not in made]
        made |= (fresh := dict(zip(new, self.asked(new), strict=True)))
        self.known.put_all({k: np.array(v, "<u4").tobytes() for k, v in fresh.items() if len(k) <= 256 and (len(k) > UNIT or len(v) > IDS)})
        return [made[x] for x in units]

    def units(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all units, and the number of each; data goes on for 16 bytes after them."""
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        first = words[starts] & _MASKS[np.minimum(sizes, 8)]
        second = words[starts + 8] & _MASKS[np.clip(sizes - 8, 0, 8)]
        large = sizes > UNIT
        second[large] = 0
        second |= np.minimum(sizes, UNIT + 1).astype(np.uint64) << np.uint64(56)
        h = common.mix64(first * np.uint64(0x9E3779B97F4A7C15) + second)
        at = self.table.find(first, second, h)
        n, ids = self.table.n[at].astype(np.int64), self.table.ids[at]

        missed = np.flatnonzero((at < 0) & ~large)
        _, one, which = np.unique(h[missed], return_index=True, return_inverse=True)
        one = missed[one]
        same = (first[missed] == first[one][which]) & (second[missed] == second[one][which])
        large[missed[~same]] = True  # another unit with the same hash
        missed, which = missed[same], which[same]
        found = self.learn([data[i : i + j] for i, j in zip(starts[one].tolist(), sizes[one].tolist(), strict=True)])
        made = np.array([len(x) for x in found], np.int64)
        fits = made <= IDS
        rows = np.full((len(one), IDS), self.none, ids.dtype)
        rows[(np.arange(IDS) < made[:, None]) & fits[:, None]] = [*chain.from_iterable(x for x in found if len(x) <= IDS)]
        self.table.put(first[one[fits]], second[one[fits]], h[one[fits]], made[fits], rows[fits])
        n[missed], ids[missed] = made[which], rows[which]

        over = ~fits[which]
        others = {i: found[k] for i, k in zip(missed[over].tolist(), which[over].tolist(), strict=True)}
        at_large = np.flatnonzero(large)
        named = [data[i : i + j] for i, j in zip(starts[at_large].tolist(), sizes[at_large].tolist(), strict=True)]
        distinct = list(dict.fromkeys(named))
        got = dict(zip(distinct, self.learn(distinct), strict=True))
        others |= {i: got[x] for i, x in zip(at_large.tolist(), named, strict=True)}
        n[at_large], ids[at_large] = [len(got[x]) for x in named], self.none
        values = ids[ids != self.none].astype(np.uint32)
        if not others:
            return values, n
        held = np.ones(len(n), bool)
        held[list(others)] = False
        held = np.repeat(held, n)
        out = np.empty(len(held), np.uint32)
        out[held] = values
        out[~held] = [*chain.from_iterable(others[i] for i in sorted(others))]
        return out, n

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and the number of each, from their UTF-8 bytes and the offsets of texts in them."""
        values, counts, i = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while i < len(offsets) - 1:
            j = max(int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1, i + 1)
            part, ends = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            data = part.tobytes() + bytes(16)
            begin = begins(part)
            for token in self.added:  # the library looks for these before anything else
                at = data.find(token)
                while at >= 0:
                    begin[at + 1 : at + len(token)] = False
                    at = data.find(token, at + 1)
            begin[ends[ends < len(part)]] = True
            starts = np.flatnonzero(begin)
            sizes = np.diff(starts, append=len(part))
            numbers = [np.zeros(1, np.int64)]
            for k in range(0, len(starts), AT_ONCE):
                got, n = self.units(data, starts[k : k + AT_ONCE], sizes[k : k + AT_ONCE])
                values.append(got)
                numbers.append(n)
            before = np.cumsum(np.concatenate(numbers))
            counts.append(np.diff(before[np.searchsorted(starts, ends)]))
            i = j
        return np.concatenate(values), np.concatenate(counts)


def splits_by_bytes(tokenizer) -> bool:
    import json

    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"] for t in spec.get("added_tokens", []))
    return spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file; workers outlive tasks."""
    return common.worker_keeps(("tokens", path), lambda: Encoder(path))
