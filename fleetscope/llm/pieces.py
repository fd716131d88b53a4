"""Byte-level BPE by pieces: texts are cut at safe boundaries, pieces met before come from a bounded cache.

Cutting before a blank or line break that follows a character which is no white space, or
after an ASCII letter before an ASCII character that is none, changes no match of the split pattern: a text's ids are those of its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHE_BYTES, ENTRY_BYTES, KEPT_KEY

#: White space after which a blank may continue the same match.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_PIECE = re.compile(r"[ \n\r\t]*[A-Za-z]++(?![^\x00-\x7f])|[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_BLANKS = b" \n\r\t"
#: Kinds of bytes: 1 a blank, 2 an ASCII letter, 3 no ASCII, 0 the rest.
_KIND = np.repeat(np.array([0, 3], np.uint8), 128)
_KIND[list(_BLANKS)] = 1
_KIND[[c for c in range(128) if chr(c).isalpha()]] = 2
#: Bytes of pieces that are handed to a library as one text.
_JOINED = 1 << 12


def pieces(text: str) -> list[str]:
    """``text`` cut at safe boundaries; concatenating the pieces gives it back."""
    if _OTHER_SPACE.search(text) is None:
        return _PIECE.findall(text)
    # Odd white space: cut only where a plain word character stands before a blank.
    return re.split(r"(?<=[A-Za-z0-9.,;])(?=[ \n])", text)


class PieceCache:
    """Packed ids (little-endian, unsigned 32 bit) of texts, by a function from pieces to packed ids.

    Two generations: a piece met again moves to the young one; when that is full it becomes the old one.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int = CACHE_BYTES):
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def look_up(self, distinct: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces."""
        young, old = self.young, self.old
        found = list(map(young.get, distinct))
        new = [k for k, ids in enumerate(found) if ids is None]
        asked = [distinct[k] for k in new]
        known = list(map(old.get, asked))
        missing = [p for p, ids in zip(asked, known, strict=True) if ids is None]
        places = [k for k, ids in zip(new, known, strict=True) if ids is None]
        for k, ids in zip(new, known, strict=True):
            found[k] = ids
        for k, ids in zip(places, self.encode(missing) if missing else (), strict=True):
            found[k] = ids
        # What is long is in no generation.
        kept = {p: found[k] for k, p in zip(new, asked, strict=True) if len(p) <= KEPT_KEY}
        young.update(kept)
        self.size += ENTRY_BYTES * len(kept) + sum(map(len, kept)) + sum(map(len, kept.values()))
        if 2 * self.size > self.most:
            self.young, self.old, self.size = {}, young, 0
        return found

    def packed(self, texts: list[str]) -> list[bytes]:
        split = [pieces(t) for t in texts]
        distinct = list(set().union(*split))
        table = dict(zip(distinct, self.look_up(distinct), strict=True))
        return [b"".join(map(table.__getitem__, s)) for s in split]

    def of(self, texts: pa.Array, given: dict[int, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string array, one after another, and where each text ends.

        Texts are cut by the kinds of their bytes, and only distinct pieces reach Python; texts with odd
        white space go there whole. ``given`` has the packed ids of rows that are not to be encoded here.
        """
        given = given or {}
        odd = pc.match_substring_regex(texts, _OTHER_SPACE.pattern).to_numpy(zero_copy_only=False).copy()
        odd[list(given)] = True
        apart = np.flatnonzero(odd)
        # A text that is not cut here holds the place of one piece.
        cut = pc.if_else(pa.array(odd), " ", texts) if len(apart) else texts
        flat, bounds = _cut(cut)
        encoded = flat.dictionary_encode()
        known = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = [i for i in apart.tolist() if i not in given]
        own = dict(zip(whole, self.packed([texts[i].as_py() for i in whole]), strict=True)) | given
        packed = self.look_up(known) + [own[i] for i in apart.tolist()]
        place = encoded.indices.to_numpy().astype(np.int64)
        place[bounds[apart]] = len(known) + np.arange(len(apart))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids, lengths = np.frombuffer(b"".join(packed), "<u4"), sizes[place]
        ends = np.cumsum(lengths)
        at = np.repeat((np.cumsum(sizes) - sizes)[place] - ends + lengths, lengths) + np.arange(lengths.sum())
        return ids[at], np.concatenate([[0], ends])[bounds[1:]]


def _slices(array: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets of a string array's values in its buffer of bytes."""
    _, offsets, data = array.buffers()
    return np.frombuffer(offsets, np.int32, len(array) + 1, 4 * array.offset), data if data is not None else pa.py_buffer(b"")


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts without odd white space, one after another, and the number of pieces before each text and after the last."""
    if not len(texts):
        return texts, np.zeros(1, np.int64)
    offsets, data = _slices(texts)
    kind = _KIND[np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)]
    first = np.zeros(len(kind), bool)
    blank = kind == 1
    first[1:] = (blank[1:] & ~blank[:-1]) | ((kind[1:] == 0) & (kind[:-1] == 2))
    first[offsets[:-1][np.diff(offsets) > 0] - offsets[0]] = True
    starts = np.flatnonzero(first).astype(np.int32) + offsets[0]
    cuts = np.append(starts, offsets[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), data]), np.searchsorted(starts, offsets)


class JoinedEncoder:
    """Packed ids of pieces by a library that is called for many of them as one text.

    A call costs much more than a piece. Where pieces stand beside each other at a safe boundary, their ids
    follow each other, and the number of bytes of each id tells where a piece ends.
    """

    def __init__(self, whole: Callable[[list[str]], list[list[int]]], id_bytes: np.ndarray):
        self.whole, self.id_bytes = whole, id_bytes

    def __call__(self, missing: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(missing)
        strings = pa.array(missing, pa.string())
        offsets, data = _slices(strings)
        kind, full = np.append(_KIND[np.frombuffer(data, np.uint8)], 0) == 1, np.diff(offsets) > 0
        # White space before, none of any kind at the end: such pieces may follow each other.
        joins = full & kind[offsets[:-1]] & ~kind[offsets[1:] - 1]
        if _OTHER_SPACE.search("".join(missing)):
            joins &= [_OTHER_SPACE.search(p) is None for p in missing]
        rest = np.flatnonzero(~joins).tolist()
        for i, ids in zip(rest, self.whole([missing[i] for i in rest]), strict=True):
            out[i] = np.asarray(ids, "<u4").tobytes()
        plain = np.flatnonzero(joins)
        if not len(plain):
            return out
        offsets, data = _slices(strings.take(pa.array(plain)))
        groups = np.append(np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // _JOINED, prepend=-1)), len(plain))
        joined = pa.Array.from_buffers(pa.string(), len(groups) - 1, [None, pa.py_buffer(offsets[groups]), data])
        flat = np.concatenate([np.asarray(ids, "<u4") for ids in self.whole(joined.to_pylist())])
        ends = 4 * (np.searchsorted(np.cumsum(self.id_bytes[flat]), offsets[1:] - offsets[0]) + 1)
        packed, at = flat.tobytes(), 0
        for i, end in zip(plain.tolist(), ends.tolist(), strict=True):
            out[i] = packed[at:end]
            at = end
        return out
