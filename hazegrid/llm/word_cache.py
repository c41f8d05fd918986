"""Byte-level BPE through the tokenizers library, with the ids of repeated words kept.

A text is cut where a character that no engine takes for white space meets a plain blank or line break. No match of a
byte-level split pattern holds both, and white space never looks back, so the pieces can be encoded one by one. The
same holds between an ASCII letter and a following mark other than the apostrophe, and between a single line break and
a letter. The pieces of a batch are found and numbered in Arrow; only new ones go to the library.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

#: Longest piece that is kept, and how many are kept before the cache starts anew.
LONGEST, KEPT = 48, 500_000
#: Pieces that are given to the library at once, with a special token between them.
JOINED = 128
_BLANK = np.isin(np.arange(256), list(b" \n\r\t"))
#: Last bytes of characters that are surely no white space: printable ASCII, and what no blank beyond ASCII ends with.
_SOLID = ((np.arange(256) > 32) & (np.arange(256) < 127)) | ((np.arange(256) > 127) & ~np.isin(np.arange(256), [0x85, 0xA0, *range(0x80, 0x8B), 0x9F, 0xA8, 0xA9, 0xAF]))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_MARK = np.isin(np.arange(256), list(b".,;:!?()[]{}\"/-"))
_BREAK = np.isin(np.arange(256), list(b"\n\r\t"))


def cut(texts: Sequence[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The pieces of all texts in order, and how many stand before each text and after the last."""
    whole = pa.array(texts, pa.large_string())
    _, offsets, data = whole.buffers()
    until = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[: until[-1]] if data is not None else np.zeros(0, np.uint8)
    first = np.zeros(len(raw) + 1, bool)
    solid, letter = _SOLID[raw], _LETTER[raw]
    first[1:-1] = (_BLANK[raw[1:]] & solid[:-1]) | (_MARK[raw[1:]] & letter[:-1])
    first[2:-1] |= letter[2:] & _BREAK[raw[1:-1]] & solid[:-2]
    first[until] = True
    starts = np.flatnonzero(first)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), data])
    return pieces, np.searchsorted(starts, until)


class ByteBpe:
    """Encoder of one tokenizer file, given as bytes. Ids are returned as little-endian 32-bit numbers.

    With ``plain_specials`` the strings of special tokens are ordinary text.
    """

    def __init__(self, file: bytes, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = plain_specials
        self.plain_specials = plain_specials
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        # the library cuts at special tokens before it does anything else
        marks = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = min(marks, default=(-1, ""))
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part, encoded for itself."""
        found = self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _ids_joined(self, parts: list[bytes]) -> list[bytes]:
        """As :meth:`_ids`, for parts without special tokens: many to a call, with one between them."""
        mark = self.mark.encode()
        joined = [mark.join(parts[i : i + JOINED]).decode() for i in range(0, len(parts), JOINED)]
        self.tokenizer.encode_special_tokens = False
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        self.tokenizer.encode_special_tokens = self.plain_specials
        flat = np.fromiter(chain.from_iterable(chain(e.ids, (self.mark_id,)) for e in found), "<u4")
        raw, ends = flat.tobytes(), (4 * np.flatnonzero(flat == self.mark_id)).tolist()
        return [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends, strict=False)]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        pieces, before = cut(texts)
        numbered = pieces.dictionary_encode()
        words = numbered.dictionary.to_pylist()
        if len(self.cache) > KEPT:
            # frequent words are among those at hand
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        new = [w for w in words if w not in self.cache]
        if self.mark and not any(t in text for t in self.added for text in texts):
            self.cache.update(zip(new, self._ids_joined(new), strict=True))
        else:
            self.cache.update(zip(new, self._ids(new), strict=True))
        ids = list(map(self.cache.__getitem__, words))
        for w in new:
            if len(w) > LONGEST:
                del self.cache[w]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = numbered.indices.to_numpy()
        n = size[which]
        ends = np.append(0, np.cumsum(n))
        first = (np.cumsum(size) - size)[which]
        flat = np.frombuffer(b"".join(ids), "<u4")[np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)]
        stops = ends[before]
        return [flat[a:b].tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id, read from the byte-level alphabet of the vocabulary; ids without an entry are empty."""
        printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        others = [b for b in range(256) if b not in set(printable)]
        alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        return out


_ENCODERS: dict[tuple[str, bool], ByteBpe] = {}


def encoder(name: str, file: bytes, plain_specials: bool = False) -> ByteBpe:
    """The encoder of this Python worker for a file with the given ``name``."""
    key = (name, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpe(file, plain_specials)
    return _ENCODERS[key]
