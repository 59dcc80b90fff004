"""Token ids of whole texts by a public tokenizer, with distinct words encoded once for each worker."""

from __future__ import annotations

import gc
import os
import re

import numpy as np
import pyarrow as pa

from morphotab.llm import text as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 2
TOGETHER = 256
SLICE_BYTES = 6 << 20  # text encoded in one step; the more, the fewer its distinct pieces to the byte
CACHE = 400_000  # pieces in each of the two generations that a worker remembers; some 200 bytes each
#: The same two for jobs that also hold ids or follow others in one worker.
SMALL_SLICE_BYTES, SMALL_CACHE = SLICE_BYTES // 4, CACHE // 4
#: Blanks and controls that libraries take for white space or not; texts with any of them are encoded in one piece.
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
#: Bytes with which such characters begin; texts without any need no look at their characters.
_MAYBE_ODD = np.zeros(256, bool)
_MAYBE_ODD[[*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \n\t\r")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?%&*#$|")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_encoders: dict[tuple[str, bool, int], Encoder] = {}


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of the letters A-Z, a-z and of Latin-1, two bytes each in UTF-8."""
    out = _LETTER[data]
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs for times and divided by
        out[lead] = out[lead + 1] = True
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in rows of UTF-8 text: a word with the blanks before it, or blanks at a row's end.

    A word that is letters up to a punctuation mark is cut before the mark.
    """
    blank = _BLANK[data]
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    letter = _letters(data)
    other = np.flatnonzero(~(letter | blank))
    if len(other):
        own = np.cumsum(first, dtype=np.int32)[other]
        change = np.ones(len(own), bool)
        change[1:] = own[1:] != own[:-1]
        other = other[change]  # the first byte of a piece that is neither letter nor blank
        cut = other[_MARK[data[other]] & ~first[other]]
        first[cut[letter[cut - 1]]] = True
    return np.flatnonzero(first)


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    Pre-tokenizers never join what stands before a blank with the blank, nor letters with punctuation behind them, so a
    text's ids are those of its pieces: words, with the blanks before them unless the tokenizer drops blanks. The distinct
    pieces of a slice are found by Arrow's dictionary encoding, without a string for each word. Those that
    the worker has not met lately are encoded some together, as one text, and told apart by the lengths of their tokens or by
    the mark that a token at a word's end carries.
    """

    def __init__(self, path: str, blanks: bool, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.blanks, self.cache = blanks, cache
        vocabulary = self.plain.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level token has a character for each byte
            self.sizes[i] = len(token) if blanks else token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that can stand side by side."""
        groups = [pieces[at : at + TOGETHER] for at in range(0, len(pieces), TOGETHER)]
        out: list[bytes] = []
        for group, e in zip(groups, self.plain.encode_batch_fast([("" if self.blanks else " ").join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([len(p.encode()) for p in group]) if self.blanks else np.arange(1, len(group) + 1)
            cuts = np.searchsorted(ends, wanted)
            if len(ids) and ends[-1] == wanted[-1] and (ends[cuts] == wanted).all():
                raw, cuts = ids.tobytes(), [0, *(4 * cuts + 4).tolist()]
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:
                out += self._each(group)
        return out

    def _learn(self, wanted: set[str]) -> None:
        again = wanted & self.older.keys()
        self.known.update((p, self.older[p]) for p in again)
        rest = wanted - again
        easy = [p for p in rest if (p[0] in " \n\t\r" and p[-1] not in " \n\t\r" if self.blanks else _PLAIN(p))]
        self.known.update(zip(easy, self._together(easy), strict=True))
        hard = list(rest.difference(easy))
        self.known.update(zip(hard, self._each(hard), strict=True))

    def _regular(self, column: pa.Array) -> list[bytes]:
        """Ids of texts that can be cut into pieces."""
        data, offsets = T.utf8(column)
        starts = pieces(data, offsets)
        if not self.blanks:
            kept = ~_BLANK[data]
            before = np.concatenate(([0], np.cumsum(kept)))
            data, offsets, starts = data[kept], before[offsets], before[starts]
            starts = starts[np.append(starts[1:], len(data)) > starts]
        spans = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        ids = list(map(self.known.get, distinct))
        holes = [k for k, i in enumerate(ids) if i is None]
        self._learn({distinct[k] for k in holes})
        for k in holes:
            ids[k] = self.known[distinct[k]]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, place = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        size, place = size[which], place[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = flat[np.repeat(place - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        rows = (4 * ends[np.searchsorted(starts, offsets)]).tolist()
        return [raw[a:b] for a, b in zip(rows, rows[1:], strict=False)]

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string array without nulls."""
        if len(self.known) > self.cache:
            self.known, self.older = {}, self.known
        data, offsets = T.utf8(column)
        maybe = np.unique(np.searchsorted(offsets, np.flatnonzero(_MAYBE_ODD[data]), "right") - 1)
        texts = {k: column[k].as_py() for k in maybe.tolist()}
        odd = [k for k, t in texts.items() if _ODD.search(t)]
        if not odd:
            return self._regular(column)
        regular = np.ones(len(column), bool)
        regular[odd] = False
        out: list[bytes] = [b""] * len(column)
        for k, ids in zip(odd, self._each([texts[k] for k in odd]), strict=True):
            out[k] = ids
        for k, ids in zip(np.flatnonzero(regular).tolist(), self._regular(column.filter(pa.array(regular))), strict=True):
            out[k] = ids
        return out


def encoder(path: str, blanks: bool, cache: int = CACHE) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    key = path, blanks, cache
    if key not in _encoders:
        gc.disable()  # millions of strings are kept here, and no cycles
        _encoders[key] = Encoder(path, blanks, cache)
    return _encoders[key]
