"""Block-wise encoding with the ``tokenizers`` library and a cache of text units.

Texts are cut into units at places where the tokenizer always cuts, so that a
text's ids are the ids of its units one after another.  Each new unit goes
through the library once per worker; later occurrences are array look-ups.

``byte`` mode (byte-level BPE): cuts before a blank or line break that follows a
visible character, and before a punctuation mark that follows an ASCII letter.  ``word`` mode (white space is dropped): cuts at ASCII white
space and before such a mark.

Special tokens written out in a text become their one id, as in a plain call of the
library; no cut falls inside them.
"""

from __future__ import annotations

from operator import itemgetter

import numpy as np

from .textarrays import BYTE_VALUES, CHAR_START, IS_SPACE, prefix_hashes, runs, span_hashes

CACHE_UNITS = 3_000_000  # then the cache starts anew: about 100 MB
JOINED = 512  # new units that go through the library as one text
_encoders: dict[tuple[str, str], "UnitEncoder"] = {}

_ASCII_VISIBLE = np.zeros(256, bool)
_ASCII_VISIBLE[0x21:0x7F] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[*b",.;:!?()"]] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_LEADS_2 = np.zeros(256, bool)
_LEADS_2[0xC3:0xE0] = True  # no white space among these two-byte characters
_LEADS_3 = np.zeros(256, bool)
_LEADS_3[[0xE0, *range(0xE4, 0xF0)]] = True  # nor among these of three bytes


def unit_encoder(path: str, mode: str) -> "UnitEncoder":
    """One encoder for each worker process and vocabulary file."""
    key = (path, mode)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(path, mode)
    return _encoders[key]


class UnitEncoder:
    def __init__(self, path: str, mode: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if mode not in ("byte", "word"):
            raise ValueError(f"unknown mode {mode!r}")
        self.mode = mode
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # byte mode: a token's text has a character for each byte
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token.encode()) if token in special else len(token)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.mode == "word":
            starts, ends, _ = runs(~IS_SPACE[data], offsets)
            cuts = np.flatnonzero(_STOPS[data[1:]] & _LETTERS[data[:-1]]) + 1
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
            return starts, ends, np.searchsorted(starts, offsets)
        n = len(data)
        visible = np.zeros(n + 1, bool)  # of the character that ends before each place
        if n:
            visible[1:] = _ASCII_VISIBLE[data]
            tail = _CONTINUES[data]
            visible[2:] |= tail[1:] & _LEADS_2[data[:-1]]
            visible[3:] |= tail[2:] & tail[1:-1] & _LEADS_3[data[:-2]]
        cut = ((data == 0x20) | (data == 0x0A)) & visible[:-1]
        cut[1:] |= _STOPS[data[1:]] & _LETTERS[data[:-1]]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        self.regular_end = visible
        return starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, and how many each text has."""
        starts, ends, first = self.units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        hashes = span_hashes(prefix_hashes(BYTE_VALUES[data]), starts, ends)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_UNITS:
            self.reset()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == distinct
        if not known.all():
            new = index[~known]
            self._learn(distinct[~known], place[~known], data, starts[new], ends[new])
            place = np.searchsorted(self.keys, distinct)
        at, size = self.at[place][inverse], self.size[place][inverse]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[first[1:]] - total[first[:-1]]

    def _learn(self, keys: np.ndarray, place: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if self.mode == "word":
            regular = np.ones(len(starts), bool)
        else:
            regular = ((data[starts] == 0x20) | (data[starts] == 0x0A)) & self.regular_end[ends]
        order = np.concatenate([np.flatnonzero(regular), np.flatnonzero(~regular)])
        n = int(regular.sum())
        size, found = np.zeros(len(order), np.int64), []
        for lo in range(0, n, JOINED):
            part = order[lo : min(n, lo + JOINED)]
            size[part] = self._joined(data, starts[part], ends[part], found)
        rest = order[n:]
        texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[rest].tolist(), ends[rest].tolist())]
        for i, got in zip(rest.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            found.append(np.array(got.ids, np.uint32))
            size[i] = len(found[-1])
        need = self.used + int(size.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need - len(self.pool), len(self.pool)), np.uint32)])
        at = np.zeros(len(order), np.int64)
        at[order] = self.used + np.cumsum(size[order]) - size[order]
        self.pool[self.used : need] = np.concatenate(found)
        self.used = need
        self.keys, self.at, self.size = (np.insert(old, place, x) for old, x in ((self.keys, keys), (self.at, at), (self.size, size)))

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        """Encodes units as one text; how many ids each has."""
        gap = 1 if self.mode == "word" else 0
        length = ends - starts
        to = np.cumsum(length + gap) - (length + gap)
        text = np.full(int(to[-1] + length[-1]), 0x20, np.uint8)
        text[np.repeat(to, length) + _ramp(length)] = data[np.repeat(starts, length) + _ramp(length)]
        if self.mode == "byte":  # tokens keep all bytes, so their lengths give their places
            ids = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
            size = self.token_bytes[ids]
            ends = np.cumsum(size)
            if ends[-1] != len(text):
                raise ValueError("the tokenizer does not keep all bytes")
            found.append(ids)
            return np.diff(np.searchsorted(ends - size, np.append(to, len(text))))
        chars = np.cumsum(CHAR_START[text])
        begin = chars[to] - 1
        got = self.tokenizer.encode_batch([text.tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0]
        found.append(np.array(got.ids, np.uint32))
        token_at = np.fromiter(map(itemgetter(0), got.offsets), np.int64, len(found[-1]))
        return np.diff(np.searchsorted(token_at, np.append(begin, chars[-1])))


def _ramp(length: np.ndarray) -> np.ndarray:
    """0..n-1 for each n."""
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
