"""Whole-text encoding with a public word-level BPE, over byte blocks.

The tokenizer lower-cases, drops white space and splits texts into runs of
letters, single digits, runs of other characters and the English contractions; only
then merges pieces.  So the ids of a text are those of its pieces in order.
A block is split with numpy, each distinct piece goes through the tokenizers
library once per worker, and its ids are copied to wherever it stands.  Rows with
characters outside printable ASCII and U+00C0..U+00FF, or with the marker ``<|`` of
special tokens, are encoded whole by the library.
"""

from __future__ import annotations

import functools

import numpy as np

from . import wordhash as W

#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 3_000_000

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = 0, 1, 2, 3, 4
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE


def tokenizer_file(name: str) -> str:
    """A vocabulary file by path, or by its name among the installed public ones."""
    import os
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class BlockEncoder:
    def __init__(self, name: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(tokenizer_file(name))
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces = Tokenizer.from_file(tokenizer_file(name))
        self.pieces.encode_special_tokens = True
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ids_bytes = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        # Byte-level alphabet (fixed by the vocabulary's format): printable bytes stand for themselves, others move above 0xFF.
        self.alphabet = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
        vocab = self.whole.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.store = np.zeros(1 << 16, np.int32)
        self.used, self.known = 0, 0
        self.at, self.len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        if self.known + len(pieces) > max(REMEMBERED, len(pieces)):
            self._forget()
        group = 256
        batches = [" ".join(p.decode("latin-1").translate(self.alphabet) for p in pieces[i:i + group]) for i in range(0, len(pieces), group)]
        for i, e in enumerate(self.pieces.encode_batch_fast(batches, add_special_tokens=False)):
            ids, n = np.array(e.ids, np.int32), min(group, len(pieces) - i * group)
            ends = np.append(0, np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != n + 1:  # a vocabulary without word ends
                words = self.pieces.encode_batch([batches[i]], add_special_tokens=False)[0].word_ids
                ends = np.searchsorted(np.array(words, np.int64), np.arange(n + 1))
            while self.used + len(ids) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            while self.known + n > len(self.at):
                self.at, self.len = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.len, np.zeros_like(self.len)])
            self.store[self.used:self.used + len(ids)] = ids
            self.at[self.known:self.known + n] = self.used + ends[:-1]
            self.len[self.known:self.known + n] = np.diff(ends)
            self.used += len(ids)
            self.known += n
        order = np.argsort(hashes)
        level = (hashes[order], (self.known - len(pieces) + order).astype(np.int64))
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            h, s = (np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True))
            order = np.argsort(h, kind="stable")
            level = (h[order], s[order])
        self.levels.append(level)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for h, s in self.levels:
            i = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
            hit = h[i] == hashes
            out[hit] = s[i[hit]]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the n + 1 offsets of the rows in them."""
        rows = len(offsets) - 1
        low, kind = data.copy(), _CLASS[data]
        low[(data >= 0x41) & (data <= 0x5A)] += 32
        lead = np.flatnonzero(data == 0xC3)
        if len(lead):
            lead = lead[lead + 1 < len(data)]
            tail = data[lead + 1]
            latin = (tail >= 0x80) & (tail <= 0xBF)
            lead, tail = lead[latin], tail[latin]
            sign = (tail == 0x97) | (tail == 0xB7)
            kind[lead] = kind[lead + 1] = np.where(sign, _OTHER, _LETTER)
            upper = lead[(tail <= 0x9E) & (tail != 0x97)] + 1
            low[upper] += 32
        odd = kind == _ODD
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        slow = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
        for r in slow:
            kind[offsets[r]:offsets[r + 1]] = _SPACE
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin = kind != _SPACE
        same = (kind[1:] == kind[:-1]) & (kind[1:] != _DIGIT)
        edge = np.zeros(len(data), bool)
        edge[first] = True
        begin[1:] &= ~same | edge[1:]
        self._contract(low, kind, begin, edge)
        starts = np.flatnonzero(begin)
        stop = np.append(starts[1:], len(data))
        ends = stop.copy()
        gaps = np.flatnonzero(kind == _SPACE)
        if len(gaps) and len(starts):
            g = np.searchsorted(gaps, starts)
            ends = np.minimum(stop, np.where(g < len(gaps), gaps[np.minimum(g, len(gaps) - 1)], len(data)))
        hashes = W.span_hashes(low, starts, ends)
        uniq, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self._slots(uniq)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw, a, b = low.tobytes(), starts[index[new]].tolist(), ends[index[new]].tolist()
            before = self.known
            self._learn(uniq[new], [raw[x:y] for x, y in zip(a, b, strict=True)])
            if self.known - len(new) != before:  # started anew: the known ones are to be learnt again
                return self.encode(data, offsets)
            slots = self._slots(uniq)
        slot = slots[inverse]
        lens = self.len[slot].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.store[np.repeat(self.at[slot] - total[:-1], lens) + np.arange(total[-1])]
        at = total[np.searchsorted(starts, offsets)]
        if len(slow):
            raw = data.tobytes()
            parts, done = [], 0
            extra = np.zeros(rows, np.int64)
            for r, e in zip(slow.tolist(), self.whole.encode_batch_fast([raw[offsets[r]:offsets[r + 1]].decode("utf-8") for r in slow],
                                                                        add_special_tokens=False), strict=True):
                parts += [ids[done:at[r]], np.array(e.ids, np.int32)]
                done, extra[r] = at[r], len(e.ids)
            ids = np.concatenate([*parts, ids[done:]])
            at = at + np.concatenate([[0], np.cumsum(extra)])
        return ids, at

    def _contract(self, low, kind, begin, edge) -> None:
        """A lone apostrophe takes the contraction that follows it into its piece."""
        n = len(low)
        quote = np.flatnonzero((low == 0x27) & begin)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
        if not len(quote):
            return
        one = low[quote + 1]
        second = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & (kind[second] == _LETTER) & ~edge[second], low[second], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        size[((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))] = 2
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        rest = quote + 1 + size
        rest = rest[rest < n]
        begin[rest[(kind[rest] == _LETTER) & ~edge[rest]]] = True


@functools.cache
def encoder(name: str) -> BlockEncoder:
    return BlockEncoder(name)
