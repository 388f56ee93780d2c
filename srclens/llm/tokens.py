"""Token ids of whole texts; each distinct piece of text is encoded once per worker.

A text is cut at ASCII white space, and plain words further at changes between
letters, digits and other characters, where this tokenizer's own pattern cuts as
well.  Words with an apostrophe, a ``<`` (special tokens) or characters beyond
Latin-1 letters stay whole, since contractions, special tokens and canonical
composition may reach across such a cut.
"""

from __future__ import annotations

import numpy as np

from srclens.llm.common import BLANK, groups, prefix_sums, substrings

VOCABULARY = "word_bpe_49k.json"
MOST_KEPT = 600_000  # pieces a worker remembers before it starts anew

_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[BLANK] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = _LETTER
_KIND[ord("0"):ord("9") + 1] = _DIGIT
_LATIN = np.zeros(256, bool)  # second bytes of the letters U+00C0 to U+00FF
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False  # the signs for times and division
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that can be encoded alone."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    kind = _KIND[data]
    blank = kind == 0
    first = ~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1])
    last = ~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    cut = first | (~blank & (kind == _DIGIT))
    cut[1:] |= ~blank[1:] & (kind[1:] != kind[:-1])
    hard = (data == ord("'")) | (data == ord("<"))
    if (data >= 128).any():
        pair = np.zeros(n, bool)
        pair[:-1] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
        easy = pair.copy()
        easy[1:] |= pair[:-1]
        hard |= (data >= 128) & ~easy
    if hard.any() and len(starts):
        whole = np.unique(np.searchsorted(starts, np.flatnonzero(hard), "right") - 1)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, starts[whole] + 1, 1)
        np.add.at(step, ends[whole], -1)
        cut &= np.cumsum(step[:-1]) == 0
    at = np.flatnonzero(cut)
    word = np.searchsorted(starts, at, "right") - 1
    stop = ends[word]
    stop[:-1] = np.minimum(stop[:-1], at[1:])
    return at, stop


class Encoder:
    """A tokenizer with a memory of the pieces it has encoded."""

    def __init__(self, file: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.places, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(flat)] = flat
        places = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.places, self.sizes = np.insert(self.places, at, places), np.insert(self.sizes, at, sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Per group of texts: (first text, ids of all its texts, bounds of each text)."""
        for a, b in groups(offsets):
            yield a, *self._encode(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = units(data, offsets)
        low = _LOWER[data]
        keys, first, which = np.unique(
            substrings(prefix_sums(low), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MOST_KEPT:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = first[~known]
            raw = low.tobytes()
            self._learn(keys[~known], [raw[s:e].decode("utf-8", "replace") for s, e in zip(
                starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.keys, keys)
        sizes, places = (self.sizes[at][which], self.places[at][which]) if len(keys) else (np.zeros(0, np.int64),) * 2
        stops = np.cumsum(sizes)
        token = np.arange(stops[-1] if len(stops) else 0) + np.repeat(places - (stops - sizes), sizes)
        bounds = np.concatenate([[0], stops])[np.searchsorted(starts, offsets)]
        return self.ids[token], bounds


_encoders: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY) -> Encoder:
    """The worker's encoder for a vocabulary of the installed public tokenizers, or a file."""
    import os

    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _encoders[name]
