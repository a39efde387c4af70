"""Fast token ids of many texts by the tokenizers library.

A byte-pair tokenizer first splits a text into words, and each word's ids
depend on that word alone. So the bytes of a batch of texts are cut, with
numpy, at places that are safe for the tokenizer's own word pattern; every
distinct chunk is encoded once by the library; and the ids of the texts are
gathered from the chunks'. Chunks are found again in a hash table of their own
bytes, compared whole, not by hash. Texts in which a cut is not provably safe,
and those that hold the string of an added token, are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowlens.llm.common import claim
from rowlens.llm.rolling import mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode white space, as the tokenizers' patterns have it, and the controls that Python counts too.
_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = rf"[ \n][{_WS}]|[{_WS}][ \n]"
#: Bounds of memory: distinct chunks that a worker keeps, and bytes of text cut at once.
MOST_CHUNKS = 1_000_000
MOST_BYTES = 1 << 20
#: Longest chunk that is kept, in bytes; with its length it fills the words of a key.
LONGEST_CHUNK, KEY_WORDS = 31, 4
#: Words of letters that are encoded as one text.
GROUP = 64
#: Texts that the library encodes at once, as what it returns is many times their size.
AT_ONCE = 512

_SPACE, _NEWLINE = 0x20, 0x0A
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_ASCII_OTHER = ~_LETTER & (np.arange(256) < 128)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class _Table:
    """Row numbers of keys of KEY_WORDS words: open addressing with linear steps, many keys at a time."""

    def __init__(self) -> None:
        self.rows = 0
        self.keys = np.zeros((1 << 15, KEY_WORDS), np.uint64)
        self.slots = np.full(1 << 16, -1, np.int32)

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        h = mix(keys[:, 0].copy())
        for j in range(1, KEY_WORDS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + keys[:, j])
        return h

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for those that have none."""
        at = self._home(h)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.keys.take(out, 0, mode="clip") != keys).any(1))
        while len(left):
            at[left] = at[left] + 1 & len(self.slots) - 1
            out[left] = found = self.slots[at[left]]
            left = left[(found >= 0) & (self.keys.take(found, 0, mode="clip") != keys[left]).any(1)]
        return out

    def add(self, keys: np.ndarray, h: np.ndarray) -> None:
        """Appends keys, all different and none known."""
        n = self.rows + len(keys)
        while n > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        self.keys[self.rows : n] = keys
        first, self.rows = self.rows, n
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (4 * n - 1).bit_length(), -1, np.int32)
            first, h = 0, self.hashes(self.keys[:n])
        row, at = np.arange(first, n, dtype=np.int32), self._home(h)
        while len(row):
            free = self.slots[at] < 0
            self.slots[at[free]] = row[free]
            lost = self.slots[at] != row
            row, at = row[lost], at[lost] + 1 & len(self.slots) - 1


class Encoder:
    """Ids of texts under one tokenizer file.

    keeps_spaces: the tokenizer is byte-level and joins a space to the word
    that follows it; otherwise it marks the ends of words, drops white space
    between them and has no capitals.
    """

    def __init__(self, path: str, keeps_spaces: bool, most_chunks: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_spaces = keeps_spaces
        self.most_chunks = most_chunks
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.mark = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token, or whether it ends a word
        for token, i in vocabulary.items():
            self.mark[i] = len(token) if keeps_spaces else token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.table = _Table()
        self.lengths = np.zeros(1 << 15, np.int64)
        self.starts = np.zeros(1 << 15, np.int64)
        self.ids = np.zeros(1 << 17, np.uint32)
        self.used = 0

    def _raw(self, texts: list[str]) -> list[list[int]]:
        parts = (texts[i : i + AT_ONCE] for i in range(0, len(texts), AT_ONCE))
        return [e.ids for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self._raw(texts)]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, each with the space before it where spaces are kept, and how many each has.

        Many of them are one text. Its ids are dealt out to them by what the
        vocabulary says: by bytes, or by the ends of words.
        """
        between = b"" if self.keeps_spaces else b" "
        flat = np.fromiter(chain.from_iterable(self._raw([between.join(words[i : i + GROUP]).decode() for i in range(0, len(words), GROUP)])), np.uint32)
        if self.keeps_spaces:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            reached = np.cumsum(self.mark[flat])
            last = np.minimum(np.searchsorted(reached, ends), len(flat) - 1)
            fits = bool((reached[last] == ends).all())
        else:
            last = np.flatnonzero(self.mark[flat])
            fits = len(last) == len(words) and last[-1] == len(flat) - 1
        if not fits:
            raise ValueError("the tokenizer does not split words as expected")
        return flat, np.diff(last, prepend=-1)

    def _listed(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._raw([c.decode() for c in chunks])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _learn(self, chunks: list[bytes], words: np.ndarray) -> None:
        """Appends what chunks have to ids; words: which are words of letters."""
        n = self.table.rows
        while n + len(chunks) > len(self.lengths):
            self.lengths, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts))
        for at, encode in ((np.flatnonzero(words), self._words), (np.flatnonzero(~words), self._listed)):
            if not len(at):
                continue
            flat, sizes = encode([chunks[i] for i in at.tolist()])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.lengths[n + at] = sizes
            self.starts[n + at] = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)

    def _chunks(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks start and end in the joined bytes of texts, of which none is empty."""
        n = len(data)
        letter, start = _LETTER[data], np.zeros(n + 1, bool)
        start[1:n] = letter[:-1] & _ASCII_OTHER[data[1:]]  # a word of letters ends at any other character
        start[bounds] = True
        if self.keeps_spaces:
            start[:n] |= data == _SPACE
            start[1:] |= data == _NEWLINE
            at = np.flatnonzero(start)
            return at[:-1], at[1:]
        solid = (data != _SPACE) & (data != _NEWLINE)
        begins = solid.copy()
        begins[1:] &= start[1:n] | ~solid[:-1]
        stops = solid.copy()
        stops[:-1] &= start[1:n] | ~solid[1:]
        return np.flatnonzero(begins), np.flatnonzero(stops) + 1

    def _cut(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        """The ids of each text; none is empty and all can be cut."""
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        start, end = self._chunks(data, bounds)
        size = end - start
        inner = start + 1 if self.keeps_spaces else start  # behind the space
        others = np.concatenate([[0], np.cumsum(~_LETTER[data], dtype=np.int32)])
        words = (others[end] == others[np.minimum(inner, end)]) & (end > inner)
        if self.keeps_spaces:
            words &= data[start] == _SPACE
        else:  # words of letters alone don't tell capitals
            high = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int32)])
            lowered = _LOWER[data]
            raw_at = np.flatnonzero(high[end] != high[start])
        room = KEY_WORDS * 8

        def load(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
            padded = np.concatenate([raw, np.zeros(room, np.uint8)])
            every = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
            keys = np.zeros((len(start), KEY_WORDS), np.uint64)
            keys[:, 0] = every[start] & _MASKS[np.minimum(size, 8)]
            for j in range(1, KEY_WORDS):
                more = np.flatnonzero((size > 8 * j) & (size <= LONGEST_CHUNK))
                keys[more, j] = every[start[more] + 8 * j] & _MASKS[np.minimum(size[more] - 8 * j, 8)]
            keys[:, -1] |= size.astype(np.uint64) << np.uint64(56)
            return keys

        if self.keeps_spaces:
            keys = load(data, start, size)
        else:
            keys = load(lowered, start, size)
            if len(raw_at):
                keys[raw_at] = load(data, start[raw_at], size[raw_at])
        h = self.table.hashes(keys)
        at = self.table.find(keys, h)
        long = size > LONGEST_CHUNK
        if len(new := np.flatnonzero((at < 0) & ~long)):
            if self.table.rows + len(new) > (self.most_chunks or MOST_CHUNKS):
                self._forget()
                new = np.flatnonzero(~long)
            _, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())], words[one])
            first = self.table.rows
            self.table.add(keys[one], h[one])
            at[new] = first + back
            long[new[(keys[new] != keys[one[back]]).any(1)]] = True  # another chunk with the same hash
        at[long] = 0
        sizes, starts, ids = self.lengths[at], self.starts[at], self.ids
        if long.any():  # not kept
            which = np.flatnonzero(long)
            raw = data.tobytes()
            flat, own = self._listed([raw[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())])
            sizes[which], starts[which] = own, self.used + np.cumsum(own) - own
            ids = np.concatenate([self.ids[: self.used], flat])
        ends = np.cumsum(sizes)
        take = np.repeat(starts - ends + sizes, sizes)
        take += np.arange(len(take))
        flat = ids[take]
        ends = np.concatenate([[0], ends])[np.searchsorted(start, bounds)]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _some(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        bad = pc.equal(pc.binary_length(texts), 0)
        for content in self.added:
            bad = pc.or_(bad, pc.match_substring(texts, content))
        if self.keeps_spaces:
            bad = pc.or_(bad, pc.match_substring_regex(texts, _UNSAFE))
        bad = bad.to_numpy(zero_copy_only=False)
        if not bad.any():
            return self._cut(texts)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for mask, encode in ((bad, lambda some: self.whole(some.to_pylist())), (~bad, self._cut)):
            if (at := np.flatnonzero(mask)).size:
                for i, x in zip(at.tolist(), encode(texts.take(pa.array(at)))):
                    out[i] = x
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        claim(f"chunks of {id(self)}", self._forget)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + MOST_BYTES, "right")))
            yield from self._some(texts[i:j])
            i = j


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_spaces: bool, most_chunks: int | None = None) -> Encoder:
    """This worker's encoder for a file; its table of chunks serves all tasks."""
    if (path, keeps_spaces) not in _ENCODERS:
        _ENCODERS[path, keeps_spaces] = Encoder(path, keeps_spaces, most_chunks)
    return _ENCODERS[path, keeps_spaces]
