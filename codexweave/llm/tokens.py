"""Token ids of whole texts, each distinct word encoded once per worker.

Neither vocabulary joins a word with the white space after it, so a text's ids are those of its
parts: for ``byte_bpe_50k`` a run of white space with the word behind it, for ``word_bpe_49k`` the
word alone. Texts with white space beyond ASCII are encoded in one piece.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import EVERY_BYTE, hash_spans, hashes, split

ODD_SPACE = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


class Encoder:
    """Encodes with a file of the ``tokenizers`` library; holds the ids of at most ``keep`` words (about 35 bytes each).

    Words are found in two sorted indexes, an old one and a young one that is merged into it now and then. When there are more than ``keep``,
    those met again since they were learned stay, the most frequent half of ``keep`` at most.
    """

    def __init__(self, path: str, spaced: bool, keep: int = 1_000_000, young: int = 100_000, mark: str = "<|endoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.keep, self.young, self.mark = Tokenizer.from_file(path), spaced, keep, young, mark
        self.mark_id = self.tokenizer.token_to_id(mark)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._start(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, self.kind))

    def _start(self, hashed: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Hold words of ascending hashes, their ids end to end."""
        n = len(hashed)
        self.indexes = [(hashed, np.arange(n, dtype=np.int32)), (np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        self.length, self.begin, self.hits = length, (np.cumsum(length) - length).astype(np.int32), np.zeros(n, np.int32)
        self.flat, self.used = ids, len(ids)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many short texts from one call, told apart by a special token between them."""
        if any(self.mark in x for x in texts):
            each = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark_id)
        lengths = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        return np.delete(ids, cuts), lengths

    def _learn(self, new: np.ndarray, texts: list[str]) -> None:
        """Add words by ascending hash."""
        lengths = []
        for at in range(0, len(texts), 5000):
            ids, length = self._ids(texts[at : at + 5000])
            end = self.used + len(ids)
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used // 4, len(ids), 1 << 16), self.kind)])
            self.flat[self.used : end] = ids
            lengths.append(length)
            self.used = end
        length = np.concatenate(lengths).astype(np.int32)
        entry = np.arange(len(self.length), len(self.length) + len(new), dtype=np.int32)
        self.begin = np.concatenate([self.begin, (self.used - length.sum() + np.cumsum(length) - length).astype(np.int32)])
        self.length, self.hits = np.concatenate([self.length, length]), np.concatenate([self.hits, np.zeros(len(new), np.int32)])

        def merged(index: tuple, added: tuple) -> tuple:
            place = np.searchsorted(index[0], added[0])
            return np.insert(index[0], place, added[0]), np.insert(index[1], place, added[1])

        old, young = self.indexes[0], merged(self.indexes[1], (new, entry))
        if len(young[0]) > self.young:
            old, young = merged(old, young), (young[0][:0], young[1][:0])
        self.indexes = [old, young]

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        """The entries of words, -1 for unknown ones."""
        out = np.full(len(hashed), -1, np.int32)
        for known, entry in self.indexes:
            if len(known):
                slot = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                hit = known[slot] == hashed
                out[hit] = entry[slot[hit]]
        return out

    def _trim(self) -> None:
        hashed, entry = (np.concatenate(x) for x in zip(*self.indexes))
        hits = self.hits[entry]
        stay = np.flatnonzero(hits > 0)
        if len(stay) > self.keep // 2:
            stay = stay[np.argsort(-hits[stay], kind="stable")[: self.keep // 2]]
        stay = stay[np.argsort(hashed[stay])]
        entry, length = entry[stay], self.length[entry[stay]]
        self._start(hashed[stay], length, self._gather(self.begin[entry], length))

    def _gather(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        total = np.cumsum(length, dtype=np.int64)
        return self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - length), length)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and how many each has. Nulls count as empty texts."""
        texts = pc.fill_null(texts, "")
        is_odd = pc.match_substring_regex(texts, ODD_SPACE)
        odd = np.flatnonzero(is_odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(is_odd, "", texts) if len(odd) else texts
        w = split(plain)
        if self.spaced:
            begins = np.zeros(len(w.data) + 1, bool)
            begins[w.bounds] = begins[w.end] = True
            start = np.flatnonzero(begins[:-1])
            end, first = np.append(start[1:], len(w.data)), np.searchsorted(start, w.bounds)
            h = hash_spans(w.data, start, end - start, EVERY_BYTE)
        else:
            start, end, first, h = w.start, w.end, w.first, hashes(w)
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        entry = self._find(unique)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if len(self.length) + len(new) > self.keep:
                self._trim()
                entry = self._find(unique)
                new = np.flatnonzero(entry < 0)
            self._learn(unique[new], [w.data[a:b].tobytes().decode() for a, b in zip(start[at[new]], end[at[new]])])
            entry[new] = np.arange(len(self.length) - len(new), len(self.length))
        met = np.ones(len(unique), bool)
        met[new] = False
        self.hits[entry[met]] += 1
        length, begin = self.length[entry][inverse], self.begin[entry][inverse]
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = self._gather(begin, length).astype(np.uint32)
        counts = total[first[1:]] - total[first[:-1]]
        if len(odd):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd.tolist():
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each file and worker process."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each text's."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
