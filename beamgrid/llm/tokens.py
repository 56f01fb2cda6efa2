"""Byte-level BPE ids of whole texts, as little-endian unsigned 32-bit payloads.

The library encodes each distinct piece of text once; numpy cuts the pieces, looks them up and lays out the ids of a whole
block of texts at a time. Memory is bounded: the table of known pieces has a fixed number of places, blocks a fixed size.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut and looked up at once.
BLOCK = 1 << 19
#: Pieces of more bytes than this are encoded wherever they occur, without the table.
LONGEST = 24
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_MARKS = ".,;:!?)"
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in _MARKS]] = True
#: The last bytes of white space beyond ASCII.
_WIDE = np.zeros(256, bool)
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE[[s[-1] for s in _WIDE_SPACES]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cuttable(spec: dict) -> bool:
    """Whether pieces can be encoded apart: plain byte-level pre-tokens, and added tokens that no cut goes through."""
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    added = spec.get("added_tokens") or []
    loose = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
    cut = any(_SPACE[b] or _MARK[b] for t in added for b in t["content"].encode())
    return plain and not loose and not cut and not spec.get("truncation") and not spec.get("padding")


class Encoder:
    """Encodes texts with the tokenizers library; equal pieces of words are encoded once.

    A text is cut before white space that follows something else, and before a mark that follows a letter. A byte-level
    pre-token never reaches over such a place, so the ids of the pieces, one after another, are those of the text.
    Tokenizers of another kind encode whole texts. Known pieces are found in a hash table by all their bytes; when
    cache_words of them are held, those that were met only once are dropped.
    """

    def __init__(self, path: str, cache_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cuttable = _cuttable(json.loads(self.tokenizer.to_str()))
        self.most = cache_words
        self.bits = max(4, (2 * cache_words - 1).bit_length())
        places = 1 << self.bits
        self.keys = np.zeros((3, places), np.uint64)
        self.size = np.zeros(places, np.uint8)
        self.word = np.zeros(places, np.int32)
        # word 0 is the end of a text, one id or none
        self.start, self.count, self.ids, self.seen = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint32), np.zeros(1, bool)
        self.words, self.used = 1, 1
        feed, pair = (self._encode([x])[0] for x in ("\n", "a\n b"))
        self.line_feed = feed[0] if self.cuttable and len(feed) == 1 and pair[1:2] == feed and len(pair) == 3 else None

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids one after another, how many of each piece), from one text with a piece a line: a line feed is an id of its own.

        For pieces without line feeds that start with a space and something else, or with something else.
        """
        if self.line_feed is None or not pieces:
            return None
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.line_feed)
        return (np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1) if len(cuts) == len(pieces) - 1 else None

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encode pieces and append their ids; the numbers of the new words."""
        out = np.arange(self.words, self.words + len(pieces))
        simple = [not (_SPACE[p[0]] and (p[0] != 32 or len(p) < 2 or _SPACE[p[1]]) or b"\n" in p) for p in pieces]
        texts = [p.decode() for p in pieces]
        ids, sizes = [], np.zeros(len(pieces), np.int64)
        order = np.argsort(~np.array(simple, bool), kind="stable")
        k = sum(simple)
        lines = self._lines([texts[i] for i in order[:k].tolist()])
        if lines:
            ids.append(lines[0])
            sizes[order[:k]] = lines[1]
        rest = order[k if lines else 0 :]
        found = self._encode([texts[i] for i in rest.tolist()])
        sizes[rest] = [len(x) for x in found]
        ids = np.concatenate([*ids, np.fromiter((i for x in found for i in x), np.uint32)])
        n = self.words + len(pieces)
        if n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.start, self.count))
            self.seen = np.concatenate([self.seen, np.zeros(n, bool)])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(ids), np.uint32)])
        self.count[out], self.seen[out] = sizes, False
        laid = sizes[order]
        self.start[out[order]] = self.used + np.cumsum(laid) - laid
        self.ids[self.used : self.used + len(ids)] = ids
        self.words, self.used = n, self.used + len(ids)
        return out

    def _sweep(self) -> None:
        """Keep the words that were met again since the last sweep; all go if these are more than half."""
        places = np.flatnonzero(self.size)
        again = self.seen[self.word[places]]
        if again.sum() * 2 > self.most:
            again[:] = False
        self.size[places[~again]] = 0
        places = places[again]
        own = np.concatenate([[0], self.word[places]])
        n = self.count[own]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.start[own] - (ends - n), n) + np.arange(ends[-1])]
        ids = np.concatenate([self.ids[:1], ids[int(n[0]) :]])
        self.count, self.start = n, np.concatenate([[0], 1 + ends[:-1] - n[0]])
        self.word[places] = np.arange(1, len(own))
        self.ids, self.seen, self.words, self.used = ids, np.zeros(len(own), bool), len(own), len(ids)

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """First bytes of all pieces; starts: first bytes of the texts."""
        space = _SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
        doubtful = np.flatnonzero(cut & space & np.append(False, _WIDE[data[:-1]]))
        for s in _WIDE_SPACES:
            own = doubtful[doubtful >= len(s)]
            wide = np.ones(len(own), bool)
            for k, b in enumerate(s):
                wide &= data[own - len(s) + k] == b
            cut[own[wide]] = False
        cut[starts[starts < len(data)]] = True
        return np.flatnonzero(cut)

    def _look_up(self, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The word of each piece; unknown ones are encoded."""
        padded = np.zeros(len(data) // 8 * 8 + 48, np.uint8)
        padded[: len(data)] = data
        aligned = padded.view("<u8")
        q, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        back = np.uint64(63) - shift
        parts, h, low = [], sizes.astype(np.uint64) * _ODD[3], aligned[q]
        for k in range(3):
            high = aligned[q + k + 1]
            w = ((low >> shift) | ((high << np.uint64(1)) << back)) & _MASKS[np.clip(sizes - 8 * k, 0, 8)]
            parts.append(w)
            h = (h ^ w) * _ODD[k]
            h ^= h >> np.uint64(29)
            low = high
        out = np.full(len(at), -1, np.int64)
        mask = (1 << self.bits) - 1
        slot = ((h * _ODD[3]) >> np.uint64(64 - self.bits)).astype(np.int64)
        short = sizes.astype(np.uint8)
        left = np.flatnonzero(sizes <= LONGEST)
        missing = []
        for probe in range(4):
            s = (slot[left] + probe) & mask
            empty = self.size[s] == 0
            hit = self.size[s] == short[left]
            for k in range(3):
                hit &= self.keys[k][s] == parts[k][left]
            own = self.word[s[hit]]
            out[left[hit]] = own
            self.seen[own] = True
            missing.append(left[empty])
            left = left[~hit & ~empty]
            if not len(left):
                break
        unknown = np.concatenate([*missing, left])
        held = self.words, self.used
        if len(unknown):
            _, first, which = np.unique(h[unknown], return_index=True, return_inverse=True)
            chosen = unknown[first]
            own = chosen[which]
            same = sizes[own] == sizes[unknown]
            for k in range(3):
                same &= parts[k][own] == parts[k][unknown]
            words = self._add([data[a : a + n].tobytes() for a, n in zip(at[chosen].tolist(), sizes[chosen].tolist(), strict=True)])
            out[unknown[same]] = words[which[same]]
            for probe in range(4):
                s = (slot[chosen] + probe) & mask
                _, first = np.unique(s, return_index=True)
                first = first[self.size[s[first]] == 0]
                s, c = s[first], chosen[first]
                self.size[s], self.word[s] = sizes[c], words[first]
                for k in range(3):
                    self.keys[k][s] = parts[k][c]
                chosen, words = np.delete(chosen, first), np.delete(words, first)
            held = self.words, self.used
        # long pieces, and those whose hash another piece has
        rest = np.flatnonzero(out < 0)
        if len(rest):
            pieces = [data[a : a + n].tobytes() for a, n in zip(at[rest].tolist(), sizes[rest].tolist(), strict=True)]
            distinct = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            words = self._add(list(distinct))
            out[rest] = words[[distinct[p] for p in pieces]]
        self.kept = held
        return out

    def _block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with word 0 behind it, first id of each text and the end); starts has the end too."""
        at = self._cuts(data, starts[:-1]) if len(data) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(at, len(data)))
        word = self._look_up(data, at, sizes)
        word = np.insert(word, np.searchsorted(at, starts[1:]), 0)
        n = self.count[word]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.start[word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends[np.flatnonzero(word == 0)]])
        self.words, self.used = self.kept
        if self.words > self.most or self.used > 8 * self.most:
            self._sweep()
        return ids, bounds

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _block; a text longer than a block is taken in parts that end where a piece does."""
        if len(data) <= 2 * BLOCK or len(starts) != 2:
            return self._block(data, starts)
        held, a = [], 0
        while a < len(data):
            b = min(a + BLOCK, len(data))
            while b < len(data):
                cuts = self._cuts(data[b - 3 : b + BLOCK], np.zeros(0, np.int64)) + b - 3
                cuts = cuts[cuts > b]
                if len(cuts):
                    b = int(cuts[0])
                    break
                b = min(b + BLOCK - 8, len(data))
            ids, _ = self._block(data[a:b], np.array([0, b - a]))
            held.append(ids if b == len(data) else ids[:-1] if self.count[0] else ids)
            a = b
        ids = np.concatenate(held)
        return ids, np.array([0, len(ids)])

    def blocks(self, texts: pa.Array, end_id: int | None = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, first id of each text and the end) for texts of about a block; null is empty, each ends with end_id."""
        texts = texts.cast(pa.large_string())
        lengths = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        begin, size = lengths[:-1].copy(), np.diff(lengths)
        if texts.null_count:
            size = np.where(texts.is_valid().to_numpy(zero_copy_only=False), size, 0)
        i = 0
        while i < len(texts):
            j = i + 1 + int(np.searchsorted(np.cumsum(size[i + 1 :]), BLOCK - int(size[i]), "right")) if size[i] < BLOCK else i + 1
            part = data[begin[i] : begin[j - 1] + size[j - 1]]
            if int(size[i:j].sum()) != len(part):  # bytes under nulls
                part = np.concatenate([data[a : a + n] for a, n in zip(begin[i:j].tolist(), size[i:j].tolist(), strict=True)])
            starts = np.concatenate([[0], np.cumsum(size[i:j])])
            if self.cuttable:
                self.count[0], self.ids[0] = (0, 0) if end_id is None else (1, end_id)
                yield i, *self._pieces(part, starts)
            else:
                found = self._encode([part[a:b].tobytes().decode() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])
                ids = [np.array(x if end_id is None else [*x, end_id], np.uint32) for x in found]
                yield i, np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            i = j

    def __call__(self, texts: list[str | None], end_id: int | None = 0) -> list[bytes]:
        """One payload per text."""
        out = []
        for _, ids, bounds in self.blocks(pa.array(texts, pa.string()), end_id):
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return out


def payloads(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The ids of each text as a binary value."""
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int64)), data]).cast(pa.binary())


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker; its table, of bounded size, is kept between tasks."""
    return Encoder(path)
