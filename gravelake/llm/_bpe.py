"""Byte-level BPE: pre-tokens through bounded caches, misses by segment trees.

The merge loop keeps, for each pre-token, a segment tree whose leaves hold
``rank of the pair starting here, position``; its root is the leftmost pair of
lowest rank.  A merge changes three leaves and the paths above them.  Trees of
many pre-tokens of like width are kept in one array and advance together.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import regex

from ._words import polynomial_hashes

#: The pre-tokeniser's pattern and the end-of-text string are fixed values of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1) << np.int64(62)
_POS = 32


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else 256 onwards in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + counts[i]``, end to end."""
    ends = np.cumsum(counts)
    at = np.repeat(starts - (ends - counts), counts)
    at += np.arange(len(at))
    return at


class Vocabulary:
    """Ranks, ids and byte strings read from a ``tokenizer.json``."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, to_byte = spec["model"], _byte_chars()
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.byte_id = np.zeros(256, np.int64)
        for ch, b in to_byte.items():
            self.byte_id[b] = ids[ch]
        size = max([*ids.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for token, i in ids.items():
            strings[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.special.items():
            strings[i] = token.encode()
        digits = len(str(size)) + 1
        self._digits = np.frombuffer(b"".join(f"{i},".encode().ljust(digits, b"\0") for i in range(size)), np.uint8).reshape(size, digits)
        self._lengths = np.array([len(s) for s in strings], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._blob = np.frombuffer(b"".join(strings), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or the sentinel where the pair has no merge."""
        key = a << 32 | b
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._ranks[at], _NONE >> _POS)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Byte strings of ``ids`` put end to end."""
        if not len(ids):
            return b""
        return self._blob[ragged(self._starts[ids], self._lengths[ids])].tobytes()

    def decimal_bytes(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        if not len(ids):
            return b""
        rows = self._digits[ids]
        return rows[rows != 0].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> str:
        """The decoded text; ill-formed UTF-8 becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of the pre-tokens given as bytes, end to end, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = np.left_shift(1, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
        counts, parts, order = np.zeros(len(words), np.int64), [], []
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            step = max(1, (1 << 18) // w)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                ids, n = self._forest([words[i] for i in part.tolist()], w)
                counts[part] = n
                parts.append(ids)
                order.append(part)
        if not parts:
            return np.zeros(0, np.uint32), counts
        flat, order = np.concatenate(parts), np.concatenate(order)
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(starts, counts)], counts

    def _forest(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(words), np.array([len(w) for w in words])
        column = np.arange(width)
        inside = column < size[:, None]
        ids = np.zeros((n, width), np.int64)
        ids[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        alive, ids = inside.ravel().copy(), ids.ravel()
        base = np.arange(n)[:, None] * width
        following = np.where(column + 1 < size[:, None], base + column + 1, -1).ravel()
        before = np.where((column > 0) & inside, base + column - 1, -1).ravel()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        paired = following >= 0
        leaves = np.full(n * width, _NONE, np.int64)
        where = np.flatnonzero(paired)
        leaves[where] = (self.rank(ids[where], ids[following[where]]) << _POS) | (where % width)
        leaves[leaves >= _NONE] = _NONE
        tree[:, width:] = leaves.reshape(n, width)
        level = width
        while level > 1:
            level //= 2
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        flat, row = tree.ravel(), np.arange(n)
        while True:
            root = flat[row * (2 * width) + 1]
            go = root < _NONE
            row, root = row[go], root[go]
            if not len(row):
                break
            first = row * width + (root & ((1 << _POS) - 1))
            second = following[first]
            ids[first] = self.merged[root >> _POS]
            alive[second] = False
            after = following[second]
            following[first] = after
            has = after >= 0
            before[after[has]] = first[has]
            prior = before[first]
            leaf = np.full((3, len(row)), _NONE, np.int64)
            leaf[1, has] = (self.rank(ids[first[has]], ids[after[has]]) << _POS) | (first[has] % width)
            had = prior >= 0
            leaf[2, had] = (self.rank(ids[prior[had]], ids[first[had]]) << _POS) | (prior[had] % width)
            leaf[leaf >= _NONE] = _NONE
            spots = [(second, leaf[0], None), (first, leaf[1], None), (prior, leaf[2], had)]
            nodes = []
            for spot, value, mask in spots:
                tops = row if mask is None else row[mask]
                spot, value = (spot, value) if mask is None else (spot[mask], value[mask])
                node = tops * (2 * width) + width + spot % width
                flat[node] = value
                nodes.append((tops * (2 * width), node - tops * (2 * width)))
            origin = np.concatenate([o for o, _ in nodes])
            node = np.concatenate([x for _, x in nodes])
            for _ in range(width.bit_length() - 1):
                node >>= 1
                low = origin + 2 * node
                flat[origin + node] = np.minimum(flat[low], flat[low + 1])
        return ids[alive].astype(np.uint32), alive.reshape(n, width).sum(1)


@lru_cache(maxsize=4)
def vocabulary(content: bytes) -> Vocabulary:
    """One parsed vocabulary for each worker process and file."""
    return Vocabulary(content)


class ChunkTable:
    """Token ids of texts from cached ids of their chunks.

    Texts are cut where the pre-tokeniser is sure to cut: before a space or
    line feed that a non-space follows, and between an ASCII letter and one of
    ``.,;:!?``.  Chunks are identified by a 64-bit hash in an open-addressing
    table (numpy arrays, at most ``limit`` chunks; a full table starts afresh
    from ``hot``).  Chunks that it lacks are pre-tokenised and go through the
    segment trees.
    """

    _PATTERN = regex.compile(PATTERN)
    _SPACE = np.zeros(256, bool)
    _SPACE[[*range(9, 14), 0x20, *range(0x1C, 0x20)]] = True
    #: Bytes that surely begin a non-space: neither ASCII space nor a lead byte of any Unicode space.
    _SOLID = ~_SPACE
    _SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
    _GAP = np.zeros(256, bool)
    _GAP[[0x20, 0x0A]] = True
    _STOP = np.zeros(256, bool)
    _STOP[[ord(c) for c in ".,;:!?"]] = True
    _LETTER = np.zeros(256, bool)
    _LETTER[[*range(65, 91), *range(97, 123)]] = True

    def __init__(self, vocab: Vocabulary, limit: int = 1 << 19, hot: tuple[np.ndarray, np.ndarray] | None = None):
        """``hot``: hashes and token counts of frequent chunks, for ``counts`` alone (their ids are not known)."""
        self.vocab, self.limit, self.hot = vocab, limit, hot
        self._special = [s.encode() for s in vocab.special]
        self._shift = np.uint64(64 - (max(limit, 2) * 2 - 1).bit_length())
        self._reset()

    def _reset(self) -> None:
        slots = 1 << (64 - int(self._shift))
        self._key, self._entry = np.zeros(slots, np.uint64), np.full(slots, -1, np.int64)
        self._used = 0
        self._start, self._count = np.zeros(self.limit + 1, np.int64), np.zeros(self.limit + 1, np.int64)
        self._ids, self._filled = np.zeros(4 * self.limit, np.uint32), 0
        if self.hot is not None:
            self._put(self.hot[0][: self.limit // 2], np.full(len(self.hot[0]), -1, np.int64), self.hot[1].astype(np.int64))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        slot = (h >> self._shift).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        mask = len(self._key) - 1
        while len(left):
            entry = self._entry[slot]
            same = self._key[slot] == h[left]
            hit = same & (entry >= 0)
            out[left[hit]] = entry[hit]
            go = ~same & (entry >= 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def _put(self, h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Insert hashes that are distinct and absent."""
        entry = np.arange(self._used, self._used + len(h))
        self._start[entry], self._count[entry] = starts[: len(h)], counts[: len(h)]
        self._used += len(h)
        slot = (h >> self._shift).astype(np.int64)
        mask = len(self._key) - 1
        while len(entry):
            free = self._entry[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self._key[slot[take]], self._entry[slot[take]] = h[take], entry[take]
            stay = np.ones(len(entry), bool)
            stay[take] = False
            h, entry, slot = h[stay], entry[stay], (slot[stay] + 1) & mask

    def cuts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where chunks begin: sorted byte positions, first of each non-empty row included."""
        n = len(raw)
        begin = np.zeros(n, bool)
        if n > 1:
            begin[:-1] = self._GAP[raw[:-1]] & self._SOLID[raw[1:]]
            begin[1:] |= self._STOP[raw[1:]] & self._LETTER[raw[:-1]]
            inner = offs[1:-1]
            last = inner[(inner > 0) & (inner < n)] - 1
            begin[last[self._GAP[raw[last]]]] = False  # a row's last byte is followed by nothing
        begin[offs[:-1][offs[:-1] < n]] = True
        blob = None
        for s in self._special:
            if len(at := np.flatnonzero(raw == s[0])):
                blob = raw.tobytes() if blob is None else blob
                row = np.searchsorted(offs, at, side="right")
                for p in at[offs[row] - at >= len(s)].tolist():
                    if blob.startswith(s, p):
                        begin[p : p + len(s)] = False
                        begin[p] = True
                        if p + len(s) < n:
                            begin[p + len(s)] = True
                        if p and self._SPACE[raw[p - 1]] and not (p - 1 in offs or blob.endswith(tuple(self._special), 0, p - 1)):
                            begin[p - 1] = False  # a run of spaces before a special string is one pre-token
        return np.flatnonzero(begin)

    def _learn(self, raw: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode chunks with distinct hashes and put them in."""
        if self._used + len(h) > self.limit:
            self._reset()
        blob, index, plan, sizes = raw.tobytes(), {}, [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            piece = blob[a:b]
            if piece in self._special:
                tokens = [piece]
            else:
                word = piece[1:] if piece[:1] == b" " else piece
                tokens = [piece] if word.isalpha() else [t.encode() for t in self._PATTERN.findall(piece.decode("utf-8", "replace"))]
            plan += [index.setdefault(t, len(index)) for t in tokens]
            sizes.append(len(tokens))
        words = list(index)
        ids, counts = self.vocab.encode_words(words)
        if self._special and any(s in index for s in self._special):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for s in self._special:
                if s in index:
                    parts[index[s]] = np.array([self.vocab.special[s.decode()]], np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        plan, sizes = np.array(plan, np.int64), np.array(sizes, np.int64)
        ids = ids[ragged((np.cumsum(counts) - counts)[plan], counts[plan])]
        total = np.concatenate([[0], np.cumsum(counts[plan])])
        edge = np.cumsum(sizes)
        begin = total[edge - sizes]
        if self._filled + len(ids) > len(self._ids):
            grown = np.zeros(2 * (self._filled + len(ids)), np.uint32)
            grown[: self._filled] = self._ids[: self._filled]
            self._ids = grown
        self._ids[self._filled : self._filled + len(ids)] = ids
        self._put(h, begin + self._filled, total[edge] - begin)
        self._filled += len(ids)

    def lengths(self, chunks: Sequence[bytes]) -> np.ndarray:
        """Number of tokens of each of these different chunks, at most ``limit`` of them."""
        if not len(chunks):
            return np.zeros(0, np.int64)
        blob, ends = np.frombuffer(b"".join(chunks), np.uint8), np.cumsum([len(c) for c in chunks], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        h = polynomial_hashes(blob, starts, ends)
        self._learn(blob, h, starts, ends)
        return self._count[self._find(h)]

    def _entries(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each chunk of a slice, and the chunk index where each row begins (n+1)."""
        starts = self.cuts(raw, offs)
        ends = np.append(starts[1:], len(raw))
        h = polynomial_hashes(raw, starts, ends)
        entry = self._find(h)
        if len(lacking := np.flatnonzero(entry < 0)):
            _, first = np.unique(h[lacking], return_index=True)
            some = lacking[np.sort(first)]
            room = max(1, self.limit - (len(self.hot[0]) if self.hot is not None else 0)) // 2
            if len(some) > room or self._used + len(some) > self.limit:
                return self._afresh(raw, offs, starts, ends, h)
            self._learn(raw, h[some], starts[some], ends[some])
            entry = self._find(h)
        return entry, np.searchsorted(starts, offs)

    def _afresh(self, raw, offs, starts, ends, h):
        """The table is full: start again and learn all chunks of this slice that it then lacks."""
        self._reset()
        lacking = np.flatnonzero(self._find(h) < 0)
        _, first = np.unique(h[lacking], return_index=True)
        some = lacking[np.sort(first)]
        if self._used + len(some) > self.limit:  # one slice with more kinds of chunks than the table holds
            self.limit = 2 * (self._used + len(some))
            self._shift = np.uint64(64 - (self.limit * 2 - 1).bit_length())
            self._reset()
        self._learn(raw, h[some], starts[some], ends[some])
        return self._find(h), np.searchsorted(starts, offs)

    def counts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of tokens of each row of a slice."""
        if not len(raw):
            return np.zeros(len(offs) - 1, np.int64)
        entry, at = self._entries(raw, offs)
        total = np.concatenate([[0], np.cumsum(self._count[entry])])
        return total[at[1:]] - total[at[:-1]]

    def ids(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all rows of a slice end to end, and their n+1 offsets."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        entry, at = self._entries(raw, offs)
        counts = self._count[entry]
        total = np.concatenate([[0], np.cumsum(counts)])
        return self._ids[ragged(self._start[entry], counts)], total[at]


_TABLES: dict[tuple, ChunkTable] = {}


def worker_table(content: bytes, hot: tuple[np.ndarray, np.ndarray] | None = None) -> ChunkTable:
    """This worker process's table for a vocabulary; kept from task to task, one at a time."""
    key = (hash(content), None if hot is None else hash(hot[0].tobytes()))
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = ChunkTable(vocabulary(content), hot=hot)
    return _TABLES[key]
