"""Byte-level BPE by speculation: greedy longest matches, pair checks, exact merging only where a check fails.

A token sequence is the BPE encoding of its bytes exactly when each adjacent pair is: merging works from local ranks, so
a sequence can only go wrong across one of its joints. Greedy longest match therefore proposes the tokens of each word,
numpy checks all joints of all new words at once, and a word with a bad joint is merged again in rank order.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import regex

#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = np.int64(1) << 40
_ASTRAL = re.compile("[\U00010000-\U0010ffff]").search
#: Longer words (in bytes) are walked one by one, since a lock step over all words would idle on them.
_LOCKSTEP_BYTES = 48
#: Words kept from batch to batch; beyond this the cache starts anew.
_CACHE_WORDS = 400_000
_CHUNK_CHARS = 1_000_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself where it is visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        letters[b] = chr(b) if b in visible else chr(spare)
        spare += b not in visible
    return letters


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of one vocabulary; a few MB, fixed by the vocabulary, so they may be broadcast."""

    byte_id: np.ndarray  # id of each byte
    left: np.ndarray  # the two ids a token was merged from, -1 for bytes
    right: np.ndarray
    pair_key: np.ndarray  # left << 32 | right, sorted
    pair_id: np.ndarray
    edge_key: np.ndarray  # trie: node << 8 | byte, sorted
    edge_to: np.ndarray
    node_id: np.ndarray  # token that ends in a node, or -1
    size: np.ndarray  # bytes of each token

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a JSON file with `vocab` and ordered `merges` whose ids rise with their rank."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        n = max(vocab.values()) + 1
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        last = -1
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            merged = vocab[a + b]
            if left[merged] < 0:
                if merged < last:
                    raise ValueError("ids of this vocabulary don't follow the order of its merges")
                left[merged], right[merged], last = vocab[a], vocab[b], merged
        made = np.flatnonzero(left >= 0)
        keys = left[made] << 32 | right[made]
        order = np.argsort(keys)

        edges: dict[int, int] = {}
        ends, size = [-1], np.zeros(n, np.int64)
        for text, token in vocab.items():
            if len(text) > 1 and left[token] < 0:
                continue  # a special token
            node = 0
            for c in text:
                key = node << 8 | byte_of[c]
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            ends[node], size[token] = token, len(text)
        edge_key = np.fromiter(edges.keys(), np.int64, len(edges))
        by_key = np.argsort(edge_key)
        return cls(
            np.array([vocab[c] for c in letters], np.int64), left, right, keys[order], made[order],
            edge_key[by_key], np.fromiter(edges.values(), np.int64, len(edges))[by_key], np.array(ends, np.int64), size,
        )


@functools.cache
def _splitters() -> tuple[Callable[[str], list[str]], ...]:
    """Splitters for ASCII text, for text in the first 65,536 characters, and for any text.

    The first two are the same pattern for the standard library's engine, which looks a character up in a table; their
    classes are read off the general pattern's properties. Letters come first, since no other branch starts with one.
    """

    def pattern(limit: int) -> Callable[[str], list[str]]:
        every = "".join(map(chr, [*range(min(limit, 0xD800)), *range(0xE000, limit)]))

        def ranges(of: str) -> str:
            return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for part in (every[:0xD800], every[0xD800:]) for m in regex.finditer(f"(?:{of})+", part))

        letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
        return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    return pattern(0x80), pattern(0x10000), regex.compile(PATTERN).findall


def split_words(text: str) -> list[str]:
    """The words of a text by PATTERN; together they are the text."""
    small, wide, full = _splitters()
    return small(text) if text.isascii() else full(text) if _ASTRAL(text) else wide(text)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class Encoder:
    """Encodes batches of texts and remembers the words it has seen."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self._edges: dict[int, int] | None = None
        self._merges: dict[int, int] | None = None
        self.verified = self.merged = 0
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.tokens = np.zeros(8192, np.int32)
        self.used = 0

    # ---- speculate

    def _propose(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the greedy longest matches, in order within each word."""
        v, word, pos = self.v, np.arange(len(begin)), begin.copy()
        words_out, tokens_out = [], []
        while len(word):
            node = np.zeros(len(word), np.int64)
            best, best_end = np.full(len(word), -1, np.int64), pos.copy()
            live, p = np.arange(len(word)), pos.copy()
            while len(live):
                nxt = _find(v.edge_key, v.edge_to, node[live] << 8 | buf[p[live]], -1)
                live = live[nxt >= 0]
                node[live] = nxt[nxt >= 0]
                p[live] += 1
                hit = v.node_id[node[live]]
                full = live[hit >= 0]
                best[full], best_end[full] = hit[hit >= 0], p[full]
                live = live[p[live] < end[word[live]]]
            words_out.append(word)
            tokens_out.append(best)
            keep = best_end < end[word]
            word, pos = word[keep], best_end[keep]
        words, tokens = np.concatenate(words_out), np.concatenate(tokens_out)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def _propose_long(self, data: bytes) -> list[int]:
        """The same for one long word."""
        if self._edges is None:
            self._edges = dict(zip(self.v.edge_key.tolist(), self.v.edge_to.tolist(), strict=True))
        edges, ends, out, pos, n = self._edges, self.v.node_id, [], 0, len(data)
        while pos < n:
            node, p, best, best_end = 0, pos, -1, pos
            while p < n:
                node = edges.get(node << 8 | data[p], -1)
                if node < 0:
                    break
                p += 1
                if ends[node] >= 0:
                    best, best_end = int(ends[node]), p
            out.append(best)
            pos = best_end
        return out

    # ---- verify

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when its bytes are merged in rank order.

        Undoes the merges inside both tokens from the latest to the earliest. At each moment the two pieces at the joint
        are known, and so is the rank at which either was used up within its own token. A merge across the joint comes
        first if its rank is below the left piece's (the merge further left wins a tie) and not above the right piece's.
        """
        v = self.v
        a, b = first.astype(np.int64), second.astype(np.int64)
        until_a, until_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            rank = _find(v.pair_key, v.pair_id, a[live] << 32 | b[live], _NEVER)
            crossed = (rank < until_a[live]) & (rank <= until_b[live])
            good[live[crossed]] = False
            live = live[~crossed]
            live = live[(v.left[a[live]] >= 0) | (v.left[b[live]] >= 0)]
            made_a = np.where(v.left[a[live]] >= 0, a[live], -1)
            made_b = np.where(v.left[b[live]] >= 0, b[live], -1)
            undo_a, undo_b = live[made_a > made_b], live[made_a <= made_b]
            until_a[undo_a], a[undo_a] = a[undo_a], v.right[a[undo_a]]
            until_b[undo_b], b[undo_b] = b[undo_b], v.left[b[undo_b]]
        return good

    # ---- merge exactly

    def merge(self, data: bytes) -> list[int]:
        """Rank-ordered merging of one word with a heap over a linked list: n log n also for very long words."""
        if self._merges is None:
            self._merges = dict(zip(self.v.pair_key.tolist(), self.v.pair_id.tolist(), strict=True))
        ranks, ids = self._merges, self.v.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(rank << 32 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[j]]))
            if (k := before[i]) >= 0 and (r := ranks.get(ids[k] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, k, ids[k], rank))
        return [x for x in ids if x >= 0]

    # ---- words and texts

    def _learn(self, new: list[str]) -> None:
        """Append the tokens of new words, which take the next codes in order."""
        data = [w.encode("utf-8") for w in new]
        size = np.fromiter(map(len, data), np.int64, len(data))
        short = size <= _LOCKSTEP_BYTES
        buf = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        end = np.cumsum(size)
        at = np.flatnonzero(short)
        word, token = self._propose(buf, (end - size)[at], end[at]) if len(at) else (np.zeros(0, np.int64),) * 2
        word = at[word]
        for i in np.flatnonzero(~short):
            proposal = self._propose_long(data[i])
            word = np.append(word, np.full(len(proposal), i))
            token = np.append(token, proposal)
        if not short.all():
            order = np.argsort(word, kind="stable")
            word, token = word[order], token[order]
        joint = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(token[joint] << 32 | token[joint + 1], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failing = np.unique(word[joint[bad]])
        self.verified += len(new) - len(failing)
        self.merged += len(failing)
        if len(failing):
            keep = ~np.isin(word, failing)
            exact = [self.merge(data[i]) for i in failing]
            word = np.concatenate([word[keep], np.repeat(failing, [len(x) for x in exact])])
            token = np.concatenate([token[keep], np.concatenate([np.array(x, np.int64) for x in exact])])
            order = np.argsort(word, kind="stable")
            word, token = word[order], token[order]
        base, counts = len(self.words) - len(new), np.bincount(word, minlength=len(new))
        while base + len(new) > len(self.count):
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        while self.used + len(token) > len(self.tokens):
            self.tokens = np.append(self.tokens, np.zeros_like(self.tokens))
        self.tokens[self.used : self.used + len(token)] = token
        self.count[base : base + len(new)] = counts
        self.start[base : base + len(new)] = self.used + np.cumsum(counts) - counts
        self.used += len(token)

    def split(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words of all texts in a row, their codes, and the number of words of each text (0 for None and '')."""
        if len(self.words) > _CACHE_WORDS or self.used > 8 * _CACHE_WORDS:
            self._forget()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = split_words(text)
                counts[i] = len(own)
                words += own
        known = self.words
        codes = np.fromiter(map(known.get, words, [-1] * len(words)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new: list[str] = []
            for i in missing.tolist():
                word = words[i]
                code = known.get(word)
                if code is None:
                    code = known[word] = len(known)
                    new.append(word)
                codes[i] = code
            self._learn(new)
        return words, codes, counts

    def tokens_of(self, codes: np.ndarray) -> np.ndarray:
        """Token ids of words in a row."""
        counts = self.count[codes]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.tokens[np.repeat(self.start[codes] - ends + counts, counts) + np.arange(total)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in a row, and where each text's begin (one more entry for the end)."""
        parts, sizes, at = [], [], 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars < _CHUNK_CHARS):
                chars += len(texts[to] or "")
                to += 1
            _, codes, counts = self.split(texts[at:to])
            parts.append(self.tokens_of(codes))
            ends = np.append(0, np.cumsum(self.count[codes]))
            bounds = np.append(0, np.cumsum(counts))
            sizes.append(np.diff(ends[bounds]))
            at = to
        offsets = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), offsets


_encoders: dict[int, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker process and vocabulary, so that its words outlive a task."""
    key = hash((len(vocabulary.pair_key), vocabulary.pair_id.tobytes()))
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]
