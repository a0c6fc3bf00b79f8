"""Bits of words in their texts: code, hashed contexts, logistic mixing learned online.

A frequent word is a path in a binary tree (a Huffman code of fixed size); two more leaves
stand for a word that is none of them, seen before in the text or not. At each node of a path
predictors tell the next bit from how often 0 and 1 followed there in their hashed
context: what the last words say of the language, the word before, the two words before, and
what came after that word when it was last met in the text. Their logits are combined by
weights that a gate selects (longest context known, what the earlier place expects), learned
online by the gradient of the coding cost, then refined by an adaptive table. In a
text that is scored the weights go on learning, from the same start for all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docloom.llm.words import Texts, mix

#: Words with a path at most; slots of the predictors' tables as powers of 2; tokens whose bits are told at once.
CODED, TABLE_BITS, TOKENS = 1 << 10, (16, 20, 20, 12), 4_000
#: Tokens of a block, after which a text's weights are changed; blocks back that tell the language; how far weights go.
BLOCK, REACH, RATE = 32, 1, 0.3
#: Tokens whose bits are learned between two changes of the weights.
STEP_TOKENS = 1500
INPUTS, DEPTHS, CELLS, LIMIT = len(TABLE_BITS), 8, 32, 1e-6
GATES = 3 * 5
_ODD, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Code:
    """Paths of words: the bits of a number behind a leading 1, ``length`` of them. After the
    words come the leaves ``again`` and ``other``."""

    def __init__(self, words: pa.Array, counts: np.ndarray, rest: int):
        self.words, self.counts = words.cast(pa.large_string()), counts
        self.again, self.other = len(words), len(words) + 1
        # The empty word, the end of a text, has no hash.
        named = np.array([bool(w) for w in self.words.to_pylist()], dtype=bool)
        hashes = np.zeros(len(words), dtype=np.uint64)
        hashes[named] = Texts(self.words).word_hashes()
        self.end = int(np.flatnonzero(~named)[0]) if not named.all() else -1
        by = np.argsort(hashes[named] >> np.uint64(32), kind="stable")
        self.marks, self.symbols = (hashes[named] >> np.uint64(32))[by], np.flatnonzero(named)[by]
        weights = [*np.maximum(counts, 1).tolist(), max(rest // 2, 1), max(rest // 2, 1)]
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up = [0] * (2 * len(weights))
        for joined in range(len(weights), 2 * len(weights) - 1):
            (v, i), (w, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = joined
            heapq.heappush(heap, (v + w, joined))
        depth = np.zeros(2 * len(weights) - 1, dtype=np.int64)
        for node in range(2 * len(weights) - 3, -1, -1):
            depth[node] = depth[up[node]] + 1
        self.length, self.paths = depth[: len(weights)], np.zeros(len(weights), dtype=np.int64)
        self.longest, path, before = int(self.length.max()), 0, 0
        # Leaves from left to right, the highest first.
        for leaf in np.argsort(self.length, kind="stable").tolist():
            path <<= int(self.length[leaf]) - before
            before = int(self.length[leaf])
            self.paths[leaf] = 1 << before | path
            path += 1

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bits two paths begin with that are the same."""
        aligned = self.paths << (self.longest - self.length)
        return self.longest - np.frexp((aligned[x] ^ aligned[y]).astype(float))[1].astype(np.int64)

    def of_marks(self, marks: np.ndarray) -> np.ndarray:
        """Symbols of words by 32 bits of their hash, -1 for a word without a path."""
        if not len(self.marks):
            return np.full(len(marks), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        return np.where(self.marks[at] == marks, self.symbols[at], -1)


def earlier(places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each token's place occurs before it in its text, and where last (or -1)."""
    # Texts follow each other, so a stable sort by place keeps them apart; 16 bits at a time are sorted fastest.
    order = np.argsort(places.astype(np.uint16), kind="stable")
    order = order[np.argsort((places >> 16).astype(np.uint16)[order], kind="stable")]
    p, o = places[order], owner[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (o[1:] != o[:-1])]) if len(p) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    times, last = np.empty(len(places), dtype=np.int64), np.full(len(places), -1, dtype=np.int64)
    times[order] = np.arange(len(places)) - np.repeat(heads, np.diff(np.append(heads, len(places))))
    last[order[1:][~new[1:]]] = order[:-1][~new[1:]]
    return times, last


class Tokens:
    """Words and ends of whole texts as symbols with their contexts. ``symbols``, ``marks`` (32
    bits of hash) and ``lifts`` are of places; ``places`` and ``counts`` have the ends."""

    def __init__(self, code: Code, places: np.ndarray, counts: np.ndarray, symbols: np.ndarray, marks: np.ndarray, lifts: np.ndarray):
        self.code, self.counts, self.n = code, counts, len(places)
        self.first = np.cumsum(counts) - counts
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.index = np.arange(self.n) - self.first[self.owner]
        self.symbol = symbols[places]
        rare = np.flatnonzero(self.symbol < 0)
        self.times = np.zeros(self.n, dtype=np.int64)
        self.times[rare] = earlier(places[rare], self.owner[rare])[0]
        self.symbol[rare] = np.where(self.times[rare] > 0, code.again, code.other)
        # Words without a path before this one in its text.
        is_rare = np.zeros(self.n + 1, dtype=np.int64)
        is_rare[rare + 1] = 1
        passed = np.cumsum(is_rare)[:-1]
        self.passed = passed - passed[self.first[self.owner]] if self.n else passed
        # The group that the last blocks of words speak for, one more if they speak for none.
        heads = np.flatnonzero(self.index % BLOCK == 0)
        said = np.add.reduceat(lifts.take(places, axis=0), heads, axis=0) if self.n else lifts[:0]
        spoken = np.zeros_like(said)
        for back in range(1, REACH + 1):
            inner = np.flatnonzero(self.index[heads] >= back * BLOCK)
            spoken[inner] += said[inner - back]
        group = np.where(spoken.max(axis=1, initial=0) > 1e-3, spoken.argmax(axis=1), lifts.shape[1])
        self.group = np.repeat(group, np.diff(np.append(heads, self.n)))
        one, two = (self._back(places, marks, k) for k in (1, 2))
        both = mix(one * _ODD + two)
        self.contexts = [mix(self.group.astype(np.uint64)), mix(one + np.uint64(1 << 40)), mix(both + np.uint64(1 << 41))]
        # What came after the same word, earlier in the text; 2 if two words are the same.
        before = np.concatenate([[-1], places[:-1]])[: self.n].astype(np.int64)
        before[self.first] = -1
        inner = np.flatnonzero(before >= 0)
        last = earlier(before[inner], self.owner[inner])[1]
        met = np.full(self.n, -1, dtype=np.int64)
        met[inner[last >= 0]] = inner[last[last >= 0]]
        # Up to this depth the earlier place expects a bit, the last of them a wrong one.
        self.agree = np.where(met >= 0, code.common(self.symbol, self.symbol[met]), -1)
        self.same = np.where(two == two[met], 3, 1)

    def _back(self, places: np.ndarray, marks: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(self.n, dtype=np.uint64)
        out[k:] = marks[places[: self.n - k]] + np.uint64(1)
        out[self.index < k] = 0
        return out

    def bits(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the tokens ``at``, one after the other: the token of each bit, the bits, their depth,
        what the earlier place expects, and their slots in each table."""
        symbol = self.symbol[at]
        n = self.code.length[symbol]
        depth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        path, left = np.repeat(self.code.paths[symbol], n), np.repeat(n, n) - depth
        # The path up to the bit is its node.
        step = (path >> left).view(np.uint64) * _ODD
        ones = (path >> (left - 1) & 1).astype(bool)
        agree = np.repeat(self.agree[at], n)
        expected = (np.repeat(self.same[at], n) + (ones ^ (depth == agree))) * (depth <= agree)
        np.minimum(depth, DEPTHS - 1, out=depth)
        slots = [((np.repeat(c[at], n) ^ step) * _FOLD >> np.uint64(64 - b)).view(np.int64) for c, b in zip(self.contexts, TABLE_BITS)]
        return np.repeat(at, n), ones, depth, expected, [*slots, expected * DEPTHS + depth]


def _by_state() -> tuple[np.ndarray, np.ndarray]:
    """Logits of a 1 and whether there is a count, for pairs of counts up to 255; then the same
    with a 0 taken out of the counts, then with a 1. Counts at the limit stay."""
    n0, n1 = np.arange(65536) >> 8, np.arange(65536) & 255
    exact = np.maximum(n0, n1) < 255
    pairs = [(n0, n1), (n0 - (exact & (n0 > 0)), n1), (n0, n1 - (exact & (n1 > 0)))]
    logits = np.concatenate([np.log((b + 0.3) / (a + 0.3)) for a, b in pairs])
    return logits.astype(np.float32), np.concatenate([a + b > 0 for a, b in pairs]).astype(np.int8)


def weighed(x: np.ndarray, weights: np.ndarray, gate: np.ndarray, own: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """Logits of a 1: inputs by the weights of their gate, and their text's own (``sizes`` bits each)."""
    logit = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(INPUTS):
        chosen = np.ascontiguousarray(weights[:, k]).take(gate)
        if own is not None:
            chosen += np.repeat(own[:, k], sizes)
        logit += chosen * x[k]
    return np.clip(logit, -13, 13)


class WordMixer:
    """Tables of the predictors, weights by gate, and the table that refines what they say."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.logits, self.seen = _by_state()
        self.weights = np.full((DEPTHS * GATES, INPUTS), 0.3)
        self.cells = np.zeros((2, DEPTHS * GATES * CELLS))
        self.steps = 0

    def __getstate__(self) -> dict:
        # Tables that were sent to executors are not sent again.
        left_out = {"logits", "seen"} | ({"tables"} if "sent" in vars(self) else set())
        return {name: value for name, value in vars(self).items() if name not in left_out}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.logits, self.seen = _by_state()
        if "sent" in state:
            self.tables = self.sent.value

    def inputs(self, tokens: Tokens, at: np.ndarray, without: bool) -> tuple[np.ndarray, ...]:
        """Tokens, bits, inputs and gates. ``without`` takes the bit itself out of the counts, for
        texts that the tables were learned from."""
        token, ones, depth, expected, slots = tokens.bits(at)
        x, known = np.empty((INPUTS, len(ones)), dtype=np.float32), np.zeros(len(ones), dtype=np.int8)
        own = (1 + ones) * 65536
        for k, slot in enumerate(slots):
            state = self.tables[k].take(slot)
            state = own + state if without else state.astype(np.int64)
            self.logits.take(state, out=x[k], mode="clip")
            if 0 < k < INPUTS - 1:
                np.maximum(known, self.seen.take(state) * np.int8(k), out=known)
        return token, ones, x, (depth * 3 + known) * 5 + expected

    def _cell(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * CELLS + np.clip((logit + 8) * (CELLS / 16), 0, CELLS - 1).astype(np.int64)

    def learn(self, tokens: Tokens) -> None:
        """Down the gradient of the coding cost for each gate, mean over its bits, step by step."""
        seen = np.zeros(2 * self.cells.shape[1], dtype=np.int64)
        for lo in range(0, tokens.n, STEP_TOKENS):
            self.steps += 1
            rate = max(0.5 / math.sqrt(self.steps), 0.02)
            _, ones, x, gate = self.inputs(tokens, np.arange(lo, min(tokens.n, lo + STEP_TOKENS)), without=True)
            logit = weighed(x, self.weights.astype(np.float32), gate)
            wrong = ones - 1 / (1 + np.exp(-logit))
            n = np.maximum(np.bincount(gate, minlength=len(self.weights)), 50)
            for k in range(INPUTS):
                self.weights[:, k] += rate * np.bincount(gate, wrong * x[k], len(self.weights)) / n
            seen += np.bincount(self._cell(logit, gate) * 2 + ones, minlength=len(seen))
        self.cells += np.stack([seen.reshape(-1, 2).sum(axis=1), seen[1::2]])

    def cost(self, tokens: Tokens) -> np.ndarray:
        """Natural logarithm of the probability of each text's paths. Weights follow the text:
        after each block of its tokens they take a step of their own."""
        out, own = np.zeros(len(tokens.counts)), np.zeros((len(tokens.counts), INPUTS), dtype=np.float32)
        block = tokens.index // BLOCK
        by = np.argsort(block, kind="stable")
        ends = np.cumsum(np.bincount(block))
        weights = self.weights.astype(np.float32)
        # Half of what a cell was learned from, and half of the share that is left to the mixture.
        part = ((1 / (self.cells[0] + 4)) / 2).astype(np.float32)
        hits, left = self.cells[1].astype(np.float32) * part, np.float32(0.5) + 4 * part
        lo = 0
        while lo < len(ends):
            # So many blocks at once as have about TOKENS tokens.
            start = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, start + TOKENS, side="right")))
            token, ones, x, gate = self.inputs(tokens, by[start : ends[hi - 1]], without=False)
            owner, cuts = tokens.owner.take(token), np.searchsorted(block.take(token), np.arange(lo, hi + 1))
            for a, b in zip(cuts, cuts[1:]):
                heads = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
                texts, sizes = owner[a:b][heads], np.diff(np.append(heads, b - a))
                inputs, g = x[:, a:b], gate[a:b]
                logit = weighed(inputs, weights, g, own[texts], sizes)
                p, at = 1 / (1 + np.exp(-logit)), self._cell(logit, g)
                wrong = ones[a:b] - p
                p = np.clip(hits.take(at) + left.take(at) * p, LIMIT, 1 - LIMIT)
                out[texts] += np.add.reduceat(np.log(np.where(ones[a:b], p, 1 - p)), heads, dtype=float)
                own[texts] += RATE * (np.add.reduceat(wrong * inputs, heads, axis=1) / sizes).T
            lo = hi
        return out


def count_bits(counts: list[np.ndarray], tokens: Tokens) -> None:
    """Adds a 0 or 1 to each table's ``counts`` (slot and bit) for every bit of the tokens."""
    for lo in range(0, tokens.n, TOKENS):
        _, ones, _, _, slots = tokens.bits(np.arange(lo, min(tokens.n, lo + TOKENS)))
        for k, slot in enumerate(slots):
            np.add.at(counts[k], slot * 2 + ones, np.int32(1))


def groups_of(counts: np.ndarray, size: int = 300_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that have about ``size`` tokens together."""
    stops = np.cumsum(counts)
    cuts = np.flatnonzero(np.diff(stops // size)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)])
