"""LM scoring: online logistic mixing of hashed-context bit predictors and, beside it, of token counts.

A text is its tokens: words with A-Z lower-cased, and one end. A frequent token is coded as a whole, by
binary decisions along Huffman's tree of the frequent tokens; any other by an escape in that tree and then
byte by byte, with a space at its end, along trees that depend on the two bytes before. For every decision,
predictors look up the log odds of a one under hashes of different contexts; they are added up with
weights that a gate chooses, and the weights of each gate go down the gradient of what the decisions cost
as the document goes on. They begin at one value in every document: nothing is fitted beforehand, so a
score depends on the corpus counts and on the text alone.

The probability of a token is a mixture: a share of it is the token's share of all training tokens
(exact counts, a table that grows with the corpus and is joined), the rest is the product of its
decisions. Both add up to one over all tokens at most, so the score is that of a code. The share is
refined within a document, by how much of the tokens before the counts explain.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.llm.common import fold_of, runs, slices, stage, table, texts

#: Predictors. Of a frequent token: the last short token (short words tell languages apart), the token
#: before, the two before. Of a byte: order 3, order 5, both within the word, and the word so far after the
#: last short token.
PREDICTORS = 3
#: The slots of each predictor's table, as a power of two: one for each byte of training text, within
#: bounds that keep what every executor holds below 40 MB.
LEAST_BITS, MOST_BITS = 12, 22
#: Bytes of a short word at most.
SHORT = 4
CONTEXT = 5
NOTHING = b"\n" * CONTEXT
#: Tokens whose decisions are made at once; a longer text is taken in stretches.
RUN_TOKENS = 1 << 15
#: Tokens whose decisions are counted at once.
COUNTED = 1 << 12
#: Tokens of a document after which its weights learn; a step is longer where it is less than a share of what came before.
STEP, LATER = 64, 8
#: The share of the longest safe step that weights take, and the curvature that they start against.
RATE, STIFF = 1.0, 1000.0
#: What the weights of log odds in tenths begin at, and the input of the last weight, a constant.
START, BIAS = 0.03, 10.0
#: A gate is, of a frequent token, whether the one before is short and, of a byte, its place in the word up to the fourth.
GATES = 6
#: The share of the token counts in a token's probability at first, what it weighs in tokens, and the tokens of a step.
SHARE, TRUST, TOKENS = 1 / 8, 16, 32
#: So many of the most frequent tokens, of those that occur LEAST times, are coded as a whole, their counts looked up in
#: memory; all others are spelled, and their counts joined.
FREQUENT, LEAST = 1 << 18, 8
CHUNK = 1 << 15
#: Groups of a byte, for the trees: its low bits.
GROUPS = 16
_POWER, _INVERSE = 0x01000193, pow(0x01000193, -1, 1 << 32)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A finaliser for 32-bit hashes."""
    x = (x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA6B)
    x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE3D)
    return x ^ x >> np.uint32(16)


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(2 * node + bit along the ways to all symbols, the lengths of the ways)."""
    n = len(weights)
    heap = [(w, s) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    up = np.zeros(2 * n, np.int64)
    for fresh in range(n, 2 * n - 1):
        w, a = heapq.heappop(heap)
        v, b = heap[0]
        heapq.heapreplace(heap, (w + v, fresh))
        up[a], up[b] = 2 * (fresh - n), 2 * (fresh - n) + 1
    root, at = 2 * n - 2, np.arange(n)
    owner, steps, depth = [], [], []
    k = 0
    while len(live := np.flatnonzero(at != root)):
        owner.append(live)
        steps.append(up[at[live]])
        depth.append(np.full(len(live), k))
        at[live] = n + (up[at[live]] >> 1)
        k += 1
    if not owner:
        return np.empty(0, np.int64), np.zeros(n, np.int64)
    owner, steps, depth = (np.concatenate(x) for x in (owner, steps, depth))
    order = np.lexsort((-depth, owner))
    return steps[order], np.bincount(owner, minlength=n)


class Code:
    """The frequent tokens, and the way of decisions to each of them, to the escape and to each byte.

    A byte's tree is that of the byte before and a group of the one before that. A tree is cut into pieces of
    three levels. node is, of each decision, a hash of the tree and its piece's top, then in four bits the place in
    the piece and the decision: slots of one piece under one context are neighbours, of eight that lie in one line
    of memory.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], others: int, after: np.ndarray) -> None:
        self.number = {t: k for k, (t, _) in enumerate(frequent)}
        self.short = np.array([len(t) <= SHORT for t, _ in frequent] + [False])
        node, lengths = [], []

        def add(weights: list[int], tree: int) -> np.ndarray:
            steps, length = huffman(weights)
            level = (np.arange(len(steps)) - np.repeat(np.cumsum(length) - length, length)) % 3
            top, bit = np.arange(len(steps)) - level, steps & 1
            place = np.where(level == 0, 0, np.where(level == 1, 1 + bit[top], 3 + 2 * bit[top] + bit[np.minimum(top + 1, len(steps) - 1)]))
            x = scrambled((steps[top] >> 1).astype(np.uint32) + np.uint32(tree))
            node.append(x & ~np.uint32(15) | (2 * place + bit).astype(np.uint32))
            lengths.append(length)
            return length

        add([n for _, n in frequent] + [max(1, others)], 1 << 28)
        trees = np.zeros(GROUPS << 8, np.int64)
        add([1] * 256, 1 << 27)  # of all contexts that were never seen
        seen = 0
        for tree in np.flatnonzero(after.reshape(-1, 256).any(axis=1)).tolist():
            seen += 1
            trees[tree] = seen
            add((after[tree * 256 : tree * 256 + 256].astype(np.int64) * 64 + 1).tolist(), (tree + 1) << 8)
        self.trees = trees
        self.node, length = np.concatenate(node), np.concatenate(lengths)
        self.first, self.length = (np.cumsum(length) - length).astype(np.int32), length.astype(np.int32)
        self.bytes_at = len(frequent) + 1


_POWERS: list[np.ndarray] = [np.ones(1, np.uint32)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**32, kept for the next call."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_POWER, _INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint32), np.full(2 * n, x, np.uint32)]), dtype=np.uint32)
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Units:
    """What is coded by one way through a tree: a frequent token, an escape, a byte."""

    way: np.ndarray
    hashes: list[np.ndarray]
    gate: np.ndarray
    token: np.ndarray


class Texts:
    """Tokens of whole texts, one text after another, each with its number (len(frequent): not frequent) and its contexts."""

    def __init__(self, texts_tokens: list[list[bytes]], code: Code) -> None:
        self.code = code
        self.tokens = [w for some in texts_tokens for w in some]
        self.size = np.array([len(w) for w in texts_tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        none = code.bytes_at - 1
        self.id = np.fromiter(map(code.number.get, self.tokens, repeat(none)), np.int64, len(self.tokens))
        self.rare = np.flatnonzero(self.id == none)
        n = len(self.id)
        name = scrambled(self.id.astype(np.uint32) + np.uint32(1))
        first = np.zeros(n, bool)
        first[self.start] = True
        short = code.short[self.id]
        short[self.rare] = [len(self.tokens[k]) <= SHORT for k in self.rare]
        begin = np.repeat(self.start, self.size)
        recent = np.maximum.accumulate(np.concatenate([[-1], np.where(short, np.arange(n), -1)[:-1]])) if n else np.empty(0, np.int64)
        self.hint = np.where(recent >= begin, name[np.maximum(recent, 0)], np.uint32(0))
        self.before = np.where(first, np.uint32(0), np.concatenate([np.zeros(1, np.uint32), name[:-1]])) if n else name
        self.two = np.where(first, np.uint32(0), np.concatenate([np.zeros(1, np.uint32), self.before[:-1]])) if n else name
        self.after_short = np.where(first, False, np.concatenate([[False], short[:-1]])) if n else short

    def units(self, a: int, b: int) -> Units:
        """Those of the tokens from a to b, first the frequent tokens and escapes, then all bytes."""
        code = self.code
        hint, before = self.hint[a:b], self.before[a:b]
        hashes = [[scrambled(hint + np.uint32(11)), scrambled(before + np.uint32(0x5851F42D)), scrambled(before * np.uint32(0x9E3779B1) + self.two[a:b])]]
        way, gate, token = [self.id[a:b]], [self.after_short[a:b].astype(np.uint8)], [np.arange(b - a)]
        low, high = np.searchsorted(self.rare, [a, b])
        spelled = self.rare[low:high]
        if len(spelled):
            words = [self.tokens[k] for k in spelled.tolist()]
            size = np.array([len(w) + 1 for w in words], np.int64)
            start = np.cumsum(size) - size
            n = int(size.sum())
            whole = NOTHING + (b" " + NOTHING).join([*words, b""])
            place = np.arange(n) - np.repeat(start, size)
            real = np.arange(n) + np.repeat(CONTEXT * np.arange(1, len(words) + 1), size)
            raw = np.frombuffer(whole, np.uint8)
            data = raw[real]
            four = np.ndarray((len(whole) - 4,), np.uint32, whole, 0, (1,))[real - 4]
            up, down = _powers(n + 1)
            sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum((data.astype(np.uint32) + np.uint32(1)) * up[:n], dtype=np.uint32)])
            so_far = (sums[:n] - np.repeat(sums[start], size)) * np.repeat(down[start], size)
            hints = np.repeat(hint[spelled - a], size)
            hashes.append([scrambled(four >> np.uint32(8)), scrambled(four ^ raw[real - 5].astype(np.uint32) * np.uint32(0x85EBCA77)), scrambled(so_far + hints * np.uint32(0xC2B2AE35) + np.uint32(5))])
            tree = code.trees[(four >> np.uint32(24)) * np.uint32(GROUPS) + (four >> np.uint32(16) & np.uint32(GROUPS - 1))]
            way.append(code.bytes_at + tree * 256 + data)
            gate.append((2 + np.minimum(place, 3)).astype(np.uint8))
            token.append(np.repeat(spelled - a, size))
        return Units(np.concatenate(way), [np.concatenate(h) for h in zip(*hashes, strict=True)], np.concatenate(gate), np.concatenate(token))


def expanded(units: Units, code: Code, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of all decisions of the units, in order: the slot of each predictor, the bit, and where each unit begins, and one more."""
    length = code.length[units.way]
    ends = np.cumsum(length, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    begins = ends - length
    k = np.repeat(code.first[units.way] - begins, length)
    k += np.arange(total)
    leaf = code.node[k]
    node, place = leaf & ~np.uint32(15), leaf >> np.uint32(1) & np.uint32(7)
    slots = []
    for h in units.hashes:
        x = np.repeat(h, length)
        x += node
        x >>= np.uint32(32 - bits)
        x ^= place
        slots.append(x.astype(np.intp))
    return slots, (leaf & np.uint32(1)).astype(np.uint8), np.append(begins, total)


def token_runs(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """[from, to) of consecutive texts of RUN_TOKENS at most, or of one longer text."""
    at, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > at and held + n > RUN_TOKENS:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(size):
        yield at, len(size)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """ln((ones + 0.3) / (zeros + 0.3)) of pairs of counts, in tenths: near zero where little was seen."""
    both = counts.reshape(-1, 2).astype(np.float32)
    return np.clip(np.rint(10 * np.log((both[:, 1] + np.float32(0.3)) / (both[:, 0] + np.float32(0.3)))), -127, 127).astype(np.int8)


@dataclass
class Model:
    code: Code
    bits: int
    #: log odds of the slots of each predictor
    odds: list[np.ndarray]

    def costs(self, some: Texts, first: int, last: int) -> np.ndarray:
        """What each token of the texts from first to last costs in nats: one run, or one long text in stretches.

        Each text has weights of its own. The decisions of a step are coded by the weights before it, which then go
        down the gradient, by a step that the curvature met so far bounds: it can't overshoot.
        """
        n = last - first
        weights = [np.full(n * GATES, START if k < PREDICTORS else 0, np.float32) for k in range(PREDICTORS + 1)]
        stiff = np.full(n * GATES, STIFF, np.float32)
        begin, end = int(some.start[first]), int(some.start[last - 1] + some.size[last - 1])
        longest = int(some.size[first:last].max())
        edges = [0]
        while edges[-1] < longest:
            edges.append(edges[-1] + max(STEP, edges[-1] // LATER))
        steps = np.array(edges)
        out = []
        at = begin
        while at < end:
            to = end if n > 1 else min(end, begin + edges[max(int(np.searchsorted(steps, at - begin + RUN_TOKENS, side="right")) - 1, int(np.searchsorted(steps, at - begin, side="right")))])
            out.append(self._stretch(some, first, last, at, to, steps, weights, stiff))
            at = to
        return np.concatenate(out)

    def _stretch(self, some: Texts, first: int, last: int, a: int, b: int, steps: np.ndarray, weights: list[np.ndarray], stiff: np.ndarray) -> np.ndarray:
        n = last - first
        units = some.units(a, b)
        where = np.arange(a, b) - np.repeat(some.start[first:last], some.size[first:last])[: b - a] if n > 1 else np.arange(a, b) - some.start[first]
        step = np.searchsorted(steps, where, side="right") - 1
        low = int(step.min())
        text = np.repeat(np.arange(n), some.size[first:last]) if n > 1 else np.zeros(b - a, np.int64)
        # units in order of step, text and gate: what shares weights stands together
        key = ((step - low) * n + text)[units.token] * GATES + units.gate
        order = np.argsort(key.astype(np.uint16) if int(key.max()) < 1 << 16 else key, kind="stable")
        key = key[order]
        units = Units(units.way[order], [h[order] for h in units.hashes], units.gate, units.token[order])
        slots, bit, starts = expanded(units, self.code, self.bits)
        odds = [o.take(s, mode="wrap") for o, s in zip(self.odds, slots, strict=True)]
        del slots
        cost = np.empty(len(bit), np.float32)
        groups = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        group_key, group_at = key[groups], starts[np.append(groups, len(key))]
        per_step = np.searchsorted(group_key, np.arange(int(step.max()) - low + 2) * n * GATES)
        for f, t in zip(per_step[:-1].tolist(), per_step[1:].tolist(), strict=True):
            x0, x1 = int(group_at[f]), int(group_at[t])
            if x0 == x1:
                continue
            group = group_key[f:t] % (n * GATES)
            edge = group_at[f:t] - x0
            each = group_at[f + 1 : t + 1] - group_at[f:t]
            # a frequent token that is alone in its tree takes no decision
            full = each > 0
            group, edge, each = group[full], edge[full], each[full]
            z = np.repeat(weights[PREDICTORS][group] * np.float32(BIAS), each)
            xs, square = [], np.full(x1 - x0, BIAS * BIAS, np.float32)
            for o, w in zip(odds, weights, strict=False):
                x = o[x0:x1].astype(np.float32)
                xs.append(x)
                z += np.repeat(w[group], each) * x
                square += x * x
            np.clip(z, -20, 20, out=z)
            sign = bit[x0:x1].astype(np.float32)
            sign *= 2
            sign -= 1
            z *= -sign
            np.exp(z, out=z)
            np.log1p(z, out=cost[x0:x1])
            z /= z + np.float32(1)
            square *= z - z * z
            stiff[group] += np.add.reduceat(square, edge)
            z *= sign  # the decision less its probability
            rate = np.float32(RATE) / stiff[group]
            for x, w in zip(xs, weights, strict=False):
                x *= z
                w[group] += rate * np.add.reduceat(x, edge)
            weights[PREDICTORS][group] += np.float32(BIAS) * rate * np.add.reduceat(z, edge)
        sums = np.concatenate([np.zeros(1), np.cumsum(cost, dtype=np.float64)])
        return np.bincount(units.token, sums[starts[1:]] - sums[starts[:-1]], b - a)

    def token_costs(self, some: Texts) -> np.ndarray:
        """What each token of whole texts costs in nats, one text after another."""
        out = [self.costs(some, a, b) for a, b in token_runs(some.size)]
        return np.concatenate(out) if out else np.empty(0)


def _fold(batch: pa.RecordBatch, items: list[bytes]) -> list[bytes]:
    return [t for t, learn in zip(items, batch["learn"].to_pylist(), strict=True) if learn]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens and, for the trees, of bytes after two bytes of a word, of the documents to learn from."""
    after, tokens = np.zeros(GROUPS << 16, np.int64), Counter()

    def flush() -> pa.RecordBatch:
        words, n = list(tokens.keys()), np.fromiter(tokens.values(), np.int64, len(tokens))
        data = np.frombuffer(b"  " + b" ".join([*words, b""]), np.uint8)
        gap = data == 0x20
        one, two = data.astype(np.int32), data.astype(np.int32)
        one[gap] = NOTHING[0]
        two[gap] = NOTHING[0]
        two[:-1][gap[1:]] = NOTHING[0]
        times = np.repeat(n, [len(w) + 1 for w in words])
        after[:] += np.bincount((one[1:-1] * GROUPS + (two[:-2] & (GROUPS - 1))) * 256 + data[2:], times, GROUPS << 16).astype(np.int64)
        tokens.clear()
        return pa.RecordBatch.from_pydict({"token": pa.array(words, pa.binary()), "n": pa.array(n)})

    for batch in slices(batches):
        items = _fold(batch, texts(batch["text"]))
        for t in items:
            tokens.update(t.lower().split())
        tokens[b""] += len(items)
        if len(tokens) > 300_000:
            yield flush()
    yield flush()
    # these go the same way, under keys that no token has: a space and three bytes
    some = np.flatnonzero(after)
    yield pa.RecordBatch.from_pydict({"token": pa.array([b" " + int(k).to_bytes(3, "big") for k in some], pa.binary()), "n": pa.array(after[some])})


def _counts(batches: Iterator[pa.RecordBatch], code, bits: int) -> Iterator[pa.RecordBatch]:
    """Each task's counts of zeros and ones, a chunk of a table a row: by slot where few are there, else all of them."""
    held = [np.zeros(2 << bits, np.uint32) for _ in range(PREDICTORS)]
    for batch in slices(batches):
        some = Texts([[*t.lower().split(), b""] for t in _fold(batch, texts(batch["text"]))], code.value)
        for at in range(0, len(some.id), COUNTED):
            slots, bit, _ = expanded(some.units(at, min(len(some.id), at + COUNTED)), code.value, bits)
            for h, s in zip(held, slots, strict=True):
                s += s
                s += bit
                np.add.at(h, s, np.uint32(1))
    for k, h in enumerate(held):
        for at in range(0, len(h), CHUNK):
            part = h[at : at + CHUNK]
            most = int(part.max())
            for shift in range(0, most.bit_length(), 8):
                plane = (part >> np.uint32(shift)).astype(np.uint8)
                some = np.flatnonzero(plane)
                if len(some):
                    sparse = 3 * len(some) < len(plane)
                    slots, counts = (some.astype("<u2").tobytes(), plane[some].tobytes()) if sparse else (None, plane.tobytes())
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([k * 4096 + at // CHUNK], pa.int32()), "shift": pa.array([shift], pa.int32()), "slots": pa.array([slots], pa.binary()), "counts": pa.array([counts], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks' log odds: a task streams its rows into a table for each chunk that it was dealt."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, shift, slots, counts in zip(*(batch[c].to_pylist() for c in ("chunk", "shift", "slots", "counts")), strict=True):
            at = slice(None) if slots is None else np.frombuffer(slots, "<u2")
            got = np.frombuffer(counts, np.uint8).astype(np.int64) << shift
            held.setdefault(chunk, np.zeros(max(CHUNK, 1), np.int64))[: len(got) if slots is None else None][at] += got
    for chunk, total in held.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "odds": pa.array([log_odds(total).tobytes()], pa.binary())})


def mixture(value: np.ndarray, cost: np.ndarray, size: np.ndarray, log_all: float) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens of several texts, log p with those of value -1 taken as unknown, and ln(share / (1 - share)).

    value is log10 of a token's count and one, cost its decisions' in nats, size the tokens of each text.
    """
    counted = np.where(value >= 0, (value - log_all) * np.log(10), -np.inf)
    out, odds = np.empty(len(cost)), np.empty(len(cost))
    share = np.full(len(size), SHARE * TRUST)
    first = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    alive, done = len(order), 0
    while True:
        while alive and size[order[alive - 1]] <= done:
            alive -= 1
        if not alive:
            return out, odds
        now = order[:alive]
        step = max(TOKENS, done // LATER)
        n = np.minimum(size[now] - done, step)
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(first[now] + done - begin, n)
        part = share[now] / (TRUST + done)
        told, spelled = counted[at] + np.repeat(np.log(part), n), np.repeat(np.log1p(-part), n) - cost[at]
        out[at] = np.logaddexp(told, spelled)
        odds[at] = np.repeat(np.log(part) - np.log1p(-part), n)
        share[now] += np.add.reduceat(np.exp(told - out[at]), begin)
        done += step


def _score(batches: Iterator[pa.RecordBatch], model, logs, log_all: float) -> Iterator[pa.RecordBatch]:
    """Scores as if no token but the frequent ones were known; the others are listed with what knowing them is worth."""
    learned = model.value
    for batch in slices(batches):
        words = [[*t.lower().split(), b""] for t in texts(batch["text"])]
        some = Texts(words, learned.code)
        cost = learned.token_costs(some)
        value = logs.value[some.id]
        hit = value >= 0
        nats, odds = mixture(value, cost, some.size, log_all)
        ends = pa.array(np.searchsorted(some.rare, np.append(some.start, len(value))).astype(np.int32))
        sums = (lambda x, at=some.start: np.add.reduceat(x, at)) if len(some.size) else (lambda x: np.zeros(0, x.dtype))
        out = {name: batch[name] for name in batch.schema.names if name not in ("text", "learn")}
        yield pa.RecordBatch.from_pydict(
            out
            | {"n_tokens": pa.array(some.size), "hits": pa.array(sums(hit.astype(np.int64))), "sums": pa.array(sums(np.where(hit, value, 0.0))), "nats": pa.array(sums(nats)), "n_bytes": pa.array([sum(map(len, w)) + len(w) for w in words], pa.int64())}
            | {"rare": pa.ListArray.from_arrays(ends, pa.array([some.tokens[k] for k in some.rare.tolist()], pa.binary())), "costs": pa.ListArray.from_arrays(ends, pa.array((cost + odds)[some.rare], pa.float64()))}
        )


def score(docs: DataFrame, folds: int = 7, left_out: int = 2) -> DataFrame:
    """One row per row of docs (doc_id, text; others are not read), of whole texts, learning from the rows outside a fold.

    doc_id, held_out (crc32 of the id as text modulo folds is left_out; a null id never is), n_tokens
    (words and the end), n_known (those that training texts hold), train_tokens, base_score (unigram,
    one added to each count), score (the mixed model's log10 probability of the text) and
    bits_per_byte (score in bits, by bytes of the tokens, one more for each). A null text is empty: its one token is the end. Equal rows are
    rows of their own; an empty table has no rows. Where nothing is left to learn from, counts are 0. Of equally
    frequent tokens the lesser bytes come first.

    Token counts and the predictors' counts are over all training rows. The predictors' tables grow
    with the training text up to 2**MOST_BITS slots each, so what goes to the executors is bounded (some 20 MB with the
    frequent tokens); counts of all other tokens grow without a bound and are joined.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    fold = fold_of("doc_id", folds)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (fold != left_out).alias("learn"))
    counted_rows = rows.where("learn").select("text", "learn").mapInArrow(_tokens, "token binary, n long")
    counts = stage(counted_rows.groupBy("token").agg(F.sum("n").alias("n")), "lm-tokens")
    is_byte = F.substring("token", 1, 1) == F.lit(b" ")
    after = np.zeros(GROUPS << 16, np.int64)
    for token, n in counts.where(is_byte).collect():
        after[int.from_bytes(token[1:], "big")] = n
    tokens = counts.where(~is_byte & (F.col("n") > 0))
    train_tokens, distinct, n_bytes = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") * (F.octet_length("token") + 1)), F.lit(0))).first()
    log_all = float(np.log10(train_tokens + distinct + 1))
    top = tokens.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "token").limit(FREQUENT)
    listed = top.select("token", "n").toArrow()
    n = listed["n"].to_numpy()
    code = Code(list(zip(listed["token"].to_pylist(), n.tolist(), strict=True)), train_tokens - int(n.sum()), after)
    logs = np.append(np.log10(n + 1.0), -1.0)
    bits = min(MOST_BITS, max(LEAST_BITS, n_bytes.bit_length()))
    parts = rows.where("learn").select("text", "learn").mapInArrow(partial(_counts, code=sc.broadcast(code), bits=bits), "chunk int, shift int, slots binary, counts binary")
    n_chunks = PREDICTORS * max(1, (2 << bits) // CHUNK)
    summed = parts.repartition(min(n_chunks, 64), "chunk").mapInArrow(_summed, "chunk int, odds binary")
    odds = [np.zeros(1 << bits, np.int8) for _ in range(PREDICTORS)]
    for chunk, got in summed.collect():
        k, at = divmod(chunk, 4096)
        part = np.frombuffer(got, np.int8)
        room = odds[k][at * CHUNK // 2 : (at + 1) * CHUNK // 2]
        room[:] = part[: len(room)]
    model = Model(code, bits, odds)
    ids = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "learn")
    kind = rows.schema["doc_id"].dataType.simpleString()
    run = partial(_score, model=sc.broadcast(model), logs=sc.broadcast(logs), log_all=log_all)
    made = ids.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, hits long, sums double, nats double, n_bytes long, rare array<binary>, costs array<double>")
    held = stage(made, "lm-rows")
    rare = held.select("row", F.explode(F.arrays_zip("rare", "costs")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.costs").alias("cost"))
    share = F.log10(F.col("n") + 1.0) - F.lit(log_all)
    # log10(1 + share of the counts / share of the decisions * the token's count / probability of its decisions), without overflow
    gain = share + F.col("cost") / F.lit(float(np.log(10)))
    gain = F.greatest(gain, F.lit(0.0)) + F.log1p(F.pow(F.lit(10.0), -F.abs(gain))) / F.lit(float(np.log(10)))
    found = rare.join(tokens.select("token", "n"), "token").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("add"), F.sum(gain).alias("gain"))
    joined = held.drop("rare", "costs").join(found, "row", "left")
    scored = F.col("nats") / F.lit(float(np.log(10))) + F.coalesce("gain", F.lit(0.0))
    return joined.select(
        "doc_id",
        (fold_of("doc_id", folds) == left_out).alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        scored.alias("score"),
        (-scored / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
