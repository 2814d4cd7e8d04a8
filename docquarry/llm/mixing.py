"""Logistic context mixing over the bits of a byte code, for whole batches of texts.

A text is its lower-cased bytes and then ``END``. Each byte is a path in a Huffman tree that
the two bytes before it choose, so it costs a few binary decisions. Each is predicted:

* predictors: for each context (see ``CONTEXTS``; two of them cross words) a hashed table gives
  the stretched probability of a 1 at this node of the tree, counted over all training texts;
  one more predictor knows the text alone: the byte that followed the same context last;
* gated weights: how often training saw the longest contexts, and how steady the text's own
  predictor was, choose the gate whose weights sum the predictors' inputs; each text adds
  weights of its own, which learn online as the text goes by;
* adaptive refinement: a table of each text, indexed by the mixed prediction, learns what
  really followed, and is averaged in.

Texts are scored in blocks of bytes: a block is predicted with the text's weights and
refinement as they were before it. So a score depends on the trained model and on the text
alone, never on the batch. A text longer than ``SPAN`` bytes goes on in pieces: contexts start
anew with each, weights and refinement are carried on.
"""

from __future__ import annotations

import heapq

import numpy as np

END = 255
END_BYTE = b"\xff"  # UTF-8 never holds it
SPAN = 1 << 18
#: Bytes and texts scored together.
BATCH, MOST = 200_000, 4000
#: Bytes counted together: so few that their arrays stay in a core's cache.
GROUP = 24_000
#: Last 4 bytes; word so far after the last 3 bytes of the word before; word so far; word so
#: far after the word before.
CONTEXTS = ("four", "tail", "word", "last")
#: Most slots of their tables, as powers of two.
SIZES = (21, 22, 22, 22)
#: The contexts whose counts choose the gate: counts from which the next class begins.
SEEN = {"word": (1, 4, 20), "last": (1, 3, 12)}
#: The context of the text's own predictor, and its inputs by how often in a row it held.
OWN, RUN_INPUT = "tail", np.array([0, 24, 40, 56], np.int8)
INPUTS = len(CONTEXTS) + 1
RUNS = len(RUN_INPUT)
GATES = 4 * 4 * RUNS
#: The own predictor's inputs by row, bit and whether the guess is right.
_SIGNED = np.array([x if bit == right else -x for x in RUN_INPUT.tolist() for bit in (0, 1) for right in (0, 1)], np.int8)
SCALE = 16.0  # steps of a stored stretched probability
FIRST_WEIGHT = 0.2
#: Contexts of two bytes with a tree of their own, and the count that they need.
TREES, TREE_COUNT = 1024, 1024
RATE, CALM = 0.015, 24
CELLS, REFINED, PRIOR = 32, 0.35, 24.0

_U32, _U64 = np.uint32, np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32, END]] = True
#: Odd multipliers of the hashes.
_M = tuple(map(_U32, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)))
_MIX, _PAIR, _FOLD = _U32(0x2C1B3C6D), _U32(0xD3A2646D), _U64(0xD6E8FEB86659FD93)
_STEP = 0x9E3779B97F4A7C15
_ONE = np.arange(SPAN + BATCH + 1) > 0
_POWERS, _INVERSE = (np.cumprod(np.where(_ONE, _U64(x), _U64(1)), dtype=_U64) for x in (_STEP, pow(_STEP, -1, 1 << 64)))


def block_stops(size: int) -> np.ndarray:
    """Where the blocks of a piece end: 48 bytes at first, 4096 at most."""
    stops, at, step = [], 0, 48
    while at < size:
        at += step
        stops.append(at)
        step = min(4096, step + step // 4)
    return np.array(stops, np.int64)


_BLOCK = np.searchsorted(block_stops(SPAN), np.arange(SPAN), side="right").astype(np.uint16)


def pieces(text: bytes) -> list[bytes]:
    data = text + END_BYTE
    return [data[i : i + SPAN] for i in range(0, len(data), SPAN)]


class Code:
    """Huffman codes: one for each byte before, and one for each two bytes before that are
    frequent enough. ``one`` counts (byte before, byte); ``two`` has the counts of the
    frequent pairs before, as rows (256 * second last + last): array of 256."""

    def __init__(self, one: np.ndarray, two: dict[int, np.ndarray]):
        whole = one.sum(0)
        self.share = whole * 256 // max(1, int(whole.sum()))
        self.tree = (np.arange(65536) & 255).astype(np.int64)
        parts: list[tuple] = []
        self.nodes: list[int] = []
        self.turns: list[int] = []
        for p in range(256):
            parts.append(self._tree(one[p]))
        for pair in sorted(two):
            self.tree[pair] = len(parts)
            parts.append(self._tree(two[pair]))
        self.first, self.length, self.path = (np.concatenate(x) for x in zip(*parts, strict=True))
        m = (np.array(self.nodes, _U32) + _U32(1)) * _M[0]
        #: Of every decision: the node's hash, whose lowest bit is the decision itself.
        self.packed = ((m ^ (m >> _U32(15))) & _U32(0xFFFFFFFE)) | np.array(self.turns, _U32)
        del self.nodes, self.turns

    def _tree(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Scaled, so that no path is longer than about 30.
        weights = (counts * (1 << 20) // max(1, int(counts.sum())) + self.share + 1).tolist()
        heap = [(w, s) for s, w in enumerate(weights)]
        heapq.heapify(heap)
        children, serial = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[serial] = (a[1], b[1])
            heapq.heappush(heap, (a[0] + b[0], serial))
            serial += 1
        first, length, path = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, _U32)
        stack: list[tuple] = [(serial - 1, (), ())]
        while stack:
            node, way, turns = stack.pop()
            if node >= 256:
                stack += [(children[node][b], (*way, node - 256), (*turns, b)) for b in (0, 1)]
                continue
            first[node], length[node] = len(self.nodes), len(way)
            self.nodes += way
            self.turns += turns
            path[node] = sum(b << (31 - i) for i, b in enumerate(turns))
        return first, length, path


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges starts[i] .. starts[i] + sizes[i], in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sym = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return sym, np.cumsum(size) - size, size


def contexts(sym: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of pieces that stand one after another: the two bytes before each byte (END before a
    piece), and a 32-bit hash of each context; then of each word with the white space or end
    behind it: its first byte, and a 64-bit hash."""
    n = len(sym)
    at, of = np.arange(n), np.repeat(starts, size)
    place = np.minimum(at - of, 4).astype(np.uint8)
    past = sym.astype(_U32)
    past += _U32(1)
    h, backs = np.zeros(n, _U32), []
    for k in range(1, 5):
        back = np.zeros(n, _U32)
        if n > k:
            np.multiply(past[:-k], place[k:] >= k, out=back[k:])
        backs.append(back)
        h += back
        h *= _MIX
        h ^= h >> _U32(15)
    one, two = (backs[k] - _U32(1) & _U32(255) for k in (0, 1))
    before = (two << _U32(8)) | one
    # The word so far, by a rolling sum over powers of an odd number, taken back to its start.
    new = np.flatnonzero(_SPACE.take(one))  # where words begin, the start of each piece included
    chars = np.diff(np.append(new, n))
    begin = np.repeat(new, chars)
    total = np.zeros(n + 1, _U64)
    np.cumsum(past * _POWERS[:n], out=total[1:])
    word = total[:-1] - np.repeat(total[new], chars)
    word *= np.repeat(_INVERSE[new], chars)
    word += _U64(0x51ED27)
    word *= _FOLD
    word >>= _U64(32)
    word = word.astype(_U32)
    # Of each word start: the word before and its last three bytes, if there is one.
    from_ = of[new]
    inside, end = new > from_, np.maximum(new - 1, 0)
    last, tail = np.where(inside, word[end], _U32(0)), np.zeros(len(new), _U32)
    for k in range(1, 4):
        tail = tail * _U32(257) + np.where(end - k >= from_, past[np.maximum(end - k, 0)], _U32(0))
    found = {"four": h, "word": word}
    for name, x in (("tail", np.where(inside, tail, _U32(0))), ("last", last)):
        h = np.repeat(x * _MIX, chars)
        h ^= word
        h *= _PAIR
        h ^= h >> _U32(15)
        found[name] = h
    own = (total[np.append(new[1:], n)] - total[new]) * _INVERSE[new]
    return before.astype(np.int64), found, (new, own)


def _slots(h: np.ndarray, mixed: np.ndarray, k: int, bits: int) -> np.ndarray:
    s = h ^ mixed
    s *= _M[k]
    s >>= _U32(32 - bits)
    return s


def count(parts: list[bytes], code: Code, tables: list[np.ndarray]) -> None:
    """Add the decisions of pieces to ``tables`` (per context: slots * 2 counts). After a short
    context, which comes often, the same byte counts in one step, and so does a word that comes
    again for the context that sees no more than it."""
    sym, starts, size = _joined(parts)
    before, found, (new, own) = contexts(sym, starts, size)
    which = code.tree[before] * 256 + sym
    kind = tables[0].dtype
    key = found[CONTEXTS[0]].astype(_U64) << _U64(20)
    key |= which.astype(_U64)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(first, len(key))).astype(kind)
    key = key[first]
    of, packed = _decisions(code, (key & _U64(0xFFFFF)).astype(np.int64))
    _add(tables[0], 0, (key >> _U64(20)).astype(_U32).take(of), packed, times.take(of))
    size = np.diff(np.append(new, len(sym)))
    some, times = _distinct(own * _FOLD ^ (before[new].astype(_U64) + _U64(1)) * _U64(_STEP))
    byte, times = _ranges(new[some], size[some]), np.repeat(times.astype(kind), size[some])
    of, packed = _decisions(code, which[byte])
    k = CONTEXTS.index("word")
    _add(tables[k], k, found["word"][byte].take(of), packed, times.take(of))
    of, packed = _decisions(code, which)
    ones = np.ones(len(of), kind)
    for k in range(1, len(tables)):
        if CONTEXTS[k] != "word":
            _add(tables[k], k, found[CONTEXTS[k]].take(of), packed, ones)


def _decisions(code: Code, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all decisions on some paths: the path's place, and the code's word for it."""
    each = code.length[which]
    stop = np.cumsum(each)
    of = np.repeat(np.arange(len(each)), each)
    at = (code.first[which] - (stop - each)).take(of)
    at += np.arange(len(of))
    return of, code.packed.take(at)


def _add(table: np.ndarray, k: int, h: np.ndarray, packed: np.ndarray, times: np.ndarray) -> None:
    turn = packed & _U32(1)
    s = _slots(h, packed ^ turn, k, len(table).bit_length() - 2)
    s <<= _U32(1)
    s |= turn
    np.add.at(table, s.astype(np.intp), times)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for all with an equal key, and for how many."""
    row = _U64((1 << 22) - 1)  # no batch has as many words
    order = keys & ~row
    order |= np.arange(len(keys), dtype=_U64)
    order.sort()
    order = (order & row).astype(np.int64)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return order[first], np.diff(np.append(first, len(keys)))


def stretched(counts: np.ndarray) -> np.ndarray:
    """Signed bytes from pairs of counts (of 0, of 1)."""
    n = counts.reshape(-1, 2).astype(np.float64) + 0.3
    return np.clip(np.rint(np.log(n[:, 1] / n[:, 0]) * SCALE), -127, 127).astype(np.int8)


def classes(counts: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """For each slot, how many of ``steps`` its count reaches."""
    return np.searchsorted(np.array(steps), counts.reshape(-1, 2).sum(1), side="right").astype(np.int8)


def trained(counts: list[np.ndarray]) -> list[np.ndarray]:
    """A mixer's tables from counted ones: those of the contexts, then the classes."""
    return [*map(stretched, counts), *(classes(counts[CONTEXTS.index(k)], steps) for k, steps in SEEN.items())]


def last_byte(h: np.ndarray, sym: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: the byte that followed the same context last in this piece, and how
    often in a row it had been that byte (0: the context is new)."""
    n = len(sym)
    key = text.astype(_U64) << _U64(32)
    key |= h
    key <<= _U64(20)  # a batch and a piece have fewer bytes than this, and 12 bits of texts
    key |= np.arange(n, dtype=_U64)
    key.sort()
    at = (key & _U64((1 << 20) - 1)).astype(np.int32)
    key >>= _U64(20)
    s, i = sym[at], np.arange(n, dtype=np.int32)
    same, again = np.zeros(n, bool), np.zeros(n, bool)
    same[1:] = key[1:] == key[:-1]
    again[1:] = same[1:] & (s[1:] == s[:-1])
    row = i - np.maximum.accumulate(np.where(again, 0, i)) + 1
    guess, run = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    guess[at[1:]] = s[:-1]
    run[at[1:]] = np.minimum(row[:-1], RUNS - 1) * same[1:]
    return guess, run


class Mixer:
    """Scores texts under a code, trained tables and the weights of the gates
    (GATES * INPUTS)."""

    def __init__(self, code: Code, tables: list[np.ndarray], weights: np.ndarray | None = None):
        self.code, self.tables = code, tables
        weights = np.full((GATES, INPUTS), FIRST_WEIGHT) if weights is None else weights
        self.weights = np.ascontiguousarray(weights.T / SCALE, np.float32)
        #: Of the contexts that choose the gate, value and class in one number.
        self.both = {k: (tables[k].astype(np.int16) << 2) | tables[len(CONTEXTS) + i] for i, k in enumerate(map(CONTEXTS.index, SEEN))}
        self.centres = 1 / (1 + np.exp(-((np.arange(CELLS) + 0.5) / 2 - CELLS / 4)))

    def inputs(self, parts: list[bytes]) -> tuple:
        """Of the decisions of pieces, ordered by block and piece: inputs, gate, bit; then the
        runs of one block and piece: piece, first decision (and the end), and the first run
        of each block (and the end)."""
        code = self.code
        sym, starts, size = _joined(parts)
        before, found, _ = contexts(sym, starts, size)
        text = np.repeat(np.arange(len(parts)), size)
        block = _BLOCK[np.arange(len(sym)) - np.repeat(starts, size)]
        order = np.argsort(block, kind="stable")
        tree = code.tree[before] * 256
        guess, run = last_byte(found[OWN], sym, text)
        which = tree + sym
        apart = code.path[tree + guess] ^ code.path[which]
        agree = 32 - np.frexp(apart.astype(np.float64))[1]  # decisions before the two paths part
        which, text, block = which[order], text[order], block[order]
        each = code.length[which]
        stop = np.cumsum(each)
        n = int(stop[-1]) if len(stop) else 0
        of = np.repeat(np.arange(len(each)), each)  # the byte of each decision
        step = np.arange(n)
        step -= (stop - each).take(of)  # its place on the byte's path
        packed = code.packed.take(code.first[which].take(of) + step)
        bit, mixed = (packed & _U32(1)).astype(np.uint8), packed & _U32(0xFFFFFFFE)
        x, gate = [], np.zeros(n, np.int16)
        for k, name in enumerate(CONTEXTS):
            s = _slots(found[name][order].take(of), mixed, k, len(self.tables[k]).bit_length() - 1)
            if k in self.both:
                v = self.both[k].take(s)
                gate <<= 2
                gate |= v & np.int16(3)
                v >>= 2
                x.append(v.astype(np.int8))
            else:
                x.append(self.tables[k].take(s))
        # The own predictor's input until the paths have parted, with the sign of its guess.
        run, agree = run[order], agree[order].astype(np.int8)
        ahead = agree.take(of)
        ahead -= step.astype(np.int8)
        row = run.take(of)
        row *= ahead >= 0
        x.append(_SIGNED.take((row << 2) | (bit << 1) | (ahead > 0)))
        gate *= RUNS
        gate += row
        runs = block.astype(np.int64) * len(parts) + text
        new = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
        stops = np.append((stop - each)[new], n)
        blocks = np.append(np.flatnonzero(np.concatenate(([True], block[new[1:]] != block[new[:-1]]))), len(new))
        return x, gate, bit, text[new], stops, blocks

    def fresh(self, n: int) -> dict:
        """The state of n texts before their first byte."""
        cells = np.empty((2, n * CELLS), np.float32)
        cells[0], cells[1] = PRIOR, np.tile(self.centres * PRIOR, n)
        return {"w": np.zeros((INPUTS, n), np.float32), "cells": cells, "bits": np.zeros(n)}

    def run(self, parts: list[bytes], state: dict) -> None:
        """Score one piece of each text and learn from it."""
        x, gate, bit, who, stops, blocks = self.inputs(parts)
        for i, j in zip(blocks[:-1].tolist(), blocks[1:].tolist(), strict=True):
            a, b = int(stops[i]), int(stops[j])
            self._block([v[a:b].astype(np.float32) for v in x], gate[a:b], bit[a:b], who[i:j], stops[i:j] - a, np.diff(stops[i : j + 1]), state)

    def _block(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, who: np.ndarray, begin: np.ndarray, size: np.ndarray, state: dict) -> None:
        w, cells = state["w"], state["cells"]
        t, gate = np.zeros(len(gate), np.float32), gate.astype(np.intp)
        for k in range(INPUTS):
            v = self.weights[k].take(gate)
            v += np.repeat(w[k][who], size)
            v *= x[k]
            t += v
        np.clip(t, -12, 12, out=t)
        p = np.exp(-t)
        p += 1
        np.reciprocal(p, out=p)
        t += np.float32(CELLS / 4)
        t *= 2
        cell = t.astype(np.intp)
        np.minimum(cell, CELLS - 1, out=cell)
        np.maximum(cell, 0, out=cell)
        cell += np.repeat(who * CELLS, size)
        refined = (cells[1] / cells[0]).take(cell)
        refined -= p
        refined *= np.float32(REFINED)
        refined += p
        np.clip(refined, 1e-5, 1 - 1e-5, out=refined)
        y = bit.astype(np.float32)
        refined += y
        refined -= 1
        np.abs(refined, out=refined)
        # Logarithms of products of at most 32: none is below 1e-160.
        many = (size + 31) // 32
        cuts = _ranges(np.zeros(len(size), np.int64), many) * 32 + np.repeat(begin, many)
        bits = np.log2(np.multiply.reduceat(refined, cuts, dtype=np.float64))
        state["bits"][who] -= np.add.reduceat(bits, np.cumsum(many) - many)
        wrong = np.subtract(y, p, out=p)
        rate = np.float32(RATE / SCALE / SCALE) * np.minimum(1, CALM / size).astype(np.float32)
        for k in range(INPUTS):
            x[k] *= wrong
            w[k][who] += rate * np.add.reduceat(x[k], begin)
        cell <<= 1
        cell += bit
        both = np.bincount(cell, minlength=2 * cells.shape[1]).reshape(-1, 2)
        cells[0] += both.sum(1)
        cells[1] += both[:, 1]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each text and its end take. Short texts go in batches; a text longer than
        a piece is scored alone, piece by piece, so memory stays bounded."""
        out = np.zeros(len(texts))
        for part in batches(texts):
            found = pieces(texts[part[0]]) if len(part) == 1 else None
            state = self.fresh(len(part))
            for p in found or [None]:
                self.run([p] if found else [texts[j] + END_BYTE for j in part], state)
            out[part] = state["bits"]
        return out


def batches(texts: list[bytes], end: int = 1) -> list[list[int]]:
    """Groups of texts, which ``end`` bytes follow, to work on together; a text longer than a
    piece is one of its own."""
    out, part, size = [], [], 0
    for i, t in enumerate(texts):
        if len(t) >= SPAN:
            out.append([i])
            continue
        if part and (size + len(t) >= BATCH or len(part) >= MOST):
            out.append(part)
            part, size = [], 0
        part.append(i)
        size += len(t) + end
    return [*out, part] if part else out


def newton_sums(x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per gate, the sums that one Newton step on its weights needs: INPUTS * INPUTS of the
    curvature, then INPUTS of the slope. They add up over texts."""
    out = np.zeros((GATES, INPUTS * INPUTS + INPUTS))
    order = np.argsort(gate, kind="stable")
    many = np.bincount(gate, minlength=GATES)
    some = np.flatnonzero(many)
    begin = (np.cumsum(many) - many)[some]
    v = [k[order].astype(np.float32) for k in x]
    t = np.zeros(len(order))
    for k in range(INPUTS):
        t += np.repeat(weights[some, k] / SCALE, many[some]) * v[k]
    p = 1 / (1 + np.exp(-np.clip(t, -12, 12)))
    wrong, bend = (p - bit[order]).astype(np.float32), (p * (1 - p)).astype(np.float32)
    for i in range(INPUTS):
        out[some, INPUTS * INPUTS + i] = np.add.reduceat(v[i] * wrong, begin, dtype=np.float64)
        bent = v[i] * bend
        for j in range(i, INPUTS):
            out[some, i * INPUTS + j] = out[some, j * INPUTS + i] = np.add.reduceat(bent * v[j], begin, dtype=np.float64)
    return out


def newton_step(sums: np.ndarray, weights: np.ndarray, ridge: float = 200.0) -> np.ndarray:
    """The gates' weights after a step; gates that saw little stay near the first weight."""
    out = weights.copy()
    for g in range(GATES):
        h, slope = sums[g, : INPUTS * INPUTS].reshape(INPUTS, INPUTS), sums[g, INPUTS * INPUTS :]
        back = ridge * (weights[g] - FIRST_WEIGHT) / SCALE
        out[g] -= np.linalg.solve(h + ridge * np.eye(INPUTS), slope + back) * SCALE
    return out
