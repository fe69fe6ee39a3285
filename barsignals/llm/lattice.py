"""Piece lattices: a double-array trie of vocabulary pieces, best paths and path sums.

Pieces never hold a space after another character, so a text falls into independent
stretches (spaces and the word after them), and all distinct stretches of a batch go
through the same vectorised steps: trie walk from every byte, then one dynamic
programme by position in the stretch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece

MARK = "▁"  # written for a space in a vocabulary file
UNK_PENALTY = 10.0
WINDOW = 1 << 18  # bytes of a long stretch whose edges are held at once
LONGEST = 1 << 10  # bytes that a piece may read beyond its window


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a vocabulary file as bytes (mark as space), with scores and kinds."""

    pieces: list[bytes]  # the bytes that an id decodes to
    scores: np.ndarray
    normal: np.ndarray  # pieces matched in a text
    byte_ids: np.ndarray  # id of each byte's piece, -1 without byte fallback
    unknown: int
    end: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        is_byte = np.array([sp.is_byte(i) for i in range(n)])
        byte_ids = np.full(256, -1, np.int32)
        pieces = []
        for i, name in enumerate(names):
            if is_byte[i]:
                byte_ids[int(name[1:-1], 16)] = i
                pieces.append(bytes([int(name[1:-1], 16)]))
            else:
                pieces.append(b"" if special[i] else name.replace(MARK, " ").encode())
        if max(map(len, pieces)) > LONGEST:
            raise ValueError("a piece is longer than the windows of a stretch allow")
        if any(b" " in p.lstrip(b" ") for p in pieces):
            raise ValueError("a piece with a space after another character: texts can't be cut at spaces")
        return Vocabulary(pieces, np.array([sp.get_score(i) for i in range(n)]), ~special & ~is_byte, byte_ids,
                          sp.unk_id(), sp.eos_id())


class DoubleArray:
    """Trie in two arrays: from node s, byte c leads to t = base[s] + c if check[t] == s."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @staticmethod
    def build(keys: list[tuple[bytes, int]]) -> DoubleArray:
        tree: list[dict[int, int]] = [{}]
        ids = [-1]
        for key, number in keys:
            node = 0
            for c in key:
                nxt = tree[node].get(c)
                if nxt is None:
                    nxt = tree[node][c] = len(tree)
                    tree.append({})
                    ids.append(-1)
                node = nxt
            ids[node] = number
        size = 2 * len(tree) + 1024
        base, check, value = (np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32))
        used = bytearray(size)
        used[0] = 1
        check[0] = -2
        lowest, wide, todo = 1, 1, [(0, 0)]  # first free cell; where the search for several cells begins
        while todo:
            node, slot = todo.pop()
            value[slot] = ids[node]
            children = sorted(tree[node])
            if not children:
                continue
            if len(children) == 1:
                while used[lowest] or lowest <= children[0]:
                    lowest = lowest + 1 if used[lowest] else children[0] + 1
                at = lowest - children[0]
            else:
                at = wide
                while any(used[at + c] for c in children):
                    at += 1
                if at - wide > 32:  # crowded: later searches begin further on
                    wide += (at - wide) // 2
            while at + 512 >= len(used):
                grow = len(used)
                used.extend(bytes(grow))
                base, check, value = (np.concatenate([x, np.full(grow, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
            base[slot] = at
            for c in children:
                used[at + c] = 1
                check[at + c] = slot
                todo.append((tree[node][c], at + c))
        top = int(np.flatnonzero(np.frombuffer(used, np.uint8))[-1]) + 257
        if top > len(base):
            base, check, value = (np.concatenate([x, np.full(top - len(x), f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
        return DoubleArray(base[:top], check[:top], value[:top])

    def matches(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every key found in ``data``; ``stop`` is the end of each byte's stretch."""
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        starts, lengths, ids, depth = [], [], [], 0
        while len(at):
            to = self.base[node] + data[at + depth]
            go = self.check[to] == node
            at, node, depth = at[go], to[go], depth + 1
            found = self.value[node]
            k = np.flatnonzero(found >= 0)
            starts.append(at[k])
            lengths.append(np.full(len(k), depth, np.int32))
            ids.append(found[k])
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)


@dataclass(frozen=True)
class PieceModel:
    """Arrays of a vocabulary as tasks need them; weights may differ from the file's scores."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    weights: np.ndarray  # of each id
    unknown_weight: float  # of a character without a piece, or of one byte of it (see byte_weights)
    byte_weights: np.ndarray | None  # weight of each byte of a character without a piece
    unknown: int

    @staticmethod
    def of(v: Vocabulary, weights: np.ndarray, unknown_weight: float, byte_weights: np.ndarray | None = None) -> PieceModel:
        trie = DoubleArray.build([(p, i) for i, p in enumerate(v.pieces) if v.normal[i]])
        return PieceModel(trie.base, trie.check, trie.value, weights, unknown_weight, byte_weights, v.unknown)

    def edges(self, data: np.ndarray, offsets: np.ndarray):
        """Lattice edges of stretches: (stretch, start in it, length, id), by start; unknown characters included."""
        size = np.diff(offsets)
        stop = np.repeat(offsets[1:], size)
        start, length, ids = DoubleArray(self.base, self.check, self.value).matches(data, stop)
        lead = (data & 0xC0) != 0x80
        chars = np.flatnonzero(lead)
        width = np.diff(np.append(chars, len(data)))
        have = np.zeros(len(data), bool)
        char_width = np.zeros(len(data), np.int32)
        char_width[chars] = width
        have[start[length == char_width[start]]] = True
        bare = chars[~have[chars]]
        keep = lead[start]
        start = np.concatenate([start[keep], bare])
        length = np.concatenate([length[keep], char_width[bare]])
        ids = np.concatenate([ids[keep], np.full(len(bare), self.unknown, np.int32)])
        stretch = np.repeat(np.arange(len(size)), size)[start] if len(start) else start
        weight = self.weights[ids]
        if len(bare):
            if self.byte_weights is None:
                weight[len(weight) - len(bare):] = self.unknown_weight
            else:
                total = np.concatenate([[0.0], np.cumsum(self.byte_weights[data])])
                weight[len(weight) - len(bare):] = total[bare + char_width[bare]] - total[bare]
        rel = start - offsets[stretch]
        by = np.argsort(rel, kind="stable")
        return stretch[by], rel[by], length[by], ids[by], weight[by]

    def _steps(self, data: np.ndarray, offsets: np.ndarray):
        """Edges as (source cell, target cell, id, weight), cut into steps of one position each.

        A stretch has one more cell than bytes. Targets of one step are distinct. A single
        stretch beyond ``WINDOW`` comes in windows, so its edges are never held all at once.
        """
        n = len(data)
        if len(offsets) != 2 or n <= WINDOW:
            yield self._window(data, offsets)
            return
        s = 0
        while s < n:
            e = min(n, s + WINDOW)
            while e < n and data[e] & 0xC0 == 0x80:
                e += 1
            part = data[s:min(n, e + LONGEST)]
            while len(part) and s + len(part) < n and data[s + len(part)] & 0xC0 == 0x80:
                part = part[:-1]  # whole characters only
            source, target, ids, weight, cuts = self._window(part, np.array([0, len(part)]))
            own = int(np.searchsorted(source, e - s))
            cuts = np.append(cuts[cuts < own], own)
            yield source[:own] + s, target[:own] + s, ids[:own], weight[:own], cuts
            s = e

    def _window(self, data: np.ndarray, offsets: np.ndarray):
        stretch, rel, length, ids, weight = self.edges(data, offsets)
        source = (offsets[:-1] + np.arange(len(offsets) - 1))[stretch] + rel
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(rel)) + 1, [len(rel)]]) if len(rel) else np.zeros(1, np.int64)
        return source, source + length, ids, weight, cuts

    def forward(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all segmentations of each stretch."""
        first = offsets[:-1] + np.arange(len(offsets) - 1)
        alpha = np.full(len(data) + len(offsets) - 1, -np.inf)
        alpha[first] = 0
        for source, target, _, weight, cuts in self._steps(data, offsets):
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                t = target[a:b]
                alpha[t] = np.logaddexp(alpha[t], alpha[source[a:b]] + weight[a:b])
        return alpha[first + np.diff(offsets)]

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the heaviest segmentation of each stretch: (ids, byte start of each, offsets by stretch)."""
        first = offsets[:-1] + np.arange(len(offsets) - 1)
        score = np.full(len(data) + len(offsets) - 1, -np.inf)
        came, piece = np.full(len(score), -1, np.int64), np.full(len(score), -1, np.int32)
        score[first] = 0
        for source, target, ids, weight, cuts in self._steps(data, offsets):
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                new = score[source[a:b]] + weight[a:b]
                k = np.flatnonzero(new > score[target[a:b]])
                t = target[a + k]
                score[t], came[t], piece[t] = new[k], source[a + k], ids[a + k]
        cell = first + np.diff(offsets)
        who = np.flatnonzero(np.diff(offsets) > 0)
        cell = cell[who]
        out = []
        while len(who):
            out.append((who, piece[cell], came[cell]))
            cell = came[cell]
            go = cell > first[who]
            who, cell = who[go], cell[go]
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        w, ids, source = (np.concatenate(x) for x in zip(*out[::-1]))
        by = np.argsort(w, kind="stable")
        w = w[by]
        counts = np.bincount(w, minlength=len(offsets) - 1)
        return ids[by], source[by] - w, np.concatenate([[0], np.cumsum(counts)])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts, with the leading space of the vocabulary's convention, as (distinct-coded stretches, per text counts).

    U+2581 in a text reads as a space. Empty texts have no stretch.
    """
    local = offsets - offsets[0]
    part = data[offsets[0]:offsets[-1]]
    mark = np.flatnonzero((part[:-2] == 0xE2) & (part[1:-1] == 0x96) & (part[2:] == 0x81)) if len(part) > 2 else []
    if len(mark):
        part = part.copy()
        part[mark] = 32
        drop = np.concatenate([mark + 1, mark + 2])
        gone = np.zeros(len(part) + 1, np.int64)
        gone[drop + 1] = 1
        local = local - np.cumsum(gone)[local]
        part = np.delete(part, drop)
    full = np.flatnonzero(np.diff(local) > 0)
    part = np.insert(part, local[full], 32)
    text_at = local[full] + np.arange(len(full))
    cut = np.zeros(len(part), bool)
    cut[1:] = (part[1:] == 32) & (part[:-1] != 32)
    cut[text_at] = True
    starts = np.flatnonzero(cut)
    counts = np.zeros(len(offsets) - 1, np.int64)
    counts[full] = np.diff(np.append(np.searchsorted(starts, text_at), len(starts)))
    bounds = np.append(starts, len(part)).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(part)])
    return array.dictionary_encode(), counts


def by_size(offsets: np.ndarray, limits: tuple[int, ...] = (24, 256, 4096)):
    """Groups of stretches of like size, so that few long ones don't lengthen the steps of all."""
    size = np.diff(offsets)
    low = 0
    for high in limits:
        at = np.flatnonzero((size > low) & (size <= high))
        low = high
        if len(at):
            yield at
    for k in np.flatnonzero(size > low).tolist():
        yield np.array([k])


def take_stretches(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = offsets[at + 1] - offsets[at]
    out = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(int(out[-1])) + np.repeat(offsets[at] - out[:-1], size)
    return data[index], out
