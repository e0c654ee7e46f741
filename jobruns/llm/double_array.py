"""Tries as two arrays, walked by all positions of a text at once.

State s has a child by byte c where ``check[base[s] + c] == s``; that place is the child's state. The arrays are filled by
numpy: states with many children take a random place among a few that fit, the rest are thrown together and thrown again where they
collide, and states with one child take what is free.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BYTES = 256
#: Places for each child; rounds of throwing before a state gets places of its own.
_ROOM, _ROUNDS, _MANY = 1.6, 60, 24


class Trie(NamedTuple):
    """``accept`` has the number of the key that ends in a state, or -1. The root is state 0."""

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray

    def walk(self, text: np.ndarray, pos: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Follow ``text`` (bytes, the last one in no key) from each position and state, all positions one byte further
        at a time. Returns what was met: which position, the number of the key, and the place behind it."""
        which, found = np.arange(len(pos)), []
        while len(which):
            nxt = self.base[state] + text[pos]
            on = self.check[nxt] == state
            which, pos, state = which[on], pos[on] + 1, nxt[on]
            key = self.accept[state]
            hit = key >= 0
            found.append((which[hit], key[hit], pos[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (which, which, which)

    def after(self, prefix: bytes) -> int:
        """The state behind ``prefix``, or -1."""
        state = 0
        for c in prefix:
            nxt = int(self.base[state]) + c
            if self.check[nxt] != state:
                return -1
            state = nxt
        return state


def _edges(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, byte) of every edge, parents before children and -1 for the root, and the edge that each key ends with."""
    sizes = np.array([len(k) for k in keys], np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(keys), np.uint8)
    last = np.full(len(keys), -1, np.int32)
    alive, count, depth = np.arange(len(keys), dtype=np.int32), 0, 0
    parents, labels = [], []
    while len(alive := alive[sizes[alive] > depth]):
        label, parent = text[begin[alive] + depth], last[alive]
        new = np.ones(len(alive), bool)
        new[1:] = (label[1:] != label[:-1]) | (parent[1:] != parent[:-1])
        parents.append(parent[new])
        labels.append(label[new])
        last[alive] = count + np.cumsum(new, dtype=np.int32) - 1
        count += int(new.sum())
        depth += 1
    if not parents:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), last
    return np.concatenate(parents), np.concatenate(labels).astype(np.int32), last


def _places(parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The place of every edge, the base of every edge's parent, and the number of places."""
    rng = np.random.default_rng(len(parent))
    room = int(len(parent) * _ROOM) + 4 * _BYTES
    first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
    degree = np.diff(np.append(first, len(parent)))
    base = np.zeros(len(first), np.int64)
    used = np.zeros(room, bool)
    used[0] = True
    later = []
    for g in np.flatnonzero(degree > _MANY)[np.argsort(-degree[degree > _MANY], kind="stable")]:
        own = label[first[g] : first[g] + degree[g]]
        tries = rng.integers(1, room - _BYTES, 64)
        fits = np.flatnonzero(~used[tries[:, None] + own].any(axis=1))
        if len(fits):
            base[g] = tries[fits[0]]
            used[base[g] + own] = True
        else:
            later.append(g)
    group = np.repeat(np.arange(len(first)), degree)
    left = np.flatnonzero((degree > 1) & (degree <= _MANY))
    for _ in range(_ROUNDS):
        if not len(left):
            break
        base[left] = rng.integers(1, room - _BYTES, len(left))
        mine = np.zeros(len(first), bool)
        mine[left] = True
        edges = np.flatnonzero(mine[group])
        place = base[group[edges]] + label[edges]
        winner = np.zeros(len(edges), bool)
        winner[np.unique(place, return_index=True)[1]] = True
        lost = np.zeros(len(first), bool)
        lost[group[edges[used[place] | ~winner]]] = True
        kept = ~lost[group[edges]]
        used[place[kept]] = True
        left = left[lost[left]]
    rest = np.concatenate([left, np.array(later, np.int64)])
    base[rest] = room + np.arange(len(rest)) * _BYTES
    room += len(rest) * _BYTES
    single = np.flatnonzero(degree == 1)
    free = np.flatnonzero(~used)[: len(single)]
    base[single] = free - label[first[single]]
    return base[group] + label, base[group], room


def build(keys: list[bytes]) -> Trie:
    """The trie of sorted, different, non-empty keys."""
    parent, label, last = _edges(keys)
    place, base_of_parent, room = _places(parent, label) if len(parent) else (parent, parent, 1)
    base = np.zeros(room + _BYTES, np.int32)
    check, accept = np.full(room + _BYTES, -1, np.int32), np.full(room + _BYTES, -1, np.int32)
    state = np.where(parent >= 0, place[np.maximum(parent, 0)], 0) if len(parent) else parent
    base[state] = base_of_parent
    check[place] = state
    accept[place[last]] = np.arange(len(keys))
    return Trie(base, check, accept)
