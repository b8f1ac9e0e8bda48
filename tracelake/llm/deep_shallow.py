"""Deep-shallow ordering of equally long byte strings that are windows of one buffer.

Shallow: multikey quicksort on eight bytes at a time down to depth `SHALLOW`, each step ordering only
groups that are still equal. Deep: a blind trie for each group that shares a longer prefix; it branches on
the first byte in which its strings differ, so a string is compared in full with one leaf only.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


class BlindTrie:
    """Strings of one length in order; equal strings share a leaf."""

    def __init__(self):
        self.root = None  # leaf: (string, members); branch: [depth, {byte: child}]

    def add(self, s: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = (s, [member])
            return
        while type(node) is list:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        other = node[0]
        if other == s:
            node[1].append(member)
            return
        x = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        at = len(s) - (x.bit_length() + 7) // 8  # first byte that differs
        parent, key, node = None, None, self.root
        while type(node) is list and node[0] < at:
            parent, key = node, s[node[0]]
            node = node[1].get(key)
        leaf = (s, [member])
        if type(node) is list and node[0] == at:
            node[1][s[at]] = leaf
        elif node is None:
            parent[1][key] = leaf
        else:
            branch = [at, {other[at]: node, s[at]: leaf}]
            if parent is None:
                self.root = branch
            else:
                parent[1][key] = branch

    def groups(self) -> list[list[int]]:
        """Members of each distinct string, in the strings' order."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                out.append(node[1])
        return out


def prefix_words(data: np.ndarray) -> np.ndarray:
    """Big-endian number of the eight bytes from each position (zeros beyond the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def order_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows data[s : s + length], and the rank of each place's distinct string (equal strings, equal rank)."""
    words = prefix_words(data)

    def word(at: np.ndarray, depth: int) -> np.ndarray:
        w = words[np.minimum(at + depth, len(words) - 1)]
        return w >> np.uint64(8 * (8 - (length - depth))) if length - depth < 8 else w

    key = word(starts, 0)
    order = np.argsort(key)
    fresh = np.concatenate((np.ones(min(1, len(order)), bool), np.diff(key[order]) != 0))
    depth = 8
    while depth < min(SHALLOW, length):
        group = np.cumsum(fresh)
        again = np.flatnonzero(np.bincount(group, minlength=group[-1] + 1 if len(group) else 1)[group] > 1)
        if not len(again):
            break
        w, g = word(starts[order[again]], depth), group[again]
        apart = (w[1:] != w[:-1]) & (g[1:] == g[:-1])
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[g[1:][apart]] = True
        some = mixed[g]  # a group with one word is in order
        again, w, g = again[some], w[some], g[some]
        inner = np.lexsort((w, g))
        order[again] = order[again][inner]
        w = w[inner]
        fresh[again[1:]] |= (w[1:] != w[:-1]) & (g[1:] == g[:-1])
        depth += 8
    if depth < length and len(order):
        begins = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begins, len(order)))
        pair = begins[sizes == 2]
        a, b = starts[order[pair]], starts[order[pair + 1]]
        decided = np.zeros(len(pair), bool)
        for d in range(depth, length, 8):  # a trie of two strings is one comparison
            wa, wb = word(a, d), word(b, d)
            new = ~decided & (wa != wb)
            fresh[pair[new] + 1] = True
            swap = pair[new & (wa > wb)]
            order[swap], order[swap + 1] = order[swap + 1], order[swap].copy()
            decided |= new
        many = np.flatnonzero(sizes > 2)
        if len(many):  # groups of one string need no trie
            rows = np.repeat(begins[many] - np.concatenate(([0], np.cumsum(sizes[many])[:-1])), sizes[many]) + np.arange(sizes[many].sum())
            cuts = np.concatenate(([0], np.cumsum(sizes[many])[:-1]))
            mixed = np.zeros(len(many), bool)
            for d in range(depth, length, 8):
                w = word(starts[order[rows]], d)
                mixed |= np.minimum.reduceat(w, cuts) != np.maximum.reduceat(w, cuts)
            many = many[mixed]
        raw = data.tobytes()
        for begin, size in zip(begins[many].tolist(), sizes[many].tolist(), strict=True):
            trie = BlindTrie()
            for i in order[begin : begin + size].tolist():
                s = int(starts[i])
                trie.add(raw[s + depth : s + length], i)
            at = begin
            for members in trie.groups():
                order[at : at + len(members)] = members
                fresh[at] = True
                at += len(members)
    return order, np.cumsum(fresh) - 1
