"""Deep-shallow sorting of many strings at once.

Shallow: multikey sorting on symbols of eight bytes; in each round, all groups that still agree are split by their next
symbol, until they differ or agree on SHALLOW bytes. Deep: what still agrees is ordered by a blind trie for each group: a
compacted trie that keeps only branching bytes, so that an insertion descends without comparing, compares once with one
leaf to learn the true common prefix, and branches there.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def words_at(buf: np.ndarray) -> np.ndarray:
    """Big-endian value of the eight bytes from each position of buf, which ends in eight bytes of padding at least."""
    n = len(buf) - 8
    out = np.empty(n, dtype=np.uint64)
    for o in range(8):
        part = buf[o : o + (n - o + 7) // 8 * 8]
        out[o::8] = np.frombuffer(part.tobytes(), dtype=">u8")[: len(out[o::8])]
    return out


class BlindTrie:
    """Orders strings; leaves hold the numbers of equal strings."""

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # [depth, children by next byte (-1 at a string's end), a leaf below, numbers]
        for i in range(len(strings)):
            self.insert(i)

    def insert(self, i: int) -> None:
        x = self.strings[i]
        if self.root is None:
            self.root = [len(x), None, i, [i]]
            return
        node = self.root
        while node[1] is not None:  # blind: only the branching bytes are looked at
            child = node[1].get(x[node[0]] if node[0] < len(x) else -1)
            if child is None:
                break
            node = child
        y = self.strings[node[2]]
        common = common_prefix(x, y)
        if common == len(x) == len(y):
            node[3].append(i)
            return
        node, up, edge = self.root, None, None
        while node[1] is not None and node[0] < common:
            up, edge = node, x[node[0]]
            node = node[1][edge]
        leaf = [len(x), None, i, [i]]
        own = x[common] if common < len(x) else -1
        if node[1] is not None and node[0] == common:
            node[1][own] = leaf
            return
        other = self.strings[node[2]]
        split = [common, {own: leaf, (other[common] if common < len(other) else -1): node}, node[2], None]
        if up is None:
            self.root = split
        else:
            up[1][edge] = split

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and for each the common prefix with the one before it (0 for the first)."""
        order: list[int] = []
        common: list[int] = []
        stack = [(self.root, 0)]  # a node and what its first leaf shares with the leaf before
        while stack:
            node, shared = stack.pop()
            if node[1] is None:
                for k, i in enumerate(node[3]):
                    order.append(i)
                    common.append(node[0] if k else shared)
            else:
                for k, edge in enumerate(sorted(node[1], reverse=True)):
                    stack.append((node[1][edge], shared if k == len(node[1]) - 1 else node[0]))
        return order, common


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    a, b = x[:n], y[:n]
    if a == b:
        return n
    differ = int.from_bytes(a) ^ int.from_bytes(b)
    return n - (differ.bit_length() + 7) // 8


def deep_shallow(buf: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings buf[start : start + size] within each group (ascending numbers), and the common prefix of each
    with the string before it in its group. buf ends in shallow + 8 bytes of padding at least."""
    n = len(start)
    order = np.argsort(group, kind="stable")
    common = np.zeros(n, dtype=np.int64)
    if not n:
        return order, common
    word = words_at(buf)
    segment = np.cumsum(np.concatenate([[0], np.diff(group[order]) != 0]))
    at = in_company(segment, np.arange(n))
    depth = 0
    while len(at) and depth < shallow:
        item = order[at]
        left = np.clip(size[item] - depth, 0, 8)
        value = word[np.minimum(start[item] + depth, len(word) - 1)]
        value = np.where(left > 0, value >> (np.uint64(8) * (8 - left).astype(np.uint64)) % np.uint64(64) << (np.uint64(8) * (8 - left).astype(np.uint64)) % np.uint64(64), np.uint64(0))
        by = np.lexsort((left, value, segment[at]))
        item, value, left = item[by], value[by], left[by]
        order[at] = item
        same_segment = np.concatenate([[False], segment[at][1:] == segment[at][:-1]])
        differs = np.concatenate([[True], (value[1:] != value[:-1]) | (left[1:] != left[:-1])])
        edge = same_segment & differs
        k = np.flatnonzero(edge)
        bits = value[k] ^ value[k - 1]
        agree = np.full(len(k), 8, dtype=np.int64)
        for b in range(7, -1, -1):
            agree[(bits >> np.uint64(56 - 8 * b)) & np.uint64(0xFF) != 0] = b
        common[at[k]] = depth + np.minimum(agree, np.minimum(left[k], left[k - 1]))
        # a string that ends here and equals the one before it is done
        ended = same_segment & ~differs & (left < 8)
        common[at[ended]] = size[item[ended]]
        new = np.cumsum(~same_segment | differs)
        segment[at] = new + (segment.max() + 1)
        depth += 8
        on = left == 8
        at = in_company(segment, at[on])
    if len(at):
        cut = np.flatnonzero(np.concatenate([[True], segment[at][1:] != segment[at][:-1], [True]]))
        raw = buf.tobytes()
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            items = order[at[lo:hi]]
            tails = [raw[s + depth : s + z] for s, z in zip(start[items].tolist(), size[items].tolist(), strict=True)]
            if hi - lo == 2:
                x, y = tails
                own, shared = ([0, 1] if x <= y else [1, 0]), [0, common_prefix(x, y)]
            else:
                own, shared = BlindTrie(tails).ordered()
            first = common[at[lo]]
            order[at[lo:hi]] = items[own]
            common[at[lo:hi]] = depth + np.array(shared)
            common[at[lo]] = first
    return order, common


def in_company(segment: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those positions (neighbours of one segment stand together) whose segment has another one."""
    if len(at) < 2:
        return at[:0]
    same = segment[at][1:] == segment[at][:-1]
    keep = np.zeros(len(at), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    return at[keep]
