"""Signature trees over shingle sets: nodes hold OR-combined bitmaps and size ranges.

A dual traversal meets two nodes only while their sizes and the common bits of their bitmaps allow a pair inside to
reach the threshold. A set of n shingles has a bitmap of at least 2n bits; bit positions are hash values modulo the width, so
a wide bitmap folds onto a narrow one by OR.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LEAF = 16
FANOUT = 4


def bitmap(hashes: np.ndarray) -> np.ndarray:
    width = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    bits = np.zeros(width // 64, np.uint64)
    place = hashes & np.uint64(width - 1)
    np.bitwise_or.at(bits, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return bits


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


@dataclass
class Node:
    #: OR of the members' bitmaps
    bits: np.ndarray
    low: int
    high: int
    #: at most so many shingles of one member share a bit with another of it
    clash: int
    members: np.ndarray
    #: of a leaf: each member's bitmap, and its shared bits
    rows: np.ndarray | None = None
    clashes: np.ndarray | None = None
    children: tuple[Node, ...] = ()


def build(sizes: np.ndarray, bitmaps: list[np.ndarray]) -> Node | None:
    """A tree over members; neighbours in size, then in bits, share leaves.

    All bitmaps of a leaf have one width: folded onto that of a much smaller set, large sets would all look alike.
    """
    if not len(sizes):
        return None
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], bitmaps[i].tobytes()))
    nodes, leaves = [], []
    widths = np.array([len(bitmaps[i]) for i in order])
    for run in np.split(np.array(order), np.flatnonzero(np.diff(widths)) + 1):
        leaves += [run[at : at + LEAF] for at in range(0, len(run), LEAF)]
    for members in leaves:
        rows = np.stack([bitmaps[i] for i in members])
        own = sizes[members]
        clashes = own - _count(rows)
        nodes.append(
            Node(np.bitwise_or.reduce(rows, axis=0), int(own.min()), int(own.max()), int(clashes.max()), members, rows, clashes)
        )
    while len(nodes) > 1:
        level = []
        for at in range(0, len(nodes), FANOUT):
            below = tuple(nodes[at : at + FANOUT])
            words = min(len(n.bits) for n in below)
            # folded onto fewer bits, up to all of a member's shingles can share them
            clash = max(n.clash if len(n.bits) == words else n.high for n in below)
            level.append(
                Node(
                    np.bitwise_or.reduce(np.stack([fold(n.bits, words) for n in below]), axis=0),
                    min(n.low for n in below),
                    max(n.high for n in below),
                    clash,
                    np.concatenate([n.members for n in below]),
                    children=below,
                )
            )
        nodes = level
    return nodes[0]


def _possible(a: Node, b: Node) -> bool:
    """Whether sizes and common bits allow an overlap of 4/9 of both sizes, which is a similarity of 0.8."""
    if 5 * a.high < 4 * b.low or 5 * b.high < 4 * a.low:
        return False
    words = min(len(a.bits), len(b.bits))
    common = int(np.bitwise_count(fold(a.bits, words) & fold(b.bits, words)).sum())
    # a shingle shared by two members sets a common bit, unless another of its member has set it
    clash = min(n.clash if len(n.bits) == words else n.high for n in (a, b))
    return 9 * (common + clash) >= 4 * (a.low + b.low)


def pairs(a: Node | None, b: Node | None, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Members of ``a`` and of ``b`` that may be similar, with the largest overlap possible, in arrays per leaf pair.

    Members of one ``group`` (which may change meanwhile) are not paired; ``a`` and ``b`` may be one tree.
    """
    if a is None or b is None:
        return
    stack = [(a, b)]
    while stack:
        u, v = stack.pop()
        # both of one group already
        if len(set(group[u.members].tolist()) | set(group[v.members].tolist())) == 1 or not _possible(u, v):
            continue
        if u.children or v.children:
            # open the larger one; of a node with itself each pair of children once
            if u is v:
                stack += [(x, y) for i, x in enumerate(u.children) for y in u.children[i:]]
            elif v.children and (not u.children or len(v.members) >= len(u.members)):
                stack += [(u, y) for y in v.children]
            else:
                stack += [(x, v) for x in u.children]
            continue
        words = min(u.rows.shape[1], v.rows.shape[1])
        left = np.stack([fold(r, words) for r in u.rows])
        right = np.stack([fold(r, words) for r in v.rows])
        common = np.bitwise_count(left[:, None, :] & right[None, :, :]).sum(axis=2, dtype=np.int64)
        left_size, right_size = _count(u.rows) + u.clashes, _count(v.rows) + v.clashes
        bound = common + np.minimum((left_size - _count(left))[:, None], (right_size - _count(right))[None, :])
        total = left_size[:, None] + right_size[None, :]
        fine = (9 * bound >= 4 * total) & (5 * np.minimum(left_size[:, None], right_size) >= 4 * np.maximum(left_size[:, None], right_size))
        fine &= group[u.members][:, None] != group[v.members][None, :]
        if u is v:
            fine &= np.arange(len(u.members))[:, None] < np.arange(len(v.members))[None, :]
        i, j = np.nonzero(fine)
        if len(i):
            yield u.members[i], v.members[j], bound[i, j]
