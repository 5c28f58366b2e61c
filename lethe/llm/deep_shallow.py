"""Deep-shallow sorting of short contexts, with their longest common prefixes.

Shallow: multikey quicksort, breadth first; each pass splits all open groups by the next
super-character of four symbols.  Deep: groups still equal at the shallow depth go into a blind
trie, which compares each context with one leaf only.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16  # symbols


def padded(contexts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of symbols 1..256, with 0 beyond a context's end, as big-endian 16-bit units, four at least; lengths."""
    width = max(4, -(-width // 4) * 4)  # contexts may all be empty
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    rows = np.zeros((len(contexts), width), ">u2")
    data = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
    row = np.repeat(np.arange(len(contexts)), sizes)
    rows[row, np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = data
    return rows, sizes


class _Node:
    __slots__ = ("depth", "kids", "leaf")

    def __init__(self, depth: int, kids: dict, leaf: int):
        self.depth, self.kids, self.leaf = depth, kids, leaf


def _blind_trie(rows: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the rows (of equal width, two bytes a symbol) and each one's common symbols with the one before it."""
    width = len(rows[0]) // 2
    numbers = [int.from_bytes(r, "big") for r in rows]
    equal: list[list[int]] = [[0]]
    root = _Node(width, {}, 0)
    for i in range(1, len(rows)):
        own, node, path = rows[i], root, []
        while node.kids:
            path.append(node)
            nxt = node.kids.get(own[2 * node.depth : 2 * node.depth + 2])
            if nxt is None:
                break
            node = nxt
        differ = numbers[i] ^ numbers[equal[node.leaf][0]]
        if not differ:
            equal[node.leaf].append(i)
            continue
        common = (16 * width - differ.bit_length()) // 16
        leaf = _Node(width, {}, len(equal))
        other = rows[equal[node.leaf][0]]
        equal.append([i])
        above = None
        node = root
        for x in path:
            if x.depth >= common:
                break
            above, node = x, x.kids.get(own[2 * x.depth : 2 * x.depth + 2])
        if node is not None and node.kids and node.depth == common:
            node.kids[own[2 * common : 2 * common + 2]] = leaf
        elif node is None:
            above.kids[own[2 * above.depth : 2 * above.depth + 2]] = leaf
        else:
            split = _Node(common, {own[2 * common : 2 * common + 2]: leaf, other[2 * common : 2 * common + 2]: node}, node.leaf)
            if above is None:
                root = split
            else:
                above.kids[own[2 * above.depth : 2 * above.depth + 2]] = split
    order: list[int] = []
    commons: list[int] = []
    stack: list[tuple[_Node, int]] = [(root, -1)]
    while stack:
        node, common = stack.pop()
        if node.kids:
            kids = [node.kids[k] for k in sorted(node.kids)]
            stack += [(k, node.depth if j else common) for j, k in reversed(list(enumerate(kids)))]
            continue
        order += equal[node.leaf]
        commons += [common] + [width] * (len(equal[node.leaf]) - 1)
    return order, commons


def sort(groups: np.ndarray, contexts: list[bytes], width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the contexts within their groups; common prefix of each with the one before it, -1 at a group's start."""
    n = len(contexts)
    rows, sizes = padded(contexts, width)
    chars = rows.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    new = np.ones(n, bool)
    new[1:] = groups[order][1:] != groups[order][:-1]
    common = np.where(new, -1, 0)
    done = min(shallow // 4, chars.shape[1])
    for d in range(done):
        group = np.cumsum(new) - 1
        act = np.flatnonzero((np.bincount(group) > 1)[group]) if n else np.zeros(0, np.int64)
        if not len(act):
            break
        char = chars[order[act], d]
        o = np.lexsort((char, group[act]))
        order[act], char = order[act][o], char[o]
        split = np.zeros(len(act), bool)
        split[1:] = (char[1:] != char[:-1]) & (group[act][1:] == group[act][:-1])
        at = act[split]
        x = char[split] ^ char[np.flatnonzero(split) - 1]
        common[at] = 4 * d + np.where(x >> np.uint64(48) > 0, 0, np.where(x >> np.uint64(32) > 0, 1, np.where(x >> np.uint64(16) > 0, 2, 3)))
        new[at] = True
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, n))
    pairs = starts[counts == 2]
    if len(pairs):
        a, b = rows[order[pairs]], rows[order[pairs + 1]]
        differ = a != b
        place = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        at = np.minimum(place, rows.shape[1] - 1)
        k = np.arange(len(pairs))
        swap = a[k, at] > b[k, at]
        s = pairs[swap]
        order[s], order[s + 1] = order[s + 1].copy(), order[s].copy()
        common[pairs + 1] = place
    for s, c in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
        own = order[s : s + c]
        o, l = _blind_trie([rows[i].tobytes() for i in own])
        order[s : s + c] = own[o]
        common[s + 1 : s + c] = l[1:]
    inner = np.flatnonzero(common >= 0)
    common[inner] = np.minimum(common[inner], np.minimum(sizes[order[inner]], sizes[order[inner - 1]]))
    return order, common
