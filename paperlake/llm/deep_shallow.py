"""Sorting strings with long common prefixes: multikey quicksort to a shallow depth, then blind tries.

The shallow part splits by eight bytes at a time, all groups at once. Strings that agree to the shallow
depth are put into a blind trie each group, whose nodes hold only where strings part and by which byte;
reading the trie in order sorts the group.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the shallow sort looks at.
SHALLOW = 48


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict) -> None:
        self.depth, self.kids = depth, kids


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halves."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def blind_order(strings: list[bytes]) -> list[int]:
    """The order of strings of one length; equal ones stay in their order."""
    root: _Node | list[int] = [0]
    for i in range(1, len(strings)):
        s = strings[i]
        # blind: follow the bytes at the branching depths only, to any string below
        node, path = root, []
        while isinstance(node, _Node):
            path.append(node)
            kid = node.kids.get(s[node.depth])
            node = kid if kid is not None else next(iter(node.kids.values()))
        depth = _common(s, strings[node[0]])
        if depth == len(s):
            node.append(i)
            continue
        # the node above which the new string parts from those there
        above, here = None, root
        while isinstance(here, _Node) and here.depth < depth:
            above, here = here, here.kids.get(s[here.depth])
            if here is None:
                break
        if isinstance(here, _Node) and here.depth == depth:
            here.kids[s[depth]] = [i]
            continue
        if here is None:
            above.kids[s[above.depth]] = [i]
            continue
        low = here
        while isinstance(low, _Node):
            low = next(iter(low.kids.values()))
        new = _Node(depth, {strings[low[0]][depth]: here, s[depth]: [i]})
        if above is None:
            root = new
        else:
            above.kids[s[above.depth]] = new
    out: list[int] = []
    todo: list = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, _Node):
            todo += [node.kids[c] for c in sorted(node.kids, reverse=True)]
        else:
            out += node
    return out


def sorted_order(rows: np.ndarray) -> np.ndarray:
    """The order of the rows (strings of one length, a matrix of bytes)."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8")
    order, group = np.arange(n), np.zeros(n, np.int64)
    at = np.arange(n)  # places whose group has more than one string
    for k in range(min(SHALLOW // 8, words.shape[1])):
        if not len(at):
            break
        key = words[order[at], k].astype(np.uint64)
        by = np.lexsort((key, group[at]))
        order[at] = order[at][by]
        key = key[by]
        g = group[at]
        new = np.ones(len(at), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        last = np.append(new[1:], True)
        at = at[~(new & last)]
    if len(at):
        cut = np.flatnonzero(np.diff(group[at])) + 1
        for place in np.split(at, cut):
            own = order[place]
            if len(own) == 2:
                a, b = rows[own[0]].tobytes(), rows[own[1]].tobytes()
                if b < a:
                    order[place] = own[::-1]
                continue
            order[place] = own[blind_order([rows[i].tobytes() for i in own])]
    return order


def neighbours_common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order, the common prefix with the row before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 8192):
        j = min(len(order), i + 8192)
        same = rows[order[i:j]] == rows[order[i - 1 : j - 1]]
        out[i:j] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return out
