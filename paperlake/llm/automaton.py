"""A deterministic automaton for many patterns at once: subset construction, minimisation, transition arrays.

Patterns are written in a small notation: literals, ``[classes]`` with ranges (or ``[^others]``), ``( | )``, ``? * +`` and
``{n}``. A scan reads each byte once for all patterns; the state says which patterns end here.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np


class _Parts:
    """A nondeterministic automaton under construction: edges by byte set, and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1


def _class(text: str, i: int) -> tuple[frozenset[int], int]:
    found: set[int] = set()
    i += 1
    others = text[i] == "^"
    i += others
    while text[i] != "]":
        a = text[i + 1] if text[i] == "\\" else text[i]
        i += 2 if text[i] == "\\" else 1
        if text[i] == "-" and text[i + 1] != "]":
            found.update(range(ord(a), ord(text[i + 1]) + 1))
            i += 2
        else:
            found.add(ord(a))
    return frozenset(set(range(256)) - found if others else found), i + 1


def _either(text: str, i: int, fold: bool) -> tuple[tuple, int]:
    options, row = [], []
    while i < len(text) and text[i] != ")":
        if text[i] == "|":
            options.append(("row", row))
            row, i = [], i + 1
            continue
        if text[i] == "(":
            item, i = _either(text, i + 1, fold)
            i += 1
        elif text[i] == "[":
            chars, i = _class(text, i)
            item = ("set", chars)
        else:
            i += text[i] == "\\"
            c = text[i]
            item = ("set", frozenset(map(ord, {c.lower(), c.upper()} if fold else {c})))
            i += 1
        while i < len(text) and text[i] in "?*+{":
            if text[i] == "{":
                j = text.index("}", i)
                item = ("row", [item] * int(text[i + 1 : j]))
                i = j + 1
            else:
                item = (text[i], item)
                i += 1
        row.append(item)
    return ("any", [*options, ("row", row)]), i


def _backwards(item: tuple) -> tuple:
    """The item that reads the same strings from their ends."""
    kind, what = item
    if kind == "set":
        return item
    if kind in ("row", "any"):
        parts = [_backwards(x) for x in what]
        return kind, parts[::-1] if kind == "row" else parts
    return kind, _backwards(what)


def _lay(nfa: _Parts, item: tuple, start: int) -> int:
    """Adds the item's states after start; returns the state at which it ends."""
    kind, what = item
    if kind == "set":
        end = nfa.state()
        nfa.edges[start].append((what, end))
        return end
    if kind == "row":
        for part in what:
            start = _lay(nfa, part, start)
        return start
    end = nfa.state()
    if kind == "any":
        for option in what:
            first = nfa.state()
            nfa.empty[start].append(first)
            nfa.empty[_lay(nfa, option, first)].append(end)
        return end
    first = nfa.state()
    nfa.empty[start].append(first)
    last = _lay(nfa, what, first)
    nfa.empty[last].append(end)
    if kind in "?*":
        nfa.empty[start].append(end)
    if kind in "*+":
        nfa.empty[last].append(first)
    return end


@lru_cache(maxsize=8)
def compiled(rules: tuple[tuple[str, bool], ...], anywhere: bool = True, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """next[state, byte] and marks[state] (a bit for each rule that may end in the state), from state 0.

    rules: (pattern, whether letters count in either case). A rule may begin at any byte, or only where the
    reading begins; backwards, bytes are read from the end, so that rules end where their matches start."""
    nfa = _Parts()
    start = nfa.state()
    marks: dict[int, int] = defaultdict(int)
    for k, (pattern, fold) in enumerate(rules):
        first = nfa.state()
        nfa.empty[start].append(first)
        item = _either(pattern, 0, fold)[0]
        marks[_lay(nfa, _backwards(item) if backwards else item, first)] |= 1 << k

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = [*states], set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    first = closed({start})
    names, rows, todo = {first: 0}, [], [first]
    while todo:
        here = todo.pop(0)
        reach: list[set[int]] = [{start} if anywhere else set() for _ in range(256)]
        for s in here:
            for chars, t in nfa.edges[s]:
                for c in chars:
                    reach[c].add(t)
        row, known = [], {}
        for r in reach:
            key = frozenset(r)
            if key not in known:
                full = closed(r)
                if full not in names:
                    names[full] = len(names)
                    todo.append(full)
                known[key] = names[full]
            row.append(known[key])
        rows.append(row)
    table = np.array(rows, np.int32)
    ends = np.array([sum({marks[s] for s in full if s in marks}) if full else 0 for full in names], np.int64)
    # minimisation: split blocks of states until all states of a block go to the same blocks
    block = np.unique(ends, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    lead = np.unique(block, return_index=True)[1]
    move = np.argsort(np.argsort(np.where(np.arange(len(lead)) == block[0], -1, np.arange(len(lead)))))
    new = np.empty((len(lead), 256), np.int32)
    new[move] = move[block[table[lead]]]
    out = np.empty(len(lead), np.int64)
    out[move] = ends[lead]
    return (new.astype(np.uint8) if len(lead) <= 256 else new.astype(np.uint16)), out


def scan(table: np.ndarray, data: np.ndarray, at: np.ndarray, lane: int = 512) -> np.ndarray:
    """The state after each byte, with a fresh start at each text of ``at``.

    Bytes are dealt into lanes that move on together. A lane first starts from state 0; lanes whose
    forerunner ended elsewhere are run again from there, until they fall in with what they had."""
    n = len(data)
    if not n:
        return np.zeros(0, table.dtype)
    flat = table.ravel()
    lanes = -(-n // lane)
    grid = np.zeros((lane, lanes), np.uint8)
    padded = np.zeros(lanes * lane, np.uint8)
    padded[:n] = data
    grid[:] = padded.reshape(lanes, lane).T
    fresh = np.zeros(lanes * lane, bool)
    fresh[at[at < n]] = True
    fresh = np.ascontiguousarray(fresh.reshape(lanes, lane).T)
    any_fresh = fresh.any(1)
    states = np.empty((lane, lanes), table.dtype)
    now = np.zeros(lanes, np.intp)
    for i in range(lane):
        if any_fresh[i]:
            now[fresh[i]] = 0
        now = flat[(now << 8) + grid[i]].astype(np.intp)
        states[i] = now
    redo = np.arange(1, lanes)
    redo = redo[(states[-1, redo - 1] != 0) & ~fresh[0, redo]]
    while len(redo):
        begin = states[-1, redo - 1].astype(np.intp)
        now, who = begin, redo
        for i in range(lane):
            if i:
                now = np.where(fresh[i, who], 0, now)
            now = flat[(now << 8) + grid[i, who]].astype(np.intp)
            change = states[i, who] != now
            if not change.all():
                who, now = who[change], now[change]
                if not len(who):
                    break
            states[i, who] = now
        # lanes that changed to their very end hand on a new state
        redo = who + 1 if len(who) else who
        redo = redo[redo < lanes]
        redo = redo[~fresh[0, redo]]
    return states.T.ravel()[:n]


def starts(table: np.ndarray, marks: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which matches start, and a bit for each rule, by one pass of a backwards automaton over all bytes."""
    n = len(data)
    states = scan(table, data[::-1], (n - at)[::-1])[::-1]
    here = np.flatnonzero((marks != 0)[states])
    return here, marks[states[here]]


def longest(table: np.ndarray, marks: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start: where its rule's match may first end, and where the longest one does; all starts move on together.

    The automaton isn't ``anywhere``; begin and end are the start's place and its text's end."""
    dead = np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & (marks == 0))
    state, first, last = np.zeros(len(begin), np.intp), np.full(len(begin), -1), np.full(len(begin), -1)
    live, place = np.arange(len(begin)), begin.copy()
    live = live[place < end]
    while len(live):
        state[live] = table[state[live], data[place[live]]]
        place[live] += 1
        hit = live[(marks[state[live]] >> rule[live]) & 1 == 1]
        first[hit] = np.where(first[hit] < 0, place[hit], first[hit])
        last[hit] = place[hit]
        live = live[(place[live] < end[live]) & ~np.isin(state[live], dead)]
    return first, last
