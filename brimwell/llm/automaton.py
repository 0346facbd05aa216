"""Byte automata: regular expressions by subset construction and minimisation into transition arrays.

`compile_rules` joins all rules in one deterministic automaton whose states know which rules accept.
Patterns are read by the parser of the standard `re` module; bytes, classes, groups, alternatives and
repeats are understood, anchors and back references are refused.  Matching is leftmost-longest.
"""

from __future__ import annotations

import re._constants as K
import re._parser as P
from dataclasses import dataclass

import numpy as np

SEPARATOR = 0xFF  # stands between texts; no UTF-8 text holds it and no rule may match it
LANE = 256  # bytes that one lane of a scan takes
FEW = 24  # lanes below which the scan goes on without numpy


@dataclass
class Automaton:
    """table[state, class of byte] is the next state; states from `accepting` on accept, with a bit for each rule in `masks`."""

    table: np.ndarray
    classes: np.ndarray
    masks: list[int]
    start: int
    accepting: int
    dead: int  # -1 where every state can still accept

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that begins at `at`, or -1."""
        rows, classes, s, found = self.rows, self.class_list, self.start, -1
        if s >= self.accepting:
            found = at
        for i in range(at, len(data)):
            s = rows[s][classes[data[i]]]
            if s == self.dead:
                break
            if s >= self.accepting:
                found = i + 1
        return found

    def __post_init__(self) -> None:
        self.rows = self.table.tolist()
        self.class_list = self.classes.tolist()


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[int, int]]] = []  # (bit mask of bytes, next state)

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def put(self, items, at: int, flags: int, reverse: bool) -> int:
        """Adds a parsed sequence behind state `at`; returns the state it ends in."""
        for op, arg in reversed(list(items)) if reverse else items:
            if op in (K.LITERAL, K.NOT_LITERAL, K.IN, K.ANY):
                to = self.state()
                self.edges[at].append((_bytes(op, arg, flags), to))
                at = to
            elif op is K.SUBPATTERN:
                _, add, drop, inner = arg
                at = self.put(inner, at, (flags | add) & ~drop, reverse)
            elif op is K.BRANCH:
                to = self.state()
                for inner in arg[1]:
                    first = self.state()
                    self.empty[at].append(first)
                    self.empty[self.put(inner, first, flags, reverse)].append(to)
                at = to
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                least, most, inner = arg
                for _ in range(least):
                    at = self.put(inner, at, flags, reverse)
                if most is K.MAXREPEAT:
                    loop, to = self.state(), self.state()
                    self.empty[at] += [loop]
                    self.empty[self.put(inner, loop, flags, reverse)].append(loop)
                    self.empty[loop].append(to)
                    at = to
                else:
                    to = self.state()
                    self.empty[at].append(to)
                    for _ in range(most - least):
                        at = self.put(inner, at, flags, reverse)
                        self.empty[at].append(to)
                    at = to
            else:
                raise ValueError(f"not a rule for a byte automaton: {op}")
        return at


def _bytes(op, arg, flags: int) -> int:
    if op is K.ANY:
        return (1 << 256) - 1 & ~(1 << 10) & ~(1 << SEPARATOR)
    items = [(op, arg)] if op is not K.IN else list(arg)
    mask, negate = 0, False
    for kind, x in items:
        if kind is K.NEGATE:
            negate = True
        elif kind is K.LITERAL:
            mask |= 1 << x
        elif kind is K.NOT_LITERAL:
            mask, negate = 1 << x, True
        elif kind is K.RANGE:
            mask |= (1 << (x[1] + 1)) - (1 << x[0])
        else:
            raise ValueError(f"not in a class of a byte automaton: {kind}")
    if flags & K.SRE_FLAG_IGNORECASE:
        for b in range(26):
            if mask >> (65 + b) & 1 or mask >> (97 + b) & 1:
                mask |= 1 << (65 + b) | 1 << (97 + b)
    if negate:
        mask = ~mask & ((1 << 256) - 1) & ~(1 << SEPARATOR)
    if mask >> SEPARATOR:
        raise ValueError("a rule may not match the byte 255")
    return mask


def compile_rules(patterns: list[str], *, anywhere: bool, reverse: bool = False) -> Automaton:
    """One minimal automaton for all patterns.

    anywhere: a match may begin at any byte, else at the first only.  reverse: it reads texts from
    their end, so that it accepts where a match of the forward pattern begins.
    """
    nfa = _Nfa()
    first = nfa.state()
    ends: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        parsed = P.parse(pattern)
        own = nfa.state()
        nfa.empty[first].append(own)
        ends[nfa.put(parsed, own, parsed.state.flags, reverse)] = k
    masks = sorted({m for edges in nfa.edges for m, _ in edges})
    kinds: dict[tuple[int, ...], int] = {}
    classes = np.array([kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]

    # sets of states are bit masks; `reach` has what a state leads to without a byte, `moves` what it leads to by a class
    reach = []
    for s in range(len(nfa.empty)):
        held, todo = 1 << s, [s]
        while todo:
            for x in nfa.empty[todo.pop()]:
                if not held >> x & 1:
                    held |= 1 << x
                    todo.append(x)
        reach.append(held)
    moves = [[(c, reach[n]) for m, n in edges for c, b in enumerate(sample) if m >> b & 1] for edges in nfa.edges]
    base = reach[first]
    number, todo, table = {base: 0}, [base], []
    for states in todo:  # grows as new sets are met
        row = [base if anywhere else 0] * len(sample)
        while states:
            low = states & -states
            for c, held in moves[low.bit_length() - 1]:
                row[c] |= held
            states ^= low
        for c, target in enumerate(row):
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row[c] = number[target]
        table.append(row)
    accept = [sum(1 << k for s, k in ends.items() if states >> s & 1) for states in number]
    return _minimal(np.array(table, np.int64), classes, accept)


def _minimal(table: np.ndarray, classes: np.ndarray, accept: list[int]) -> Automaton:
    """Merges states until those that remain differ in what they accept; accepting states come last."""
    block = np.unique(np.array(accept, object).astype(str), return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, one = np.unique(block, return_index=True)
    order = sorted(range(len(one)), key=lambda b: (accept[one[b]] != 0, b))
    new = np.empty(len(one), np.int64)
    new[order] = np.arange(len(one))
    small = new[block[table[one[order]]]].astype(np.int32)
    masks = [accept[one[b]] for b in order]
    accepting = sum(m == 0 for m in masks)
    stuck = [s for s in range(accepting) if (small[s] == s).all()]
    return Automaton(small, classes, masks, int(new[block[0]]), accepting, stuck[0] if stuck and stuck[0] != new[block[0]] else -1)


def scan_backwards(machine: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, state) wherever the reversed automaton accepts, by place, in one pass over the bytes.

    The texts are laid out with a separator before each.  Bytes that lead from every state to the
    first one cut this row into lanes, which advance together; the cuts change no state.
    """
    n_texts = len(offsets) - 1
    row = np.full(len(data) + n_texts, SEPARATOR, np.uint8)
    shift = np.repeat(np.arange(1, n_texts + 1), np.diff(offsets))
    row[np.arange(len(data)) + shift] = data
    resets = (machine.table == machine.start).all(axis=0)
    symbols = machine.classes[row]
    if not resets[machine.classes[SEPARATOR]]:
        raise ValueError("the separator must lead to the first state")
    cuts = np.flatnonzero(resets[symbols])
    ends = cuts[np.unique(np.searchsorted(cuts, np.arange(0, len(row), LANE), "left").clip(max=len(cuts) - 1))] if len(row) else np.zeros(0, np.int64)
    ends = np.append(ends[ends > 0], len(row))
    begins = np.append(0, ends[:-1])
    size = ends - begins
    order = np.argsort(-size, kind="stable")
    size, at = size[order], ends[order] - 1
    alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right") if len(row) else np.zeros(0, np.int64)
    flat, width = machine.table.ravel(), machine.table.shape[1]
    state = np.full(len(at), machine.start, np.int32)
    places, states = [], []
    step = 0
    while step < len(alive) and alive[step] >= FEW:
        k = alive[step]
        state = flat[state[:k] * width + symbols[at[:k] - step]]
        if state.max() >= machine.accepting:
            hit = np.flatnonzero(state >= machine.accepting)
            places.append(at[hit] - step)
            states.append(state[hit])
        step += 1
    if step < len(alive):
        rows = machine.rows
        for lane in range(int(alive[step])):
            s = int(state[lane])
            top = int(at[lane]) - step
            low = int(at[lane]) - int(size[lane])
            for back, c in enumerate(symbols[low + 1 : top + 1][::-1].tobytes()):
                s = rows[s][c]
                if s >= machine.accepting:
                    places.append(np.array([top - back]))
                    states.append(np.array([s], np.int32))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    place, found = np.concatenate(places), np.concatenate(states)
    by = np.argsort(place, kind="stable")
    place, found = place[by], found[by]
    text = np.searchsorted(offsets + np.arange(n_texts + 1), place, "right") - 1
    return place - text - 1, found  # as a place in data
