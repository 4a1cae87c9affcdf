"""One deterministic automaton for many regular expressions, as transition arrays.

Patterns are read with Python's own regex parser (literals, classes, groups, alternatives,
repeats, case-insensitive groups; no anchors, look-around or back references), turned into
non-deterministic states over bytes, made deterministic by subset construction for all patterns at
once, and minimised by partition refinement. Bytes no pattern tells apart share a column.

:class:`Scanner` finds, per pattern, the matches that lie leftmost and do not overlap, each as long
as possible. One pass of the combined automaton over the bytes gives the ends; for every end the
automaton of the reversed pattern, run backwards, gives the start. The pass advances all stretches
of a text between two bytes that always lead to the first state (a line end, say) side by side.

Patterns must be such that a match cannot be followed directly by another's end (all that end in a
repeated class or a fixed text that differs from their beginning are).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_OPS = re._constants
_NAMED = {
    _OPS.CATEGORY_DIGIT: set(b"0123456789"),
    _OPS.CATEGORY_SPACE: set(b" \t\n\r\x0b\x0c"),
    _OPS.CATEGORY_WORD: set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"),
}
LANES = 12


class _Graph:
    """Non-deterministic states: edges on byte sets, and empty moves."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def on(self, byte_set: set[int], begin: int) -> int:
        end = self.state()
        self.edges[begin].append((frozenset(byte_set), end))
        return end

    def add(self, parsed, begin: int, fold: bool, backwards: bool) -> int:
        """Append a parsed sequence after ``begin``; returns its last state."""
        items = reversed(list(parsed)) if backwards else parsed
        for op, arg in items:
            begin = self._item(op, arg, begin, fold, backwards)
        return begin

    def _item(self, op, arg, begin: int, fold: bool, backwards: bool) -> int:
        if op is _OPS.LITERAL:
            return self.on(_folded({arg}, fold), begin)
        if op is _OPS.IN:
            return self.on(_folded(_members(arg), fold), begin)
        if op is _OPS.SUBPATTERN:
            _, added, _, inner = arg
            return self.add(inner, begin, fold or bool(added & re.IGNORECASE), backwards)
        if op is _OPS.BRANCH:
            end = self.state()
            for choice in arg[1]:
                self.empty[self.add(choice, begin, fold, backwards)].append(end)
            return end
        if op is _OPS.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                begin = self.add(inner, begin, fold, backwards)
            if most == _OPS.MAXREPEAT:
                loop = self.state()
                self.empty[begin].append(loop)
                self.empty[self.add(inner, loop, fold, backwards)].append(loop)
                return loop
            end = self.state()
            for _ in range(most - least):
                self.empty[begin].append(end)
                begin = self.add(inner, begin, fold, backwards)
            self.empty[begin].append(end)
            return end
        raise ValueError(f"not supported in a scanned pattern: {op}")

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for other in self.empty[todo.pop()]:
                if other not in found:
                    found.add(other)
                    todo.append(other)
        return frozenset(found)


def _members(items) -> set[int]:
    out: set[int] = set()
    for op, arg in items:
        if op is _OPS.LITERAL:
            out.add(arg)
        elif op is _OPS.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        elif op is _OPS.CATEGORY:
            out |= _NAMED[arg]
        else:
            raise ValueError(f"not supported in a scanned class: {op}")
    return out


def _folded(members: set[int], fold: bool) -> set[int]:
    if max(members) > 127:
        raise ValueError("scanned patterns are ASCII")
    if fold:
        members = members | {ord(chr(m).swapcase()) for m in members if chr(m).isalpha()}
    return members


@dataclass(frozen=True)
class Automaton:
    """``table[state, column]``; state 0 is the first, ``column[byte]``; ``accepts``: pattern bits.

    States are numbered so that those that accept come last, from ``first_accept`` on.
    ``dead`` is the state nothing leaves (-1: there is none).
    """

    table: np.ndarray
    column: np.ndarray
    accepts: np.ndarray
    first_accept: int
    dead: int

    @property
    def resets(self) -> np.ndarray:
        """Per byte: does it lead from every state to the first one?"""
        return (self.table == 0).all(axis=0)[self.column]

    def shortest(self) -> int:
        """Bytes of the shortest text that is accepted."""
        seen, step = {0}, 0
        front = {0}
        while front and not any(self.accepts[s] for s in front):
            front = {int(t) for s in front for t in self.table[s]} - seen
            seen |= front
            step += 1
        return step


def compile_patterns(patterns: list[str], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """Subset construction over all patterns at once; ``anywhere``: a match may begin at any byte."""
    graph = _Graph()
    root = graph.state()
    ends = [graph.add(re._parser.parse(pattern), root, False, backwards) for pattern in patterns]
    column, sets = _columns(graph)
    begin = graph.closure([root])
    number, todo, rows = {begin: 0}, [begin], []
    while todo:
        members = todo.pop(0)
        row = []
        for sample in sets:
            reached = {t for s in members for on, t in graph.edges[s] if sample in on}
            if anywhere:
                reached |= begin
            target = graph.closure(reached)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    accepts = np.array([sum(1 << k for k, end in enumerate(ends) if end in members) for members in number], np.int64)
    return _minimised(np.array(rows, np.int64), accepts, column)


def _columns(graph: _Graph) -> tuple[np.ndarray, list[int]]:
    """Bytes that are in the same edge sets share a column; a sample byte of each column."""
    sets = {on for edges in graph.edges for on, _ in edges}
    kinds: dict[tuple, int] = {}
    column, samples = np.zeros(256, np.uint8), []
    ordered = sorted(sets, key=sorted)
    for byte in range(256):
        kind = tuple(byte in on for on in ordered)
        if kind not in kinds:
            kinds[kind] = len(kinds)
            samples.append(byte)
        column[byte] = kinds[kind]
    return column, samples


def _minimised(table: np.ndarray, accepts: np.ndarray, column: np.ndarray) -> Automaton:
    """Merge states no text tells apart: refine by the blocks their moves lead to."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    blocks = int(block.max()) + 1
    pick = np.array([np.flatnonzero(block == b)[0] for b in range(blocks)])
    order = sorted(range(blocks), key=lambda b: (b != block[0], accepts[pick[b]] != 0, b))
    rank = np.empty(blocks, np.int64)
    rank[order] = np.arange(blocks)
    pick = pick[order]
    table = rank[block[table[pick]]]
    accepts = accepts[pick]
    first_accept = int(np.flatnonzero(accepts)[0])
    stuck = [s for s in range(len(table)) if not accepts[s] and (table[s] == s).all()]
    return Automaton(table.astype(np.int32), column, accepts, first_accept, stuck[0] if stuck else -1)


class Scanner:
    """Finds the matches of all patterns in byte arrays."""

    def __init__(self, patterns: list[str]):
        self.forward = compile_patterns(patterns)
        self.backward = [compile_patterns([p], anywhere=False, backwards=True) for p in patterns]
        self.shortest = self.forward.shortest()
        self.reset = self.forward.resets
        self.columns = self.forward.table.shape[1]
        # State times columns, so that the next lookup needs one addition.
        self.moves = np.ascontiguousarray((self.forward.table * self.columns).ravel().astype(np.int32))
        self.back_rows = [(a.table.tolist(), a.column.tolist(), a.accepts.tolist(), a.dead) for a in self.backward]

    def accepting(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of bytes after which some pattern accepts, ascending, and the pattern bits."""
        column = self.forward.column[data]
        cuts = np.flatnonzero(self.reset[data])
        begin = np.concatenate([[0], cuts + 1])
        length = np.concatenate([cuts, [len(data)]]) - begin
        long_enough = length >= self.shortest
        begin, length = begin[long_enough], length[long_enough]
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        limit = self.forward.first_accept * self.columns
        state = np.zeros(len(begin), np.int32)
        positions, states = [], []
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        step = 0
        for count in active.tolist():
            if count < LANES:
                break
            at = begin[:count] + step
            state = self.moves[state[:count] + column[at]]
            if state.max() >= limit:
                hit = np.flatnonzero(state >= limit)
                positions.append(at[hit])
                states.append(state[hit])
            step += 1
        for lane in range(int((length > step).sum())):  # the few longest stretches, one by one
            moves, now = self.moves, int(state[lane])
            found, begin_at = [], int(begin[lane]) + step
            for at, kind in enumerate(column[begin_at : int(begin[lane] + length[lane])].tolist(), begin_at):
                now = int(moves[now + kind])
                if now >= limit:
                    found.append((at, now))
            if found:
                positions.append(np.array([x[0] for x in found]))
                states.append(np.array([x[1] for x in found]))
        if not positions:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        where, what = np.concatenate(positions), np.concatenate(states)
        order = np.argsort(where, kind="stable")
        return where[order].astype(np.int64), self.forward.accepts[what[order] // self.columns]

    def matches(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(pattern, start, end) of every match, by pattern and start."""
        where, bits = self.accepting(data)
        out = []
        for pattern in range(len(self.backward)):
            ends = where[(bits >> pattern) & 1 == 1]
            last = np.concatenate([np.diff(ends) != 1, [True]]) if len(ends) else []
            floor = 0
            for end in (ends[last] + 1).tolist() if len(ends) else []:
                start = self._start(pattern, data, floor, end)
                if start >= 0:
                    out.append((pattern, start, end))
                    floor = end
        return out

    def _start(self, pattern: int, data: np.ndarray, floor: int, end: int) -> int:
        """The earliest start, not before ``floor``, of a match that ends at ``end``; -1: none."""
        table, column, accepts, dead = self.back_rows[pattern]
        state, best = 0, -1
        block, at = 4096, end
        while at > floor:
            low = max(floor, at - block)
            for byte in reversed(data[low:at].tolist()):
                at -= 1
                state = table[state][column[byte]]
                if state == dead:
                    return best
                if accepts[state]:
                    best = at
        return best
