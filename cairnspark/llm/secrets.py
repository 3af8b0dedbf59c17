"""Secret scans with one automaton for all rules.

The rules' expressions become one byte automaton: a Thompson construction over byte sets, subset construction over classes
of bytes that no rule tells apart, minimisation by partition refinement, and a transition array. A slice of texts is then
read once, in lanes that all advance one byte per step; where a lane starts inside a match, it is run again from the state
its predecessor ended in, so hits across lanes are found. Two more automata of all rules give the spans in the texts that it
marks: one of the reversed expressions, read from the end, stops where matches start, and one that begins there and reads
forward stops where they end last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_slices

_sre = re._parser  # the standard library's own reading of an expression


@dataclass(frozen=True)
class Rule:
    """kind; a byte expression that every match contains; the exact one; one that matches wherever the exact one does, if counts in
    that would make too many states (the exact one by default); how long the repeated end of a match is at least, for rules whose
    shorter matches take their place but are no findings. Expressions have no priorities: the longest match at a place counts."""

    kind: str
    trigger: str
    exact: str
    begins: str | None = None
    least: int = 1
    any_case: bool = False


_VALUE = "[A-Za-z0-9+/_.=-]"
_KEYS = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"

#: Fixed expressions: the three base kinds first, then the kinds that are added to them.
BASE_RULES = (
    Rule("assign", f"{_KEYS}{_VALUE}{{8}}", f"{_KEYS}{_VALUE}+", least=8, any_case=True),
    Rule("access", "AKIA[A-Z0-9]{12}", "AKIA[A-Z0-9]+", least=12),
    Rule("hex", "[0-9a-f]{32}", "[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", "xox[abprs]-", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]"),
    Rule("google", "AIza", "AIza[0-9A-Za-z_-]{35}", "AIza[0-9A-Za-z_-]"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("stripe", "[sr]k_live_", "[sr]k_live_[0-9A-Za-z]{16,}", "[sr]k_live_[0-9A-Za-z]"),
    Rule("key_block", "-----BEGIN ", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, any_case: bool) -> int:
        """Append a parsed expression after `start`; returns its end."""
        at = start
        for op, value in tree:
            name = str(op)
            if name in ("LITERAL", "IN", "ANY"):
                end = self.state()
                self.moves[at].append((_byte_set(name, value, any_case), end))
                at = end
            elif name == "SUBPATTERN":
                at = self.add(value[-1], at, any_case)
            elif name == "BRANCH":
                end = self.state()
                for branch in value[1]:
                    self.empty[self.add(branch, at, any_case)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                least, most, inner = value
                for _ in range(least):
                    at = self.add(inner, at, any_case)
                if most == _sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(inner, loop, any_case)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.empty[at].append(end)
                    for _ in range(most - least):
                        at = self.add(inner, at, any_case)
                        self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"a trigger can't have {name}")
        return at


    def turn(self, first: int) -> None:
        """Turn all moves between the states from `first` on around."""
        moves: list[list] = [[] for _ in self.moves[first:]]
        empty: list[list] = [[] for _ in self.moves[first:]]
        for s in range(first, len(self.moves)):
            for on, t in self.moves[s]:
                moves[t - first].append((on, s))
            for t in self.empty[s]:
                empty[t - first].append(s)
        self.moves[first:], self.empty[first:] = moves, empty


def _byte_set(name: str, value, any_case: bool) -> frozenset[int]:
    if name == "ANY":
        return frozenset(range(256)) - {10}
    found: set[int] = set()
    for op, x in [(name, value)] if name == "LITERAL" else value:
        if str(op) == "LITERAL":
            found.add(x)
        elif str(op) == "RANGE":
            found.update(range(x[0], x[1] + 1))
        elif str(op) != "NEGATE":
            raise ValueError(f"a trigger can't have {op}")
    if any_case:
        found |= {ord(y) for x in found if x < 128 for y in (chr(x).lower(), chr(x).upper())}
    if name == "IN" and str(value[0][0]) == "NEGATE":
        found = set(range(256)) - found
    if max(found) > 255:
        raise ValueError("a trigger must be ASCII")
    return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """next state = table[state * classes + class of byte]; marks[state] has a bit for each rule that matches there."""

    byte_class: bytes
    classes: int
    table: np.ndarray
    marks: np.ndarray
    dead: int = -1

    def lanes(self, data: bytes) -> tuple[np.ndarray, int]:
        """The rules hit in each of the equal stretches of data, and the bytes of a stretch."""
        count = max(1, min(8192, len(data) // 256))
        size = -(-len(data) // count)
        coded = np.frombuffer(data.translate(self.byte_class).ljust(count * size, self.byte_class[:1]), dtype=np.uint8)
        steps = np.ascontiguousarray(coded.reshape(count, size).T)
        begun, ends, marks = np.zeros(count, dtype=np.int32), np.zeros(count, dtype=np.int32), np.zeros(count, dtype=self.marks.dtype)
        todo = np.arange(count)
        while len(todo):
            state, found, part = begun[todo], np.zeros(len(todo), dtype=self.marks.dtype), steps if len(todo) == count else steps[:, todo]
            for step in part:
                state = self.table[state * self.classes + step]
                found |= self.marks[state]
            ends[todo] = state
            marks[todo] |= found
            wrong = np.flatnonzero(begun[1:] != ends[:-1]) + 1
            begun[wrong] = ends[wrong - 1]
            todo = wrong
        return marks, size


def compile_rules(rules: Sequence[Rule] = RULES) -> Automaton:
    """The automaton that marks where a trigger of each rule has been read."""
    return _automaton([(rule.trigger, rule.any_case) for rule in rules])


def _automaton(expressions: Sequence[tuple[str, bool]], anywhere: bool = True, backward: bool = False) -> Automaton:
    """One minimised automaton for all expressions, each a bit of its marks. It may begin `anywhere` or only at the first byte (then
    state 0 is the start and the state without a way out is `dead`), and reads texts `backward` from the ends of matches."""
    nfa, start, finals = _Nfa(), 0, {}
    nfa.state()
    for i, (expression, any_case) in enumerate(expressions):
        first = nfa.state()
        last = nfa.add(_sre.parse(expression), first, any_case)
        if backward:
            nfa.turn(first)
            first, last = last, first
        nfa.empty[start].append(first)
        finals[last] = 1 << i
    # bytes that no move tells apart share a class
    sets = list({s for moves in nfa.moves for s, _ in moves})
    classes: dict[tuple, int] = {}
    byte_class = bytes(classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256))
    example = [byte_class.index(c) for c in range(len(classes))]

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in finals)

    always = closure({start})
    numbers, order, rows = {always: 0}, [always], []
    for current in order:  # grows while it is read
        row = []
        for byte in example:
            target = closure({t for s in current for on, t in nfa.moves[s] if byte in on}) | (always if anywhere else frozenset())
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        rows.append(row)
    table = np.array(rows, dtype=np.int64)
    marks = np.array([sum({finals[s] for s in x if s in finals}) for x in order], dtype=np.int64)
    group = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    # the start state becomes 0
    group = np.where(group == group[0], 0, np.where(group == 0, group[0], group))
    first = np.unique(group, return_index=True)[1]
    dead = int(group[numbers[frozenset()]]) if frozenset() in numbers else -1
    return Automaton(byte_class, len(classes), group[table[first]].astype(np.int32).ravel(), marks[first].astype(np.uint16), dead)


class Spans:
    """Spans of all rules in one text: leftmost, longest, not overlapping within a rule."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = rules
        self.starts = _automaton([(r.begins or r.exact, r.any_case) for r in rules], backward=True)
        self.ends = _automaton([(r.exact, r.any_case) for r in rules], anywhere=False)
        self._tables = [(a.table.reshape(-1, a.classes).tolist(), a.marks.tolist()) for a in (self.starts, self.ends)]

    def of(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then by the rules' order."""
        (back, begun), (forth, ended) = self._tables
        state, begins = 0, []
        for i, c in enumerate(reversed(data.translate(self.starts.byte_class))):
            state = back[state][c]
            if begun[state]:
                begins.append((len(data) - 1 - i, begun[state]))
        coded, dead = data.translate(self.ends.byte_class), self.ends.dead
        free, found = [0] * len(self.rules), []
        for start, bits in reversed(begins):
            open_rules = [k for k in range(len(self.rules)) if bits >> k & 1 and start >= free[k]]
            if not open_rules:
                continue
            # one reading gives the first and the last end of each rule here
            state, first, last = 0, {}, {}
            for at in range(start, len(coded)):
                state = forth[state][coded[at]]
                if state == dead:
                    break
                if ended[state]:
                    for k in open_rules:
                        if ended[state] >> k & 1:
                            first.setdefault(k, at)
                            last[k] = at
            for k, at in last.items():
                free[k] = at + 1
                if at - first[k] + 1 >= self.rules[k].least:
                    found.append((start, k, at + 1))
        return sorted(found)


def _scan(rules: Sequence[Rule], automaton: Automaton, exact: Spans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, rows=20_000):
            texts = pc.fill_null(batch.column("text"), "")
            data = pc.binary_join(pa.array([texts.cast(pa.binary()).to_pylist()], type=pa.list_(pa.binary())), b"\0")[0].as_py()
            sizes = np.asarray(pc.binary_length(texts)).astype(np.int64) + 1
            ends = np.cumsum(sizes)
            hit = np.zeros(len(texts), dtype=np.int64)
            if data:
                marks, size = automaton.lanes(data)
                for lane in np.flatnonzero(marks):
                    a, b = np.searchsorted(ends, [lane * size, (lane + 1) * size - 1], side="right")
                    hit[a : b + 1] |= int(marks[lane])
            found: list[list] = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(hit).tolist():
                own = data[ends[i] - sizes[i] : ends[i] - 1]
                # code points before each byte
                points = np.concatenate([[0], np.cumsum((np.frombuffer(own, dtype=np.uint8) & 0xC0) != 0x80)])
                found[i] = [{"kind": rules[k].kind, "start": int(points[a]), "end": int(points[b])} for a, k, b in exact.of(own)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=kind)], names=["doc_id", "findings"])

    return run


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings in docs (doc_id, text): doc_id, findings array of (kind, start, end), by start, then by the rules' order.

    Offsets are code points, ends exclusive; matches of one kind don't overlap and are the leftmost ones. A null or empty text
    has no findings, repeated rows are scanned one by one, other columns are not looked at; a text of any length is read whole by
    one task; an empty table gives an empty one.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scan(rules, compile_rules(rules), Spans(rules)), "doc_id long, findings array<struct<kind:string,start:long,end:long>>"
    )


def spelled(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
