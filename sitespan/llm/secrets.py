"""Secret scans: one deterministic automaton for all rules.

The rules' regular expressions (literals, classes, groups, alternation,
? * + {m,n}) are compiled over bytes: Thompson's construction, the subset
construction of all rules together behind a start that any byte may precede,
and minimisation by partition refinement. The result is one transition array;
a text's UTF-8 bytes pass through it once, and states that accept say which
rule's match ends there. A match's start comes from the rule's reversed
automaton, run back from its end.

A rule's expression must end in a repeated class (or a fixed string), so that a
match grows until its accepting run ends; matches are leftmost, longest and do
not overlap within a rule. `least` drops matches by the length of a rule's last
part; dropped ones still use up their characters.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import row_mapper


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters of the part after `skip`, or of the match
    skip: str = ""  # what precedes the part that `least` measures
    any_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, r"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),  # shorter runs are told apart by length, which keeps the automaton small
)
MORE = (
    Rule("pem", r"-----BEGIN\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY-----"),
    # keys known by their prefix share one rule: what may be under way at once multiplies the automaton's states
    Rule("key", r"(gh[pousr]_|xox[abprs]-|[sr]k_(live|test)_|AIza|eyJ)[A-Za-z0-9_.-]+", 24),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]+", 20, r"[A-Za-z]+\x20+", True),
    Rule("login", r"://[A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE


# --- expressions to automata -------------------------------------------------


def parsed(pattern: str):
    """Syntax tree: ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, least, most or None)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        if c.isalnum():
            raise ValueError(f"escape \\{c} is not supported")
        return ord(c)

    def charset() -> frozenset:
        nonlocal at
        negated = pattern[at] == "^"
        at += negated
        out: set[int] = set()
        while pattern[at] != "]":
            low = high = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = char()
            out.update(range(low, high + 1))
        at += 1
        return frozenset(range(256)) - out if negated else frozenset(out)

    def item():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            part = either()
            at += 1
        elif pattern[at] == "[":
            at += 1
            part = "set", charset()
        else:
            part = "set", frozenset([char()])
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                low, comma, high = pattern[at : pattern.index("}", at)].partition(",")
                at = pattern.index("}", at) + 1
                part = "rep", part, int(low), (int(high) if high else None) if comma else int(low)
            else:
                part = "rep", part, int(c == "+"), 1 if c == "?" else None
        return part

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(item())
        return "cat", parts

    def either():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return "alt", parts

    return either()


def any_case(tree):
    kind = tree[0]
    if kind == "set":
        return "set", frozenset(c for b in tree[1] for c in ((b, b ^ 32) if chr(b).isascii() and chr(b).isalpha() else (b,)))
    if kind == "rep":
        return "rep", any_case(tree[1]), *tree[2:]
    return kind, [any_case(x) for x in tree[1]]


def reversed_tree(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return "rep", reversed_tree(tree[1]), *tree[2:]
    parts = [reversed_tree(x) for x in tree[1]]
    return kind, parts[::-1] if kind == "cat" else parts


class Nfa:
    def __init__(self) -> None:
        self.free: list[set[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append(set())
        self.steps.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Put the tree behind `start`; its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.steps[start].append((tree[1], end))
            return end
        if kind == "cat":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                begin = self.state()
                self.free[start].add(begin)
                self.free[self.add(x, begin)].add(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start].add(loop)
            self.free[loop].add(end)
            self.free[self.add(part, loop)].add(loop)
            return end
        end = self.state()
        self.free[start].add(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.free[start].add(end)
        return end

    def closed(self, states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)


def minimal(trees: list, search: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transition array (states x 256) and, for each state, the bits of the trees that it accepts; state 0 begins.

    With `search`, a match may begin at any byte.
    """
    nfa = Nfa()
    begin = nfa.state()
    ends: dict[int, int] = {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.free[begin].add(first)
        ends[nfa.add(tree, first)] = k
    # bytes that no rule tells apart are one letter
    sets = sorted({s for steps in nfa.steps for s, _ in steps}, key=sorted)
    kinds: dict[tuple, int] = {}
    letter = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
    sample = [int(np.argmax(letter == x)) for x in range(len(kinds))]
    home = nfa.closed([begin])
    number, todo, rows = {home: 0}, deque([home]), []
    leads = [[frozenset().union(*(nfa.closed([t]) for s, t in steps if b in s)) for b in sample] for steps in nfa.steps]
    busy = {q for q, steps in enumerate(nfa.steps) if steps}
    while todo:
        now = todo.popleft()
        row = []
        moving = [leads[q] for q in now if q in busy]
        for x in range(len(sample)):
            nxt = frozenset().union(*(m[x] for m in moving))
            if search:
                nxt |= home
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum(1 << ends[q] for q in states if q in ends) for states in number])
    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # refine until states of a block agree on the blocks of all their successors
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    # quiet states first, so that accepting ones are known by their number; the start is 0
    first = np.unique(block, return_index=True)[1]
    order = sorted(range(len(first)), key=lambda k: (accepts[first[k]] != 0, k != block[0], k))
    new = np.empty(len(order), int)
    new[order] = np.arange(len(order))
    return new[block[table[first[order]]]][:, letter], accepts[first[order]]


class Automaton:
    """All rules' transition arrays, ready for scanning."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        trees = [any_case(parsed(r.pattern)) if r.any_case else parsed(r.pattern) for r in rules]
        self.unpack((rules, minimal(trees, True), [minimal([reversed_tree(t)], False) for t in trees]))

    @classmethod
    def unpacked(cls, packed: tuple) -> Automaton:
        out = cls.__new__(cls)
        out.unpack(packed)
        return out

    def unpack(self, packed: tuple) -> None:
        rules, (table, accepts), back = packed
        self.packed = rules, (table.astype(np.int32), accepts), back
        self.rules = rules
        self.table = (table.astype(np.int64) * 256).ravel().tolist()
        self.accepts = accepts.tolist()
        self.first = 256 * int(np.argmax(accepts != 0))
        self.back = []
        for t, a in back:
            dead = [k for k in range(len(t)) if not a[k] and (t[k] == k).all()]
            self.back.append(((t * 256).ravel().tolist(), [bool(x) for x in a], dead[0] * 256 if dead else -1))
        self.skips = [re.compile(r.skip.encode()) if r.skip else None for r in rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """Where rules accept: (offset behind the byte, bits of the rules). The one pass."""
        table, first, s, hits = self.table, self.first, 0, []
        for i, b in enumerate(data):
            s = table[s + b]
            if s >= first:
                hits.append((i + 1, s))
        accepts = self.accepts
        return [(i, accepts[s >> 8]) for i, s in hits]

    def start(self, k: int, data: bytes, end: int, floor: int) -> int:
        """The first byte of the longest match of rule k that ends at `end` and begins at `floor` or later; -1: none."""
        table, good, dead = self.back[k]
        s, found = 0, -1
        for i in range(end - 1, floor - 1, -1):
            s = table[s + data[i]]
            if s == dead:
                break
            if good[s >> 8]:
                found = i
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule's number, end) in bytes, sorted."""
        hits = self.ends(data)
        if not hits:
            return []
        out = []
        last = {}
        floor = [0] * len(self.rules)
        for i, bits in [*hits, (len(data) + 2, 0)]:
            for k in [k for k, e in last.items() if e < i - 1 or not bits >> k & 1]:
                end = last.pop(k)
                begin = self.start(k, data, end, floor[k])
                if begin >= 0:
                    floor[k] = end
                    if self.long(k, data[begin:end]):
                        out.append((begin, k, end))
            k = 0
            while bits:
                if bits & 1:
                    last[k] = i
                bits >>= 1
                k += 1
        return sorted(out)

    def long(self, k: int, found: bytes) -> bool:
        least, skip = self.rules[k].least, self.skips[k]
        return len(found) - (skip.match(found).end() if skip else 0) >= least


_built: dict[tuple, Automaton] = {}


def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """The rules' automaton, compiled once a process."""
    if rules not in _built:
        _built[rules] = Automaton(rules)
    return _built[rules]


def received(packed: tuple) -> Automaton:
    """The automaton that the driver compiled, unpacked once a worker."""
    rules = packed[0]
    if rules not in _built:
        _built[rules] = Automaton.unpacked(packed)
    return _built[rules]


def find(text: str | None, auto: Automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then the rules' order."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = auto.spans(data)
    if found and not data.isascii():
        # bytes that begin a character, counted once for all spans
        at = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
        found = [(int(at[a]), k, int(at[b])) for a, k, b in found]
    return [(a, auto.rules[k].kind, b) for a, k, b in found]


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end) in code points.

    Null and empty texts have no spans. Spans of different rules may overlap.
    Rows that repeat all stay and get equal spans; an empty table gives none,
    and other columns, whatever their names, are not looked at.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]

    packed = automaton(rules).packed  # its size follows the rules, never the data

    def make():
        auto = received(packed)
        return lambda cols: [cols[0], [[{"kind": k, "start": a, "end": b} for a, k, b in find(t, auto)] for t in cols[1]]]

    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return row_mapper(d, "doc_id long, spans array<struct<kind:string,start:int,end:int>>", fields, make)
