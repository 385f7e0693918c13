"""Secret scans: all rules in one automaton over bytes.

Each rule's detection regex becomes a nondeterministic automaton (Thompson's construction), all of them together one
deterministic automaton by subset construction, which is minimised by partition refinement and laid out as a transition
array over byte classes. A text is cut where the automaton is certain to be back at its start (bytes after which nothing
is pending, found from the transitions), and all pieces of a batch take their bytes in step: one pass, all rules.
A piece in which a rule's detection state was reached goes to that rule's own regex, which gives the exact spans.

Spans are leftmost and don't overlap within a kind; matches below a kind's least length are dropped after matching.

Defined cases: a null or empty text has no spans (the digest of no spans is that of the empty string); positions are code
points; repeated rows are answered one by one; other columns don't matter; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced, texts_of


@dataclass(frozen=True)
class Rule:
    """exact: the rule's spans, by re. detect: a regex of the subset below that every match begins with; runs are left short
    where the least length alone would multiply the automaton's states. least: characters of group (0: the match)."""

    kind: str
    detect: str
    exact: bytes
    group: int
    least: int
    base: bool


#: The kinds in the order in which equal starts are listed.
RULES = (
    Rule("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]", rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]{4}", rb"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]{24}", rb"[0-9a-f]+", 0, 24, True),
    Rule("github", "gh[opsur]_[A-Za-z0-9]", rb"gh[opsur]_[A-Za-z0-9]+", 0, 40, False),
    Rule("slack", "xox[abprs]-", rb"xox[abprs]-[0-9A-Za-z-]+", 0, 15, False),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)?", 0, 20, False),
    Rule("pem", "-----BEGIN\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----", rb"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 0, 1, False),
)

#: Bytes of a piece, about, before the next place where it may be cut.
PIECE = 224


class _Nfa:
    """Thompson's construction over bytes for literals, classes, groups, |, ?, *, +, {m} and {m,n}."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.step) - 1

    def add(self, regex: str) -> tuple[int, int]:
        self.regex, self.at = regex, 0
        found = self.either()
        if self.at != len(regex):
            raise ValueError(f"{regex!r}: unexpected {regex[self.at]!r} at {self.at}")
        return found

    def peek(self) -> str:
        return self.regex[self.at] if self.at < len(self.regex) else ""

    def either(self) -> tuple[int, int]:
        parts = [self.row()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.row())
        if len(parts) == 1:
            return parts[0]
        a, z = self.state(), self.state()
        for p, q in parts:
            self.empty[a].append(p)
            self.empty[q].append(z)
        return a, z

    def row(self) -> tuple[int, int]:
        a = z = self.state()
        while self.peek() not in ("", "|", ")"):
            p, q = self.repeated()
            self.empty[z].append(p)
            z = q
        return a, z

    def repeated(self) -> tuple[int, int]:
        begin = self.at
        found = self.atom()
        end, c = self.at, self.peek()
        if c in ("?", "*", "+") and c:
            self.at += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        elif c == "{":
            stop = self.regex.index("}", self.at)
            low, comma, high = self.regex[self.at + 1 : stop].partition(",")
            self.at = stop + 1
            least, most = int(low), (int(high) if high else None) if comma else int(low)
        else:
            return found
        after, made = self.at, [found]

        def again() -> tuple[int, int]:
            self.at = begin
            p = self.atom()
            if self.at != end:
                raise ValueError(self.regex)
            return p

        while len(made) < max(least, 1 if most is None else most):
            made.append(again())
        self.at = after
        a = z = self.state()
        for k, (p, q) in enumerate(made):
            n = self.state()
            self.empty[z].append(p)
            self.empty[q].append(n)
            if k >= least:
                self.empty[z].append(n)
            z = n
        if most is None:
            self.empty[z].append(made[-1][0])
        return a, z

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            self.at += 1
            found = self.either()
            if self.peek() != ")":
                raise ValueError(f"{self.regex!r}: a group isn't closed")
            self.at += 1
            return found
        if c == "[":
            stop = self.regex.index("]", self.at + 1)
            chosen = self.members(self.regex[self.at + 1 : stop])
            self.at = stop + 1
        else:
            code, self.at = self.char(self.regex, self.at)
            chosen = frozenset([code])
        a, z = self.state(), self.state()
        self.step[a] = (chosen, z)
        return a, z

    @staticmethod
    def char(text: str, i: int) -> tuple[int, int]:
        if text[i] != "\\":
            return ord(text[i]), i + 1
        return (int(text[i + 2 : i + 4], 16), i + 4) if text[i + 1] == "x" else (ord(text[i + 1]), i + 2)

    def members(self, text: str) -> frozenset[int]:
        found, i = set(), 0
        while i < len(text):
            low, i = self.char(text, i)
            high = low
            if i + 1 < len(text) and text[i] == "-":
                high, i = self.char(text, i + 1)
            found.update(range(low, high + 1))
        return frozenset(found)


@dataclass
class Automaton:
    """classes: of each byte. steps: next state times the number of classes, at state times that number plus the class.
    hits: bit per rule, at the same place as the state's row. sync: bytes after which every state is the start."""

    classes: np.ndarray
    steps: np.ndarray
    hits: np.ndarray
    sync: np.ndarray
    states: int
    unminimised: int


def build(regexes: list[str]) -> Automaton:
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for k, r in enumerate(regexes):
        a, z = nfa.add(r)
        nfa.empty[start].append(a)
        ends[z] = ends.get(z, 0) | 1 << k

    # bytes that no rule tells apart are one class
    signature = [tuple(b in s[0] for s in nfa.step if s) for b in range(256)]
    number: dict[tuple, int] = {}
    classes = np.array([number.setdefault(x, len(number)) for x in signature], np.uint8)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(number))]

    closed: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in closed:
            seen, todo = {s}, [s]
            while todo:
                for n in nfa.empty[todo.pop()]:
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            closed[s] = frozenset(x for x in seen if nfa.step[x] or x in ends)
        return closed[s]

    # subset construction; every byte may also begin a match anew
    root = closure(start)
    index, rows, marks, todo = {root: 0}, [], [], [root]
    moves = {s: [nfa.step[s][1] if nfa.step[s] and b in nfa.step[s][0] else None for b in sample] for s in range(len(nfa.step)) if nfa.step[s]}
    while todo:
        here = todo.pop(0)
        marks.append(sum({ends[s] for s in here if s in ends}))
        row = []
        for c in range(len(sample)):
            there = set(root)
            for s in here:
                if s in moves and moves[s][c] is not None:
                    there |= closure(moves[s][c])
            key = frozenset(there)
            if key not in index:
                index[key] = len(index)
                todo.append(key)
            row.append(index[key])
        rows.append(row)
    table, mark = np.array(rows, np.int64), np.array(marks, np.int64)

    # minimisation by refinement: states stay together while their marks and all successors' groups agree
    group = np.unique(mark, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = np.full(group.max() + 1, -1)
    first = np.unique(group, return_index=True)[1]
    order[group[0]] = 0
    order[[g for g in range(len(order)) if g != group[0]]] = np.arange(1, len(order))
    group = order[group]
    keep = np.empty(len(order), np.int64)
    keep[order] = first
    small, n = group[table[keep]], len(number)
    hits = np.zeros(len(keep) * n, np.uint8)
    hits[np.arange(len(keep)) * n] = mark[keep]
    return Automaton(classes, (small * n).astype(np.int32).ravel(), hits, (small == 0).all(axis=0)[classes], len(keep), len(table))


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    if len(rules) > 8:
        raise ValueError("hits are kept in 8 bits")
    return build([r.detect for r in rules])


def pieces(data: np.ndarray, offsets: np.ndarray, sync: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of all texts begin, and where they end: behind sync bytes and at the ends of texts."""
    cuts = np.flatnonzero(sync[data]) + 1
    text = np.searchsorted(offsets, cuts, side="left") - 1  # a cut at a text's end belongs to it and is its end anyway
    bins = (cuts - offsets[text]) // PIECE
    keep = np.concatenate([[True], (text[1:] != text[:-1]) | (bins[1:] != bins[:-1])])[: len(cuts)]
    starts = np.unique(np.concatenate([offsets, cuts[keep & (bins > 0)]]))
    return starts[:-1], starts[1:]


def run_automaton(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, dfa: Automaton) -> np.ndarray:
    """Bits of the rules detected in each piece; all pieces take their next byte in step."""
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that those which go on stand in front
    at, left = starts[order].copy(), np.sort(starts - ends)
    classed, state = dfa.classes[data], np.zeros(len(order), np.int32)
    seen, done, n = np.zeros(len(order), np.uint8), 0, len(order)
    while True:
        n = int(np.searchsorted(left[:n], -done, side="left"))  # pieces of more than done bytes
        if not n:
            break
        s = dfa.steps[state[:n] + classed[at[:n]]]
        state[:n] = s
        seen[:n] |= dfa.hits[s]
        at[:n] += 1
        done += 1
    out = np.zeros(len(order), np.uint8)
    out[order] = seen
    return out


def find_spans(column: pa.Array, rules: tuple[Rule, ...] = RULES, dfa: Automaton | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end) in code points, in order."""
    dfa = dfa or automaton(rules)
    data, offsets = texts_of(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(data):
        return out
    starts, ends = pieces(data, offsets, dfa.sync)
    seen = run_automaton(data, starts, ends, dfa)
    exact = [re.compile(r.exact) for r in rules]
    flagged = np.flatnonzero(seen)
    owner = np.searchsorted(offsets, starts[flagged], side="right") - 1
    for p, d in zip(flagged.tolist(), owner.tolist(), strict=True):
        lo, piece = int(starts[p]), data[starts[p] : ends[p]].tobytes()
        base = lo - int(offsets[d])
        for k, r in enumerate(rules):
            if seen[p] >> k & 1:
                out[d] += [(base + m.start(), k, base + m.end()) for m in exact[k].finditer(piece) if m.end(r.group) - m.start(r.group) >= r.least]
    for d in set(owner.tolist()):
        if out[d]:
            before = np.concatenate([[0], np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) == 0x80)])
            out[d] = sorted((a - int(before[a]), k, z - int(before[z])) for a, k, z in out[d])
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), for each document."""
    ship(docs.sparkSession)
    dfa = automaton(rules)
    kinds = [r.kind for r in rules]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 4 << 20):
            found = find_spans(b.column(1), rules, dfa)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"kind": kinds[k], "start": a, "end": z} for a, k, z in x] for x in found], span)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def secrets(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))

    def joined(spans):  # noqa: ANN001, ANN202
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):  # noqa: ANN202
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES if r.base]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """The spans by re over the whole text, for tests."""
    t = text or ""
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.exact.decode("latin-1"), t, re.ASCII):
            if m.end(r.group) - m.start(r.group) >= r.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def digest(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(",".join(f"{rules[k].kind}:{a}:{z}" for a, k, z in spans if rules[k].base).encode()).hexdigest()
