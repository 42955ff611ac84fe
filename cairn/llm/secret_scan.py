"""Secret scans (7): one combined deterministic automaton over bytes.

The rules' regexes become one nondeterministic automaton that reads texts from their end and may start
at any byte. Subset construction and minimisation turn it into transition arrays, and one pass over a
text's bytes tells, for all rules, at which bytes a match begins. From the leftmost of them on, a
rule's own automaton runs forward to the longest match, and the next match is looked for behind it:
leftmost, longest and without overlap, in time linear in the text. What is too short is dropped.
"""

from __future__ import annotations

import functools
import hashlib
import re
import re._parser as sre  # the parse tree of Python's own regexes
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.common import batches, column, texts


@dataclass(frozen=True)
class Rule:
    """kind; span: a regex over bytes of the whole match; group and least: what must have least characters, else the match is dropped."""

    kind: str
    span: bytes
    group: int = 0
    least: int = 0


# The kinds and patterns that are asked for, in their order.
BASE = (
    Rule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", rb"[0-9a-f]{24,}"),
)
# Public formats of credentials that the base kinds don't name.
MORE = (
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("google", rb"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("stripe", rb"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class _Nfa:
    def __init__(self, back: bool) -> None:
        self.back = back
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, tree, at: int, fold: bool = False) -> int:
        """Append the parsed regex from state at on, its last part first where texts are read from their end; its end state."""
        for op, arg in reversed(list(tree)) if self.back else tree:
            name = str(op)
            if name in ("LITERAL", "IN", "ANY"):
                to = self.state()
                self.step[at].append((_bytes(name, arg, fold), to))
                at = to
            elif name == "SUBPATTERN":
                at = self.add(arg[3], at, fold or bool(arg[1] & re.IGNORECASE))
            elif name == "BRANCH":
                end = self.state()
                for branch in arg[1]:
                    start = self.state()
                    self.free[at].append(start)
                    self.free[self.add(branch, start, fold)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, fold)
                if high == sre.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, fold)].append(loop)
                    self.free[loop].append(end)
                    at = end
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.free[at].append(end)
                        at = self.add(inner, at, fold)
                    self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"the automaton has no {name}")
        return at

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)


def _bytes(name: str, arg, fold: bool) -> frozenset[int]:
    if name == "LITERAL":
        got = {arg}
    elif name == "ANY":
        got = set(range(256)) - {10}
    else:
        got, negate = set(), False
        for op, x in arg:
            if str(op) == "NEGATE":
                negate = True
            elif str(op) == "LITERAL":
                got.add(x)
            elif str(op) == "RANGE":
                got.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"the automaton has no {op} in a class")
        got = set(range(256)) - got if negate else got
    if fold:
        got |= {b ^ 32 for b in got if 65 <= (b & ~32) <= 90}
    return frozenset(got)


def shortest(tree) -> list:
    """The parsed regex with repeats at its end cut to their least number: it matches from the same places."""
    out = list(tree)
    while out:
        name, arg = str(out[-1][0]), out[-1][1]
        if name == "MAX_REPEAT":
            low, high, inner = arg
            if not low:
                out.pop()
                continue
            out[-1] = (out[-1][0], (low, low, inner))
        elif name == "SUBPATTERN":
            out[-1] = (out[-1][0], (*arg[:3], shortest(arg[3])))
        elif name == "BRANCH":
            out[-1] = (out[-1][0], (arg[0], [shortest(x) for x in arg[1]]))
        break
    return out


class Automaton:
    """rows[state][byte] is the next state, the start is 0; accepting states are numbered last, from first_accept on; said[state - first_accept]: the bits of the patterns that have matched."""

    def __init__(self, trees: list, back: bool, anywhere: bool):
        """back: texts are read from their end; anywhere: a match may start at any byte, so the start is in every subset."""
        nfa = _Nfa(back)
        start, ends = nfa.state(), {}
        for k, tree in enumerate(trees):
            own = nfa.state()
            nfa.free[start].append(own)
            ends[nfa.add(tree, own)] = k
        # bytes that no step tells apart are one column
        sets = sorted({chars for own in nfa.step for chars, _ in own}, key=sorted)
        groups: dict[tuple, list[int]] = {}
        for b in range(256):
            groups.setdefault(tuple(b in x for x in sets), []).append(b)
        columns = list(groups.values())
        first = nfa.closure({start})
        number, todo, table, bits = {first: 0}, [first], [], []
        while todo:
            now = todo.pop(0)
            row = []
            for own in columns:
                to = {t for s in now for chars, t in nfa.step[s] if own[0] in chars}
                nxt = nfa.closure(to | {start} if anywhere else to)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            table.append(row)
            bits.append(sum(1 << ends[s] for s in now if s in ends))
        self.subset_states = len(table)
        table, bits, begin = _minimised(table, bits)
        # Accepting states last, the start first.
        order = sorted(range(len(table)), key=lambda s: (bits[s] > 0, s != begin, s))
        to_new = {s: k for k, s in enumerate(order)}
        of = {b: c for c, own in enumerate(columns) for b in own}
        self.rows = [[to_new[table[s][of[b]]] for b in range(256)] for s in order]
        self.first_accept = sum(1 for b in bits if not b)
        self.said = [bits[s] for s in order[self.first_accept :]]
        # once there, nothing matches any more
        self.dead = next((s for s in range(self.first_accept) if set(self.rows[s]) == {s}), -1)

    def begins(self, data: bytes) -> list[tuple[int, int]]:
        """(place, bits of the patterns of which a match begins there), from the last place to the first; for an automaton that reads back."""
        rows, accept, out, row, last = self.rows, self.first_accept, [], self.rows[0], len(data) - 1
        for k, b in enumerate(reversed(data)):
            s = row[b]
            row = rows[s]
            if s >= accept:
                out.append((last - k, self.said[s - accept]))
        return out

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that begins at `at`, -1 for none; for an automaton that reads forward."""
        rows, accept, dead, s, end = self.rows, self.first_accept, self.dead, 0, -1
        for k in range(at, len(data)):
            s = rows[s][data[k]]
            if s == dead:
                break
            if s >= accept:
                end = k + 1
        return end


def _minimised(table: list[list[int]], bits: list[int]) -> tuple[list[list[int]], list[int], int]:
    """Merge states that no input tells apart: split classes by what they accept and where each byte leads, until nothing splits."""
    of = bits
    count = len(set(of))
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((of[s], *[of[t] for t in row]), len(keys)) for s, row in enumerate(table)]
        if len(keys) == count:
            break
        of, count = new, len(keys)
    keep = {c: s for s, c in reversed(list(enumerate(new)))}
    return [[new[t] for t in table[keep[c]]] for c in range(count)], [bits[keep[c]] for c in range(count)], new[0]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [sre.parse(r.span) for r in rules]
        self.automaton = Automaton([shortest(t) for t in trees], True, True)
        self.ends = [Automaton([t], False, False) for t in trees]
        self.groups = [re.compile(r.span) if r.group else None for r in rules]

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of all spans, by start, then rule."""
        out, free = [], [0] * len(self.rules)
        for at, bits in reversed(self.automaton.begins(data)):
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and at >= free[k]:
                    end = free[k] = self.ends[k].longest(data, at)
                    # of a span that has been found, the regex only tells where its group stands
                    low, high = self.groups[k].fullmatch(data, at, end).span(rule.group) if rule.group else (at, end)
                    if high - low >= rule.least:
                        out.append((at, k, end))
        return sorted(out)


@functools.lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def in_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans with code points for bytes."""
    marks = sorted({p for s, _, e in found for p in (s, e)})
    to, at, n = {}, 0, 0
    for p in marks:
        n += len(data[at:p].decode("utf-8", "replace"))
        to[p], at = n, p
    return [(to[s], k, to[e]) for s, k, e in found]


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, an array of (kind, start, end) in code points, end exclusive, by start, then the rules' order.

    Null and empty texts have no spans. Repeated rows are scanned one by one. Other columns are left
    out. An empty table gives an empty result. No shuffle.
    """

    def scan(part: pa.RecordBatch) -> dict:
        own, out = scanner(rules), []
        for t in texts(part, "text_"):
            found = own.find(t)
            out.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in in_code_points(t, found)] if found else [])
        return {"doc_id": column(part, "id_"), "spans": out}

    rows = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].cast("string").alias("text_"))
    return batches(rows, scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """n_<kind> of the base kinds, base_sha256 and all spans as one string, from secret_scan's rows."""
    base = [r.kind for r in BASE]

    def said(spans: list[dict]) -> str:
        return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)

    def digest(part: pa.RecordBatch) -> dict:
        every = column(part, "spans").to_pylist()
        return {
            "doc_id": column(part, "doc_id"),
            **{f"n_{k}": [sum(x["kind"] == k for x in spans) for spans in every] for k in base},
            "base_sha256": [hashlib.sha256(said([x for x in spans if x["kind"] in base]).encode()).hexdigest() for spans in every],
            "spans": [said(spans) for spans in every],
        }

    return batches(scanned, digest, "doc_id long, " + ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string")
