"""Secret scans by one deterministic automaton for all rules, in one pass over the bytes.

compile_rules reads the rules' expressions into a nondeterministic automaton, determines it by subset construction over byte
classes and minimises it by partition refinement. The transition array is flat, so a scan is one lookup a byte. A
state that completes a rule reports the place; the span then follows from the bytes around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import table, with_python

#: What completes each rule, letters of keywords in either case. Lengths beyond that are checked where a rule completes: counters of
#: several rules in one automaton would multiply its states.
RULES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
    "access": r"""AKIA""",
    "hex": r"""[0-9a-f]{24}""",
    "pem": r"""-----BEGIN [A-Z ]*PRIVATE KEY-----""",
    "hub": r"""gh[pousr]_[A-Za-z0-9]""",
}
ORDER = {kind: i for i, kind in enumerate(RULES)}
VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
UPPER = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
HEX = frozenset(b"0123456789abcdef")
ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


class _Nfa:
    """Byte automaton with empty moves, built from the part of regular-expression syntax that rules use.

    That is: characters, escapes, sets with ranges, groups, (?i:...), alternatives, and ?, *, + or {n} after any of these.
    """

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, rule: str, start: int) -> int:
        """Adds the rule from start; returns its end."""
        self.rule, self.at = rule, 0
        end = self._choice(start, False)
        if self.at < len(rule):
            raise ValueError(f"rules don't use {rule[self.at:]!r}")
        return end

    def _peek(self, n: int = 1) -> str:
        return self.rule[self.at : self.at + n]

    def _take(self, n: int = 1) -> str:
        self.at += n
        return self.rule[self.at - n : self.at]

    def _choice(self, start: int, fold: bool) -> int:
        end = self.state()
        while True:
            begin = self.state()
            self.empty[start].append(begin)
            while self._peek() not in ("", "|", ")"):
                begin = self._repeated(begin, fold)
            self.empty[begin].append(end)
            if self._peek() != "|":
                return end
            self._take()

    def _repeated(self, start: int, fold: bool) -> int:
        was = self.at
        end = self._one(start, fold)
        then = self.at
        if self._peek() == "{":
            n = int(self.rule[self.at + 1 : (stop := self.rule.index("}", self.at))])
            for _ in range(n - 1):
                self.at = was
                end = self._one(end, fold)
            self.at = stop + 1
        elif self._peek() and self._peek() in "?*+":
            kind, stop = self._take(), self.at
            out = self.state()
            self.empty[end].append(out)
            if kind in "?*":
                self.empty[start].append(out)
            if kind in "*+":  # a loop of its own, so that nothing else leads back to start
                self.at = was
                self.empty[self._one(out, fold)].append(out)
                self.at = stop
            end = out
        else:
            self.at = then
        return end

    def _one(self, start: int, fold: bool) -> int:
        if self._peek() == "(":
            inner = self._peek(4) == "(?i:"
            self._take(4 if inner else 1)
            end = self._choice(start, fold or inner)
            self._take()
            return end
        of = self._set() if self._peek() == "[" else {self._char()}
        if fold:
            of |= {b for x in of for b in chr(x).swapcase().encode("latin-1") if x < 128}
        end = self.state()
        self.moves[start].append((frozenset(of), end))
        return end

    def _char(self) -> int:
        if self._peek() != "\\":
            return ord(self._take())
        self._take()
        return int(self._take(3)[1:], 16) if self._peek() == "x" else ord(self._take())

    def _set(self) -> set[int]:
        self._take()
        found: set[int] = set()
        while self._peek() != "]":
            low = self._char()
            if self._peek() == "-" and self._peek(2) != "-]":
                self._take()
                found |= set(range(low, self._char() + 1))
            else:
                found.add(low)
        self._take()
        return found


@cache
def compile_rules(rules: tuple[tuple[str, str], ...] = tuple(RULES.items())) -> tuple[bytes, list[int], list[tuple[str, ...]], int]:
    """(class of each byte, flat transitions by state * classes + class, kinds that each state reports, states).

    States that report come last, so a scan tells them by one comparison. Transitions hold the next state times the number of classes.
    """
    nfa, accept = _Nfa(), {}
    root = nfa.state()
    for kind, pattern in rules:
        begin = nfa.state()
        nfa.empty[root].append(begin)
        accept[nfa.add(pattern, begin)] = kind

    sets = {s for moves in nfa.moves for s, _ in moves}
    signature = {b: tuple(b in s for s in sorted(sets, key=sorted)) for b in range(256)}
    classes = {sig: i for i, sig in enumerate(dict.fromkeys(signature.values()))}
    byte_class, example = bytes(classes[signature[b]] for b in range(256)), {}
    for b in range(256):
        example.setdefault(byte_class[b], b)
    n = len(classes)

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    start = closed({root})
    number, table_, todo = {start: 0}, [], [start]
    while todo:  # subset construction; the root stays in every set, as a rule may begin anywhere
        here, row = todo.pop(0), []
        for c in range(n):
            to = closed({root} | {t for s in here for on, t in nfa.moves[s] if example[c] in on})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table_.append(row)
    says = [tuple(sorted({accept[s] for s in subset if s in accept}, key=ORDER.get)) for subset in number]

    block = {i: s for i, s in enumerate(says)}
    while True:  # partition refinement: states stay together while they report alike and move alike
        keys = [(block[i], *(block[t] for t in row)) for i, row in enumerate(table_)]
        names = {k: j for j, k in enumerate(dict.fromkeys(keys))}
        refined = {i: names[k] for i, k in enumerate(keys)}
        if len(set(refined.values())) == len(set(block.values())):
            break
        block = refined
    members = {b: i for i, b in reversed(block.items())}
    order = sorted(members, key=lambda b: (bool(says[members[b]]), members[b]))
    place = {b: i for i, b in enumerate(order)}
    flat = [place[block[t]] * n for b in order for t in table_[members[b]]]
    return byte_class, flat, [says[members[b]] for b in order], place[block[0]] * n


def hits(data: bytes) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(place of the completing byte, kinds) for all rules, in one pass."""
    byte_class, move, says, state = compile_rules()
    n = len(move) // len(says)
    first = next(i for i, s in enumerate(says) if s) * n
    for at, c in enumerate(data.translate(byte_class)):
        state = move[state + c]
        if state >= first:
            yield at, says[state // n]


def _run(data: bytes, at: int, of: frozenset[int], step: int) -> int:
    while 0 <= at < len(data) and data[at] in of:
        at += step
    return at


_WORDS = re.compile(rb"(?:password|passwd|secret|token|api_?key)\Z", re.IGNORECASE)


def _assign(data: bytes, at: int) -> tuple[int, int, bool]:
    """The match whose first value byte is data[at], and whether its value is long enough."""
    p = at - (data[at - 1] in b"\"'")
    p = _run(data, p - 1, frozenset(b" "), -1)  # now at : or =
    p = _run(data, p - 1, frozenset(b" "), -1) + 1
    for end in (p, p - 1):
        if (end == p or data[end : end + 1] in (b'"', b"'")) and (m := _WORDS.search(data[max(0, end - 8) : end])):
            start = end - len(m[0])
            break
    stop = _run(data, at, VALUE, 1)
    return start, stop, stop - at >= 6


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed; no two of a kind overlap."""
    data, found, over = text.encode(), [], dict.fromkeys(RULES, 0)
    for at, kinds in hits(data):
        for kind in kinds:
            if at < over[kind]:
                continue
            ok = True
            if kind == "assign":
                start, stop, ok = _assign(data, at)
                if start < over[kind]:
                    continue
            elif kind == "access":
                start, stop = at - 3, _run(data, at, UPPER, 1)
                ok = stop - start >= 20
            elif kind == "hex":
                start, stop = _run(data, at, HEX, -1) + 1, _run(data, at, HEX, 1)
            elif kind == "hub":
                start, stop = at - 4, _run(data, at, ALNUM, 1)
                ok = stop - at >= 36
            else:
                start, stop = data.rindex(b"-----BEGIN ", 0, at), at + 1
            over[kind] = stop
            if ok:
                found.append((start, ORDER[kind], stop, kind))
    found.sort()
    point, last, n = {}, 0, 0  # code points before each byte place that is needed, counted in one walk
    if not text.isascii():
        for at in sorted({p for a, _, b, _ in found for p in (a, b)}):
            n += len(data[last:at].decode())
            point[at], last = n, at
    return [(kind, point.get(a, a), point.get(b, b)) for a, _, b, kind in found]


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, stop), for every row.

    A null or empty text has none. Rows are worked on alone: repeated rows and null ids give a row each, an empty table none.
    Place and length of a span are in code points. Kinds: assign, access, hex, and beyond those pem (headers of
    private keys) and hub (prefixed access tokens).
    """

    def run(texts: list[str]) -> dict:
        return {"spans": [[{"kind": k, "start": a, "stop": b} for k, a, b in spans(t)] for t in texts]}

    ready = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    return with_python(ready, "t", run, "spans array<struct<kind:string,start:long,stop:long>>")


def op8_secrets(spark, sf_dir):
    out = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
