"""How long a regular expression can take, told from its automaton, and matching that stays linear in the text.

A backtracking engine tries every way in which a pattern can read a text, so its time follows the pattern's
ambiguity. ``growth`` builds the automaton of positions (a state for each character of the pattern; first and follow sets, with the
number of ways from one to the next) and looks at pairs of runs that read the same text:

* two runs from a state back to it: ``exponential`` time;
* a loop that another loop can follow on the same text: ``polynomial``, with a power for each further loop. The start of an unanchored search counts as
  a loop, so ``\\w+@`` is quadratic;
* neither: ``linear``.

A repeat of what varies in length counts as unbounded here even if it is bounded, and a repeat of what can be empty is exponential.

``search`` and ``extract`` use the JVM's engine for patterns proven linear, else RE2 (in Arrow batches), which takes linear time for
any pattern; both read the whole text. Patterns that are exponential, do not compile, or are neither proven nor known to RE2 (look-arounds,
back-references) are refused: ``usable`` is False, and steps that take patterns are then left out.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

parser = re._parser  # type: ignore[attr-defined]
REPEATS = ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT")
#: A repeat of more than this counts as unbounded; states of an automaton that is looked at; copies of a part that stand for a fixed number.
FEW, MOST_STATES, COPIES = 64, 300, 2


class Unproven(Exception):
    """The automaton is too large, or the pattern has parts that none stands for."""


class Automaton:
    """Positions of a pattern with their character sets (over ``alphabet``), and the ways from each to the next."""

    def __init__(self, pattern: str, flags: int = 0):
        tree = parser.parse(pattern, flags)
        self.flags = tree.state.flags | flags
        self.sets: list[frozenset] = []
        self.follow: dict[int, Counter] = defaultdict(Counter)
        self.unbounded: set[tuple[int, int]] = set()
        self.empty_repeat = self.groups_repeat = self.conditions = self.anchored = False
        self.alphabet = self._alphabet(pattern)
        self.nullable, self.first, self.last = self._sequence(list(tree))
        self.anchored = bool(len(tree)) and str(tree[0][0]) == "AT" and str(tree[0][1]) in ("AT_BEGINNING_STRING", "AT_BEGINNING") and not self.flags & re.MULTILINE

    def _alphabet(self, pattern: str) -> list[str]:
        near = {chr(ord(c) + d) for c in pattern for d in (-1, 0, 1) if 0 < ord(c) + d < 0x10FFFF}
        return sorted(near | {c.swapcase() for c in near if len(c.swapcase()) == 1} | set("aZ0_ \t\n.,;-中é€"))

    def _set(self, op, arg) -> frozenset:
        """The characters of the alphabet that the item matches, as the engine itself says."""
        data = parser.SubPattern(parser.State(), [(op, arg)])
        data.state.str, data.state.flags = "", self.flags
        one = re._compiler.compile(data, self.flags & (re.IGNORECASE | re.DOTALL | re.ASCII | re.UNICODE))  # type: ignore[attr-defined]
        return frozenset(c for c in self.alphabet if one.fullmatch(c))

    def _position(self, chars: frozenset):
        if len(self.sets) >= MOST_STATES:
            raise Unproven
        self.sets.append(chars)
        at = Counter({len(self.sets) - 1: 1})
        return 0, at, at

    def _link(self, last: Counter, first: Counter, unbounded: bool = False):
        for p, a in last.items():
            for q, b in first.items():
                self.follow[p][q] = min(2, self.follow[p][q] + a * b)
                if unbounded:
                    self.unbounded.add((p, q))

    def _sequence(self, items):
        nullable, first, last = 1, Counter(), Counter()
        for op, arg in items:
            n, f, z = self._item(str(op), op, arg)
            self._link(last, f)
            for q, b in f.items() if nullable else ():
                first[q] = min(2, first[q] + nullable * b)
            last = Counter({p: min(2, a * n) for p, a in last.items() if n}) + z
            nullable = min(2, nullable * n)
        return nullable, first, last

    def _item(self, name, op, arg):
        if name in REPEATS:
            return self._repeat(*arg)
        if name == "SUBPATTERN":
            return self._sequence(list(arg[-1]))
        if name == "ATOMIC_GROUP":
            return self._sequence(list(arg))
        if name == "BRANCH":
            parts = [self._sequence(list(b)) for b in arg[1]]
            return min(2, sum(n for n, _, _ in parts)), sum((f for _, f, _ in parts), Counter()), sum((z for _, _, z in parts), Counter())
        if name == "AT":
            self.conditions = True
            return 1, Counter(), Counter()
        if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY", "CATEGORY", "RANGE"):
            return self._position(self._set(op, arg))
        raise Unproven  # look-arounds, back-references, conditions

    def _repeat(self, low: int, high, body):
        least, most = body.getwidth()
        body = list(body)
        many = high >= 2
        if many and least == 0:
            self.empty_repeat = True
        single = len(body) == 1 and str(body[0][0]) in ("LITERAL", "NOT_LITERAL", "IN", "ANY")
        far = high > FEW
        if many and (least != most or low != high):
            if far and not single:
                self.groups_repeat = True
            n, first, last = self._sequence(body)
            self._link(last, first, far or int(high) * int(most) > 4 * FEW)
            return (1 if low == 0 else n), first, last
        copies = [self._sequence(body) for _ in range(min(int(high), COPIES))]
        if not copies:
            return 1, Counter(), Counter()
        for (_, _, z), (_, f, _) in zip(copies, copies[1:]):
            self._link(z, f)
        n, first, last = copies[0][0], copies[0][1], copies[-1][2]
        return (min(2, n + 1) if low == 0 else n), first, last

    def settled(self) -> None:
        """Let a search end at the first state where the match is complete; it never comes back from there."""
        if not self.conditions:
            for p in self.last:
                self.follow[p] = Counter()


def components(edges: dict) -> dict:
    """The strongly connected component (a number) of each node, of those on a cycle."""
    order, low, on, stack, out = {}, {}, set(), [], {}
    for start in list(edges):
        if start in order:
            continue
        work = [(start, iter(edges.get(start, ())))]
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(edges.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    if len(group) > 1 or node in edges.get(node, ()):
                        for x in group:
                            out[x] = order[node]
    return out


def _two_ways_round(a: Automaton) -> bool:
    """Do two different runs lead from some state back to it on the same text?"""
    ring = components(a.follow)
    if any(n > 1 and ring.get(p, -1) == ring.get(q, -2) for p, to in a.follow.items() for q, n in to.items()):
        return True
    pairs: dict = {}
    todo = [(p, p) for p in ring]
    while todo:
        p, r = todo.pop()
        if (p, r) not in pairs:
            # both runs stay on the cycle they have to come back to
            pairs[p, r] = [(x, y) for x in a.follow[p] for y in a.follow[r] if ring.get(x) == ring[p] == ring.get(y) and a.sets[x] & a.sets[y]]
            todo += pairs[p, r]
    number = components(pairs)
    diagonal = {n for (p, r), n in number.items() if p == r}
    return any(p != r and n in diagonal for (p, r), n in number.items())


def _loops_in_a_row(a: Automaton) -> int:
    """The longest chain of loops of which each can take over from the one before in the midst of a text."""
    start = len(a.sets)
    sets, follow = [*a.sets, frozenset(a.alphabet)], {p: set(q) for p, q in a.follow.items()}
    if not a.anchored:
        follow[start] = {start, *a.first}
    far = {p: {q for q in to if (p, q) in a.unbounded or p == q == start} for p, to in follow.items()}
    ring = components(follow)
    loops = {ring[p] for p, to in far.items() for q in to if p in ring and ring.get(q) == ring[p]}
    heads = {n: [p for p in ring if ring[p] == n] for n in loops}
    after: dict[int, set[int]] = {n: set() for n in loops}
    for n in loops:
        for m in loops - {n}:
            if any(_takes_over(sets, follow, ring, p, q) for p in heads[n] for q in heads[m]):
                after[n].add(m)

    @functools.cache
    def longest(n: int) -> int:
        return 1 + max((longest(m) for m in after[n]), default=0)

    return max((longest(n) for n in loops), default=0)


def _takes_over(sets, follow, ring, p, q) -> bool:
    """Is there a text on which p comes back to p, p leads to q, and q comes back to q?"""
    todo, seen = [(p, p, q)], set()
    while todo:
        x, y, z = todo.pop()
        for x2 in follow.get(x, ()):
            if ring.get(x2) != ring[p]:
                continue
            for z2 in follow.get(z, ()):
                if ring.get(z2) != ring[q] or not (both := sets[x2] & sets[z2]):
                    continue
                for y2 in follow.get(y, ()):
                    state = (x2, y2, z2)
                    if state not in seen and both & sets[y2]:
                        if state == (p, q, q):
                            return True
                        seen.add(state)
                        todo.append(state)
    return False


@functools.lru_cache(1000)
def growth(pattern: str, flags: int = 0) -> tuple[str, int]:
    """(``linear``, ``polynomial``, ``exponential``, ``unproven`` or ``invalid``; power of the text's length, 0 where none is known)."""
    try:
        a = Automaton(pattern, flags)
    except (re.error, OverflowError):
        return "invalid", 0
    except (Unproven, RecursionError):
        return "unproven", 0
    if a.empty_repeat or _two_ways_round(a):
        return "exponential", 0
    a.settled()
    power = max(1, _loops_in_a_row(a))
    return ("linear" if power == 1 else "polynomial"), power


@functools.lru_cache(1000)
def engine(pattern: str, flags: int = 0) -> str:
    """What runs the pattern: ``jvm``, ``re2``, or ``none`` if it is refused."""
    kind, _ = growth(pattern, flags)
    if kind in ("exponential", "invalid"):
        return "none"
    # the JVM's engine takes a stack frame for each round of a repeated group, so long texts would overflow it
    if kind == "linear" and not Automaton(pattern, flags).groups_repeat:
        return "jvm"
    try:
        pc.match_substring_regex(pa.array([""]), pattern=_flagged(pattern, flags))
        return "re2"
    except pa.ArrowInvalid:
        return "none"


def usable(pattern: str, flags: int = 0) -> bool:
    return engine(pattern, flags) != "none"


def _flagged(pattern: str, flags: int) -> str:
    letters = "".join(c for c, f in (("i", re.IGNORECASE), ("s", re.DOTALL), ("m", re.MULTILINE)) if flags & f)
    return f"(?{letters}){pattern}" if letters else pattern


def search(text: Column, pattern: str, flags: int = 0) -> Column:
    """Does the pattern match somewhere in the text? Refused patterns give null."""
    how, whole = engine(pattern, flags), _flagged(pattern, flags)
    if how == "jvm":
        return text.rlike(whole)
    if how == "none":
        return F.lit(None).cast("boolean")

    @F.arrow_udf("boolean")
    def run(values: pa.Array) -> pa.Array:
        return pc.match_substring_regex(values, pattern=whole)

    return run(text)


def named_groups(pattern: str) -> str:
    """The pattern with its groups named g1, g2 and so on, all of it g0."""
    out, at, number, inside = [], 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            at += 1
            if pattern[at : at + 1] == "^":
                out.append("^")
                at += 1
            if pattern[at : at + 1] == "]":  # a bracket that comes first is a character
                out.append("\\]")
                at += 1
            continue
        if c == "]":
            inside = False
        if c == "(" and not inside:
            named = re.match(r"\(\?P<\w+>|\((?!\?)", pattern[at:])
            if named:
                number += 1
                out.append(f"(?P<g{number}>")
                at += named.end()
                continue
        out.append(c)
        at += 1
    return f"(?P<g0>{''.join(out)})"


def extract(text: Column, pattern: str, group: int = 0, flags: int = 0) -> Column:
    """The group of the first match, '' where it takes no part; null without a match or for refused patterns."""
    how, whole = engine(pattern, flags), _flagged(pattern, flags)
    if how == "jvm":
        return F.when(text.rlike(whole), F.regexp_extract(text, whole, group))
    if how == "none":
        return F.lit(None).cast("string")
    named = _flagged(named_groups(pattern), flags)

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pc.struct_field(pc.extract_regex(values, pattern=named), f"g{group}")

    return run(text)
