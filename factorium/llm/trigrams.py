"""Boolean trigram queries from regular expressions, built when the plan is.

A pattern is parsed by Python's own parser. `strings` walks it and keeps the exact strings that the part
just read can be, as long as they are few; where they aren't exact any more, the trigrams that each must hold
become one OR of ANDs, and all such ORs are ANDed. Everything is lower case: the index is too.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from itertools import product

#: Exact strings that are followed at once.
MOST_EXACT = 32

#: A query in conjunctive form: every clause must hold; a clause holds if all trigrams of one of its sets occur.
Clause = frozenset[frozenset[str]]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def flush(exact: set[str], clauses: set[Clause]) -> None:
    sets = {trigrams(s) for s in exact}
    if all(sets):
        clauses.add(frozenset(sets))


def join(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a, b in product(left, right)} if len(left) * len(right) <= MOST_EXACT else None


def exact_of(items: list) -> set[str] | None:
    """All strings that the items can be, or None if they are many."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            part: set[str] | None = {chr(arg).lower()}
        elif op is C.SUBPATTERN:
            part = exact_of(list(arg[3]))
        elif op is C.BRANCH:
            parts = [exact_of(list(x)) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 2:
            one = exact_of(list(arg[2]))
            part = None if one is None else set().union(*({"".join(x) for x in product(one, repeat=n)} for n in range(arg[0], arg[1] + 1)))
        elif op is C.IN and all(x[0] is C.LITERAL for x in arg):
            part = {chr(x[1]).lower() for x in arg}
        elif op is C.AT:
            part = {""}
        else:
            part = None
        out = None if part is None else join(out, part)
        if out is None:
            return None
    return out


def clauses_of(items: list) -> set[Clause]:
    clauses: set[Clause] = set()
    exact = {""}
    for item in items:
        part = exact_of([item])
        both = None if part is None else join(exact, part)
        if both is not None:
            exact = both
            continue
        flush(exact, clauses)
        exact = {""} if part is None else part
        op, arg = item
        if op is C.SUBPATTERN:
            clauses |= clauses_of(list(arg[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            clauses |= clauses_of(list(arg[2]))
    flush(exact, clauses)
    return clauses


def query(pattern: str) -> list[Clause]:
    """The clauses that every text with a match meets; none: the pattern has no mandatory trigram."""
    return sorted(clauses_of(list(parser.parse(pattern))), key=lambda c: sorted(map(sorted, c)))
