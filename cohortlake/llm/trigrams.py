"""Boolean trigram queries derived from regular expressions.

A query is a disjunction of conjunctions: a set of clauses, each a set of lower-case trigrams. A text
that matches the expression holds all trigrams of at least one clause. An expression without
mandatory trigrams gives None.
"""

from __future__ import annotations

import itertools
from re import _constants as op
from re import _parser

# Larger alternatives are given up as unknown, which keeps the query sound.
MOST_STRINGS, MOST_CLAUSES = 64, 64

Clauses = frozenset[frozenset[str]]


def trigrams_of(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(node: tuple) -> set[str] | None:
    """The lower-cased strings that a node can match, if they are few and known."""
    kind, arg = node
    if kind is op.LITERAL:
        return {chr(arg).lower()}
    if kind is op.IN:
        found: set[str] = set()
        for inner, value in arg:
            if inner is op.LITERAL:
                found.add(chr(value).lower())
            elif inner is op.RANGE and value[1] - value[0] < MOST_STRINGS:
                found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None
        return found if len(found) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(arg[3])
    if kind is op.BRANCH:
        parts = [_sequence_strings(branch) for branch in arg[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and arg[1] is not op.MAXREPEAT and arg[1] <= 8:
        once = _sequence_strings(arg[2])
        if once is None or len(once) ** arg[1] > MOST_STRINGS:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(sorted(once), repeat=n)}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(found) * len(part) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def _any_of(strings: set[str]) -> Clauses | None:
    """A clause for each string; nothing is mandatory if one is too short."""
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(trigrams_of(s) for s in strings)


def _both(left: Clauses | None, right: Clauses | None) -> Clauses | None:
    if left is None or right is None:
        return right if left is None else left
    if len(left) * len(right) > MOST_CLAUSES:
        return min(left, right, key=len)
    return frozenset(a | b for a in left for b in right)


def _sequence(nodes) -> Clauses | None:
    query, run = None, {""}
    for node in nodes:
        part = _strings(node)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        query, run = _both(query, _any_of(run)), {""}
        query = _both(query, _node(node))
    return _both(query, _any_of(run))


def _node(node: tuple) -> Clauses | None:
    """Mandatory trigrams inside a node whose strings are not all known."""
    kind, arg = node
    if kind is op.SUBPATTERN:
        return _sequence(arg[3])
    if kind is op.MAX_REPEAT and arg[0] >= 1:
        return _sequence(arg[2])
    if kind is op.BRANCH:
        parts = [_sequence(branch) for branch in arg[1]]
        return None if None in parts else frozenset().union(*parts)
    return None


def trigram_query(pattern: str) -> Clauses | None:
    """The Boolean trigram query of an expression, without clauses that another one implies."""
    clauses = _sequence(_parser.parse(pattern))
    if clauses is None:
        return None
    return frozenset(c for c in clauses if not any(other < c for other in clauses))
