"""Boolean trigram queries derived from regular expressions.

A query says which three-character strings a text must hold, in lower case, if the
expression matches anywhere in it. Sets of exact strings are carried through
concatenation, alternation and small classes; where a set grows too large or ends at a
repeat, its trigrams become a condition (Cox, "Regular Expression Matching with a
Trigram Index", 2012). ``None`` is the query every text satisfies.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

#: Exact strings carried along, and members of a class spelled out.
MOST_STRINGS = 40
MOST_CLASS = 8

Query = tuple | None  # ("and" | "or", frozenset of queries or trigrams)


def both(a: Query | str, b: Query | str) -> Query | str:
    return _join("and", [x for x in (a, b) if x is not None])


def either(parts: list) -> Query | str:
    return None if any(p is None for p in parts) else _join("or", parts)


def _join(kind: str, parts: list) -> Query | str:
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if kind == "or":  # what asks for more than another alternative does adds nothing
        needs = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset({q}) for q in flat}
        flat = {q for q in flat if not any(needs[o] < needs[q] for o in flat)}
    return None if not flat else next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_strings(strings: set[str]) -> Query | str:
    """What a text must hold that holds one of ``strings``."""
    out = []
    for s in strings:
        q = None
        for i in range(len(s) - 2):
            q = both(q, s[i : i + 3])
        out.append(q)
    return either(out) if out else None


class _Seen:
    """Exact strings so far (None: unknown) and the condition gathered."""

    def __init__(self, strings: set[str] | None, query: Query = None) -> None:
        self.strings, self.query = strings, query

    def done(self) -> Query | str:
        return self.query if self.strings is None else both(self.query, _of_strings(self.strings))


def _walk(items) -> _Seen:
    run, query, whole = {""}, None, True  # whole: ``run`` spells the entire match

    def close() -> None:
        nonlocal run, query
        query, run = both(query, _of_strings(run)), {""}

    for kind, value in items:
        part = _one(kind, value)
        query = both(query, part.query)
        if part.strings is None:
            close()
            whole = False
        elif len(run) * len(part.strings) > MOST_STRINGS:
            close()
            run, whole = set(part.strings), False
        else:
            run = {a + b for a, b in product(run, part.strings)}
    if whole:
        return _Seen(run)
    close()
    return _Seen(None, query)


def _one(kind, value) -> _Seen:
    if kind is op.LITERAL:
        return _Seen({chr(value).lower()})
    if kind is op.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                chars.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < MOST_CLASS:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return _Seen(None)
        return _Seen(chars) if len(chars) <= MOST_CLASS else _Seen(None)
    if kind is op.SUBPATTERN:
        return _walk(value[-1])
    if kind is op.BRANCH:
        parts = [_walk(x) for x in value[1]]
        if all(p.strings is not None for p in parts):
            return _Seen(set().union(*(p.strings for p in parts)))
        return _Seen(None, either([p.done() for p in parts]))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, body = value
        part = _walk(body)
        if (least, most) == (0, 1) and part.strings is not None:
            return _Seen({""} | part.strings)
        if (least, most) == (1, 1):
            return part
        return _Seen(None, part.done() if least else None)
    if kind is op.AT:
        return _Seen({""})
    return _Seen(None)


def query_of(pattern: str) -> Query | str:
    """The trigram query of a regular expression, or None if it has no mandatory one."""
    return _walk(_parser.parse(pattern)).done()


def trigrams_of(query: Query | str) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*(trigrams_of(x) for x in query[1]))
