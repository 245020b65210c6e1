"""Boolean trigram queries from regular expressions.

A query is a trigram, ("and", ...) or ("or", ...) over queries, or None where a match needs no trigram. Whatever matches
the expression satisfies the query. Trigrams are in lower case and looked up in lower-cased texts, so they serve rules in
either case.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser

Query = "str | tuple | None"


def derive(pattern: str) -> Query:
    """The trigram query that every match of `pattern` satisfies."""
    return _sequence(_parser.parse(pattern))


def _both(parts: list) -> Query:
    flat = []
    for p in parts:
        flat += p[1:] if isinstance(p, tuple) and p[0] == "and" else [p] if p is not None else []
    flat = list(dict.fromkeys(flat))
    return None if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _either(parts: list) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _run(text: str) -> Query:
    return _both([text[i : i + 3].lower() for i in range(len(text) - 2)])


def _sequence(items) -> Query:
    found, literal = [], ""
    for kind, value in items:
        if kind is op.LITERAL:
            literal += chr(value)
            continue
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, _, inner = value
            # a literal repeated a fixed number of times goes on the run
            if len(inner) == 1 and inner[0][0] is op.LITERAL and least:
                found.append(_run(literal + chr(inner[0][1]) * least))
            elif least:
                found.append(_sequence(inner))
        elif kind is op.SUBPATTERN:
            found.append(_sequence(value[-1]))
        elif kind is op.BRANCH:
            found.append(_either([_sequence(branch) for branch in value[1]]))
        elif kind is op.AT:
            continue
        found.append(_run(literal))
        literal = ""
    found.append(_run(literal))
    return _both(found)


def trigrams(query: Query) -> list[str]:
    """All trigrams of a query, each once."""
    if query is None:
        return []
    if isinstance(query, str):
        return [query]
    return list(dict.fromkeys(t for q in query[1:] for t in trigrams(q)))
