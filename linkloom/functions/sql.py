"""Building blocks for Spark SQL expressions.

The functions of this package take and return SQL expressions as text, to be
used with `selectExpr` or `F.expr`.  A long expression then reaches Spark in
one piece, instead of by thousands of calls from Python, and Catalyst sees
the same plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

_numbers = count(1)


def quote(text: str) -> str:
    """String literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def array_of(texts: Iterable[str]) -> str:
    return f"array({', '.join(map(quote, texts))})"


def record(**fields: str) -> str:
    """Struct with named fields."""
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _lambda(parameters: int, body: Callable[..., str]) -> str:
    names = [f"v{next(_numbers)}" for _ in range(parameters)]  # never twice, so none is shadowed
    head = names[0] if parameters == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def each(array: str, body: Callable[[str], str]) -> str:
    return f"transform({array}, {_lambda(1, body)})"


def each_numbered(array: str, body: Callable[[str, str], str]) -> str:
    return f"transform({array}, {_lambda(2, body)})"


def keep(array: str, test: Callable[[str], str]) -> str:
    return f"filter({array}, {_lambda(1, test)})"


def keep_numbered(array: str, test: Callable[[str, str], str]) -> str:
    return f"filter({array}, {_lambda(2, test)})"


def some(array: str, test: Callable[[str], str]) -> str:
    return f"exists({array}, {_lambda(1, test)})"


def pairs(left: str, right: str, body: Callable[[str, str], str]) -> str:
    return f"zip_with({left}, {right}, {_lambda(2, body)})"


def fold(array: str, start: str, step: Callable[[str, str], str], finish: Callable[[str], str]) -> str:
    return f"aggregate({array}, {start}, {_lambda(2, step)}, {_lambda(1, finish)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """`body` of a value that is computed once, however often the body uses it.

    A name bound by a lambda is never replaced by its expression, so this also
    keeps costly values out of the inside of other lambdas.
    """
    return f"get({each(f'array({value})', body)}, 0)"


def first_of_each(items: str, key: Callable[[str], str]) -> str:
    """Items whose key no earlier item has, in their order; by sorting, as looking each up would be quadratic."""

    def chosen(held: str) -> str:
        def heads(ordered: str) -> str:
            return keep_numbered(ordered, lambda x, i: f"{i} = 0 OR get({ordered}, {i} - 1).key <> {x}.key")

        numbered = each_numbered(held, lambda e, i: record(key=key(e), at=i))
        places = f"array_sort({each(let(f'array_sort({numbered})', heads), lambda x: f'{x}.at')})"
        return each(places, lambda at: f"get({held}, {at})")

    return let(items, chosen)


def first(array: str) -> str:
    return f"get({array}, 0)"


def cases(branches: Iterable[tuple[str, str]], otherwise: str = "NULL") -> str:
    """CASE: the value of the first test that holds."""
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in branches) + f" ELSE {otherwise} END"


def any_of(tests: Iterable[str]) -> str:
    return "(" + " OR ".join(tests) + ")"
