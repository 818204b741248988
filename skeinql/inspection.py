"""What a definition says, for tests of code that makes queries."""

from __future__ import annotations

from typing import Any

from skeinql.functions.expr import Col, Param, Scalar, Value, walk
from skeinql.plans import filters as C
from skeinql.plans.query import Query, columns


def described(x: Any) -> Any:
    """A condition or expression as plain tuples."""
    match x:
        case Col():
            return ".".join(filter(None, (x.table.path, x.name)))
        case Value():
            return x.value
        case Param():
            return f":{x.name}"
        case C.Compare():
            return (x.op, described(x.left), described(x.right))
        case C.IsNull():
            return ("is_null" if x.null else "is_not_null", described(x.of))
        case C.IsIn():
            return ("in", described(x.of), tuple(map(described, x.values)))
        case C.Like():
            return (f"like_{x.mode}", described(x.of), x.text)
        case C.Any_():
            return ("or", *map(described, x.branches))
        case C.All():
            return described(x.terms[0]) if len(x.terms) == 1 else ("and", *map(described, x.terms))
        case C.Not():
            return ("not", described(x.of))
        case C.ExistsPath():
            return ("exists" if x.there else "not_exists", x.table.path, *map(described, x.inner.terms))
        case C.Fits():
            return (x.test.name, *map(described, x.test.args))
        case Scalar():
            return (type(x).__name__.lower(), *(described(p) for p in x.parts()))
    return type(x).__name__.lower()


def filters_of(q: Query) -> list:
    return [described(t) for t in q.condition.terms]


def joins_of(q: Query) -> set[str]:
    """Paths that the query's items, filters and order read."""
    trees = (*q.items, *q.condition.terms, *(o.by for o in q.order))
    return {c.table.path for c in columns(*trees) if c.table.path}


def filters_on(q: Query, column: Col) -> list:
    """The top-level terms that read a column."""
    return [described(t) for t in q.condition.terms if any(x == column for x in walk(t))]
