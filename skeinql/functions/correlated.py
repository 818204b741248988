"""Values of a sub-query for each row of the query around it."""

from __future__ import annotations

from skeinql.errors import Code, Refused
from skeinql.functions.expr import Col, Correlated, Order, Outer, Scalar
from skeinql.plans.filters import SubSelect, _lifts
from skeinql.plans.schema import Table


def sub(table: Table, column: Scalar | None = None) -> SubSelect:
    """Rows of a root table; ``.where`` relates them to the outer query by ``outer(column)``."""
    if table.parent is not None:
        raise Refused(Code.OUTSIDE_PATH, "a sub-query starts at a root")
    return SubSelect(table, column)


def outer(column: Col) -> Outer:
    return Outer(column)


def count(s: SubSelect) -> Correlated:
    """0 of none."""
    return Correlated("count", _lifts(s))


def exists(s: SubSelect) -> Correlated:
    return Correlated("exists", _lifts(s))


def min_(s: SubSelect, value: Scalar) -> Correlated:
    return Correlated("min", _lifts(s), value)


def max_(s: SubSelect, value: Scalar) -> Correlated:
    return Correlated("max", _lifts(s), value)


def sum_(s: SubSelect, value: Scalar) -> Correlated:
    """Null of none."""
    return Correlated("sum", _lifts(s), value)


def first(s: SubSelect, value: Scalar, *order: Order) -> Correlated:
    """The first row's value by ``order``, then by key; null of none."""
    return Correlated("first", _lifts(s), value, order)
