"""Filters: a builder that records conditions as a frozen tree.

A value wrapped by ``maybe`` is optional: if it is None the condition is not there at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from skeinql.errors import Code, Refused
from skeinql.functions.expr import Col, Custom, Order, Scalar, lifted
from skeinql.plans.schema import Table


@dataclass(frozen=True)
class maybe:
    value: Any = None

    @property
    def absent(self) -> bool:
        return self.value is None


class Condition:
    def parts(self) -> tuple:
        return ()


@dataclass(frozen=True)
class Compare(Condition):
    """op: eq ne gt gte lt lte, plain SQL; same and differs, which no null escapes."""

    op: str
    left: Scalar
    right: Scalar

    def parts(self):
        return (self.left, self.right)


@dataclass(frozen=True)
class IsNull(Condition):
    of: Scalar
    null: bool = True

    def parts(self):
        return (self.of,)


@dataclass(frozen=True)
class IsIn(Condition):
    of: Scalar
    values: tuple[Scalar, ...]

    def parts(self):
        return (self.of, *self.values)


@dataclass(frozen=True)
class InSub(Condition):
    of: Scalar
    sub: Any
    inside: bool = True

    def parts(self):
        return (self.of,)


@dataclass(frozen=True)
class Like(Condition):
    of: Scalar
    text: str
    mode: str
    fold: bool = False

    def parts(self):
        return (self.of,)


@dataclass(frozen=True)
class Fits(Condition):
    """A named predicate over columns; rows where it is null are dropped, also under a negation of the group."""

    test: Custom

    def parts(self):
        return (self.test,)


@dataclass(frozen=True)
class OfType(Condition):
    table: Table
    types: tuple[str, ...]
    inside: bool = True


@dataclass(frozen=True)
class All(Condition):
    terms: tuple[Condition, ...]

    def parts(self):
        return self.terms


@dataclass(frozen=True)
class Any_(Condition):
    branches: tuple[Condition, ...]

    def parts(self):
        return self.branches


@dataclass(frozen=True)
class Not(Condition):
    of: Condition

    def parts(self):
        return (self.of,)


@dataclass(frozen=True)
class Never(Condition):
    pass


@dataclass(frozen=True)
class ExistsPath(Condition):
    """Has the row a row at the end of ``table``'s path that passes ``inner``? Adds no join to the query."""

    table: Table
    inner: All
    there: bool = True


@dataclass(frozen=True)
class ExistsSub(Condition):
    sub: Any
    there: bool = True


class Filters:
    """Records conditions, in order; every method gives the builder back."""

    def __init__(self):
        self._terms: list[Condition] = []
        self._open = True

    def _add(self, c: Condition) -> Filters:
        if not self._open:
            raise Refused(Code.BUILDER_ESCAPED, "a filter builder is used after its function")
        self._terms.append(c)
        return self

    def _with(self, v: Any, build: Callable[[Any], Condition]) -> Filters:
        if isinstance(v, maybe):
            return self if v.absent else self._add(build(v.value))
        return self._add(build(v))

    # values
    def eq(self, of: Scalar, v: Any) -> Filters:
        return self._with(v, lambda x: Compare("eq", of, lifted(x)))

    def ne(self, of: Scalar, v: Any) -> Filters:
        """Another value, or none."""
        return self._with(v, lambda x: Any_((Compare("ne", of, lifted(x)), IsNull(of))))

    def gt(self, of: Scalar, v: Any) -> Filters:
        return self._with(v, lambda x: Compare("gt", of, lifted(x)))

    def gte(self, of: Scalar, v: Any) -> Filters:
        return self._with(v, lambda x: Compare("gte", of, lifted(x)))

    def lt(self, of: Scalar, v: Any) -> Filters:
        return self._with(v, lambda x: Compare("lt", of, lifted(x)))

    def lte(self, of: Scalar, v: Any) -> Filters:
        return self._with(v, lambda x: Compare("lte", of, lifted(x)))

    def range(self, of: Scalar, from_: Any = maybe(), to: Any = maybe()) -> Filters:
        """From ``from_`` on, and below ``to``; each may be absent."""
        return self.gte(of, from_).lt(of, to)

    def between(self, of: Scalar, low: Any, high: Any) -> Filters:
        return self.gte(of, low).lte(of, high)

    def is_in(self, of: Scalar, values: Iterable | maybe) -> Filters:
        """One of the values; of none, nothing passes."""
        return self._with(values, lambda x: IsIn(of, v) if (v := tuple(map(lifted, x))) else Never())

    def not_in(self, of: Scalar, values: Iterable | maybe) -> Filters:
        """None of the values, or null; of none, everything passes."""
        if isinstance(values, maybe):
            return self if values.absent else self.not_in(of, values.value)
        v = tuple(map(lifted, values))
        return self._add(Any_((Not(IsIn(of, v)), IsNull(of)))) if v else self

    def in_sub(self, of: Scalar, sub: Any) -> Filters:
        return self._add(InSub(of, sub))

    def not_in_sub(self, of: Scalar, sub: Any) -> Filters:
        """Not among the sub-query's values, of which nulls don't count; a null passes."""
        return self._add(InSub(of, sub, False))

    def like(self, of: Scalar, v: Any, mode: str = "contains") -> Filters:
        """mode: exact (a pattern), contains, starts or ends (the text as it is)."""
        return self._with(v, lambda x: Like(of, x, mode))

    def like_ignore_case(self, of: Scalar, v: Any, mode: str = "contains") -> Filters:
        return self._with(v, lambda x: Like(of, x, mode, True))

    def eq_ignore_case(self, of: Scalar, v: Any) -> Filters:
        return self._with(v, lambda x: Like(of, x, "equal", True))

    def is_null(self, of: Scalar, yes: bool | maybe = True) -> Filters:
        return self._with(yes, lambda x: IsNull(of, bool(x)))

    def is_not_null(self, of: Scalar) -> Filters:
        return self._add(IsNull(of, False))

    def not_distinct_from(self, of: Scalar, v: Any) -> Filters:
        """Equal, null being a value like any other."""
        return self._add(IsNull(of)) if v is None else self._with(v, lambda x: Compare("same", of, lifted(x)))

    def distinct_from(self, of: Scalar, v: Any) -> Filters:
        return self._add(IsNull(of, False)) if v is None else self._with(v, lambda x: Compare("differs", of, lifted(x)))

    # columns
    def compare(self, left: Scalar, op: str, right: Any) -> Filters:
        """Plain SQL: a null on either side fails."""
        if op not in ("eq", "ne", "gt", "gte", "lt", "lte"):
            raise Refused(Code.UNKNOWN_NAME, op)
        return self._add(Compare(op, left, lifted(right)))

    def not_distinct_from_column(self, left: Scalar, right: Scalar) -> Filters:
        return self._add(Compare("same", left, right))

    def distinct_from_column(self, left: Scalar, right: Scalar) -> Filters:
        return self._add(Compare("differs", left, right))

    def op(self, operator: Any, of: Scalar, v: Any) -> Filters:
        """A named predicate (see functions.operators)."""
        return self._with(v, lambda x: Fits(operator.over(of, x)))

    def add(self, label: str, test: Callable, *args: Scalar) -> Filters:
        """A predicate of its own: a function of columns."""
        return self._add(Fits(Custom(label, test, args)))

    # groups
    def or_(self, *branches: Callable) -> Filters:
        """Any branch. Branches whose conditions were all skipped are left out; without any left there is no condition."""
        return self._branches(list(branches), False)

    def or_list(self, branches: list[Callable]) -> Filters:
        """As ``or_``, but no branches at all let nothing pass."""
        return self._branches(branches, True)

    def _branches(self, branches: list[Callable], strict: bool) -> Filters:
        if strict and not branches:
            return self._add(Never())
        built = [c for c in map(conditions, branches) if c.terms]
        return self._add(Any_(tuple(built))) if built else self

    def not_(self, group: Callable) -> Filters:
        """Plain SQL negation of a group; an empty group is skipped."""
        c = conditions(group)
        return self._add(Not(c)) if c.terms else self

    def when(self, yes: bool, group: Callable) -> Filters:
        if yes:
            group(self)
        return self

    def apply(self, fragment: Callable) -> Filters:
        fragment(self)
        return self

    # other rows
    def exists(self, table: Table, inner: Callable | None = None) -> Filters:
        return self._add(self._path(table, inner, True))

    def not_exists(self, table: Table, inner: Callable | None = None) -> Filters:
        return self._add(self._path(table, inner, False))

    @staticmethod
    def _path(table: Table, inner: Callable | None, there: bool) -> Condition:
        if table.parent is None:
            raise Refused(Code.OUTSIDE_PATH, "a path starts with a relation")
        c = conditions(inner) if inner else All(())
        for x in _columns(c):
            if x.table.row.identity[: len(table.identity)] != table.identity:
                raise Refused(Code.OUTSIDE_PATH, f"{x.name} is not on the path")
        return ExistsPath(table, c, there)

    def exists_sub(self, sub: Any) -> Filters:
        return self._add(ExistsSub(_lifts(sub)))

    def not_exists_sub(self, sub: Any) -> Filters:
        return self._add(ExistsSub(_lifts(sub), False))

    def of_type(self, table: Table, *types: str) -> Filters:
        return self._add(OfType(table, types)) if types else self._add(Never())

    def not_of_type(self, table: Table, *types: str) -> Filters:
        """Of no such type, or no row at all."""
        return self._add(OfType(table, types, False)) if types else self


def _lifts(sub: Any) -> Any:
    from skeinql.functions.expr import Outer, walk

    if not any(isinstance(x, Outer) for x in walk(sub.condition)):
        raise Refused(Code.NOTHING_LIFTED, "a correlated sub-query reads no column of the outer one")
    return sub


def _columns(c: Any):
    from skeinql.functions.expr import walk

    return (x for x in walk(c) if isinstance(x, Col))


def conditions(build: Callable) -> All:
    """What ``build`` records."""
    f = Filters()
    build(f)
    f._open = False
    return All(tuple(f._terms))


@dataclass(frozen=True)
class SubSelect:
    """One column (or none, for exists) of a table's rows that pass a filter; ``Outer`` reads the outer query."""

    table: Table
    column: Scalar | None = None
    condition: All = All(())
    order: tuple[Order, ...] = ()

    def where(self, build: Callable) -> SubSelect:
        return SubSelect(self.table, self.column, All((*self.condition.terms, *conditions(build).terms)), self.order)
