"""Scalar expressions, aggregates and windows as frozen trees; a compiler turns them into columns."""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from skeinql.errors import Code, Refused
from skeinql.plans.schema import Table

_BINDABLE = (str, bool, int, float, decimal.Decimal, datetime.date, datetime.datetime, datetime.time, bytes)


def lifted(x: Any) -> Scalar:
    """A value as an expression; expressions as they are."""
    if isinstance(x, Scalar):
        return x
    if x is None:
        raise Refused(Code.NULL_VALUE, "a value is None; use is_null, or maybe(...) to skip")
    if not isinstance(x, _BINDABLE):
        raise Refused(Code.UNBINDABLE, f"{type(x).__name__} cannot be bound")
    return Value(x)


@dataclass(frozen=True)
class Order:
    by: Scalar
    down: bool = False
    nulls: str | None = None

    def nulls_first(self) -> Order:
        return replace(self, nulls="first")

    def nulls_last(self) -> Order:
        return replace(self, nulls="last")

    @property
    def first(self) -> bool:
        """Do nulls come first? Without a word for it, as Spark orders: first ascending, last descending."""
        return self.nulls == "first" if self.nulls else not self.down

    def reversed(self) -> Order:
        return Order(self.by, not self.down, "last" if self.first else "first")


class Scalar:
    """What a row has one value of."""

    def named(self, name: str) -> Named:
        return Named(self, name)

    def asc(self) -> Order:
        return Order(self)

    def desc(self) -> Order:
        return Order(self, True)

    def parts(self) -> tuple:
        """Expressions right below this one."""
        return ()


def walk(x: Any):
    yield x
    for p in x.parts():
        yield from walk(p)


@dataclass(frozen=True)
class Named(Scalar):
    of: Scalar
    name: str

    def parts(self):
        return (self.of,)


@dataclass(frozen=True)
class Col(Scalar):
    table: Table
    name: str


@dataclass(frozen=True)
class Value(Scalar):
    value: Any


@dataclass(frozen=True)
class Param(Scalar):
    """A value that is given when the query runs."""

    name: str


@dataclass(frozen=True)
class Typed(Scalar):
    """``of`` cast to a Spark type."""

    of: Scalar
    type: str

    def parts(self):
        return (self.of,)


@dataclass(frozen=True)
class Declared(Scalar):
    """A column whose type was declared; another type is refused when the query is compiled."""

    of: Col
    type: str

    def parts(self):
        return (self.of,)


@dataclass(frozen=True)
class Blank(Scalar):
    """Null, of the type of a group key that was not chosen; it reads nothing."""

    of: Col


@dataclass(frozen=True)
class Apply(Scalar):
    """A built-in form: op over arguments."""

    op: str
    args: tuple[Scalar, ...]
    extra: Any = None

    def parts(self):
        return self.args


@dataclass(frozen=True)
class Case(Scalar):
    branches: tuple[tuple[Any, Scalar], ...]
    last: Scalar | None

    def parts(self):
        return (*(p for c, v in self.branches for p in (c, v)), *([self.last] if self.last is not None else []))


@dataclass(frozen=True)
class Custom(Scalar):
    """A function of columns that gives a column."""

    name: str
    function: Callable
    args: tuple[Scalar, ...]

    def parts(self):
        return self.args


@dataclass(frozen=True)
class TypeOf(Scalar):
    table: Table


@dataclass(frozen=True)
class Outer(Scalar):
    """A column of the outer query within a correlated one."""

    of: Col

    def __post_init__(self):
        if self.of.table.many:
            raise Refused(Code.LIFT_TO_MANY, self.of.name)


@dataclass(frozen=True)
class Correlated(Scalar):
    """One value of a sub-query for each row: kind is count, exists, min, max, sum or first."""

    kind: str
    sub: Any
    value: Scalar | None = None
    order: tuple[Order, ...] = ()


@dataclass(frozen=True)
class Aggregate(Scalar):
    kind: str
    of: Any
    condition: Any = None
    order: tuple[Order, ...] = ()
    type: str | None = None
    scale: int | None = None
    function: Callable | None = None
    label: str | None = None

    def parts(self):
        return (*([self.of] if isinstance(self.of, Scalar) else []), *([self.condition] if self.condition is not None else []), *(o.by for o in self.order))

    def filter(self, build: Callable) -> Aggregate:
        """Only rows that pass: a count of none is 0, every other kind null."""
        from skeinql.plans.filters import conditions

        if self.kind == "custom" or self.condition is not None:
            raise Refused(Code.AGGREGATE_FILTER, "one filter, and none on a custom aggregate")
        c = conditions(build)
        if not c.terms:
            raise Refused(Code.AGGREGATE_FILTER, "the filter has no condition")
        return replace(self, condition=c)

    def as_(self, label: str) -> Aggregate:
        return replace(self, label=label)


@dataclass(frozen=True)
class Window(Scalar):
    kind: str
    of: Scalar | None = None
    partition: tuple[Scalar, ...] = ()
    order: tuple[Order, ...] = ()
    frame: str = "none"

    def parts(self):
        return (*([self.of] if self.of is not None else []), *self.partition, *(o.by for o in self.order))


# expressions


def coalesce(a: Any, b: Any) -> Scalar:
    return Apply("coalesce", (lifted(a), lifted(b)))


def null_if(a: Any, sentinel: Any) -> Scalar:
    return Apply("null_if", (lifted(a), lifted(sentinel)))


def _arithmetic(op: str):
    def build(a: Any, b: Any, type: str | None = None) -> Scalar:
        out = Apply(op, (lifted(a), lifted(b)))
        return Typed(out, type) if type else out

    return build


plus, minus, times = _arithmetic("plus"), _arithmetic("minus"), _arithmetic("times")


def divided_by(a: Any, b: Any, type: str | None = None) -> Scalar:
    """A quotient; two integral operands are refused when the query is compiled, and a zero divisor fails the query."""
    out = Apply("divided_by", (lifted(a), lifted(b)))
    return Typed(out, type) if type else out


def negate(a: Any) -> Scalar:
    return Apply("negate", (lifted(a),))


def rounded(a: Any, scale: int) -> Scalar:
    """Half away from zero, as a decimal."""
    if not 0 <= scale <= 30:
        raise Refused(Code.EXACT_AVERAGE, "scale is 0 to 30")
    return Apply("round", (lifted(a),), scale)


def concat(*args: Any) -> Scalar:
    """Text of all arguments; null if one is."""
    return Apply("concat", tuple(map(lifted, args)))


_AGGREGATE_NAMES = {"count", "sum", "avg", "min", "max", "first", "last", "collect_list", "collect_set", "array_agg", "stddev", "variance", "any_value", "mean", "listagg", "string_agg"}


def function(name: str, *args: Any, type: str | None = None) -> Scalar:
    """Any scalar SQL function by name; aggregates are refused."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name) or name.lower() in _AGGREGATE_NAMES:
        raise Refused(Code.BAD_FUNCTION, name)
    out = Apply("function", tuple(map(lifted, args)), name)
    return Typed(out, type) if type else out


def constant(v: Any) -> Scalar:
    return lifted(v)


value = constant


def param(name: str) -> Param:
    return Param(name)


def next_value(sequence: str) -> Scalar:
    raise Refused(Code.SEQUENCE, f"no sequence {sequence}: a distributed read has no running number")


def type_of(table: Table) -> Scalar:
    if table.entity is None or table.entity.discriminator is None:
        raise Refused(Code.UNKNOWN_NAME, "the table has no subtypes")
    return TypeOf(table)


class cases:
    """``cases().when(filter, value)...otherwise(value)`` or ``.or_null()``."""

    def __init__(self, branches: tuple = ()):
        self._branches = branches

    def when(self, build: Callable, then: Any) -> cases:
        from skeinql.plans.filters import conditions

        c = conditions(build)
        if not c.terms:
            raise Refused(Code.EMPTY_CASE_CONDITION, "a branch has no condition")
        if any(type(x).__name__ in ("ExistsPath", "ExistsSub", "InSub", "Fits") for x in walk(c)):
            raise Refused(Code.CASE_CONDITION, "a branch holds a sub-query or a named predicate")
        return cases((*self._branches, (c, lifted(then))))

    def otherwise(self, v: Any) -> Scalar:
        return Case(self._branches, lifted(v))

    def or_null(self) -> Scalar:
        return Case(self._branches, None)


# aggregates


class Agg:
    @staticmethod
    def count(of: Any) -> Aggregate:
        """Rows of a table (a missed join counts for none), or values that are not null."""
        return Aggregate("count", of)

    @staticmethod
    def count_distinct(of: Scalar) -> Aggregate:
        return Aggregate("count_distinct", of)

    @staticmethod
    def sum(of: Scalar, type: str | None = None) -> Aggregate:
        """Of decimal, double or long values, as their type; null of no rows."""
        return Aggregate("sum", of, type=type)

    @staticmethod
    def sum_as_long(of: Scalar) -> Aggregate:
        return Aggregate("sum_as_long", of)

    @staticmethod
    def avg(of: Scalar) -> Aggregate:
        return Aggregate("avg", of)

    @staticmethod
    def avg_exact(of: Scalar, type: str = "decimal(38,10)") -> Aggregate:
        """Sum over count as a decimal; doubles are refused."""
        return Aggregate("avg_exact", of, type=type)

    @staticmethod
    def min(of: Scalar) -> Aggregate:
        return Aggregate("min", of)

    @staticmethod
    def max(of: Scalar) -> Aggregate:
        return Aggregate("max", of)

    @staticmethod
    def first_by(of: Scalar, *order: Order) -> Aggregate:
        """The value of the group's first row by ``order``, then by the root's key; a null value is one."""
        return Aggregate("first_by", of, order=order)

    @staticmethod
    def round(of: Aggregate, scale: int) -> Aggregate:
        if not 0 <= scale <= 30 or of.kind in ("count", "count_distinct", "min", "max", "first_by"):
            raise Refused(Code.EXACT_AVERAGE, "a sum or an average, to a scale of 0 to 30")
        return replace(of, scale=scale)

    @staticmethod
    def of(label: str, build: Callable, *args: Scalar) -> Aggregate:
        """An aggregate of its own: ``build`` gets columns and gives an aggregate column."""
        return Aggregate("custom", Custom(label, build, args), label=label)


# windows

FRAMES = ("none", "rows_to_current", "rows_all", "rows_from_current", "range_to_current", "range_all")
_KINDS = ("row_number", "rank", "dense_rank", "lag", "lead", "first_value", "last_value", "sum", "avg", "min", "max", "count")


def window(kind: str, of: Scalar | None = None, partition_by: tuple | list = (), order_by: tuple | list = (), frame: str = "none") -> Window:
    """A window function of a source; order-sensitive ones get the source's key appended to their order."""
    if kind not in _KINDS or frame not in FRAMES:
        raise Refused(Code.WINDOW, f"{kind} over {frame}")
    if kind in ("first_value", "last_value") and frame == "none":
        raise Refused(Code.WINDOW, f"{kind} needs a frame")
    if kind in ("row_number", "rank", "dense_rank", "lag", "lead") and (not order_by or frame != "none"):
        raise Refused(Code.WINDOW, f"{kind} needs an order, and takes no frame")
    if (of is None) != (kind in ("row_number", "rank", "dense_rank")) and kind != "count":
        raise Refused(Code.WINDOW, f"{kind}: argument")
    return Window(kind, of, tuple(partition_by), tuple(order_by), frame)
