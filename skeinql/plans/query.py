"""Immutable query definitions, and sources: named sub-queries that other queries read, join and combine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from skeinql.errors import Code, Refused
from skeinql.functions.expr import Aggregate, Blank, Col, Correlated, Named, Order, Scalar, Value, Window, walk
from skeinql.plans.filters import All, Condition, ExistsPath, conditions
from skeinql.plans.schema import Table


@dataclass(frozen=True)
class Nested:
    """A struct of a joined table's items; null where the join found no row."""

    name: str
    table: Table
    items: tuple


def output_name(item: Any) -> str:
    if isinstance(item, (Named, Nested)):
        return item.name
    if isinstance(item, Col):
        return "_".join(filter(None, (*item.table.path.split("."), item.name)))
    if isinstance(item, Aggregate) and item.label:
        return item.label
    raise Refused(Code.NO_SELECTION, "an expression needs a name: .named(...)")


def bare(item: Any) -> Any:
    return item.of if isinstance(item, Named) else item


def expressions(item: Any):
    """All nodes of an item, also of nested ones."""
    if isinstance(item, Nested):
        for i in item.items:
            yield from expressions(i)
    else:
        yield from walk(item)


def columns(*trees: Any):
    for t in trees:
        for x in expressions(t):
            if isinstance(x, Col):
                yield x


@dataclass(frozen=True)
class Query:
    root: Table
    items: tuple = ()
    condition: All = All(())
    group: tuple[Scalar, ...] | None = None
    having_: All = All(())
    order: tuple[Order, ...] = ()
    join_filters: tuple[tuple[tuple, All], ...] = ()
    params: tuple[tuple[str, Any], ...] = ()
    customizer: Callable | None = None
    children: tuple = ()
    enrichers: tuple = ()
    finisher: Callable | None = None
    mapper: Callable | None = None
    keys_first: bool = False

    # building
    def select(self, *items: Any) -> Query:
        return replace(self, items=(*self.items, *(i for i in items if i not in self.items)))

    def without(self, *names: str) -> Query:
        return replace(self, items=tuple(i for i in self.items if output_name(i) not in names))

    def contains(self, *names: str) -> bool:
        return set(names) <= set(self.names)

    def only(self, *names: str) -> Query:
        return replace(self, items=tuple(i for i in self.items if output_name(i) in names))

    def where(self, build: Callable) -> Query:
        return replace(self, condition=All((*self.condition.terms, *conditions(build).terms)))

    def group_by(self, *keys: Scalar) -> Query:
        """Rows in groups; without keys all rows are one."""
        return replace(self, group=(*(self.group or ()), *map(bare, keys)))

    def grouped_by(self, *names: str) -> Query:
        """Groups chosen at run time: by the named items; of the other items those that are no aggregate read null."""
        by = {output_name(i): bare(i) for i in self.items if not any(isinstance(x, Aggregate) for x in expressions(i))}
        if unknown := [n for n in names if n not in by]:
            raise Refused(Code.UNKNOWN_NAME, f"{unknown} are no group keys")
        items = tuple(Named(Blank(bare(i)), n) if (n := output_name(i)) in by and n not in names else i for i in self.items)
        return replace(self, items=items, group=tuple(by[n] for n in names))

    def having(self, build: Callable) -> Query:
        return replace(self, having_=All((*self.having_.terms, *conditions(build).terms)))

    def order_by(self, *order: Order) -> Query:
        return replace(self, order=(*self.order, *(o if isinstance(o, Order) else Order(o) for o in order)))

    def ordered_by(self, spec: list[tuple[str, str]]) -> Query:
        """Order at run time: (name of an item, or path to a column as ``customer.c_name``; ``asc`` or ``desc``)."""
        by = {output_name(i): bare(i) for i in self.items if not isinstance(i, Nested)}
        order = []
        for name, way in spec:
            of = by.get(name) or self._by_path(name)
            if of is None or way not in ("asc", "desc"):
                raise Refused(Code.UNKNOWN_SORT, f"{name} {way}")
            order.append(Order(of, way == "desc"))
        return replace(self, order=tuple(order))

    def _by_path(self, path: str) -> Col | None:
        """The column at the end of to-one relations; joins that the items have already are taken."""
        *steps, name = path.split(".")
        have = {t.path: t for c in columns(*self.items) for t in (c.table,)}
        t = self.root
        for i, step in enumerate(steps):
            r = next((r for r in t.entity.relations if r.name == step), None) if t.entity else None
            if r is None or r.many:
                return None
            t = have.get(".".join(steps[: i + 1])) or t.join(step)
        return Col(t, name) if steps else None

    def join_filter(self, table: Table, build: Callable) -> Query:
        """More of a LEFT join's condition: rows that fail are as if not there, and blank the join's columns."""
        if table.kind != "left" or table.parent is None:
            raise Refused(Code.JOIN_FILTER, "only a LEFT join can be filtered")
        c = conditions(build)
        for x in columns(*_conditions_of(c)):
            if x.table.row.identity != table.row.identity:
                raise Refused(Code.JOIN_FILTER, f"{x.name} is of another table")
        rest = tuple(f for f in self.join_filters if f[0] != table.identity)
        return replace(self, join_filters=(*rest, (table.identity, c)) if c.terms else rest)

    def bind(self, **values: Any) -> Query:
        return replace(self, params=tuple((dict(self.params) | values).items()))

    def customized(self, function: Callable) -> Query:
        """``function`` gets the compiled DataFrame and gives one of the same columns."""
        return replace(self, customizer=function)

    def child(self, child: Any) -> Query:
        """A nested array; a child named ``customer.orders`` is put into the nested ``customer``, as its plan."""
        if any(c.name == child.name for c in self.children):
            raise Refused(Code.PLAN_TWICE, child.name)
        return replace(self, children=(*self.children, child))

    def join_plan(self, nested: str, *children: Any) -> Query:
        """Children of a nested join: each ``parent_key`` names items of it."""
        if nested not in [i.name for i in self.items if isinstance(i, Nested)]:
            raise Refused(Code.UNKNOWN_NAME, f"no nested {nested}")
        out = self
        for c in children:
            out = out.child(replace(c, name=f"{nested}.{c.name}", parent_key=tuple(f"{nested}.{k}" for k in c.parent_key)))
        return out

    def enrich(self, enricher: Any) -> Query:
        return replace(self, enrichers=(*self.enrichers, enricher))

    def mapped(self, mapper: Callable, finisher: Callable | None = None) -> Query:
        """``mapper`` gets a row and gives a model; ``finisher`` gets the list of models of a call."""
        return replace(self, mapper=mapper, finisher=finisher)

    def primary_key_first(self) -> Query:
        """Offset pages read keys first, then rows by key."""
        return replace(self, keys_first=True)

    # what it is
    @property
    def grouped(self) -> bool:
        return self.group is not None or any(isinstance(x, Aggregate) for i in self.items for x in expressions(i))

    @property
    def names(self) -> list[str]:
        return [output_name(i) for i in self.items]

    @property
    def key(self) -> tuple[str, ...]:
        return self.root.key

    def checked(self, windows: bool = False) -> Query:
        """Itself, if its definition holds together."""
        if not self.items:
            raise Refused(Code.NO_SELECTION, "nothing is selected")
        if len(set(self.names)) != len(self.names):
            raise Refused(Code.DUPLICATE_NAME, str(self.names))
        trees = [*self.items, *(o.by for o in self.order), *(self.group or ())]
        nodes = [x for t in (*trees, *_conditions_of(self.condition), *_conditions_of(self.having_)) for x in expressions(t)]
        joins: dict[tuple, Table] = {}
        for x in nodes:
            if isinstance(x, Col):
                if x.table.root.identity != self.root.identity:
                    raise Refused(Code.FOREIGN_COLUMN, f"{x.name} is of {x.table.root.identity}")
                t = x.table
                while t is not None:
                    if joins.setdefault(t.row.identity, t).on_filter is not t.on_filter:
                        raise Refused(Code.SAME_JOIN_OTHER_CONDITION, t.path)
                    t = t.parent
            if isinstance(x, Window) and not windows:
                raise Refused(Code.WINDOW, "window functions are for sources")
            if isinstance(x, Aggregate) and isinstance(x.of, Scalar) and any(isinstance(y, Correlated) for y in walk(x.of)):
                raise Refused(Code.AGGREGATE_OF_CORRELATED, x.kind)
            if isinstance(x, Correlated) and x.sub.table.many:
                raise Refused(Code.CORRELATED_TO_MANY, x.kind)
        self._check_groups()
        return self

    def _check_groups(self) -> None:
        if not self.grouped:
            if self.having_.terms:
                raise Refused(Code.HAVING_WITHOUT_GROUPS, "having without groups")
            return
        keys = self.group or ()
        for k in keys:
            if any(isinstance(x, Aggregate) for x in walk(k)):
                raise Refused(Code.GROUP_BY_AGGREGATE, "a key holds an aggregate")
            if any(isinstance(x, Correlated) for x in walk(k)):
                raise Refused(Code.CORRELATED_GROUP_KEY, "a key holds a sub-query")
        for item in self.items:
            if isinstance(item, Nested) or not _fits(bare(item), keys):
                raise Refused(Code.NOT_GROUPED, f"{output_name(item)} is neither a key nor an aggregate")
        for o in self.order:
            if not _fits(o.by, keys):
                raise Refused(Code.ORDER_NOT_GROUPED, "an order is neither a key nor an aggregate")


def _fits(x: Scalar, keys: tuple) -> bool:
    if x in keys or isinstance(x, (Aggregate, Value, Blank)):
        return True
    if isinstance(x, (Col, Correlated)):
        return False
    return all(_fits(p, keys) for p in x.parts() if isinstance(p, Scalar)) and all(_all_fit(p, keys) for p in x.parts() if isinstance(p, Condition))


def _all_fit(c: Any, keys: tuple) -> bool:
    return all(_fits(p, keys) if isinstance(p, Scalar) else _all_fit(p, keys) for p in c.parts())


def _conditions_of(c: Any):
    """Trees to walk of a condition: itself, as nodes have parts; paths' inner conditions are the compiler's."""
    return (c,) if not isinstance(c, ExistsPath) else ()


def select_from(root: Table, *items: Any) -> Query:
    return Query(root).select(*items)


class FieldIndex:
    """Names that a client asks for against a query: items, dotted ones of nested items, sets of names, and children.

    A nested item's name stands for all of it. ``filters``: further columns that filters may name, without being read.
    """

    def __init__(self, query: Query, filters: dict[str, Scalar] | None = None, sets: dict[str, list[str]] | None = None):
        self.query, self.sets = query, {n: list(x) for n, x in (sets or {}).items()}
        self.items = {}
        for i in query.items:
            if isinstance(i, Nested):
                self.items |= {f"{i.name}.{output_name(x)}": x for x in i.items}
                self.sets.setdefault(i.name, [f"{i.name}.{output_name(x)}" for x in i.items])
            else:
                self.items[output_name(i)] = i
        self.children = {c.name: c for c in query.children}
        self.filters = {n: bare(i) for n, i in self.items.items() if not isinstance(i, Nested)} | dict(filters or {})

    @property
    def names(self) -> list[str]:
        """What ``resolve`` knows."""
        return [*self.items, *self.sets, *self.children]

    def filter(self, name: str) -> Scalar | None:
        """The column or expression that a filter may name, if any."""
        return self.filters.get(name)

    def set(self, name: str) -> list[str] | None:
        return self.sets.get(name)

    def child(self, name: str) -> Any:
        return self.children.get(name)

    def resolve(self, asked: str | list[str]) -> tuple[list[str], list[str]]:
        """(known names with sets spelled out, unknown names), each once, of a list as ``id,customer.name``."""
        names = [n.strip() for n in asked.split(",") if n.strip()] if isinstance(asked, str) else list(asked)
        known = [x for n in names for x in (self.sets[n] if n in self.sets and n not in self.items else [n]) if n in self.names]
        return list(dict.fromkeys(known)), list(dict.fromkeys(n for n in names if n not in self.names))

    def only(self, *names: str) -> FieldIndex:
        """An index of just these names; sets lose what is not among them or in them, and may not end empty."""
        if unknown := [n for n in names if n not in self.names and n not in self.filters]:
            raise Refused(Code.UNKNOWN_NAME, f"{unknown} are not in the index")
        items = {n for n in self.items if n in names or any(n in self.sets[s] for s in names if s in self.sets)}
        out = FieldIndex.__new__(FieldIndex)
        out.query, out.items = self.query, {n: i for n, i in self.items.items() if n in items}
        out.sets = {n: [x for x in s if x in items] for n, s in self.sets.items() if n in names}
        if empty := [n for n, s in out.sets.items() if not s]:
            raise Refused(Code.UNKNOWN_NAME, f"{empty} would be empty")
        out.children = {n: c for n, c in self.children.items() if n in names}
        out.filters = {n: f for n, f in self.filters.items() if n in items or n in names}
        return out

    def select(self, asked: str | list[str]) -> Query:
        """The query with the known names that are asked for, and of its children those."""
        known, _ = self.resolve(asked)
        items: list = []
        for i in self.query.items:
            if isinstance(i, Nested):
                if inner := tuple(x for x in i.items if f"{i.name}.{output_name(x)}" in known):
                    items.append(replace(i, items=inner))
            elif output_name(i) in known:
                items.append(i)
        return replace(self.query, items=tuple(items), children=tuple(c for c in self.query.children if c.name in known))


class Source:
    """A named sub-query with a key. Set operations give new sources; ``unique`` tells if the key is one row's."""

    def __init__(self, name: str, query: Query, key: tuple[str, ...] | None = None, discriminators: dict[str, Any] | None = None, operations: tuple = (), recursion: Any = None):
        self.name, self.discriminators, self.operations, self.recursion = name, dict(discriminators or {}), operations, recursion
        for d, v in self.discriminators.items():
            if d in query.names:
                raise Refused(Code.DISCRIMINATOR, f"{d} is a field already")
            query = query.select(Named(Value(v), d))
        self.query = query.checked(windows=True)
        self.key = key if key is not None else self._natural_key()
        missing = [k for k in self.key if k not in self.fields]
        if missing:
            raise Refused(Code.UNKNOWN_NAME, f"{missing} of the key are not selected")

    def _natural_key(self) -> tuple[str, ...]:
        by = {bare(i): output_name(i) for i in self.query.items if not isinstance(i, Nested)}
        if self.query.grouped:
            return tuple(by[k] for k in self.query.group or () if k in by)
        key = [by.get(Col(self.query.root, k)) for k in self.query.root.key]
        return tuple(key) if None not in key else ()

    @property
    def fields(self) -> list[str]:
        return [*self.query.names, *([self.recursion.depth] if self.recursion is not None and self.recursion.depth else [])]

    @property
    def own_unique(self) -> bool:
        q = self.query
        by = {output_name(i): bare(i) for i in q.items if not isinstance(i, Nested)}
        mine = {by[k] for k in self.key if k in by}
        if q.grouped:
            return set(q.group or ()) <= mine
        multiplied = any(x.table.many for i in (*q.items, *(o.by for o in q.order)) for x in columns(i))
        whole = bool(q.root.key) and all(Col(q.root, k) in mine for k in q.root.key)
        return whole and not multiplied and (q.root.source is None or q.root.source.unique)

    @property
    def unique(self) -> bool:
        if self.recursion is not None:
            return self.recursion.tree and self.own_unique
        out, tags, roots = self.own_unique, [self.discriminators], [self.query.root.identity]
        for op, other in self.operations:
            if op == "intersect":
                out = out or other.unique
            elif op in ("union", "union_all"):
                apart = all(any(k in t and t[k] != v for k, v in other.discriminators.items() if k in self.key) for t in tags) and bool(other.discriminators)
                alike = op == "union" and all(r == other.query.root.identity for r in roots) and set(self.key) == set(self.fields)
                out = out and other.unique and (apart or alike)
                tags.append(other.discriminators)
                roots.append(other.query.root.identity)
        return out

    def _with(self, op: str, other: Source) -> Source:
        if self.recursion is not None or other.recursion is not None:
            raise Refused(Code.SHAPE, "a recursive source is no branch of a set operation")
        if self.fields != other.fields:
            raise Refused(Code.SHAPE, f"{self.fields} and {other.fields}")
        if op in ("union", "union_all") and self.discriminators and other.discriminators == self.discriminators:
            raise Refused(Code.DISCRIMINATOR, "two branches have one tag")
        out = Source.__new__(Source)
        out.__dict__.update(self.__dict__ | {"operations": (*self.operations, (op, other))})
        return out

    def union(self, other: Source) -> Source:
        return self._with("union", other)

    def union_all(self, other: Source) -> Source:
        return self._with("union_all", other)

    def intersect(self, other: Source) -> Source:
        return self._with("intersect", other)

    def except_(self, other: Source) -> Source:
        return self._with("except", other)

    def recursive(self, child: str, parent: str, max_depth: int, depth: str | None = None, tree: bool = False, links: Query | None = None) -> Source:
        """Rows of this source (the seeds, level 0) and, level by level, rows whose ``parent`` field is a ``child`` above.

        ``links``: the rows to descend to, by default all rows of the seeds' query without its condition. ``depth``
        names a field with the level. Deeper than ``max_depth`` or a cycle is refused when read; ``tree`` also refuses
        a node that is reached twice. Composite keys: comma-separated fields.
        """
        if max_depth < 1:
            raise Refused(Code.RECURSION_STEP, "max_depth is 1 at least")
        if self.operations or self.query.grouped or any(isinstance(x, Window) for i in self.query.items for x in expressions(i)):
            raise Refused(Code.RECURSION_STEP, "the seeds are a plain selection")
        c, p = tuple(child.split(",")), tuple(parent.split(","))
        if len(c) != len(p) or any(f not in self.fields for f in (*c, *p)):
            raise Refused(Code.RECURSION_STEP, f"{child} and {parent} are fields of the source")
        out = Source.__new__(Source)
        out.__dict__.update(self.__dict__ | {"recursion": Recursion(c, p, max_depth, depth, tree, links or replace(self.query, condition=All(())))})
        return out

    def table(self) -> Table:
        return Table.of_source(self)


@dataclass(frozen=True)
class Recursion:
    child: tuple[str, ...]
    parent: tuple[str, ...]
    max_depth: int
    depth: str | None
    tree: bool
    links: Query
