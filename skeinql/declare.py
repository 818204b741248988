"""Models by declaration: a class whose attributes say which columns, joins and aggregates it holds.

    @model(schema, "orders")
    class OrderRow:
        id = column("o_orderkey", key=True)
        total = column("o_totalprice")
        customer = nested("customer", CustomerRow)

``OrderRow.query()`` is its query; reading gives instances. An attribute that was not selected is refused when read.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

from skeinql.errors import Code, Refused
from skeinql.functions.expr import Aggregate, Declared, Named, Scalar, type_of
from skeinql.operators.fetch import child
from skeinql.plans.query import FieldIndex, Nested, Query, Source
from skeinql.plans.schema import Schema, Table


@dataclass(frozen=True)
class Part:
    """An attribute: ``make`` gets the table and gives an item."""

    kind: str
    make: Callable[[Table], Any] = None
    options: tuple = ()
    default: bool = True
    inserted: bool = True
    converter: Any = None


@dataclass(frozen=True)
class Converter:
    """Model value <-> stored value. ``ordered``: keeps order, so that least and greatest may be taken."""

    into: Callable[[Any], Any]
    out: Callable[[Any], Any]
    ordered: bool = False


def column(name: str, default: bool = True, inserted: bool = True, converter: Converter | None = None, treat: str | None = None, via: Callable[[Table], Table] | None = None, type: str | None = None) -> Part:
    """A column; ``treat``: of a subtype; ``via``: of a joined table, entity or source; ``default``: is in the query
    unless asked otherwise; ``type``: what the stored type must be."""

    def make(t: Table) -> Any:
        t = via(t) if via else t
        of = (t.treat(treat) if treat else t).col(name)
        return Declared(of, type) if type else of

    return Part("column", make, (name,), default, inserted, converter)


def computed(make: Callable[[Table], Scalar], default: bool = True) -> Part:
    return Part("computed", make, default=default, inserted=False)


def aggregate(make: Callable[[Table], Aggregate]) -> Part:
    return Part("aggregate", make, inserted=False)


def group_key(make: Callable[[Table], Scalar] | str) -> Part:
    return Part("group", (lambda t: t.col(make)) if isinstance(make, str) else make, inserted=False)


def windowed(make: Callable[[Table], Scalar]) -> Part:
    return Part("window", make, inserted=False)


def nested(way: str | Callable[[Table], Table], of: type, kind: str = "left", alias: str | None = None, treat: str | None = None) -> Part:
    """A joined model; None where the join finds no row."""

    def table(t: Table) -> Table:
        j = t.join(way, kind, alias) if isinstance(way, str) else way(t)
        return j.treat(treat) if treat else j

    return Part("nested", table, (of,), inserted=False)


def children(relation: str, of: type, parent_key: str, order: Callable[[Table], list] | None = None, most: int | None = None, single: bool = False) -> Part:
    return Part("children", None, (relation, of, parent_key, order, most, single), inserted=False)


def filter_only(name: str, via: Callable[[Table], Table] | None = None) -> Part:
    """A column that filters may name and nothing reads."""
    return Part("filter", lambda t: (via(t) if via else t).col(name), inserted=False)


def discriminator(value: Any) -> Part:
    """A constant that tells this source's rows from those of the others in a set operation."""
    return Part("tag", None, (value,), inserted=False)


def depth() -> Part:
    """The level of a row in a recursive source."""
    return Part("depth", None, inserted=False)


def subtype() -> Part:
    return Part("computed", type_of, inserted=False)


def model(schema: Schema, root: str | Table, single_group: bool = False):
    """Makes a class a model of an entity (or of a source's table)."""

    def wrap(cls: type) -> type:
        parts = {n: p for n, p in vars(cls).items() if isinstance(p, Part)}
        if taken := _TAKEN & set(parts):
            raise Refused(Code.DUPLICATE_NAME, f"{sorted(taken)} are a model's own")
        cls.parts, cls.root = parts, root if isinstance(root, Table) else schema.root(root)
        cls.single_group = single_group
        for n in parts:
            setattr(cls, n, _Attribute(n))
        cls.__init__ = _init
        cls.__repr__ = lambda self: f"{cls.__name__}({', '.join(f'{k}={v!r}' for k, v in self._values.items())})"
        cls.__eq__ = lambda self, other: type(self) is type(other) and self._values == other._values
        cls.__hash__ = None
        cls.query, cls.model_items, cls.insert_columns, cls.changes_of = classmethod(_query), classmethod(_items), classmethod(_insert_columns), classmethod(_changes)
        cls.selected = property(lambda self: set(self._values))
        cls.filters = classmethod(lambda cls: {n: p.make(cls.root) for n, p in cls.parts.items() if p.kind in ("column", "computed", "filter")})
        cls.fields = classmethod(lambda cls: FieldIndex(cls.query(list(cls.parts)), cls.filters()))
        return cls

    return wrap


def source_model(schema: Schema, root: str | Table, name: str, key: tuple[str, ...] | None = None):
    """Makes a class a source: ``.source(where)`` is the sub-query of its parts, by their names.

    ``recursive``, as (child, parent, max_depth): rows below those that ``where`` chooses; a ``depth()`` part names the
    level, and ``tree`` refuses nodes that are reached twice.
    """

    def wrap(cls: type) -> type:
        cls = model(schema, root)(cls)

        def source(cls: type, where: Callable | None = None, recursive: tuple[str, str, int] | None = None, tree: bool = False) -> Source:
            parts = cls.parts.items()
            whole = Query(cls.root, tuple(cls.model_items(cls.root)))
            keys = [p.make(cls.root) for _, p in parts if p.kind == "group"]
            if keys:
                whole = replace(whole, group=tuple(keys))
            out = Source(name, whole.where(where) if where else whole, key, {n: p.options[0] for n, p in parts if p.kind == "tag"})
            level = next((n for n, p in parts if p.kind == "depth"), None)
            if recursive is None:
                if level is not None:
                    raise Refused(Code.RECURSION_STEP, f"{level} is a level, but the source is not recursive")
                return out
            return out.recursive(*recursive, depth=level, tree=tree, links=whole)

        cls.source = classmethod(source)
        return cls

    return wrap


#: Names that a model class has itself.
_TAKEN = {"source", "filters", "fields", "parts", "root", "single_group", "query", "model_items", "insert_columns", "changes_of", "selected"}


#: (model, attribute) of reads of attributes that were not selected, while ``auditing`` runs.
_unselected: list | None = None


@contextmanager
def auditing():
    """Reads of unselected attributes in the block, as (model, attribute) pairs: they give None there, and are listed."""
    global _unselected
    before, _unselected = _unselected, []
    try:
        yield _unselected
    finally:
        _unselected = before


def write_model(of: type, *names: str, update: bool = False):
    """Makes a class a shape of inserts (``.row()``) or updates (``.changes()``) of a model's entity.

    It holds the named attributes of ``of``, by default all that are inserted; an update has no key and no version.
    """

    def wrap(cls: type) -> type:
        parts = {n: p for n, p in of.parts.items() if p.kind == "column" and p.inserted and (not names or n in names)}
        if unknown := set(names) - set(parts):
            raise Refused(Code.UNKNOWN_NAME, str(sorted(unknown)))
        if update:
            parts = {n: p for n, p in parts.items() if p.options[0] not in of.root.key and p.options[0] != of.root.entity.version}
        cls.parts, cls.root = parts, of.root
        for n in parts:
            setattr(cls, n, _Attribute(n))
        cls.__init__ = _init
        setattr(cls, "changes" if update else "row", lambda self: _insert_columns(type(self), self))
        return cls

    return wrap


class _Attribute:
    def __init__(self, name: str):
        self.name = name

    def __get__(self, obj, owner=None):
        if obj is None:
            return owner.parts[self.name]
        if self.name not in obj._values and _unselected is not None:
            _unselected.append((owner.__name__, self.name))
            return None
        if self.name not in obj._values:
            raise Refused(Code.UNKNOWN_NAME, f"{self.name} was not selected")
        return obj._values[self.name]

    def __set__(self, obj, value):
        obj._values[self.name] = value


def _init(self, **values: Any) -> None:
    unknown = set(values) - set(type(self).parts)
    if unknown:
        raise Refused(Code.UNKNOWN_NAME, str(unknown))
    self._values = values


def _items(cls, table: Table, names: list[str] | None = None) -> list:
    out = []
    for n, p in cls.parts.items():
        if p.kind in ("children", "filter", "tag", "depth") or (names is None and not p.default) or (names is not None and n not in names):
            continue
        if p.kind == "nested":
            t = p.make(table)
            out.append(Nested(n, t, tuple(p.options[0].model_items(t))))
        else:
            out.append(Named(p.make(table), n))
    return out


def _query(cls, names: list[str] | None = None) -> Query:
    """The model's query with its default attributes, or those named."""
    q = Query(cls.root, tuple(cls.model_items(cls.root, names)))
    keys = [p.make(cls.root) for n, p in cls.parts.items() if p.kind == "group" and (names is None or n in names)]
    if keys or cls.single_group:
        q = replace(q, group=tuple(keys))
    for c in _children(cls, cls.root, names):
        q = q.child(c)
    return q.mapped(lambda row: _instance(cls, row))


def _children(cls, table: Table, names: list[str] | None = None) -> list:
    """Children of a model, and theirs."""
    out = []
    for n, p in cls.parts.items():
        if p.kind == "children" and (names is None or n in names):
            relation, of, parent_key, order, most, single = p.options
            c = child(n, table, relation, of.model_items, parent_key, order, most, single)
            for inner in _children(of, c.table):
                c = c.child(inner)
            out.append(c)
    return out


def _instance(cls, row: Any) -> Any:
    values = row.asDict() if hasattr(row, "asDict") else dict(row)
    for n, p in cls.parts.items():
        v = values.get(n)
        if v is None:
            continue
        if p.kind == "nested":
            values[n] = _instance(p.options[0], v)
        elif p.kind == "children":
            values[n] = _instance(p.options[1], v) if p.options[5] else [_instance(p.options[1], x) for x in v]
        elif p.converter is not None:
            values[n] = p.converter.into(v)
    return cls(**{k: v for k, v in values.items() if k in cls.parts})


def _insert_columns(cls, instance: Any) -> dict[str, Any]:
    """A row to insert: stored values by column name."""
    out = {}
    for n, p in cls.parts.items():
        if p.kind == "column" and p.inserted and n in instance._values:
            v = instance._values[n]
            out[p.options[0]] = p.converter.out(v) if p.converter is not None and v is not None else v
    return out


def _changes(cls, instance: Any) -> dict[str, Any]:
    """A change set for an update: the stored values that the instance holds, keys apart."""
    return {c: v for c, v in cls.insert_columns(instance).items() if c not in cls.root.key and c != cls.root.entity.version}
