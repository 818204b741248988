"""Entities and the tables of a query: a root, and joins that are equal if their keys are."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from skeinql.errors import Code, Refused

if TYPE_CHECKING:
    from skeinql.functions.expr import Col


@dataclass(frozen=True)
class Relation:
    """A way from an entity to another: pairs (own column, its column); ``many`` if a row can have several.

    ``through``: a link table (name, ((own column, link column), ...), ((link column, its column), ...)).
    Either side of a pair may be ``fn(column)`` text, as ``upper(code)``.
    """

    name: str
    target: str
    on: tuple[tuple[str, str], ...]
    many: bool = False
    through: tuple | None = None


@dataclass(frozen=True)
class Subtype:
    """A kind of an entity: the discriminator's value, and the table of its own columns if they are not in the entity's."""

    name: str
    value: Any
    table: str | None = None
    parent: str | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    key: tuple[str, ...] = ()
    relations: tuple[Relation, ...] = ()
    version: str | None = None
    discriminator: str | None = None
    subtypes: tuple[Subtype, ...] = ()

    def relation(self, name: str) -> Relation:
        for r in self.relations:
            if r.name == name:
                return r
        raise Refused(Code.UNKNOWN_NAME, f"{self.name} has no relation {name}")

    def values(self, name: str) -> list[Any]:
        """Discriminator values of a subtype and of those below it."""
        found = [s for s in self.subtypes if s.name == name]
        if not found:
            raise Refused(Code.UNKNOWN_NAME, f"{self.name} has no subtype {name}")
        return [found[0].value] + [v for s in self.subtypes if s.parent == name for v in self.values(s.name)]


class Schema:
    """Entities by name."""

    def __init__(self, *entities: Entity):
        self.entities = {e.name: e for e in entities}

    def __getitem__(self, name: str) -> Entity:
        if name not in self.entities:
            raise Refused(Code.UNKNOWN_NAME, f"no entity {name}")
        return self.entities[name]

    def root(self, name: str) -> Table:
        return Table(schema=self, entity=self[name])


@dataclass(frozen=True)
class Table:
    """A node of a query's join tree; two nodes are one if parent, way and alias are.

    kind: ``left`` or ``inner``. A node without parent is the root: an entity, or a source. ``way`` of a join is a
    relation's name, ``source`` or ``entity``; the latter two have ``pairs`` of (its column, expression of the query).
    """

    schema: Schema = field(compare=False, repr=False, default=None)
    entity: Entity | None = None
    source: Any = None
    parent: Table | None = None
    way: str | None = None
    kind: str = "left"
    alias: str | None = None
    pairs: tuple = ()
    when: tuple = ()
    treated: str | None = None
    on_filter: Any = field(compare=False, default=None)

    # roots
    @staticmethod
    def of_source(source: Any) -> Table:
        return Table(source=source)

    # joins
    def join(self, way: str, kind: str = "left", alias: str | None = None, on: Any = None) -> Table:
        """A relation's target; ``on``: a filter function for more of the join's condition, which needs an alias."""
        if kind not in ("left", "inner"):
            raise Refused(Code.UNKNOWN_NAME, f"a join is left or inner, not {kind}")
        if on is not None and alias is None:
            raise Refused(Code.CONDITION_NEEDS_ALIAS, way)
        relation = self.entity.relation(way)
        return Table(schema=self.schema, entity=self.schema[relation.target], parent=self, way=way, kind=kind, alias=alias, on_filter=on)

    def joined_source(self, source: Any, on: dict[str, Any], kind: str = "left", alias: str | None = None) -> Table:
        """A source joined on its whole key: {field of the source: expression}."""
        if not source.unique:
            raise Refused(Code.SOURCE_NOT_UNIQUE, f"{source.name} may have several rows for a key")
        if set(on) != set(source.key):
            raise Refused(Code.SOURCE_NOT_UNIQUE, f"{source.name} is joined on its whole key {source.key}")
        return Table(schema=self.schema, source=source, parent=self, way="source", kind=kind, alias=alias or source.name, pairs=tuple(sorted(on.items())))

    def entity_join(self, name: str, on: dict[str, Any], when: dict[str, Any] | None = None, kind: str = "left", alias: str | None = None, schema: Schema | None = None) -> Table:
        """An entity joined on its key without a relation: {its key column: expression}; ``when``: {expression: value}."""
        schema = schema or self.schema
        e = schema[name]
        if set(on) != set(e.key):
            raise Refused(Code.SOURCE_NOT_UNIQUE, f"{name} is joined on its whole key {e.key}")
        return Table(schema=schema, entity=e, parent=self, way="entity", kind=kind, alias=alias or name, pairs=tuple(sorted(on.items())), when=tuple((when or {}).items()))

    def within(self, join: Table) -> Table:
        """A source's or entity's join as a part of ``join``: its columns are null where that finds no row."""
        if self.way not in ("source", "entity") or join.root.identity != self.root.identity:
            raise Refused(Code.UNKNOWN_NAME, "only a source or an entity is joined within another join of the query")
        return replace(self, parent=join)

    def treat(self, subtype: str) -> Table:
        """The same rows; columns are null where a row is of another subtype."""
        self.entity.values(subtype)
        return Table(schema=self.schema, entity=self.entity, source=self.source, parent=self.parent, way=self.way, kind=self.kind, alias=self.alias, pairs=self.pairs, when=self.when, treated=subtype, on_filter=self.on_filter)

    # what it is
    @property
    def row(self) -> Table:
        """The node that is joined for this one: itself but for ``treat``."""
        return self if self.treated is None else Table(schema=self.schema, entity=self.entity, source=self.source, parent=self.parent, way=self.way, kind=self.kind, alias=self.alias, pairs=self.pairs, when=self.when, on_filter=self.on_filter)

    @property
    def identity(self) -> tuple:
        """Nodes of one identity are one join."""
        if self.parent is None:
            return (self.entity.name if self.entity else ("source", self.source.name),)
        return (*self.parent.identity, (self.way, self.alias, self.pairs and repr(self.pairs), self.when and repr(self.when)))

    @property
    def root(self) -> Table:
        return self.row if self.parent is None else self.parent.root

    @property
    def many(self) -> bool:
        """May a root row have several rows here?"""
        if self.parent is None:
            return False
        return self.parent.many or (self.way not in ("source", "entity") and self.parent.entity.relation(self.way).many)

    @property
    def key(self) -> tuple[str, ...]:
        return self.entity.key if self.entity else self.source.key

    @property
    def path(self) -> str:
        own = self.alias or self.way or ""
        return f"{self.parent.path}.{own}".lstrip(".") if self.parent else ""

    def col(self, name: str) -> Col:
        from skeinql.functions.expr import Col

        if self.source is not None and name not in self.source.fields:
            raise Refused(Code.UNKNOWN_NAME, f"{self.source.name} has no field {name}")
        return Col(self, name)

    __getitem__ = col

    def cols(self, *names: str) -> list[Col]:
        return [self.col(n) for n in names]
