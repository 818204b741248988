"""Nested children of rows, and values looked up for the rows of a call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinql.errors import Code, Refused
from skeinql.functions.expr import Order
from skeinql.plans.compiler import Scope, ordered
from skeinql.plans.filters import All, conditions
from skeinql.plans.query import Query, output_name
from skeinql.plans.schema import Relation, Table

if TYPE_CHECKING:
    from skeinql.operators.engine import Engine


@dataclass(frozen=True)
class Child:
    """An array of a relation's rows on each parent row.

    ``parent_key``: the parent's item(s) that the relation starts from. More rows than ``most`` for a parent are refused;
    ``single``: one struct, and two rows are refused. ``groups``: what the parents' keys tell of the partitions that hold
    the children.
    """

    name: str
    table: Table
    items: tuple
    parent_key: tuple[str, ...]
    condition: All = All(())
    order: tuple[Order, ...] = ()
    most: int | None = None
    single: bool = False
    relation: Relation | None = None
    children: tuple = ()
    groups: Any = None

    def key_groups(self, groups: Any) -> Child:
        return replace(self, groups=groups)

    def child(self, inner: Child) -> Child:
        """Children of the children; ``inner.parent_key`` names items of this one."""
        return replace(self, children=(*self.children, inner))

    def where(self, build: Callable) -> Child:
        return replace(self, condition=All((*self.condition.terms, *conditions(build).terms)))


def child(name: str, parent: Table, relation: str, items: Callable[[Table], list], parent_key: tuple[str, ...] | str, order: Callable[[Table], list[Order]] | None = None, most: int | None = None, single: bool = False) -> Child:
    """A child by relation; ``items`` and ``order`` get the child's table."""
    r = parent.entity.relation(relation)
    t = Table(schema=parent.schema, entity=parent.schema[r.target])
    key = (parent_key,) if isinstance(parent_key, str) else tuple(parent_key)
    return Child(name, t, tuple(items(t)), key, order=tuple(order(t)) if order else (), most=most, single=single, relation=r)


#: Parents up to which their keys are broadcast to the children's table.
BROADCAST_PARENTS = 100_000


def attach(engine: Engine, q: Query, rows: DataFrame, parents: int | None = None) -> DataFrame:
    """``rows`` with an array column for each child of ``q``, in one plan.

    ``parents``: how many rows there are at most, if that is known. Children are read by their parents' keys first, so
    that a page pays for its own children; only the children of a whole table are read without.
    """
    whole = parents is None and not q.condition.terms
    return _attached(engine, q, rows, q.children, parents, whole)


def _field(alias: str, path: str) -> Column:
    return F.col(".".join([alias, *(f"`{x}`" for x in path.split("."))]))


def _attached(engine: Engine, q: Query, rows: DataFrame, children: tuple, parents: int | None, whole: bool) -> DataFrame:
    for c in children:
        compiler = engine.compiler(q)
        scope = Scope(compiler, c.table)
        r = c.relation
        left = scope.aliases[c.table.identity]
        if r.through:
            name, to_link, to_target = r.through
            link = compiler.alias()
            on = None
            for a, b in to_target:
                term = F.col(f"`{link}`.`{a}`") == F.col(f"`{left}`.`{b}`")
                on = term if on is None else on & term
            scope.frame = scope.frame.join(engine.catalog.frame(name).alias(link), on)
            foreign = [F.col(f"`{link}`.`{b}`") for _, b in to_link]
        else:
            foreign = [F.col(f"`{left}`.`{b}`") for _, b in r.on]
        keys = rows.alias("p").select(*(_field("p", k).alias(f"__p{i}") for i, k in enumerate(c.parent_key))).dropna()
        few = parents is not None and parents <= BROADCAST_PARENTS
        condition = c.condition
        if c.groups is not None and few:
            found = [tuple(k) for k in keys.distinct().collect()]  # as many as parents
            condition = All((*condition.terms, *(c.groups.condition(found).terms if found else ())))
        scope.need_all(*c.items, *(o.by for o in c.order))
        found = scope.filtered(condition)
        if not whole:
            on = None
            for i, f in enumerate(foreign):
                term = f == F.col(f"__p{i}")
                on = term if on is None else on & term
            found = found.join(F.broadcast(keys) if few else keys, on, "left_semi")
        most = 1 if c.single else c.most
        # rank in the parent's order first: sorting an array knows one direction only
        order = [ordered(scope.column(o.by), o) for o in c.order] + [scope.at(c.table, k).asc_nulls_last() for k in c.table.key]
        ranked = order or most is not None
        rank = F.row_number().over(Window.partitionBy(*foreign).orderBy(*(order or foreign))) if ranked else F.lit(0)
        lines = found.select(*(f.alias(f"__c{i}") for i, f in enumerate(foreign)), rank.alias("__rank"), *(scope.column(i).alias(output_name(i)) for i in c.items))
        if most is not None:  # one more is enough to refuse, so that no parent's children are gathered beyond that
            lines = lines.where(F.col("__rank") <= most + 1)
        lines = _attached(engine, q, lines, c.children, None, whole)
        item = F.struct(*(F.col(f"`{n}`") for n in [*map(output_name, c.items), *(x.name for x in c.children)]))
        lines = lines.select(*(f"__c{i}" for i in range(len(foreign))), "__rank", item.alias("__item"))
        arrays = lines.groupBy(*(f"__c{i}" for i in range(len(foreign)))).agg(F.sort_array(F.collect_list(F.struct("__rank", "__item"))).alias("__all"))
        value = F.transform("__all", lambda x: x["__item"])
        if most is not None:
            code = Code.TWO_CHILDREN if c.single else Code.TOO_MANY_CHILDREN
            value = F.when(F.size("__all") > most, F.raise_error(F.lit(f"{code.value} {code.name}: {c.name}")).cast(_type(arrays, value))).otherwise(value)
        arrays = arrays.select(*(F.col(f"__c{i}") for i in range(len(foreign))), value.alias("__value"))
        on = None
        for i, k in enumerate(c.parent_key):
            term = _field("p", k) == F.col(f"k.__c{i}")
            on = term if on is None else on & term
        empty = F.array().cast(arrays.schema["__value"].dataType)
        out = F.get(F.col("k.__value"), 0) if c.single else F.coalesce(F.col("k.__value"), empty)
        into, _, leaf = c.name.rpartition(".")
        kept = [F.when(F.col(f"p.`{n}`").isNotNull(), F.col(f"p.`{n}`").withField(leaf, out)).alias(n) if n == into else F.col(f"p.`{n}`") for n in rows.columns]
        rows = rows.alias("p").join(arrays.alias("k"), on, "left").select(*kept, *([] if into else [out.alias(c.name)]))
    return rows


def _type(frame: DataFrame, value: Any) -> Any:
    return frame.select(value.alias("v")).schema[0].dataType


@dataclass(frozen=True)
class Enricher:
    """Fields that one lookup gives for all rows of a call: ``lookup`` gets the distinct keys and gives a dict.

    ``keys``: (field, item that holds its key) pairs, all served by the same lookup, ``batch`` keys at a time if that is
    set. A key that is null or not found gives ``default``.
    """

    keys: tuple[tuple[str, str], ...]
    lookup: Callable[[list], dict] | None = None
    default: Any = None
    pages: Callable[[list], list] | None = None
    batch: int | None = None

    @staticmethod
    def by_key(name: str, key: str, lookup: Callable[[list], dict], default: Any = None) -> Enricher:
        return Enricher(((name, key),), lookup, default)

    @staticmethod
    def by_keys(lookup: Callable[[list], dict], default: Any = None, batch: int | None = None, **keys: str) -> Enricher:
        """Several fields, each from a key of its own: ``by_keys(names, buyer="customer", maker="supplier")``."""
        return Enricher(tuple(keys.items()), lookup, default, batch=batch)

    @staticmethod
    def of(name: str, pages: Callable[[list], list]) -> Enricher:
        """``pages`` gets all rows and gives a value for each."""
        return Enricher(((name, ""),), pages=pages)

    def found(self, rows: list[Row]) -> dict:
        keys = list(dict.fromkeys(r[k] for r in rows for _, k in self.keys if r[k] is not None))
        out: dict = {}
        step = self.batch or max(1, len(keys))
        for at in range(0, len(keys), step):
            got = self.lookup(keys[at : at + step])
            if got is None:
                raise Refused(Code.LOOKUP_NOTHING, f"{[n for n, _ in self.keys]}: the lookup gave None")
            out |= got
        return out


def enriched(q: Query, rows: list[Row]) -> list[Row]:
    for e in q.enrichers:
        if not rows:
            return rows
        if e.pages is not None:
            values = e.pages(list(rows))
            if values is None or len(values) != len(rows):
                raise Refused(Code.ENRICHER_SIZE, f"{e.keys[0][0]}: {values and len(values)} values for {len(rows)} rows")
            values = [(v,) for v in values]
        else:
            found = e.found(rows)
            values = [tuple(found.get(r[k], e.default) for _, k in e.keys) for r in rows]
        make = Row(*rows[0].__fields__, *(n for n, _ in e.keys))
        rows = [make(*r, *v) for r, v in zip(rows, values, strict=True)]
    return rows
