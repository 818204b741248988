"""Verbs: what a caller does with a query."""

from __future__ import annotations

import base64
import datetime
import decimal
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.conversion import ArrowTableToRowsConversion, LocalDataToArrowConversion

from skeinql.errors import Code, Refused
from skeinql.functions.expr import Col, Order
from skeinql.operators.fetch import attach, enriched
from skeinql.plans.compiler import Compiled, Compiler, ordered
from skeinql.plans.filters import All, conditions
from skeinql.plans.query import Query, columns
from skeinql.sources.catalog import Catalog

#: Keys that are broadcast to a read by keys; more are joined as they come.
BROADCAST_KEYS = 100_000
#: Rows that ``map`` makes models of at a time.
MAPPED_ROWS = 1024
COUNT_MODES = ("count", "no_count", "only_count", "inline_count")


@dataclass(frozen=True)
class KeyGroups:
    """What a key tells of where its row lies, so that a read by keys reads those partitions only.

    ``value`` gives a key's group. ``column`` holds the group in the table: one condition on it, beyond ``most`` groups
    the range from the least to the greatest. ``binds`` are parameters of the query with a function of the group: one
    statement a group, all in one plan. ``rule`` gets the numbers of keys and groups and says whether grouping pays; if
    not, all keys are in the group ``all``, which excludes no row. ``verify``: keys without a row are read again so.
    """

    column: Col | None
    value: Callable[[Any], Any]
    most: int = 1000
    binds: tuple[tuple[str, Callable], ...] = ()
    rule: Callable[[int, int], bool] | None = None
    all: Any = None
    verify: bool = False

    @staticmethod
    def by(value: Callable[[Any], Any], column: Col | None = None) -> KeyGroups:
        return KeyGroups(column, value)

    #: As ``by``; the function gets a tuple, an element for each column of the key.
    by_composite = by

    def bind(self, name: str, value: Callable[[Any], Any]) -> KeyGroups:
        return replace(self, binds=(*(b for b in self.binds if b[0] != name), (name, value)))

    def group_when(self, rule: Callable[[int, int], bool], all: Any = None) -> KeyGroups:
        return replace(self, rule=rule, all=all)

    def verify_missing(self, all: Any = None) -> KeyGroups:
        if self.rule is not None and all != self.all:
            raise Refused(Code.TWO_CATCH_ALLS, "one group for all keys, not two")
        return replace(self, verify=True, all=all)

    def assume_in_range(self) -> KeyGroups:
        return replace(self, verify=False)

    def groups(self, keys: list[tuple]) -> dict[Any, list[tuple]]:
        out: dict[Any, list[tuple]] = {}
        for k in keys:
            g = self.value(k if len(k) > 1 else k[0])
            if g is None:
                raise Refused(Code.NULL_GROUP, str(k))
            out.setdefault(g, []).append(k)
        return out

    def condition(self, keys: list[tuple]) -> All:
        """The condition on the column that the keys' groups make."""
        values = sorted(self.groups(keys))
        if self.column is None or self.rule is not None and not self.rule(len(keys), len(values)):
            return All(())
        if len(values) > self.most:
            return conditions(lambda f: f.between(self.column, values[0], values[-1]))
        return conditions(lambda f: f.is_in(self.column, values))

    def narrowed(self, q: Query, keys: list[tuple]) -> Query:
        return replace(q, condition=All((*q.condition.terms, *self.condition(keys).terms)))

    def everything(self, q: Query) -> Query:
        return q.bind(**{n: f(self.all) for n, f in self.binds})

    def rounds(self, q: Query, keys: list[tuple]) -> list[tuple[Query, list[tuple]]]:
        """Queries and the keys that each is to find."""
        groups = self.groups(keys)
        if self.rule is not None and not self.rule(len(keys), len(groups)):
            return [(self.everything(q), keys)]
        if not self.binds:
            return [(self.narrowed(q, keys), keys)]
        return [(self.narrowed(q, ks).bind(**{n: f(g) for n, f in self.binds}), ks) for g, ks in groups.items()]


@dataclass(frozen=True)
class Page:
    items: list
    total: int | None
    has_next: bool


@dataclass(frozen=True)
class KeysetPage:
    items: list
    next_cursor: str | None
    previous_cursor: str | None
    has_next: bool
    has_previous: bool


class Engine:
    """Runs queries against a catalog. ``trusted``: see the compiler."""

    def __init__(self, catalog: Catalog, trusted: bool = False):
        self.catalog, self.trusted = catalog, trusted

    def compiler(self, q: Query) -> Compiler:
        return Compiler(self.catalog, dict(q.params), self.trusted)

    def compiled(self, q: Query, narrowed: DataFrame | None = None) -> Compiled:
        return self.compiler(q).query(q.checked(), narrowed=narrowed)

    # frames: lazy, for what Spark does next
    def frame(self, q: Query, ordered_: bool = False, limit: int | None = None) -> DataFrame:
        """The query's rows as a DataFrame; ``ordered_`` or a limit sorts them, ties by key."""
        c = self.compiled(q)
        out = c.frame.orderBy(*order) if (ordered_ or limit is not None) and (order := c.ordering(limit is not None)) else c.frame
        out = c.visible(out.limit(limit) if limit is not None else out)
        return attach(self, q, out, limit) if q.children else out

    def explain(self, q: Query) -> str:
        return self.frame(q)._jdf.queryExecution().explainString(self.catalog.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # reads
    def list(self, q: Query, limit: int | None = None) -> list:
        if limit is not None and limit < 0:
            raise Refused(Code.PAGE_SIZE, str(limit))
        if limit == 0:
            return []
        c = self.compiled(q)
        out = c.frame.orderBy(*order) if (order := c.ordering(limit is not None)) and (c.order or limit is not None) else c.frame
        return self._models(q, c.visible(out.limit(limit) if limit is not None else out), limit)

    def one(self, q: Query, key: Any = None, groups: KeyGroups | None = None) -> Any:
        """The only row, or None; two are refused."""
        q = replace(q, order=())
        if groups is not None and key is not None:
            return next(iter(self.by_keys(q, [key], groups).values()), None)
        if key is not None:
            q = q.where(lambda f: [f.eq(Col(q.root, k), v) for k, v in zip(q.key, _tuple(key), strict=True)])
        found = self._models(q, self.compiled(q).visible().limit(2), 2)
        if len(found) > 1:
            raise Refused(Code.TWO_ROWS, "one row was asked for")
        return found[0] if found else None

    def first(self, q: Query) -> Any:
        found = self.list(q, 1)
        return found[0] if found else None

    def by_keys(self, q: Query, keys: Iterable, groups: KeyGroups | None = None) -> dict:
        """Rows by key, in the order of the keys' first mention; keys without a row are not there.

        ``groups``: what the keys tell of the partitions that hold them, so that a scan skips the others.
        """
        if not q.key:
            raise Refused(Code.NEEDS_KEY, "by_keys")
        asked = list(dict.fromkeys(_tuple(k) for k in keys))
        if not asked:
            return {}
        if q.grouped or any(x.table.many for i in q.items for x in columns(i)):
            raise Refused(Code.TO_MANY_SELECTION, "by_keys reads one row a key")
        q = replace(q, order=())
        found: dict[tuple, Row] = {}
        schema = self._found(q, groups.rounds(q, asked) if groups else [(q, asked)], found)
        if groups is not None and groups.verify and (missing := [k for k in asked if k not in found]):
            self._found(q, [(groups.everything(q), missing)], found)
        there = [k for k in asked if k in found]
        models = self._finish(q, [found[k] for k in there], schema)
        return dict(zip([k if len(k) > 1 else k[0] for k in there], models, strict=True))

    def _found(self, q: Query, rounds: list[tuple[Query, list[tuple]]], found: dict[tuple, Row]) -> T.StructType:
        """Rows of all rounds, in one plan, into ``found`` by key; gives the schema of the items."""
        frames = []
        for part, keys in rounds:
            c = self.compiled(part)
            frames.append(self._with_keys(c, keys).select(*(F.col(f"`{n}`") for n in c.names), *(F.col(k) for k in c.key)))
        rows = reduce(DataFrame.unionAll, frames)
        make = Row(*c.names)
        for r in rows.collect():
            k = tuple(r[x] for x in c.key)
            if k in found:
                raise Refused(Code.DUPLICATE_KEY, str(k))
            found[k] = make(*(r[n] for n in c.names))
        return T.StructType([rows.schema[n] for n in c.names])

    def _with_keys(self, c: Compiled, asked: list[tuple]) -> DataFrame:
        fields = [c.frame.schema[k] for k in c.key]
        keys = self.catalog.spark.createDataFrame(asked, T.StructType([T.StructField(f"__q{i}", f.dataType) for i, f in enumerate(fields)]))
        on = None
        for i, k in enumerate(c.key):
            term = F.col(k) == F.col(f"__q{i}")
            on = term if on is None else on & term
        return c.frame.join(F.broadcast(keys) if len(asked) <= BROADCAST_KEYS else keys, on, "left_semi")

    def count(self, q: Query) -> int:
        """Rows, or groups, that ``list`` would read; the order is dropped, and with it joins that only it reads."""
        return self.compiled(replace(q, order=())).frame.count()

    # pages
    def page(self, q: Query, offset: int, size: int, mode: str = "count") -> Page:
        if size < 1:
            raise Refused(Code.PAGE_SIZE, str(size))
        if offset < 0:
            raise Refused(Code.OFFSET, str(offset))
        if mode not in COUNT_MODES:
            raise Refused(Code.UNKNOWN_NAME, mode)
        if mode == "only_count":
            n = self.count(q)
            return Page([], n, offset + size < n)
        total, seen = None, Observation() if mode == "inline_count" else None
        if mode == "count":
            total = self.count(q)
            if offset >= total:
                return Page([], total, False)
        frame = self.page_frame(q, offset, size + (mode == "no_count"), seen)
        rows = frame.collect()
        if seen is not None:  # what the sort of the page has read: the rows are counted as they pass
            total = seen.get["n"]
        items = self._finish(q, rows, frame.schema)
        more = offset + size < total if total is not None else len(items) > size
        return Page(items[:size], total, more)

    def page_frame(self, q: Query, offset: int, size: int, seen: Observation | None = None) -> DataFrame:
        """Rows ``offset`` to ``offset + size`` in the query's order, ties by key; ``seen`` counts all of them (``n``)."""
        c = self.compiled(q)
        if seen is not None:
            c.frame = c.frame.observe(seen, F.count(F.lit(1)).alias("n"))
        if q.keys_first:
            if not q.key or q.grouped:
                raise Refused(Code.NEEDS_KEY, "keys first needs a key")
            keys = c.frame.orderBy(*c.ordering(True)).offset(offset).limit(size).select(*(F.col(k).alias(f"__f{i}") for i, k in enumerate(c.key)))
            rows = self.compiled(q)
            on = None
            for i, k in enumerate(rows.key):
                term = F.col(k) == F.col(f"__f{i}")
                on = term if on is None else on & term
            return rows.visible(rows.frame.join(F.broadcast(keys) if size <= BROADCAST_KEYS else keys, on, "left_semi").orderBy(*rows.ordering(True)))
        return c.visible(c.frame.orderBy(*c.ordering(True)).offset(offset).limit(size))

    def keyset(self, q: Query, size: int, after: str | None = None, before: str | None = None) -> KeysetPage:
        """A page next to a cursor, without an offset; cursors are of this query's order only."""
        k = Keyset(q, self.compiled(self._keyset_ready(q, size)))
        back = before is not None
        frame = k.compiled.frame
        cursor = before if back else after
        if cursor is not None:
            frame = frame.where(k.beyond(k.decode(cursor), back))
        rows = frame.orderBy(*k.ordering(back)).limit(size + 1).collect()
        more = len(rows) > size
        rows = rows[:size][::-1] if back else rows[:size]
        given = k.decode(cursor) if cursor is not None else None
        values = [k.values(r) for r in rows]
        if given is not None and given in values:
            raise Refused(Code.REPEATED_KEY, "the cursor's own row came again")
        if any(v is None and o.nulls is None for row in values[-1:] + values[:1] for v, (_, o) in zip(row, k.parts, strict=True)):
            raise Refused(Code.NULL_IN_KEYSET, "an order column is null and its order does not say where nulls go")
        names = k.compiled.names
        items = self._finish(q, [Row(*names)(*(r[n] for n in names)) for r in rows], T.StructType([frame.schema[n] for n in names]))
        has_next, has_previous = (cursor is not None, more) if back else (more, cursor is not None)
        return KeysetPage(items, k.encode(values[-1]) if rows and has_next else None, k.encode(values[0]) if rows and has_previous else None, has_next, has_previous)

    def keyset_frame(self, q: Query, size: int, values: list, back: bool = False) -> DataFrame:
        """The page after (before) order values, as a lazy frame."""
        k = Keyset(q, self.compiled(self._keyset_ready(q, size)))
        return k.compiled.visible(k.compiled.frame.where(k.beyond(values, back)).orderBy(*k.ordering(back)).limit(size))

    def _keyset_ready(self, q: Query, size: int) -> Query:
        if size < 1:
            raise Refused(Code.PAGE_SIZE, str(size))
        if q.grouped:
            raise Refused(Code.KEYSET_ON_GROUPS, "groups have no keyset")
        if not q.key:
            raise Refused(Code.NEEDS_KEY, "a keyset needs a key")
        if q.root.source is not None and not q.root.source.unique:
            raise Refused(Code.SOURCE_NOT_UNIQUE, q.root.source.name)
        if any(not isinstance(o.by, Col) for o in q.order):
            raise Refused(Code.EXPRESSION_KEYSET, "a keyset orders by columns")
        if any(x.table.many for i in q.items for x in columns(i)):
            raise Refused(Code.TO_MANY_SELECTION, "a keyset reads one row a key")
        return q

    # all rows
    def stream(self, q: Query, limit: int | None = None) -> Iterator:
        """Models one by one, a partition at a time on the driver."""
        if q.finisher is not None:
            raise Refused(Code.CUSTOMIZER, "a finisher needs whole lists")
        for r in self.frame(q, True, limit).toLocalIterator(prefetchPartitions=True):
            yield from self._rows_to_models(q, [r])

    def map(self, q: Query, make: Callable[[Any], tuple], schema: str) -> DataFrame:
        """A row of ``schema`` for each model, made of it by ``make`` on the executors: lazy, nothing is gathered."""
        if q.finisher is not None or q.enrichers:
            raise Refused(Code.CUSTOMIZER, "a finisher or an enricher needs whole lists")
        rows, into = self.frame(q), T.StructType.fromDDL(schema)
        return rows.mapInArrow(_made(q.mapper, make, rows.schema, into), into)

    def export(self, q: Query, sink: Callable[[Any], None], transform: Callable[[list], list] | None = None, size: int = 1000) -> int:
        """Every row once, in order, to ``sink``; ``transform`` gets pages of ``size``. Gives the number of items."""
        if size < 1:
            raise Refused(Code.PAGE_SIZE, str(size))
        c = self.compiled(q)
        rows = c.frame.orderBy(*c.ordering(True))
        make, schema = Row(*c.names), T.StructType([rows.schema[n] for n in c.names])
        once = bool(q.key) and not q.grouped and not any(x.table.many for i in q.items for x in columns(i))
        n, page, last = 0, [], None

        def flush() -> int:
            models = self._finish(q, page, schema)
            models = transform(models) if transform else models
            for m in models:
                sink(m)
            return len(models)

        for r in rows.toLocalIterator(prefetchPartitions=True):
            key = tuple(r[k] for k in c.key)
            if once and key == last:
                raise Refused(Code.REPEATED_KEY, str(key))
            last = key
            page.append(make(*(r[x] for x in c.names)))
            if len(page) == size:
                n += flush()
                page = []
        return n + (flush() if page else 0)

    def export_keyset(self, q: Query, sink: Callable[[Any], None], size: int = 1000, after: str | None = None) -> tuple[int, str | None]:
        """As ``export``, page by page with cursors, so that it can be taken up again; gives the last cursor."""
        n, cursor = 0, after
        while True:
            p = self.keyset(q, size, after=cursor)
            for m in p.items:
                sink(m)
            n += len(p.items)
            if not p.has_next:
                return n, cursor
            cursor = p.next_cursor

    # models
    def _models(self, q: Query, rows: DataFrame, most: int | None = None) -> list:
        """``most``: rows that there can be, if a limit says so."""
        if q.children and most is not None:
            return self._finish(q, rows.collect(), rows.schema)
        if q.children:
            rows = attach(self, q, rows)
        return self._rows_to_models(q, rows.collect())

    def _finish(self, q: Query, rows: list[Row], schema: T.StructType) -> list:
        """Models of rows that are here: their children are read by their keys."""
        if q.children and rows:
            at = "__at"
            here = self.catalog.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType([*schema.fields, T.StructField(at, T.LongType())]))
            full = attach(self, q, here, len(rows))
            names = [n for n in full.columns if n != at]
            rows = [Row(*names)(*(r[n] for n in names)) for r in sorted(full.collect(), key=lambda r: r[at])]
        return self._rows_to_models(q, rows)

    def _rows_to_models(self, q: Query, rows: list) -> list:
        rows = enriched(q, rows)
        out = [q.mapper(r) for r in rows] if q.mapper else rows
        return q.finisher(out) if q.finisher else out


def _made(mapper: Callable[[Row], Any] | None, make: Callable[[Any], tuple], given: T.StructType, into: T.StructType) -> Callable:
    """What ``map`` runs on batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, MAPPED_ROWS):
                rows = ArrowTableToRowsConversion.convert(pa.Table.from_batches([b.slice(at, MAPPED_ROWS)]), given)
                made = [make(mapper(r) if mapper else r) for r in rows]
                yield from LocalDataToArrowConversion.convert(made, into, False).to_batches()

    return run


def _tuple(k: Any) -> tuple:
    return tuple(k) if isinstance(k, (tuple, list)) else (k,)


class Keyset:
    """Order columns, then the key in the direction of the last of them; cursors and the predicate beyond one."""

    def __init__(self, q: Query, c: Compiled):
        self.compiled = c
        down = bool(c.order) and c.order[-1][1].down
        own = {o.by.name for _, o in c.order if o.by.table.identity == q.root.identity}
        self.parts = [*c.order, *((f"__k_{k}", Order(Col(q.root, k), down, "last")) for k in q.key if k not in own)]
        self.types = [c.frame.schema[n].dataType for n, _ in self.parts]
        if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in self.types):
            raise Refused(Code.FLOAT_KEYSET, "a keyset orders by exact values")
        text = json.dumps([[o.by.table.path, o.by.name, o.down, o.first, t.simpleString()] for (_, o), t in zip(self.parts, self.types, strict=True)])
        self.fingerprint = hashlib.sha256(text.encode()).hexdigest()[:16]

    def ordering(self, back: bool) -> list[Column]:
        return [ordered(F.col(n), o.reversed() if back else o) for n, o in self.parts]

    def values(self, row: Row) -> list:
        return [row[n] for n, _ in self.parts]

    def beyond(self, values: list, back: bool) -> Column:
        """Rows strictly after ``values``: equal up to some place and beyond there, nulls as the order has them."""
        out, same = F.lit(False), F.lit(True)
        for (n, o), v, t in zip(self.parts, values, self.types, strict=True):
            o = o.reversed() if back else o
            c, lit = F.col(n), F.lit(v).cast(t)
            if v is None:
                past = c.isNotNull() if o.first else F.lit(False)
            else:
                past = (c < lit) if o.down else (c > lit)
                past = past if o.first else past | c.isNull()
            out = out | (same & F.coalesce(past, F.lit(False)))
            same = same & c.eqNullSafe(lit)
        return out

    def encode(self, values: list) -> str:
        return base64.urlsafe_b64encode(json.dumps([self.fingerprint, [_packed(v) for v in values]]).encode()).decode()

    def decode(self, cursor: str) -> list:
        try:
            print_, values = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        except ValueError as e:
            raise Refused(Code.FOREIGN_CURSOR, "not a cursor") from e
        if print_ != self.fingerprint:
            raise Refused(Code.FOREIGN_CURSOR, "the cursor is of another order")
        return [_unpacked(v) for v in values]


def _packed(v: Any) -> Any:
    match v:
        case None | bool() | int() | str():
            return v
        case decimal.Decimal():
            return {"d": str(v)}
        case datetime.datetime():
            return {"t": v.isoformat()}
        case datetime.date():
            return {"a": v.isoformat()}
        case bytes() | bytearray():
            return {"b": base64.b64encode(bytes(v)).decode()}
    raise Refused(Code.UNBINDABLE, type(v).__name__)


def _unpacked(v: Any) -> Any:
    if not isinstance(v, dict):
        return v
    ((kind, text),) = v.items()
    return {"d": decimal.Decimal, "t": datetime.datetime.fromisoformat, "a": datetime.date.fromisoformat, "b": base64.b64decode}[kind](text)
