"""Definitions to DataFrames. The only module that makes columns of them; all but recursive sources stays lazy."""

from __future__ import annotations

import datetime
import itertools
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from skeinql.errors import Code, Refused
from skeinql.functions.expr import Aggregate, Apply, Blank, Case, Col, Correlated, Custom, Declared, Named, Order, Outer, Param, Scalar, TypeOf, Typed, Value, Window, walk
from skeinql.plans import filters as C
from skeinql.plans.query import Nested, Query, Source, bare, expressions, output_name
from skeinql.plans.schema import Table
from skeinql.sources.catalog import Catalog

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Values of an ``in`` that are literals of the plan; more are rows, and so many of them are broadcast.
LITERALS, BROADCAST_VALUES = 500, 100_000
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Compiled:
    """``frame`` has the items by name, then hidden columns; ``order`` names columns of it, ``key`` those that tell rows apart."""

    frame: DataFrame
    names: list[str]
    order: list[tuple[str, Order]]
    key: list[str]

    def ordering(self, stable: bool = False, reverse: bool = False) -> list[Column]:
        out = [ordered(F.col(n), o.reversed() if reverse else o) for n, o in self.order]
        down = bool(self.order) and self.order[-1][1].down
        taken = {n for n, _ in self.order}
        return out + [ordered(F.col(k), Order(None, down != reverse, "last")) for k in self.key if stable and k not in taken]

    def visible(self, frame: DataFrame | None = None) -> DataFrame:
        return (self.frame if frame is None else frame).select(*(F.col(f"`{n}`") for n in self.names))


def literal(v: Any) -> Column:
    """A value as a column; a datetime without a zone is one without a zone."""
    if isinstance(v, datetime.datetime) and v.tzinfo is None:
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(v)


def ordered(c: Column, o: Order) -> Column:
    if o.down:
        return c.desc_nulls_first() if o.first else c.desc_nulls_last()
    return c.asc_nulls_first() if o.first else c.asc_nulls_last()


def tables_of(*trees: Any) -> list[Table]:
    """Tables whose columns are read, sub-queries apart; a path's own tables are not among them."""
    out = []
    for t in trees:
        for x in expressions(t):
            if isinstance(x, (Col, TypeOf)) or isinstance(x, C.OfType):
                out.append(x.table)
            elif isinstance(x, Aggregate) and isinstance(x.of, Table):
                out.append(x.of)
            elif isinstance(x, (Correlated, C.ExistsSub)):
                out += [y.of.table for y in walk(x.sub.condition) if isinstance(y, Outer)]
            elif isinstance(x, C.ExistsPath):
                out.append(_anchor(x.table))
        if isinstance(t, Nested):
            out.append(t.table)
    return out


def _anchor(t: Table) -> Table:
    """Where a path leaves the query: the last table before its first to-many step, or before its last step."""
    chain = [t]
    while chain[0].parent is not None:
        chain.insert(0, chain[0].parent)
    for i, x in enumerate(chain[1:], 1):
        if x.many:
            return chain[i - 1]
    return chain[-2]


class Scope:
    """One statement: its joined frame, and the aliases of the tables in it."""

    def __init__(self, compiler: Compiler, root: Table, outer: Scope | None = None, filters: dict | None = None, root_frame: DataFrame | None = None):
        self.compiler, self.outer, self.filters = compiler, outer, filters or {}
        self.root = root.row
        self.aliases: dict[tuple, str] = {self.root.identity: compiler.alias()}
        self.known: dict[Any, Column] = {}
        self.frame = (root_frame if root_frame is not None else compiler.rows(self.root)).alias(self.aliases[self.root.identity])

    def at(self, table: Table, name: str) -> Column:
        return F.col(f"`{self.aliases[table.row.identity]}`.`{name}`")

    # joins
    def need(self, table: Table, weak: bool = False) -> None:
        """Joins a table, after what it hangs on; ``weak``: LEFT, whatever it was declared."""
        t = table.row
        if t.identity not in self.aliases:
            self.need(t.parent, weak)
            self._join(t, "left" if weak else t.kind)
        if table.treated is not None:
            self._subtype(table)

    def _join(self, t: Table, kind: str) -> None:
        c = self.compiler
        right, alias = c.rows(t), c.alias()
        if t.way in ("source", "entity"):
            for x in (p for _, p in (*t.pairs, *t.when)):
                for y in tables_of(x) if isinstance(x, Scalar) else ():
                    self.need(y)
            for x, _ in t.when:
                for y in tables_of(x):
                    self.need(y)
            self.aliases[t.identity] = alias
            condition = _all([self.at(t, n) == self.column(x) for n, x in t.pairs] + [self.column(x) == F.lit(v) for x, v in t.when])
        else:
            relation = t.parent.entity.relation(t.way)
            pairs, left = relation.on, self.aliases[t.parent.row.identity]
            if relation.through:
                name, to_link, to_target = relation.through
                link = c.alias()
                self.frame = self.frame.join(c.catalog.frame(name).alias(link), _pairs(left, link, to_link), kind)
                pairs, left = to_target, link
            self.aliases[t.identity] = alias
            condition = _pairs(left, alias, pairs)
        if t.on_filter is not None:
            condition = condition & self.condition(C.conditions(t.on_filter))
        right = right.alias(alias)
        if t.identity in self.filters and kind == "left":
            condition = condition & self.condition(self.filters[t.identity])
        self.frame = self.frame.join(right, condition, kind)

    def _subtype(self, table: Table) -> None:
        """The table of a subtype's own columns, if it has one."""
        sub = next(s for s in table.entity.subtypes if s.name == table.treated)
        key = (*table.row.identity, ("treat", sub.name))
        if sub.table and key not in self.aliases:
            self.aliases[key] = alias = self.compiler.alias()
            on = _all([self.at(table, k) == F.col(f"`{alias}`.`{k}`") for k in table.entity.key])
            self.frame = self.frame.join(self.compiler.catalog.frame(sub.table).alias(alias), on, "left")

    # expressions
    def column(self, x: Any) -> Column:
        if x in self.known:
            return self.known[x]
        match x:
            case Named():
                return self.column(x.of)
            case Col():
                return self._col(x)
            case Value():
                return literal(x.value)
            case Param():
                if x.name not in self.compiler.params:
                    raise Refused(Code.UNBOUND_PARAM, x.name)
                return literal(self.compiler.params[x.name])
            case Typed():
                return self.column(x.of).cast(x.type)
            case Declared():
                if (t := self.type_of(x.of)).simpleString() != x.type:
                    raise Refused(Code.TYPE_MISMATCH, f"{x.of.name} is {t.simpleString()}, not {x.type}")
                return self.column(x.of)
            case Apply():
                return self._apply(x)
            case Case():
                out = None
                for c, v in x.branches:
                    out = F.when(self.condition(c), self.column(v)) if out is None else out.when(self.condition(c), self.column(v))
                return out if x.last is None else out.otherwise(self.column(x.last))
            case Custom():
                return x.function(*map(self.column, x.args))
            case TypeOf():
                return self.at(x.table, x.table.entity.discriminator)
            case Outer():
                if self.outer is None:
                    raise Refused(Code.LIFT_TO_MANY, "an outer column without an outer query")
                return self.outer._col(x.of).outer()
            case Correlated():
                return self._correlated(x)
            case Window():
                raise Refused(Code.WINDOW, "window functions are for sources")
        raise Refused(Code.UNKNOWN_NAME, type(x).__name__)

    def _col(self, x: Col) -> Column:
        t = x.table
        if x in self.known:
            return self.known[x]
        if t.row.identity not in self.aliases:
            relation = t.parent.entity.relation(t.way) if t.parent is not None and t.parent.entity and t.way not in ("source", "entity") else None
            back = {theirs: own for own, theirs in relation.on} if relation and not relation.many and not relation.through and t.on_filter is None and t.identity not in self.filters else {}
            if t.kind == "left" and t.parent.row.identity in self.aliases and x.name in back and x.name in t.entity.key and self.compiler.trusted:
                return self.at(t.parent, back[x.name])  # a foreign key holds the key that is read
            self.need(t)
        if t.treated is None:
            return self.at(t, x.name)
        self.need(t)
        sub = next(s for s in t.entity.subtypes if s.name == t.treated)
        alias = self.aliases.get((*t.row.identity, ("treat", sub.name)))
        own = alias and x.name in self.compiler.catalog.frame(sub.table).columns and x.name not in t.entity.key
        column = F.col(f"`{alias}`.`{x.name}`") if own else self.at(t, x.name)
        return F.when(self.at(t, t.entity.discriminator).isin(t.entity.values(t.treated)), column)

    def type_of(self, x: Any) -> T.DataType | None:
        """The Spark type of an expression without sub-queries, else None."""
        if any(isinstance(y, (Correlated, Outer)) for y in walk(x)):
            return None
        return self.frame.select(self.column(x).alias("x")).schema[0].dataType

    def _apply(self, x: Apply) -> Column:
        a = [self.column(p) for p in x.args]
        match x.op:
            case "coalesce":
                return F.coalesce(*a)
            case "null_if":
                return F.nullif(*a)
            case "plus":
                return a[0] + a[1]
            case "minus":
                return a[0] - a[1]
            case "times":
                return a[0] * a[1]
            case "divided_by":
                if all(isinstance(self.type_of(p), _INTEGRAL) for p in x.args):
                    raise Refused(Code.INTEGRAL_DIVISION, "two integral operands")
                return a[0] / a[1]
            case "negate":
                return -a[0]
            case "round":
                t = self.type_of(x.args[0])
                return F.round(a[0] if isinstance(t, T.DecimalType) else a[0].cast(f"decimal(38,{min(18, x.extra + 8)})"), x.extra)
            case "concat":
                return F.concat(*(c.cast("string") for c in a))
            case "function":
                return F.call_function(x.extra, *a)
        raise Refused(Code.BAD_FUNCTION, x.op)

    def _correlated(self, x: Correlated) -> Column:
        inner = Scope(self.compiler, x.sub.table, self)
        value = x.value if x.value is not None else x.sub.column
        inner.need_all(*([value] if value is not None else []), *(o.by for o in x.order))
        rows = inner.filtered(x.sub.condition)
        if x.kind == "first":
            order = [ordered(inner.column(o.by), o) for o in x.order] + [inner.at(x.sub.table, k).asc_nulls_last() for k in x.sub.table.key]
            return rows.orderBy(*order).limit(1).select(inner.column(value)).scalar()
        return rows.select(inner.total(x, value)).scalar()

    def total(self, x: Correlated, value: Scalar | None) -> Column:
        """The aggregate of a correlated value, in the sub-query's own scope."""
        n = F.count(F.lit(1))
        return n if x.kind == "count" else n > 0 if x.kind == "exists" else getattr(F, x.kind)(self.column(value))

    def share_subqueries(self, *trees: Any) -> None:
        """Correlated values over the same rows are one struct of one sub-query, so that those rows are read once."""
        over: dict[Any, list[Correlated]] = {}
        for t in trees:
            for x in expressions(t):
                if isinstance(x, Correlated) and x.kind != "first" and x not in over.setdefault(x.sub, []):
                    over[x.sub].append(x)
        for i, (s, xs) in enumerate((s, xs) for s, xs in over.items() if len(xs) > 1):
            inner = Scope(self.compiler, s.table, self)
            values = [x.value if x.value is not None else s.column for x in xs]
            inner.need_all(*(v for v in values if v is not None))
            rows = inner.filtered(s.condition)
            made = F.struct(*(inner.total(x, v).alias(f"v{j}") for j, (x, v) in enumerate(zip(xs, values, strict=True))))
            self.frame = self.frame.withColumn(f"__s{i}", rows.select(made).scalar())
            for j, x in enumerate(xs):
                found = F.col(f"__s{i}.v{j}")
                self.known[x] = F.coalesce(found, F.lit(0 if x.kind == "count" else False)) if x.kind in ("count", "exists") else found

    def need_all(self, *trees: Any, weak: bool = False) -> None:
        for t in tables_of(*trees):
            self.need(t, weak)

    def filtered(self, c: C.All) -> DataFrame:
        """The frame with rows that pass; joins of terms first, those of groups and negations LEFT."""
        for term in c.terms:
            self.need_all(term, weak=isinstance(term, (C.Any_, C.Not)))
        return self.frame.where(self.condition(c)) if c.terms else self.frame

    # conditions
    def condition(self, c: Any) -> Column:
        match c:
            case C.All():
                return _all([self.condition(t) for t in c.terms])
            case C.Any_():
                out = F.lit(False)
                for b in c.branches:
                    out = out | self.condition(b)
                return out
            case C.Not():
                return ~self.condition(c.of)
            case C.Never():
                return F.lit(False)
            case C.Compare():
                a, b = self.column(c.left), self.column(c.right)
                return {"eq": lambda: a == b, "ne": lambda: a != b, "gt": lambda: a > b, "gte": lambda: a >= b, "lt": lambda: a < b, "lte": lambda: a <= b, "same": lambda: a.eqNullSafe(b), "differs": lambda: ~a.eqNullSafe(b)}[c.op]()
            case C.IsNull():
                return self.column(c.of).isNull() if c.null else self.column(c.of).isNotNull()
            case C.IsIn():
                if len(c.values) > LITERALS and all(isinstance(v, Value) for v in c.values):
                    return self._in_many(c)
                return self.column(c.of).isin(*map(self.column, c.values))
            case C.Like():
                return self._like(c)
            case C.Fits():
                return self.column(c.test)
            case C.OfType():
                values = [v for t in c.types for v in c.table.entity.values(t)]
                at = self.at(c.table, c.table.entity.discriminator)
                return at.isin(values) if c.inside else ~at.isin(values) | at.isNull()
            case C.InSub():
                return self._in_sub(c)
            case C.ExistsPath():
                return self._path(c)
            case C.ExistsSub():
                found = Scope(self.compiler, c.sub.table, self).filtered(c.sub.condition).select(F.lit(1).alias("one")).exists()
                return found if c.there else ~found
        raise Refused(Code.UNKNOWN_NAME, type(c).__name__)

    def _in_many(self, c: C.IsIn) -> Column:
        """A long list as rows: a semi-join, broadcast up to BROADCAST_VALUES; null stays null, as of a list."""
        values = list(dict.fromkeys(v.value for v in c.values))
        rows = self.compiler.catalog.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("__v", self.type_of(c.of) or T.StringType())]))
        rows = F.broadcast(rows) if len(values) <= BROADCAST_VALUES else rows
        found = rows.where(F.col("__v") == self.outer_of(c.of)).select(F.lit(1).alias("one")).exists()
        return F.when(self.column(c.of).isNotNull(), found)

    def _like(self, c: C.Like) -> Column:
        of, text = self.column(c.of), c.text
        if c.fold:
            of, text = F.lower(of), text.lower()
        if c.mode == "exact":
            return of.like(text)
        return {"contains": of.contains, "starts": of.startswith, "ends": of.endswith, "equal": lambda t: of == t}[c.mode](text)

    def _in_sub(self, c: C.InSub) -> Column:
        inner = Scope(self.compiler, c.sub.table, self)
        inner.need_all(c.sub.column)
        rows = inner.filtered(c.sub.condition)
        of, value = self.column(c.of), inner.column(c.sub.column)
        outer = self.outer_of(c.of)
        found = rows.where(value == outer).select(F.lit(1).alias("one")).exists()
        return found if c.inside else ~found | of.isNull()

    def outer_of(self, x: Scalar) -> Column:
        """An expression of this scope as a sub-query of it sees it."""

        class Lifting(Scope):
            def __init__(inner, scope):
                inner.__dict__.update(scope.__dict__)
                inner.known = {}

            def _col(inner, y):
                return Scope._col(inner, y).outer()

        return Lifting(self).column(x)

    def _path(self, c: C.ExistsPath) -> Column:
        anchor = _anchor(c.table)
        step = c.table
        while step.parent.identity != anchor.identity:
            step = step.parent
        relation = anchor.entity.relation(step.way)
        inner = Scope(self.compiler, step, self)
        own = self.aliases[anchor.row.identity]
        frame, pairs, left = inner.frame, relation.on, own
        if relation.through:
            name, to_link, to_target = relation.through
            link = self.compiler.alias()
            frame = frame.join(self.compiler.catalog.frame(name).alias(link), _pairs(link, inner.aliases[step.row.identity], to_target), "inner")
            pairs = tuple((a, b) for a, b in to_link)
            condition = _pairs(own, link, pairs, True)
        else:
            condition = _pairs(left, inner.aliases[step.row.identity], pairs, True)
        inner.frame = frame
        inner.need(c.table)
        if step.on_filter is not None:
            condition = condition & inner.condition(C.conditions(step.on_filter))
        rows = inner.filtered(c.inner)
        found = rows.where(condition).select(F.lit(1).alias("one")).exists()
        return found if c.there else ~found


def _all(cs: list[Column]) -> Column:
    out = None
    for c in cs:
        out = c if out is None else out & c
    return F.lit(True) if out is None else out


def _side(alias: str, text: str) -> Column:
    m = re.fullmatch(r"(\w+)\((\w+)\)", text)
    return F.call_function(m[1], F.col(f"`{alias}`.`{m[2]}`")) if m else F.col(f"`{alias}`.`{text}`")


def _pairs(left: str, right: str, pairs: tuple, lift: bool = False) -> Column:
    return _all([(_side(left, a).outer() if lift and "(" not in a else _side(left, a)) == _side(right, b) for a, b in pairs])


class Compiler:
    """Compiles definitions against a catalog. ``trusted``: foreign keys hold, so that a joined key can be read without the join."""

    def __init__(self, catalog: Catalog, params: dict[str, Any] | None = None, trusted: bool = False):
        self.catalog, self.params, self.trusted = catalog, dict(params or {}), trusted
        self._n = itertools.count()
        self._sources: dict[int, DataFrame] = {}

    def alias(self) -> str:
        return f"t{next(self._n)}"

    def rows(self, t: Table) -> DataFrame:
        return self.source(t.source) if t.source is not None else self.catalog.frame(t.entity.name)

    # queries
    def query(self, q: Query, windows: bool = False, narrowed: DataFrame | None = None) -> Compiled:
        """``narrowed``: instead of the root's rows."""
        self.params |= dict(q.params)
        for o in q.order:
            if isinstance(o.by, Col) and o.by.table.entity is not None and o.by.table.treated is None and o.by.name not in self.rows(o.by.table).columns:
                raise Refused(Code.UNKNOWN_SORT, o.by.name)
        scope = Scope(self, q.root, None, dict(q.join_filters), narrowed)
        plain = [x for i in q.items for x in ([i] if isinstance(i, Nested) else [bare(i)])]
        strong = [*plain, *(o.by for o in q.order), *(q.group or ())]
        scope.need_all(*_outside_aggregate_filters(strong))
        used = {t.row.identity for t in tables_of(*strong)}
        moved = self._filter_only_many(q, used)
        stay = C.All(tuple(t for t in q.condition.terms if t not in moved))
        frame = scope.filtered(stay)
        scope.need_all(*(x.condition for s in (*strong, q.having_) for x in expressions(s) if isinstance(x, Aggregate) and x.condition is not None), weak=True)
        if scope.frame is not frame and stay.terms:
            frame = scope.frame.where(scope.condition(stay))
        elif not stay.terms:
            frame = scope.frame
        if moved:
            frame = self._semi_join(q, scope, frame, moved)
        scope.frame = frame
        out = self._grouped(q, scope) if q.grouped else self._flat(q, scope, windows)
        if q.customizer is not None:
            changed = q.customizer(out.frame)
            if changed.schema != out.frame.schema:
                raise Refused(Code.CUSTOMIZER, "a customizer changed the columns")
            out.frame = changed
        return out

    def _filter_only_many(self, q: Query, used: set) -> list:
        """The terms to move to a semi-join: if one reads a to-many join that nothing else does, all that join."""
        joining = [t for t in q.condition.terms if any(x.row.identity != q.root.identity for x in tables_of(t))]
        if any(x.many and x.row.identity not in used for t in joining for x in tables_of(t)):
            if not q.root.key:
                raise Refused(Code.NEEDS_KEY, "a filter on a to-many join needs the root's key")
            return joining
        return []

    def _semi_join(self, q: Query, scope: Scope, frame: DataFrame, moved: list) -> DataFrame:
        inner = Scope(self, q.root, None, dict(q.join_filters))
        rows = inner.filtered(C.All(tuple(moved)))
        keys = rows.select(*(inner.at(q.root, k).alias(f"__s_{k}") for k in q.root.key))
        return frame.join(keys, _all([scope.at(q.root, k) == F.col(f"__s_{k}") for k in q.root.key]), "left_semi")

    def _flat(self, q: Query, scope: Scope, windows: bool) -> Compiled:
        columns, key = [], []
        calls = {x: f"__w{i}" for i, x in enumerate(dict.fromkeys(x for item in q.items for x in expressions(item) if isinstance(x, Window)))}
        if calls:
            source_key = [scope.at(q.root, k) for k in q.root.key]
            for x, name in calls.items():
                scope.frame = scope.frame.withColumn(name, self._window(x, scope, source_key))
                scope.known[x] = F.col(name)
        scope.share_subqueries(*q.items, *(o.by for o in q.order))
        for item in q.items:
            columns.append(self._nested(item, scope) if isinstance(item, Nested) else scope.column(item).alias(output_name(item)))
        order = []
        for i, o in enumerate(q.order):
            columns.append(scope.column(o.by).alias(f"__o{i}"))
            order.append((f"__o{i}", o))
        for k in q.root.key:
            columns.append(scope.at(q.root, k).alias(f"__k_{k}"))
            key.append(f"__k_{k}")
        return Compiled(scope.frame.select(*columns), q.names, order, key or list(q.names))

    def _nested(self, n: Nested, scope: Scope) -> Column:
        scope.need(n.table)
        inner = F.struct(*((self._nested(i, scope) if isinstance(i, Nested) else scope.column(i)).alias(output_name(i)) for i in n.items))
        presence = _all([scope.at(n.table, k).isNotNull() for k in n.table.key])
        return F.when(presence, inner).alias(n.name)

    # groups
    def _grouped(self, q: Query, scope: Scope) -> Compiled:
        keys = {k: f"__g{i}" for i, k in enumerate(dict.fromkeys(q.group or ()))}
        trees = [*(bare(i) for i in q.items), *(o.by for o in q.order), q.having_]
        wanted = {a: f"__a{i}" for i, a in enumerate(dict.fromkeys(x for t in trees for x in expressions(t) if isinstance(x, Aggregate)))}
        by = [scope.column(k).alias(n) for k, n in keys.items()]
        frame, made = scope.frame, []
        for a, n in wanted.items():
            if a.kind == "first_by":
                frame, column = self._first_by(a, n, scope, frame, list(keys))
                made.append(column.alias(n))
            else:
                made.append(self.aggregate(a, scope).alias(n))
        made = made or [F.count(F.lit(1)).alias("__a")]
        frame = frame.groupBy(*by).agg(*made) if by else frame.agg(*made)
        out = Scope.__new__(Scope)
        out.compiler, out.outer, out.filters, out.root, out.aliases, out.frame = self, None, {}, scope.root, {}, frame
        out.known = {k: F.col(n) for k, n in keys.items()} | {a: F.col(n) for a, n in wanted.items()}
        for x in (x for i in q.items for x in walk(bare(i)) if isinstance(x, Blank)):
            out.known[x] = F.lit(None).cast(self.rows(x.of.table.row).schema[x.of.name].dataType)
        if q.having_.terms:
            out.frame = out.frame.where(out.condition(q.having_))
        calls = dict.fromkeys(x for item in q.items for x in walk(bare(item)) if isinstance(x, Window))
        for i, x in enumerate(calls):
            out.frame = out.frame.withColumn(f"__w{i}", self._window(x, out, [F.col(n) for n in keys.values()]))
            out.known[x] = F.col(f"__w{i}")
        columns = [out.column(item).alias(output_name(item)) for item in q.items]
        order = []
        for i, o in enumerate(q.order):
            columns.append(out.column(o.by).alias(f"__o{i}"))
            order.append((f"__o{i}", o))
        return Compiled(out.frame.select(*columns, *(F.col(n) for n in keys.values())), q.names, order, list(keys.values()))

    def aggregate(self, a: Aggregate, scope: Scope) -> Column:
        passes = scope.condition(a.condition) if a.condition is not None else None

        def of(c: Column) -> Column:
            return c if passes is None else F.when(passes, c)

        if a.kind == "custom":
            return scope.column(a.of)
        if a.kind == "count" and isinstance(a.of, Table):
            if a.of.parent is None:
                return F.count(of(F.lit(1)))
            if not a.of.key:
                raise Refused(Code.NEEDS_KEY, "rows of a joined table are counted by its key")
            return F.count(of(scope.at(a.of, a.of.key[0])))
        c = scope.column(a.of)
        t = scope.type_of(a.of) if a.kind in ("sum", "sum_as_long", "avg_exact") else None
        match a.kind:
            case "count":
                return F.count(of(c))
            case "count_distinct":
                return F.count_distinct(of(c))
            case "min":
                return F.min(of(c))
            case "max":
                return F.max(of(c))
            case "avg":
                out = F.avg(of(c.cast("double")))
                return out if a.scale is None else F.round(out.cast("decimal(38,10)"), a.scale)
            case "sum_as_long":
                if not isinstance(t, _INTEGRAL):
                    raise Refused(Code.SUM_TYPE, str(t))
                return F.sum(of(c.cast("long")))
            case "sum":
                if not isinstance(t, (T.DecimalType, T.DoubleType, T.LongType)):
                    raise Refused(Code.SUM_TYPE, str(t))
                out = F.sum(of(c)).cast(a.type or (t if not isinstance(t, T.DecimalType) else T.DecimalType(38, t.scale)))
                return out if a.scale is None else F.round(out.cast("decimal(38,10)") if isinstance(t, T.DoubleType) else out, a.scale)
            case "avg_exact":
                if not isinstance(t, (T.DecimalType, *_INTEGRAL)):
                    raise Refused(Code.EXACT_AVERAGE, f"of {t}")
                d = c if isinstance(t, T.DecimalType) else c.cast("decimal(19,0)")
                out = (F.sum(of(d)) / F.nullif(F.count(of(d)), F.lit(0))).cast(a.type)
                return out if a.scale is None else F.round(out, a.scale)
        raise Refused(Code.UNKNOWN_NAME, a.kind)

    def _first_by(self, a: Aggregate, name: str, scope: Scope, frame: DataFrame, keys: list) -> tuple[DataFrame, Column]:
        """The first row's value: the least struct of ranks, which combines before the shuffle; where an order can't be negated, a window."""
        value = F.struct(scope.column(a.of).alias("v"))
        passes = scope.condition(a.condition) if a.condition is not None else F.lit(True)
        root_key = [scope.at(scope.root, k) for k in scope.root.key]
        parts, plain = [], True
        for o in a.order:
            c, t = scope.column(o.by), scope.type_of(o.by)
            parts.append(F.when(c.isNull(), 0 if o.first else 2).otherwise(1))
            if not o.down:
                parts.append(c)
            elif isinstance(t, _NUMERIC):
                parts.append(-(c.cast("decimal(20,0)") if isinstance(t, _INTEGRAL) else c))
            elif isinstance(t, (T.DateType,)):
                parts.append(-F.unix_date(c))
            elif isinstance(t, T.TimestampType):
                parts.append(-F.unix_micros(c))
            elif isinstance(t, T.TimestampNTZType):
                parts.append(literal(datetime.datetime(1970, 1, 1)) - c)  # an interval, which no zone's clock changes bend
            else:
                plain = False
        if plain:
            rank = F.struct(*(p.alias(f"p{i}") for i, p in enumerate([*parts, *root_key])))
            return frame, F.min_by(F.when(passes, value), F.when(passes, rank))["v"]
        w = W.partitionBy(*(scope.column(k) for k in keys)).orderBy((~passes).asc(), *(ordered(scope.column(o.by), o) for o in a.order), *(k.asc() for k in root_key))
        frame = frame.withColumn(f"{name}_r", F.row_number().over(w))
        return frame, F.first(F.when((F.col(f"{name}_r") == 1) & passes, value), ignorenulls=True)["v"]

    # windows
    def _window(self, x: Window, scope: Scope, key: list[Column]) -> Column:
        order = [ordered(scope.column(o.by), o) for o in x.order]
        if order and (x.kind in ("row_number", "lag", "lead", "first_value", "last_value") or x.frame.startswith("rows")):
            order += [k.asc_nulls_last() for k in key]
        w = W.partitionBy(*(scope.column(p) for p in x.partition))
        w = w.orderBy(*order) if order else w
        first, here, last = W.unboundedPreceding, W.currentRow, W.unboundedFollowing
        match x.frame:
            case "rows_to_current":
                w = w.rowsBetween(first, here)
            case "rows_all":
                w = w.rowsBetween(first, last)
            case "rows_from_current":
                w = w.rowsBetween(here, last)
            case "range_to_current":
                w = w.rangeBetween(first, here)
            case "range_all":
                w = w.rangeBetween(first, last)
        of = scope.column(x.of) if x.of is not None else F.lit(1)
        call = {
            "row_number": lambda: F.row_number(), "rank": lambda: F.rank(), "dense_rank": lambda: F.dense_rank(), "lag": lambda: F.lag(of), "lead": lambda: F.lead(of), "first_value": lambda: F.first(of),
            "last_value": lambda: F.last(of), "sum": lambda: F.sum(of), "avg": lambda: F.avg(of.cast("double")), "min": lambda: F.min(of), "max": lambda: F.max(of), "count": lambda: F.count(of),
        }[x.kind]()
        out = call.over(w)
        return out.cast("long") if x.kind in ("row_number", "rank", "dense_rank") else out

    # sources
    def source(self, s: Source) -> DataFrame:
        if id(s) not in self._sources:
            if s.recursion is not None:
                from skeinql.sources.recursion import walked

                self._sources[id(s)] = walked(self, s)
            else:
                out = self._body(s)
                for op, other in s.operations:
                    right = self.source(other)
                    if [f.dataType for f in out.schema] != [f.dataType for f in right.schema]:
                        raise Refused(Code.SHAPE, f"{out.schema.simpleString()} and {right.schema.simpleString()}")
                    out = {"union": lambda a, b: a.union(b).distinct(), "union_all": lambda a, b: a.unionAll(b), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}[op](out, right)
                self._sources[id(s)] = out
        return self._sources[id(s)]

    def _body(self, s: Source) -> DataFrame:
        c = self.query(s.query, windows=True)
        return c.visible()


def _outside_aggregate_filters(trees: list) -> list:
    """Trees whose joins are strong: aggregates count by what they are of and ordered by, not by their filters."""
    out = []
    for t in trees:
        for x in expressions(t):
            if isinstance(x, Aggregate):
                out += [x.of if isinstance(x.of, Scalar) else Aggregate("count", x.of), *(o.by for o in x.order)]
        if isinstance(t, Nested) or not any(isinstance(x, Aggregate) for x in expressions(t)):
            out.append(t)
        else:
            out += [x for x in expressions(t) if isinstance(x, Col) and not any(isinstance(a, Aggregate) and x in set(walk(a)) for a in expressions(t))]
    return out
