"""Bulk writes as frames: what a table's rows are after an update, a delete, an insert or an upsert.

Files have no in-place change, so each verb gives the new rows (lazily) and those affected; ``swap`` writes them to a
new place. One pass over the table and at most one join; nothing is locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinql.errors import Code, Refused
from skeinql.functions.expr import Col, Scalar, lifted
from skeinql.operators.engine import Engine
from skeinql.plans.compiler import Compiler, Scope, literal
from skeinql.plans.filters import All, conditions
from skeinql.plans.query import Query
from skeinql.plans.schema import Table
from skeinql.sources.scratch import folder

MARK = "__written"
#: Columns of a table that committed chunks have put in key order: whether the write has chosen a row, and its file's range.
CHOSEN, RANGE = "__chosen", "__range"
#: Committed steps that are written at a time.
STEPS_AHEAD = 64
#: New rows up to which an upsert broadcasts them; they are counted before.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Chosen:
    """Rows of a table: by filter, by keys, or all."""

    root: Table
    condition: All = All(())
    keys: tuple[tuple, ...] | None = None
    everything: bool = False

    def where(self, build: Callable):
        return replace(self, condition=All((*self.condition.terms, *conditions(build).terms)))

    def where_keys(self, *keys: Any):
        return replace(self, keys=tuple(k if isinstance(k, tuple) else (k,) for k in keys))

    def all(self):
        return replace(self, everything=True)

    def _checked(self) -> None:
        if not (self.condition.terms or self.keys is not None or self.everything):
            raise Refused(Code.EMPTY_WRITE_FILTER, "no rows are chosen; say .all() for all")


@dataclass(frozen=True)
class Update(Chosen):
    assigned: tuple[tuple[str, Any], ...] = ()
    keep_version_: bool = False
    expected: Any = None

    def set(self, column: str, value: Any) -> Update:
        """A value or an expression; None is for ``set_null``."""
        if value is None:
            raise Refused(Code.NULL_ASSIGNED, column)
        return self._assign(column, lifted(value))

    def set_null(self, column: str) -> Update:
        return self._assign(column, None)

    def default(self, column: str, make: Callable[[], Any]) -> Update:
        """A write assignment: a value, made now, for a column that nothing else sets."""
        return self if any(c == column for c, _ in self.assigned) else self.set(column, make())

    def changes(self, changed: dict[str, Any]) -> Update:
        """A change set: only the columns that were written, None for null."""
        out = self
        for k, v in changed.items():
            out = out.set_null(k) if v is None else out.set(k, v)
        return out

    def keep_version(self) -> Update:
        return replace(self, keep_version_=True)

    def expect_version(self, version: Any) -> Update:
        return replace(self, expected=version)

    def _assign(self, column: str, value: Any) -> Update:
        if any(c == column for c, _ in self.assigned):
            raise Refused(Code.ASSIGNED_TWICE, column)
        if column in self.root.key or column == self.root.entity.version:
            raise Refused(Code.KEY_ASSIGNED, column)
        return replace(self, assigned=(*self.assigned, (column, value)))


@dataclass(frozen=True)
class Delete(Chosen):
    pass


@dataclass(frozen=True)
class Conflict:
    """What to do with a row whose ``columns`` equal those of a row there: nothing, or update some columns."""

    columns: tuple[str, ...]
    arbiter: Callable | None = None
    updates: tuple[tuple[str, Any], ...] | None = None
    condition: Callable | None = None

    def where_arbiter(self, build: Callable) -> Conflict:
        """Only existing rows that pass are in conflict, as under a partial unique index."""
        return replace(self, arbiter=build)

    def do_nothing(self) -> Conflict:
        return replace(self, updates=())

    def do_update(self) -> Conflict:
        return replace(self, updates=self.updates or ())

    def set_from_row(self, *columns: str) -> Conflict:
        return self._set(*((c, ("row", c)) for c in columns))

    def set(self, column: str, value: Any) -> Conflict:
        """A value, or a function of (column of the row there, column of the new row) that gives a column."""
        if value is None:
            raise Refused(Code.NULL_ASSIGNED, column)
        return self._set((column, value))

    def set_null(self, column: str) -> Conflict:
        return self._set((column, None))

    def where(self, test: Callable[[Callable, Callable], Column]) -> Conflict:
        """Update only where the function of (there, new) holds; each gives a column by name."""
        return replace(self, condition=test)

    def _set(self, *pairs: tuple[str, Any]) -> Conflict:
        names = [c for c, _ in (*(self.updates or ()), *pairs)]
        if len(set(names)) != len(names):
            raise Refused(Code.ASSIGNED_TWICE, str(names))
        if set(names) & set(self.columns):
            raise Refused(Code.KEY_ASSIGNED, str(names))
        return replace(self, updates=(*(self.updates or ()), *pairs))


@dataclass(frozen=True)
class Insert:
    """Rows of a query, or given ones, as rows of an entity's table."""

    root: Table
    query: Query | None = None
    rows: tuple[dict, ...] | None = None
    mapping: tuple[tuple[str, str], ...] = ()
    constants: tuple[tuple[str, Any], ...] = ()
    conflict: Conflict | None = None
    defaults: tuple[tuple[str, Callable[[], Any]], ...] = field(default=())

    def map(self, column: str, item: str) -> Insert:
        """Column of the table from an item of the query."""
        self._free(column)
        return replace(self, mapping=(*self.mapping, (column, item)))

    def set(self, column: str, value: Any) -> Insert:
        self._free(column)
        return replace(self, constants=(*self.constants, (column, value)))

    def default(self, column: str, make: Callable[[], Any]) -> Insert:
        """A write assignment: a value for a column that nothing else sets, made when the insert runs."""
        return replace(self, defaults=(*self.defaults, (column, make)))

    def on_conflict(self, conflict: Conflict) -> Insert:
        if conflict.updates is None:
            raise Refused(Code.CONFLICT_CLAUSE, "say do_nothing() or what to update")
        return replace(self, conflict=conflict)

    def _free(self, column: str) -> None:
        if column in [c for c, _ in (*self.mapping, *self.constants)]:
            raise Refused(Code.ASSIGNED_TWICE, column)


@dataclass
class Written:
    """``after``: the table's rows after the write. ``affected``: the rows written or, of a delete, those that went."""

    after: DataFrame
    affected: DataFrame

    def count(self) -> int:
        return self.affected.count()

    def swap(self, path: str) -> DataFrame:
        """The table at a new place. The old files stay what earlier readers see."""
        self.after.write.mode("error").parquet(path)
        return self.after.sparkSession.read.parquet(path)


class Writer:
    def __init__(self, engine: Engine):
        self.engine, self.catalog = engine, engine.catalog

    # choosing
    def _marked(self, w: Chosen) -> tuple[Scope, DataFrame]:
        """The table's rows with a flag on the chosen ones; a filter that joins is a semi-join of keys."""
        w._checked()
        compiler = Compiler(self.catalog, {}, self.engine.trusted)
        scope = Scope(compiler, w.root)
        chosen = F.lit(True)
        if w.keys is not None:
            for k in w.keys:
                if len(k) != len(w.root.key):
                    raise Refused(Code.NEEDS_KEY, str(k))
            schema = [scope.frame.schema[k] for k in w.root.key]
            from pyspark.sql import types as T

            keys = self.catalog.spark.createDataFrame(list(dict.fromkeys(w.keys)), T.StructType([T.StructField(f"__q{i}", f.dataType) for i, f in enumerate(schema)])).withColumn("__q", F.lit(True))
            scope.frame = scope.frame.join(F.broadcast(keys) if len(w.keys) <= 100_000 else keys, _on([(scope.at(w.root, k), F.col(f"__q{i}")) for i, k in enumerate(w.root.key)]), "left")
            chosen = F.coalesce(F.col("__q"), F.lit(False))
        if w.condition.terms:
            if any(t.parent is not None for t in _tables(w.condition)):
                q = Query(w.root, tuple(Col(w.root, k).named(f"__m_{k}") for k in w.root.key), w.condition)
                found = compiler.query(q).visible().distinct().withColumn("__m", F.lit(True))
                scope.frame = scope.frame.join(found, _on([(scope.at(w.root, k), F.col(f"__m_{k}")) for k in w.root.key]), "left")
                chosen = chosen & F.coalesce(F.col("__m"), F.lit(False))
            else:
                chosen = chosen & F.coalesce(scope.condition(w.condition), F.lit(False))
        return scope, chosen

    def update(self, u: Update) -> Written:
        if not u.assigned:
            raise Refused(Code.EMPTY_WRITE_FILTER, "nothing is assigned")
        scope, chosen = self._marked(u)
        names = self.catalog.frame(u.root.entity.name).columns
        version = u.root.entity.version
        for c, _ in u.assigned:
            if c not in names:
                raise Refused(Code.UNKNOWN_NAME, c)
        if u.expected is not None:
            if version is None:
                raise Refused(Code.STALE_VERSION, "the entity has no version")
            stale = chosen & ~scope.at(u.root, version).eqNullSafe(F.lit(u.expected))
            chosen = F.when(stale, F.raise_error(F.lit(f"{Code.STALE_VERSION.value} {Code.STALE_VERSION.name}: a row has another version")).cast("boolean")).otherwise(chosen)
        new, types = dict(u.assigned), dict(self.catalog.frame(u.root.entity.name).dtypes)
        columns = []
        for n in names:
            old = scope.at(u.root, n)
            if n in new:
                value = F.lit(None).cast(types[n]) if new[n] is None else scope.column(new[n]).cast(types[n])
                columns.append(F.when(F.col(MARK), value).otherwise(old).alias(n))
            elif n == version and not u.keep_version_:
                columns.append(F.when(F.col(MARK), old + 1).otherwise(old).cast(types[n]).alias(n))
            else:
                columns.append(old.alias(n))
        out = scope.frame.withColumn(MARK, chosen).select(*columns, MARK)
        return Written(out.drop(MARK), out.where(MARK).drop(MARK))

    def delete(self, d: Delete) -> Written:
        scope, chosen = self._marked(d)
        names = self.catalog.frame(d.root.entity.name).columns
        out = scope.frame.withColumn(MARK, chosen).select(*(scope.at(d.root, n).alias(n) for n in names), MARK)
        return Written(out.where(~F.col(MARK)).drop(MARK), out.where(MARK).drop(MARK))

    def chunks(self, w: Update | Delete, size: int, start_after: Any = None, commit: bool = False) -> Iterator[tuple[Any, Written]]:
        """The write in steps of ``size`` keys in key order, for work that is taken up again: (last key, written).

        The rows are chosen once, from the table as it is when the first step begins. ``catalog.frames`` is set to what
        a step leaves: the table with the write on all keys so far, so that its plan is the same after each step. With
        ``commit`` the table is first written in key order, in the folder that executors share; the rows up to a step's
        last key are written there before the step is given, and the table is these and the rows beyond. Each row is
        read and written once, however many steps there are, and all of them see the table as it was before the first.
        Steps are written one, two, four and so on at a time; where that fails, one by one up to the step that fails.
        """
        w._checked()
        if len(w.root.key) != 1:
            raise Refused(Code.NEEDS_KEY, "chunks need a key of one column")
        if size < 1:
            raise Refused(Code.PAGE_SIZE, str(size))
        if commit:
            yield from self._committed(w, size, start_after)
            return
        key, last, name = w.root.key[0], start_after, w.root.entity.name
        first = now = self.catalog.frame(name)
        while True:
            self.catalog.frames[name] = first
            scope, chosen = self._marked(w)
            rows = scope.frame.where(chosen)
            if last is not None:
                rows = rows.where(scope.at(w.root, key) > F.lit(last))
            keys = [r[0] for r in rows.select(scope.at(w.root, key).alias("k")).orderBy("k").limit(size).collect()]
            if not keys:
                self.catalog.frames[name] = now
                return
            last = keys[-1]

            def upto(f: Any, high: Any = last) -> None:
                f.lte(Col(w.root, key), high)
                if start_after is not None:
                    f.gt(Col(w.root, key), start_after)

            affected = self._written(replace(w, condition=All(()), keys=tuple((k,) for k in keys), everything=False)).affected
            now = self._written(w.where(upto)).after
            self.catalog.frames[name] = now
            yield last, Written(now, affected)

    def _committed(self, w: Update | Delete, size: int, start_after: Any) -> Iterator[tuple[Any, Written]]:
        key, name, spark = w.root.key[0], w.root.entity.name, self.catalog.spark
        first = self.catalog.frame(name)
        names, kind, k = first.columns, first.schema[key].dataType, F.col(f"`{key}`")
        scope, chosen = self._marked(w)
        marked = scope.frame.withColumn(CHOSEN, chosen).select(*(scope.at(w.root, n).alias(n) for n in names), CHOSEN)
        marked = marked.repartitionByRange(k).withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(RANGE, k)
        place = folder(spark, f"{name}-before")
        marked.write.partitionBy(RANGE).parquet(place)
        before = spark.read.schema(marked.schema).parquet(place)
        ranges, ends = self._ends(before, k, size, None if start_after is None else k > literal(start_after).cast(kind))
        self.catalog.frames[name] = before
        try:
            flagged = replace(w, condition=All(()), keys=None, everything=False).where(lambda f: f.eq(Col(w.root, CHOSEN), True))
            written = self._written(flagged)
        finally:
            self.catalog.frames[name] = first

        def within(low: Any, high: Any) -> Column:
            here = [r for r, least, most in ranges if least <= high and (low is None or most > low)]
            step = F.col(RANGE).isin(here) & (k <= literal(high).cast(kind))
            return step if low is None else step & (k > literal(low).cast(kind))

        path, kept, done = folder(spark, f"{name}-step"), None, None
        at, ahead, most, low = 0, 1, STEPS_AHEAD, start_after
        while at < len(ends):
            steps = ends[at : at + ahead]
            after = written.after.where(within(low, steps[-1])).select(*names)
            try:
                after.write.mode("append").parquet(path)
            except Exception:
                if len(steps) == 1:
                    raise
                ahead = most = 1  # the steps before the one that fails are done, at a place that has nothing of this try
                path, kept = folder(spark, f"{name}-step"), done
                continue
            done = spark.read.schema(after.schema).parquet(path)
            done = done if kept is None else kept.unionByName(done)
            for high in steps:
                beyond = k.isNull() | (k > literal(high).cast(kind))
                if start_after is not None:
                    beyond = beyond | (k <= literal(start_after).cast(kind))
                now = done.where(k <= literal(high).cast(kind)).unionByName(before.where(beyond).select(*names))
                affected = written.affected.where(within(low, high)).select(*names)
                self.catalog.frames[name], low = now, high
                yield high, Written(now, affected)
            at, ahead = at + len(steps), min(2 * ahead, most)

    def _ends(self, before: DataFrame, k: Column, size: int, after: Column | None) -> tuple[list[tuple], list]:
        """Ranges with their least and greatest keys, and each ``size``-th chosen key and the last: counted a range."""
        counted = F.col(CHOSEN) & k.isNotNull() & (F.lit(True) if after is None else after)
        found = before.where(k.isNotNull()).groupBy(RANGE).agg(F.min(k), F.max(k), F.count_if(counted)).collect()
        found.sort(key=lambda r: r[1])
        total, starts = 0, []
        for r in found:
            starts.append((r[0], total))
            total += r[3]
        if not total:
            return [], []
        begun = self.catalog.spark.createDataFrame(starts, f"{RANGE} int, __start long")
        place = F.col("__start") + F.row_number().over(Window.partitionBy(RANGE).orderBy(k))
        ends = before.where(counted).join(F.broadcast(begun), RANGE).select(k.alias("k"), place.alias("n")).where((F.col("n") % size == 0) | (F.col("n") == total))
        return [tuple(r)[:3] for r in found], list(dict.fromkeys(r[0] for r in ends.orderBy("n").collect()))

    def _written(self, w: Update | Delete) -> Written:
        return self.update(w) if isinstance(w, Update) else self.delete(w)

    # inserting
    def incoming(self, i: Insert) -> DataFrame:
        """The rows to insert, in the table's columns; columns that nothing sets are null."""
        there = self.catalog.frame(i.root.entity.name)
        types = dict(there.dtypes)
        if i.query is not None:
            rows = self.engine.frame(i.query)
            given = {c: F.col(f"`{item}`") for c, item in i.mapping}
        else:
            if not i.rows:
                return there.limit(0)
            names = list(dict.fromkeys(k for r in i.rows for k in r))
            unknown = [n for n in names if n not in types]
            if unknown:
                raise Refused(Code.UNKNOWN_NAME, str(unknown))
            schema = type(there.schema)([there.schema[n] for n in names])
            for f in schema.fields:
                f.nullable = True
            rows = self.catalog.spark.createDataFrame([tuple(r.get(n) for n in names) for r in i.rows], schema)
            given = {n: F.col(f"`{n}`") for n in names}
        given |= {c: F.lit(v) for c, v in i.constants}
        for c, make in i.defaults:
            given.setdefault(c, F.lit(make()))
        unknown = [c for c in given if c not in types]
        if unknown:
            raise Refused(Code.UNKNOWN_NAME, str(unknown))
        return rows.select(*(given.get(n, F.lit(None)).cast(types[n]).alias(n) for n in there.columns))

    def insert(self, i: Insert) -> Written:
        """Appended rows; with a conflict clause, an upsert: few rows are broadcast, many meet the table in a full outer join."""
        there, new = self.catalog.frame(i.root.entity.name), self.incoming(i)
        if i.conflict is None:
            return Written(there.unionByName(new), new)
        c, names = i.conflict, there.columns
        if not c.columns or any(n not in names for n in c.columns):
            raise Refused(Code.CONFLICT_CLAUSE, str(c.columns))
        over = Window.partitionBy(*c.columns)
        null = F.lit(False)
        for k in c.columns:
            null = null | F.col(k).isNull()
        repeated = (F.count(F.lit(1)).over(over) > 1) & ~null
        if c.updates:
            new = new.withColumn("__twice", repeated)
            new = new.where(F.when(F.col("__twice"), F.raise_error(F.lit(f"{Code.SHARED_CONFLICT_KEY.value} {Code.SHARED_CONFLICT_KEY.name}: two rows share a conflict key")).cast("boolean")).otherwise(F.lit(True))).drop("__twice")
        else:  # the first of them is inserted, the others are then in conflict with it
            new = new.withColumn("__first", F.row_number().over(over.orderBy(*names))).where((F.col("__first") == 1) | null).drop("__first")
        arbiter = F.lit(True)
        if c.arbiter is not None:
            scope = Scope(Compiler(self.catalog), i.root)
            there = scope.frame.withColumn("__arbiter", F.coalesce(scope.condition(conditions(c.arbiter)), F.lit(False))).select(*(scope.at(i.root, n).alias(n) for n in names), "__arbiter")
        else:
            there = there.withColumn("__arbiter", arbiter)
        old = there.select(*(F.col(n).alias(f"__t_{n}") for n in names), "__arbiter", F.lit(True).alias("__there"))
        add = new.select(*(F.col(n).alias(f"__n_{n}") for n in names), F.lit(True).alias("__new"))
        on = _on([(F.col(f"__t_{k}"), F.col(f"__n_{k}")) for k in c.columns]) & F.col("__arbiter")
        if (i.rows is not None and len(i.rows) <= BROADCAST_ROWS) or (i.rows is None and new.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS):
            # few new rows go to the table, not the table to them: those that meet none there are added
            met = old.join(F.broadcast(add.drop("__new")), on).select(*(F.col(f"__n_{k}").alias(f"__m_{k}") for k in c.columns)).distinct()
            fresh = add.join(F.broadcast(met), _on([(F.col(f"__n_{k}"), F.col(f"__m_{k}")) for k in c.columns]), "left_anti")
            both = old.join(F.broadcast(add), on, "left").unionByName(fresh, allowMissingColumns=True)
        else:
            both = old.join(add, on, "full_outer")
        matched = F.col("__there").isNotNull() & F.col("__new").isNotNull()
        changes = dict(c.updates or ())
        if c.condition is not None:
            ok = F.coalesce(c.condition(lambda n: F.col(f"__t_{n}"), lambda n: F.col(f"__n_{n}")), F.lit(False))
        else:
            ok = F.lit(True)
        updated = matched & ok & F.lit(bool(changes))
        types = dict(new.dtypes)

        def value(n: str) -> Column:
            v = changes[n]
            if v is None:
                return F.lit(None).cast(types[n])
            if isinstance(v, tuple) and v[0] == "row":
                return F.col(f"__n_{v[1]}")
            return (v(F.col(f"__t_{n}"), F.col(f"__n_{n}")) if callable(v) and not isinstance(v, Scalar) else F.lit(v)).cast(types[n])

        version = i.root.entity.version
        columns = []
        for n in names:
            kept = F.when(F.col("__there").isNotNull(), F.col(f"__t_{n}")).otherwise(F.col(f"__n_{n}"))
            if n in changes:
                kept = F.when(updated, value(n)).otherwise(kept)
            elif n == version:
                kept = F.when(updated, F.col(f"__t_{n}") + 1).otherwise(kept).cast(types[n])
            columns.append(kept.alias(n))
        out = both.select(*columns, (updated | F.col("__there").isNull()).alias(MARK))
        return Written(out.drop(MARK), out.where(MARK).drop(MARK))


def _tables(c: All) -> list[Table]:
    from skeinql.plans.compiler import tables_of

    return tables_of(c)


def _on(pairs: list[tuple[Column, Column]]) -> Column:
    out = None
    for a, b in pairs:
        out = a == b if out is None else out & (a == b)
    return out
