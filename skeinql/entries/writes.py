"""Bulk writes: which rows are chosen, what is assigned, versions, chunks, and rows in conflict."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinql.entries.common import table
from skeinql.functions.expr import plus
from skeinql.operators.engine import Engine
from skeinql.operators.write import Conflict, Delete, Insert, Update, Writer
from skeinql.plans.query import select_from
from skeinql.plans.schema import Entity, Schema
from skeinql.queries import C, N, O, _put
from skeinql.sources.catalog import Catalog

_put("delete_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (1, 5, 9)")(lambda e: Writer(e).delete(Delete(C).where_keys(1, 5, 9, -3)).after.select("c_custkey"))
_put("delete_all", "SELECT n_nationkey FROM nation WHERE false")(lambda e: Writer(e).delete(Delete(N).all()).after.select("n_nationkey"))
_put("delete_returning", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")(lambda e: Writer(e).delete(Delete(C).where(lambda f: f.lt(C["c_acctbal"], 0))).affected.select("c_custkey", "c_name"))
_put("update_all", "SELECT n_nationkey, n_regionkey + 1 AS n_regionkey FROM nation")(lambda e: Writer(e).update(Update(N).set("n_regionkey", plus(N["n_regionkey"], 1)).all()).after.select("n_nationkey", "n_regionkey"))
_put("update_keys_null", "SELECT c_custkey, CASE WHEN c_custkey IN (2, 4) THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")(lambda e: Writer(e).update(Update(C).set_null("c_mktsegment").where_keys(2, 4)).after.select("c_custkey", "c_mktsegment"))
_put("update_changes", "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'NEW' ELSE c_name END AS c_name, CASE WHEN c_custkey = 7 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")(lambda e: Writer(e).update(Update(C).changes({"c_name": "NEW", "c_acctbal": None}).where_keys(7)).after.select("c_custkey", "c_name", "c_acctbal"))
_put("update_returning", "SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_totalprice > 400000")(lambda e: Writer(e).update(Update(O).set("o_orderstatus", "X").where(lambda f: f.gt(O["o_totalprice"], 400000))).affected.select("o_orderkey", "o_orderstatus"))
_put("update_default", "SELECT n_nationkey, 'gone' AS n_name, 9 AS n_regionkey FROM nation WHERE n_regionkey = 1")(lambda e: Writer(e).update(Update(N).set("n_name", "gone").default("n_regionkey", lambda: 9).default("n_name", lambda: "never").where(lambda f: f.eq(N["n_regionkey"], 1))).affected.select("n_nationkey", "n_name", "n_regionkey"))


# versions
def _versioned(e: Engine) -> tuple[Writer, object]:
    schema = Schema(Entity("orders", ("o_orderkey",), version="version"))
    frame = e.catalog.frame("orders").withColumn("version", F.lit(3))
    return Writer(Engine(Catalog(e.catalog.spark, {"orders": frame}))), schema.root("orders")


def _with_version(build):
    def run(e: Engine):
        writer, t = _versioned(e)
        return writer.update(build(t)).after.select("o_orderkey", "o_orderstatus", "version")

    return run


_VERSIONS = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, {} AS version FROM orders"
_put("version_update", _VERSIONS.format("CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END"))(_with_version(lambda t: Update(t).set("o_orderstatus", "X").where(lambda f: f.eq(t["o_orderstatus"], "F"))))
_put("version_kept", _VERSIONS.format("3"))(_with_version(lambda t: Update(t).set("o_orderstatus", "X").where(lambda f: f.eq(t["o_orderstatus"], "F")).keep_version()))
_put("version_expected", _VERSIONS.format("CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END"))(_with_version(lambda t: Update(t).set("o_orderstatus", "X").where(lambda f: f.eq(t["o_orderstatus"], "F")).expect_version(3)))


# chunks
def _chunked(build, names, commit=False, start=None, size=2000):
    def run(e: Engine):
        writer, keys = Writer(e), []
        for last, _ in writer.chunks(build, size, start, commit):
            keys.append(last)
        assert keys == sorted(set(keys))
        return e.catalog.frame(build.root.entity.name).select(*names)

    return run


_RICH = "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING'{} THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer"
_ADD = Update(C).set("c_acctbal", plus(C["c_acctbal"], 1.0)).where(lambda f: f.eq(C["c_mktsegment"], "BUILDING"))
_put("chunked_update", _RICH.format(""))(_chunked(_ADD, ("c_custkey", "c_acctbal")))
_put("chunked_resumed", _RICH.format(" AND c_custkey > 100"))(_chunked(_ADD, ("c_custkey", "c_acctbal"), start=100))
_put("chunked_committed", _RICH.format(""))(_chunked(_ADD, ("c_custkey", "c_acctbal"), True))
_put("chunked_delete", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")(_chunked(Delete(O).where(lambda f: f.eq(O["o_orderstatus"], "P")), ("o_orderkey",), True, size=5000))
_put("chunked_returning", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda e: _union([w.affected.select("c_custkey", "c_acctbal") for _, w in Writer(e).chunks(_ADD, 2000)]))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# inserts
_SOME = ({"n_nationkey": 3, "n_name": "NEW", "n_regionkey": 1}, {"n_nationkey": 4, "n_name": "FOUR", "n_regionkey": 2}, {"n_nationkey": 90, "n_name": "ADDED", "n_regionkey": 1})


def _upserted(conflict: Conflict):
    return lambda e: Writer(e).insert(Insert(N, rows=_SOME).on_conflict(conflict)).after.select("n_nationkey", "n_name", "n_regionkey")


_put("insert_values", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 90, 'ADDED', 1 UNION ALL SELECT 91, NULL, 2")(lambda e: Writer(e).insert(Insert(N, rows=(_SOME[2], {"n_nationkey": 91, "n_regionkey": 2}))).after.select("n_nationkey", "n_name", "n_regionkey"))
_put("insert_defaults", "SELECT 95 AS n_nationkey, 'unnamed' AS n_name, 7 AS n_regionkey")(lambda e: Writer(e).insert(Insert(N, rows=({"n_nationkey": 95},)).set("n_regionkey", 7).default("n_name", lambda: "unnamed").default("n_regionkey", lambda: 0)).affected.select("n_nationkey", "n_name", "n_regionkey"))
_put("insert_select_upsert", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 5 THEN 77 ELSE n_regionkey END AS n_regionkey FROM nation")(
    lambda e: Writer(e).insert(Insert(N, select_from(N, N["n_nationkey"].named("id"), N["n_name"].named("name")).where(lambda f: f.lt(N["n_nationkey"], 5))).map("n_nationkey", "id").map("n_name", "name").set("n_regionkey", 77).on_conflict(Conflict(("n_nationkey",)).set_from_row("n_regionkey"))).after.select("n_nationkey", "n_name", "n_regionkey")
)
_THERE = "SELECT n_nationkey, {} AS n_name, {} AS n_regionkey FROM nation UNION ALL SELECT 90, 'ADDED', 1"
_put("conflict_set", _THERE.format("CASE WHEN n_nationkey IN (3, 4) THEN 'same' ELSE n_name END", "CASE n_nationkey WHEN 3 THEN n_regionkey + 1 WHEN 4 THEN n_regionkey + 2 ELSE n_regionkey END"))(_upserted(Conflict(("n_nationkey",)).set("n_name", "same").set("n_regionkey", lambda old, new: old + new)))
_put("conflict_set_null", _THERE.format("CASE WHEN n_nationkey IN (3, 4) THEN NULL ELSE n_name END", "n_regionkey"))(_upserted(Conflict(("n_nationkey",)).set_null("n_name")))
_put("conflict_where", _THERE.format("CASE WHEN n_nationkey = 4 THEN 'FOUR' ELSE n_name END", "n_regionkey"))(_upserted(Conflict(("n_nationkey",)).set_from_row("n_name").where(lambda old, new: new("n_regionkey") > 1)))
_put("conflict_arbiter", "SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'FOUR' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 90, 'ADDED', 1 UNION ALL SELECT 3, 'NEW', 1")(_upserted(Conflict(("n_nationkey",)).set_from_row("n_name").where_arbiter(lambda f: f.gt(N["n_nationkey"], 3))))
_put("conflict_returning", "SELECT 3 AS n_nationkey, 'NEW' AS n_name UNION ALL SELECT 4, 'FOUR' UNION ALL SELECT 90, 'ADDED'")(lambda e: Writer(e).insert(Insert(N, rows=_SOME).on_conflict(Conflict(("n_nationkey",)).set_from_row("n_name"))).affected.select("n_nationkey", "n_name"))
_put("swapped_table", "SELECT n_nationkey, 'x' AS n_name FROM nation")(lambda e: _swapped(e))


def _swapped(e: Engine):
    from skeinql.sources.scratch import folder

    return Writer(e).update(Update(N).set("n_name", "x").all()).swap(folder(e.catalog.spark, "swapped")).select("n_nationkey", "n_name")


_put("written_counts", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS gone, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS changed")(
    lambda e: table(e, [(Writer(e).delete(Delete(C).where(lambda f: f.lt(C["c_acctbal"], 0))).count(), Writer(e).update(Update(O).set("o_orderstatus", "X").where(lambda f: f.eq(O["o_orderstatus"], "F"))).count())], "gone long, changed long")
)
