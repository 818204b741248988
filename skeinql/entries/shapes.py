"""Queries of definitions: filters, joins, groups, sets, recursion and expressions beyond the first modules'."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinql.entries.common import table
from skeinql.functions import correlated as sub
from skeinql.functions.expr import Agg, Typed, cases, concat, constant, divided_by, function, null_if, plus, times, value, window
from skeinql.functions.operators import JSON_CONTAINS, full_text
from skeinql.inspection import filters_of, joins_of
from skeinql.operators.engine import Engine
from skeinql.plans.filters import maybe
from skeinql.plans.query import Nested, Source, select_from
from skeinql.plans.schema import Entity, Relation, Schema
from skeinql.queries import _DOC, _OF, _ORD, _TOTALS, DL, OC, SCHEMA, C, D, E, L, O, P, _doc, _half, _money, _order, _put, _set
from skeinql.sources.catalog import Catalog

_ODD = cases().when(lambda f: f.compare(function("pmod", E["event_id"], 2, type="bigint"), "eq", 1), "true").otherwise("false")
_WRAPPED = concat('{"a":[{"x":1},{"b":', function("get_json_object", E["props"], "$.k"), ',"y":[1,2]}],"c":{"odd":', _ODD, "}}")

# filters
_put("not_in_fields", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber NOT IN (l_suppkey, l_partkey, 3) OR l_linenumber IS NULL")(select_from(L, L["l_orderkey"], L["l_linenumber"]).where(lambda f: f.not_in(L["l_linenumber"], [L["l_suppkey"], L["l_partkey"], 3])))
_put("null_distinct_column", _DOC + "nullif(l.quality, 1) IS DISTINCT FROM nullif(l.toxic, 1)")(_doc(lambda f: f.distinct_from_column(null_if(DL["quality"], 1), null_if(DL["toxic"], 1))))
_put("operator_json_deep", """SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT IN (7, 8) AND event_id % 2 = 1""")(
    select_from(E, E["event_id"]).where(lambda f: f.or_(*(lambda g, k=k: g.op(JSON_CONTAINS, _WRAPPED, {"a": [{"b": k}], "c": {"odd": True}}) for k in (7, 8))))
)
_put("operator_full_text_english", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '\\bwidget(s|es)?\\b')")(select_from(P, P["p_partkey"]).where(lambda f: f.op(full_text("english"), P["p_name"], "the widgets")))


def _dear(least: float):
    """A filter that queries share."""
    return lambda f: f.gt(O["o_totalprice"], least)


_HALF = divided_by(O["o_totalprice"], 2.0)
_put("filter_when_apply", _ORD + "o_totalprice > 150000 AND o_orderstatus = 'F'")(_order(lambda f: f.when(True, lambda g: g.eq(O["o_orderstatus"], "F")).when(False, lambda g: g.eq(O["o_orderstatus"], "P")).apply(_dear(150000))))
_put("named_expression", "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_totalprice / 2 > 90000")(_order(lambda f: f.gt(_HALF, 90000.0), _HALF.named("half")))
_INSPECTED = _order(lambda f: f.ne(O["o_orderstatus"], "F").gt(O["o_totalprice"], 5).or_(lambda g: g.eq(OC["c_name"], "x"), lambda g: g.is_null(O["o_orderdate"])))
_put("recorded_structure", """SELECT unnest(['(''or'', (''ne'', ''o_orderstatus'', ''F''), (''is_null'', ''o_orderstatus''))', '(''gt'', ''o_totalprice'', 5)', '(''or'', (''eq'', ''customer.c_name'', ''x''), (''is_null'', ''o_orderdate''))']) AS term, 'customer' AS joins""")(
    lambda e: table(e, [(str(t), ",".join(sorted(joins_of(_INSPECTED)))) for t in filters_of(_INSPECTED)], "term string, joins string")
)

# joins
_EJ = O.entity_join("customer", {"c_custkey": O["o_custkey"]})
_put("join_filter_entity", "SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")(select_from(O, O["o_orderkey"], _EJ["c_name"].named("name")).join_filter(_EJ, lambda f: f.eq(_EJ["c_mktsegment"], "BUILDING")))


def _with_tags(e: Engine) -> tuple[Engine, Schema]:
    """Regions, tags by lower-case name, and suppliers that customers of their nation are related to."""
    tags = e.catalog.frame("region").select(F.lower("r_name").alias("name"), (F.col("r_regionkey") * 10).alias("weight"))
    frames = {n: e.catalog.frame(n) for n in ("region", "supplier", "customer")}
    schema = Schema(
        Entity("region", ("r_regionkey",), (Relation("tag", "tags", (("lower(r_name)", "name"),)),)), Entity("tags", ("name",)),
        Entity("supplier", ("s_suppkey",), (Relation("buyers", "customer", (("s_nationkey", "c_nationkey"),), many=True),)), Entity("customer", ("c_custkey",)),
    )
    return Engine(Catalog(e.catalog.spark, frames | {"tags": tags})), schema


def _formula(e: Engine):
    other, schema = _with_tags(e)
    r = schema.root("region")
    return other.frame(select_from(r, r["r_regionkey"], r.join("tag")["weight"].named("weight")))


def _non_key(e: Engine):
    other, schema = _with_tags(e)
    s = schema.root("supplier")
    return other.frame(select_from(s, s["s_suppkey"], Agg.count(s.join("buyers")).named("buyers")).group_by(s["s_suppkey"]))


_put("join_on_formula", "SELECT r_regionkey, r_regionkey * 10 AS weight FROM region")(_formula)
_put("join_on_non_key", "SELECT s_suppkey, count(c_custkey) AS buyers FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey GROUP BY 1")(_non_key)
_CF = O.join("customer", alias="far", on=lambda f: f.eq(O.join("customer", alias="far")["c_nationkey"], 3))
_WITHIN = O.joined_source(_TOTALS, {"customer": O["o_custkey"]}).within(_CF)
_put("source_within_join", "SELECT o_orderkey, c_name AS name, CASE WHEN c_custkey IS NOT NULL THEN n END AS n FROM orders o LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey = 3 LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = o_custkey")(
    lambda e: e.frame(select_from(O, O["o_orderkey"], Nested("far", _CF, (_CF["c_name"].named("name"), _WITHIN["n"].named("n"))))).select("o_orderkey", "far.name", "far.n")
)
_ON_ENTITY = _EJ.joined_source(_TOTALS, {"customer": _EJ["c_custkey"]})
_put("source_on_entity_join", "SELECT o_orderkey, c_name AS name, n FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey")(select_from(O, O["o_orderkey"], _EJ["c_name"].named("name"), _ON_ENTITY["n"].named("n")))

# groups
_CO = C.join("orders")
_put("aggregate_joined", "SELECT c_nationkey AS nation, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, max(o_totalprice) AS dearest, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(
    select_from(C, C["c_nationkey"].named("nation"), Agg.count_distinct(C["c_custkey"]).named("customers"), Agg.count(_CO).named("orders"), Agg.max(_CO["o_totalprice"]).named("dearest"), Agg.sum(_CO["o_orderkey"]).named("keys")).group_by(C["c_nationkey"])
)
_put("aggregate_label", "SELECT o_orderstatus AS status, count(*) AS orders, max(o_orderkey) AS latest FROM orders GROUP BY 1")(select_from(O, O["o_orderstatus"].named("status"), Agg.count(O).as_("orders"), Agg.max(O["o_orderkey"]).as_("latest")).group_by(O["o_orderstatus"]))
_CHOICE = select_from(O, O["o_orderstatus"].named("status"), O["o_orderpriority"].named("priority"), Agg.count(O).named("n"), Typed(Agg.sum(_money(O["o_totalprice"])), "double").named("total"))
_TOTAL = "count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders GROUP BY"
_put("group_choice_one", f"SELECT o_orderstatus AS status, CAST(NULL AS VARCHAR) AS priority, {_TOTAL} o_orderstatus")(_CHOICE.grouped_by("status"))
_put("group_choice_other", f"SELECT CAST(NULL AS VARCHAR) AS status, o_orderpriority AS priority, {_TOTAL} o_orderpriority")(_CHOICE.grouped_by("priority"))
_put("group_choice_both", f"SELECT o_orderstatus AS status, o_orderpriority AS priority, {_TOTAL} 1, 2")(_CHOICE.grouped_by("status", "priority"))
_put("first_by_time", "SELECT o_custkey AS customer, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) AS latest, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS oldest FROM orders GROUP BY 1")(select_from(O, O["o_custkey"].named("customer"), Agg.first_by(O["o_orderkey"], O["o_orderdate"].desc()).named("latest"), Agg.first_by(O["o_orderkey"], O["o_orderdate"].asc()).named("oldest")).group_by(O["o_custkey"]))

# sets and recursion
_DONE, _DEAR, _LATE, _EVEN = _half("done", lambda f: f.eq(O["o_orderstatus"], "F")), _half("dear", _dear(300000)), _half("late", lambda f: f.eq(O["o_orderpriority"], "5-LOW")), _half("even", lambda f: f.add("even", lambda k: k % 2 == 0, O["o_orderkey"]))
_ROW = "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE "
_set("set_nesting", _DONE.union(_DEAR).except_(_LATE).intersect(_EVEN), f"SELECT * FROM (SELECT * FROM ({_ROW} o_orderstatus = 'F' UNION {_ROW} o_totalprice > 300000) EXCEPT {_ROW} o_orderpriority = '5-LOW') INTERSECT {_ROW} o_orderkey % 2 = 0")
_set("set_nested_right", _DONE.except_(_DEAR.union(_LATE)), f"SELECT * FROM ({_ROW} o_orderstatus = 'F') EXCEPT SELECT * FROM ({_ROW} o_totalprice > 300000 UNION {_ROW} o_orderpriority = '5-LOW')")
_NO, _TENANT = Typed(function("floor", divided_by(Typed(C["c_custkey"], "double"), 3.0)), "bigint"), function("pmod", C["c_custkey"], 3, type="bigint")
_UP = Typed(function("floor", divided_by(Typed(_NO, "double"), 2.0)), "bigint")
_PAIRS = select_from(C, _TENANT.named("tenant"), _NO.named("no"), _UP.named("up"), _TENANT.named("above"))
_PAIRED = Source("pairs", _PAIRS.where(lambda f: f.eq(_NO, 1)), key=("tenant", "no")).recursive("tenant,no", "above,up", 40, depth="level", links=_PAIRS.where(lambda f: f.gt(_NO, 1)))
_PP = _PAIRED.table()
_put("recursive_composite", "WITH RECURSIVE k AS (SELECT c_custkey % 3 AS tenant, c_custkey // 3 AS no FROM customer), t AS (SELECT tenant, no, 0::BIGINT AS level FROM k WHERE no = 1 UNION ALL SELECT k.tenant, k.no, t.level + 1 FROM k JOIN t ON k.tenant = t.tenant AND k.no // 2 = t.no WHERE k.no > 1) SELECT tenant, no, level FROM t")(select_from(_PP, *_PP.cols("tenant", "no", "level")))

# expressions
_put("constants", "SELECT o_orderkey, 7 AS seven, 'x' AS x, o_orderkey + 2 AS more FROM orders")(select_from(O, O["o_orderkey"], constant(7).named("seven"), value("x").named("x"), plus(O["o_orderkey"], value(2)).named("more")))
_put("correlated_exists", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS dear FROM customer")(select_from(C, C["c_custkey"], sub.exists(_OF.where(lambda f: f.gt(O["o_totalprice"], 200000))).named("dear")))
_put("aliased_label", "SELECT c_custkey, c_name || '#' || (c_nationkey * 2) AS label FROM customer")(select_from(C, C["c_custkey"], concat(C["c_name"], "#", times(C["c_nationkey"], 2)).named("label")))
_ROWS = Source("placed", select_from(D, D["doc_id"].named("id"), DL["quality"].named("quality"), window("row_number", partition_by=[D["source"]], order_by=[DL["quality"].asc().nulls_last()]).named("place")))
_PT = _ROWS.table()
_put("window_nulls_last", "SELECT d.doc_id AS id, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY l.quality ASC NULLS LAST, d.doc_id) AS place FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(select_from(_PT, *_PT.cols("id", "quality", "place")).where(lambda f: f.gt(_PT["place"], maybe(0))))
_LABELLED = SCHEMA.root("labels")
_put("not_in_subselect_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(select_from(D, D["doc_id"]).where(lambda f: f.not_in_sub(D["doc_id"], sub.sub(_LABELLED, _LABELLED["doc_id"]))))
