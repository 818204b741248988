"""The registered queries of the engine, by name, each with SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.functions import correlated as sub
from skeinql.functions.expr import Agg, Typed, cases, coalesce, concat, divided_by, function, minus, negate, null_if, param, plus, rounded, times, type_of, window
from skeinql.functions.operators import ARRAY_CONTAINS, ARRAY_OVERLAPS, FULL_TEXT_MATCH, ILIKE, JSON_CONTAINS, REGEX_MATCH
from skeinql.operators.engine import Engine
from skeinql.operators.fetch import child
from skeinql.operators.write import Conflict, Delete, Insert, Update, Writer
from skeinql.plans.filters import maybe
from skeinql.plans.query import FieldIndex, Nested, Query, Source, select_from
from skeinql.plans.schema import Entity, Relation, Schema, Subtype
from skeinql.sources.catalog import Catalog

SCHEMA = Schema(
    Entity("region", ("r_regionkey",), (Relation("nations", "nation", (("r_regionkey", "n_regionkey"),), many=True),)),
    Entity("nation", ("n_nationkey",), (Relation("region", "region", (("n_regionkey", "r_regionkey"),)), Relation("customers", "customer", (("n_nationkey", "c_nationkey"),), many=True))),
    Entity("customer", ("c_custkey",), (Relation("nation", "nation", (("c_nationkey", "n_nationkey"),)), Relation("orders", "orders", (("c_custkey", "o_custkey"),), many=True))),
    Entity(
        "orders", ("o_orderkey",),
        (
            Relation("customer", "customer", (("o_custkey", "c_custkey"),)),
            Relation("lines", "lineitem", (("o_orderkey", "l_orderkey"),), many=True),
            Relation("parts", "part", (), many=True, through=("lineitem", (("o_orderkey", "l_orderkey"),), (("l_partkey", "p_partkey"),))),
        ),
    ),
    Entity("lineitem", (), (Relation("order", "orders", (("l_orderkey", "o_orderkey"),)), Relation("part", "part", (("l_partkey", "p_partkey"),)), Relation("supplier", "supplier", (("l_suppkey", "s_suppkey"),)))),
    Entity("part", ("p_partkey",)),
    Entity("supplier", ("s_suppkey",), (Relation("nation", "nation", (("s_nationkey", "n_nationkey"),)),)),
    Entity("events", ("event_id",), discriminator="event_type", subtypes=(Subtype("Click", "click"), Subtype("Deal", "purchase"), Subtype("Sign", "signup", parent="Deal"), Subtype("View", "view"), Subtype("Error", "error"))),
    Entity("documents", ("doc_id",), (Relation("label", "labels", (("doc_id", "doc_id"),)),)),
    Entity("labels", ("doc_id",)),
    Entity("conversations", ("conv_id", "turn")),
)
O, C, N, L, E, D, P, CV = map(SCHEMA.root, ("orders", "customer", "nation", "lineitem", "events", "documents", "part", "conversations"))
OC = O.join("customer", "inner")
OCN = OC.join("nation", "inner")
DL = D.join("label")
CENTS = "decimal(12,2)"
DAY = datetime.datetime

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(Catalog(spark, root=sf_dir))


def _put(name: str, sql: str):
    def wrap(f):
        if isinstance(f, Query):
            QUERIES[name] = lambda spark, d: engine(spark, d).frame(f)
        else:
            QUERIES[name] = lambda spark, d: f(engine(spark, d))
        SQL[name] = sql
        return f

    return wrap


def _money(x):
    return Typed(x, CENTS)


def _order(q: Callable, *more) -> Query:
    return select_from(O, O["o_orderkey"], *more).where(q)


def _doc(q: Callable) -> Query:
    """Documents with their label, if any: the nullable side."""
    return select_from(D, D["doc_id"], DL["quality"].named("quality")).where(q)


_DOC = "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE "
_ORD = "SELECT o_orderkey FROM orders WHERE "

# reads
FLAGSHIP = (
    select_from(O, O["o_orderkey"], O["o_totalprice"], OC["c_name"].named("customer"), OCN["n_name"].named("nation"))
    .where(lambda f: f.eq(O["o_orderstatus"], maybe("F")).range(O["o_orderdate"], maybe(DAY(1995, 1, 1)), maybe(DAY(1997, 1, 1))).eq(OCN["n_name"], maybe(None)))
    .order_by(O["o_totalprice"].desc().nulls_last())
)
_put("flagship_read", "SELECT o_orderkey, o_totalprice, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")(FLAGSHIP)

# filters
_put("filter_eq", _ORD + "o_orderstatus = 'F'")(_order(lambda f: f.eq(O["o_orderstatus"], "F")))
_put("filter_ne_keeps_null", _DOC + "l.quality <> 1 OR l.quality IS NULL")(_doc(lambda f: f.ne(DL["quality"], 1)))
_put("filter_compare_ops", _ORD + "o_totalprice > 1000 AND o_totalprice >= 1500.5 AND o_totalprice < 300000 AND o_totalprice <= 250000")(_order(lambda f: f.gt(O["o_totalprice"], 1000).gte(O["o_totalprice"], 1500.5).lt(O["o_totalprice"], 300000).lte(O["o_totalprice"], 250000)))
_put("filter_range", _ORD + "o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-06-01'")(_order(lambda f: f.range(O["o_orderdate"], DAY(1996, 3, 1), DAY(1996, 6, 1))))
_put("filter_range_open", _ORD + "o_orderdate < TIMESTAMP '1996-06-01'")(_order(lambda f: f.range(O["o_orderdate"], maybe(), DAY(1996, 6, 1))))
_put("filter_between", _ORD + "o_orderkey BETWEEN 100 AND 900")(_order(lambda f: f.between(O["o_orderkey"], 100, 900)))
_put("filter_in", _ORD + "o_orderstatus IN ('F', 'P')")(_order(lambda f: f.is_in(O["o_orderstatus"], ["F", "P"])))
_put("filter_in_empty", _ORD + "false")(_order(lambda f: f.is_in(O["o_orderstatus"], [])))
_put("filter_in_fields", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (l_suppkey, l_partkey, 3)")(select_from(L, L["l_orderkey"], L["l_linenumber"]).where(lambda f: f.is_in(L["l_linenumber"], [L["l_suppkey"], L["l_partkey"], 3])))
_put("filter_not_in_null", _DOC + "l.quality NOT IN (0, 5) OR l.quality IS NULL")(_doc(lambda f: f.not_in(DL["quality"], [0, 5]).not_in(DL["quality"], [])))
_put("like_modes", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type LIKE '%E%' AND p_brand LIKE 'Brand%' AND NOT contains(p_name, '50%')")(select_from(P, P["p_partkey"], P["p_name"]).where(lambda f: f.like(P["p_name"], "%a%", "exact").like(P["p_type"], "E").like(P["p_brand"], "Brand", "starts").not_(lambda g: g.like(P["p_name"], "50%"))))
_put("like_ignore_case", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%a%' AND lower(p_type) LIKE '%e%'")(select_from(P, P["p_partkey"]).where(lambda f: f.like_ignore_case(P["p_name"], "A").like_ignore_case(P["p_type"], "E")))
_put("eq_ignore_case", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")(select_from(C, C["c_custkey"]).where(lambda f: f.eq_ignore_case(C["c_mktsegment"], "Building")))
_put("null_tests", _DOC + "l.quality IS NULL OR l.toxic IS NOT NULL")(_doc(lambda f: f.or_(lambda g: g.is_null(DL["quality"]), lambda g: g.is_not_null(DL["toxic"])).is_null(DL["toxic"], maybe())))
_put("null_safe_value", _DOC + "l.quality IS NOT DISTINCT FROM 1")(_doc(lambda f: f.not_distinct_from(DL["quality"], 1)))
_put("null_safe_distinct", _DOC + "l.quality IS DISTINCT FROM 1")(_doc(lambda f: f.distinct_from(DL["quality"], 1)))
_put("null_safe_column", _DOC + "nullif(l.quality, 1) IS NOT DISTINCT FROM nullif(l.toxic, 1)")(_doc(lambda f: f.not_distinct_from_column(null_if(DL["quality"], 1), null_if(DL["toxic"], 1))))
_put("compare_columns", _DOC + "l.quality <> l.toxic")(_doc(lambda f: f.compare(DL["quality"], "ne", DL["toxic"])))
_put("or_not_groups", _ORD + "(o_orderstatus = 'F' OR (o_totalprice > 200000 AND NOT (o_orderpriority = '1-URGENT')))")(_order(lambda f: f.or_(lambda g: g.eq(O["o_orderstatus"], "F"), lambda g: g.gt(O["o_totalprice"], 200000).not_(lambda h: h.eq(O["o_orderpriority"], "1-URGENT")), lambda g: g.eq(O["o_orderkey"], maybe()))))
_put("or_empty_list", _ORD + "false")(_order(lambda f: f.or_list([])))
_put("not_of_null", _DOC + "NOT (l.quality = 1)")(_doc(lambda f: f.not_(lambda g: g.eq(DL["quality"], 1))))
_put("operator_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE '%rom%'")(select_from(P, P["p_partkey"]).where(lambda f: f.op(ILIKE, P["p_type"], "%ROM%")))
_put("operator_regex", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0[1-5]$')")(select_from(C, C["c_custkey"]).where(lambda f: f.op(REGEX_MATCH, C["c_name"], "0[1-5]$")))
_put("operator_arrays", "SELECT c_custkey FROM customer WHERE list_has_all(string_split(c_name, '#'), ['Customer']) OR list_has_any(string_split(c_mktsegment, 'I'), ['BU', 'MACH', 'FURN'])")(
    select_from(C, C["c_custkey"]).where(lambda f: f.or_(lambda g: g.op(ARRAY_CONTAINS, function("split", C["c_name"], "#"), ["Customer"]), lambda g: g.op(ARRAY_OVERLAPS, function("split", C["c_mktsegment"], "I"), ["BU", "MACH", "FURN"])))
)
_put("operator_json", """SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'""")(select_from(E, E["event_id"]).where(lambda f: f.op(JSON_CONTAINS, E["props"], '{"k": 7}')))
_put("operator_full_text", "SELECT p_partkey FROM part WHERE list_has_all(string_split(lower(p_name), ' '), ['widget', 'red'])")(select_from(P, P["p_partkey"]).where(lambda f: f.op(FULL_TEXT_MATCH, P["p_name"], "Widget RED")))
_put("exists_path", _ORD + "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")(_order(lambda f: f.exists(O.join("lines"), lambda g: g.gt(O.join("lines")["l_quantity"], 45))))
_put("not_exists_path", _ORD + "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)")(_order(lambda f: f.not_exists(O.join("lines"), lambda g: g.gt(O.join("lines")["l_quantity"], 10))))
_put("exists_through_link", _ORD + "EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size > 48)")(_order(lambda f: f.exists(O.join("parts"), lambda g: g.gt(O.join("parts")["p_size"], 48))))
_put("exists_in_or", _ORD + "o_totalprice < 5000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")(_order(lambda f: f.or_(lambda g: g.lt(O["o_totalprice"], 5000), lambda g: g.exists(O.join("lines"), lambda h: h.gt(O.join("lines")["l_quantity"], 48)))))
_put("in_subselect", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")(select_from(C, C["c_custkey"]).where(lambda f: f.in_sub(C["c_custkey"], sub.sub(O, O["o_custkey"]).where(lambda g: g.gt(O["o_totalprice"], 300000)))))
_put("not_in_subselect", _DOC + "l.quality IS NULL OR l.quality NOT IN (SELECT toxic FROM labels WHERE toxic = 1)")(_doc(lambda f: f.not_in_sub(DL["quality"], sub.sub(SCHEMA.root("labels"), null_if(SCHEMA.root("labels")["toxic"], 0)))))
_put("exists_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")(select_from(C, C["c_custkey"]).where(lambda f: f.exists_sub(sub.sub(O).where(lambda g: g.compare(O["o_custkey"], "eq", sub.outer(C["c_custkey"])).compare(O["o_totalprice"], "gt", times(sub.outer(C["c_acctbal"]), 40.0))))))
_put("not_exists_correlated", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")(select_from(C, C["c_custkey"]).where(lambda f: f.not_exists_sub(sub.sub(O).where(lambda g: g.compare(O["o_custkey"], "eq", sub.outer(C["c_custkey"])).eq(O["o_orderstatus"], "F")))))
_put("types_in", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup')")(select_from(E, E["event_id"]).where(lambda f: f.of_type(E, "Deal")))
_put("types_out", "SELECT event_id, event_type AS kind FROM events WHERE event_type NOT IN ('click')")(select_from(E, E["event_id"], type_of(E).named("kind")).where(lambda f: f.not_of_type(E, "Click")))
_put("treated_columns", "SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS clicked FROM events")(select_from(E, E["event_id"], E.treat("Click")["value"].named("clicked")))
_put("custom_predicate", _ORD + "o_orderkey % 7 = 3")(_order(lambda f: f.add("seventh", lambda c: c % 7 == 3, O["o_orderkey"])))

# joins
_put("left_join_nested", "SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(
    lambda e: e.frame(select_from(D, D["doc_id"], Nested("label", DL, (DL["quality"].named("quality"), DL["toxic"].named("toxic"))))).select("doc_id", F.col("label").isNotNull().alias("labelled"), F.col("label.toxic").alias("toxic"))
)
_put("inner_join", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")(select_from(D, D["doc_id"], D.join("label", "inner")["quality"].named("quality")))
_put("to_many_join", "SELECT o_orderkey, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")(_order(lambda f: f, O.join("lines")["l_quantity"].named("l_quantity")))
_BIG = O.join("lines", alias="big", on=lambda f: f.gt(O.join("lines", alias="big")["l_quantity"], 49))
_put("aliased_join_on", "SELECT o_orderkey, l_partkey AS part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 49")(_order(lambda f: f, _BIG["l_partkey"].named("part")))
_put("join_filter", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1")(select_from(D, D["doc_id"], DL["quality"].named("quality")).join_filter(DL, lambda f: f.eq(DL["toxic"], 1)))
_put("left_inside_or", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0 OR d.n_chars < 500")(select_from(D, D["doc_id"]).where(lambda f: f.or_(lambda g: g.eq(D.join("label", "inner")["quality"], 0), lambda g: g.lt(D["n_chars"], 500))))
_OL = O.join("lines")
_put("semi_join_to_many", _ORD + "o_totalprice > 50000 AND EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND l_quantity > 40 AND p_size > 10)")(_order(lambda f: f.gt(O["o_totalprice"], 50000).gt(_OL["l_quantity"], 40).gt(_OL.join("part", "inner")["p_size"], 10)))
_put("foreign_key_read", "SELECT o_orderkey, o_custkey AS customer FROM orders")(lambda e: Engine(e.catalog, trusted=True).frame(select_from(O, O["o_orderkey"], O.join("customer")["c_custkey"].named("customer"))))
_put("view_root", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")(lambda e: (e.catalog.view("big_orders", e.catalog.frame("orders").where("o_totalprice > 400000")), e.frame(select_from((s := Schema(Entity("big_orders", ("o_orderkey",)))).root("big_orders"), s.root("big_orders")["o_orderkey"])))[1])
_put("entity_join_when", "SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F'")(select_from(O, O["o_orderkey"], O.entity_join("customer", {"c_custkey": O["o_custkey"]}, {O["o_orderstatus"]: "F"})["c_name"].named("name")))

# groups
_put("group_count_sum", "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")(select_from(O, O["o_orderstatus"].named("status"), Agg.count(O).named("n"), Typed(Agg.sum(_money(O["o_totalprice"])), "double").named("total")).group_by(O["o_orderstatus"]))
_put("count_kinds", "SELECT count(*) AS roots, count(l.doc_id) AS labelled, count(nullif(l.quality, 0)) AS good, count(DISTINCT d.source) AS sources FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(select_from(D, Agg.count(D).named("roots"), Agg.count(DL).named("labelled"), Agg.count(null_if(DL["quality"], 0)).named("good"), Agg.count_distinct(D["source"]).named("sources")))
_put("sum_as_long", "SELECT l_returnflag AS flag, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1")(select_from(L, L["l_returnflag"].named("flag"), Agg.sum_as_long(L["l_linenumber"]).named("lines")).group_by(L["l_returnflag"]))
_put("sum_of_none", "SELECT CAST(NULL AS BIGINT) AS total, CAST(0 AS BIGINT) AS n")(select_from(O, Agg.sum(O["o_custkey"]).named("total"), Agg.count(O).named("n")).where(lambda f: f.lt(O["o_orderkey"], 0)).group_by())
_put("avg_exact_round", "SELECT l_returnflag AS flag, CAST(round(CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,10)) / count(*), 2) AS DOUBLE) AS mean FROM lineitem GROUP BY 1")(select_from(L, L["l_returnflag"].named("flag"), Typed(Agg.round(Agg.avg_exact(_money(L["l_quantity"])), 2), "double").named("mean")).group_by(L["l_returnflag"]))
_put("avg_double", "SELECT l_returnflag AS flag, avg(l_linenumber) AS mean FROM lineitem GROUP BY 1")(select_from(L, L["l_returnflag"].named("flag"), Agg.avg(L["l_linenumber"]).named("mean")).group_by(L["l_returnflag"]))
_put("min_max", "SELECT c_nationkey AS nation, min(c_name) AS least, max(c_custkey) AS most FROM customer GROUP BY 1")(select_from(C, C["c_nationkey"].named("nation"), Agg.min(C["c_name"]).named("least"), Agg.max(C["c_custkey"]).named("most")).group_by(C["c_nationkey"]))
_put("filtered_aggregates", "SELECT o_custkey AS customer, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")(select_from(O, O["o_custkey"].named("customer"), Agg.count(O).filter(lambda f: f.eq(O["o_orderstatus"], "F")).named("done"), Agg.max(O["o_orderkey"]).filter(lambda f: f.eq(O["o_orderstatus"], "P")).named("pending")).group_by(O["o_custkey"]))
_put("first_by", "SELECT o_custkey AS customer, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest FROM orders GROUP BY 1")(select_from(O, O["o_custkey"].named("customer"), Agg.first_by(O["o_orderkey"], O["o_totalprice"].desc()).named("dearest")).group_by(O["o_custkey"]))
_put("first_by_text", "SELECT o_custkey AS customer, first(o_orderkey ORDER BY o_orderpriority DESC, o_orderkey) AS last_priority FROM orders GROUP BY 1")(select_from(O, O["o_custkey"].named("customer"), Agg.first_by(O["o_orderkey"], O["o_orderpriority"].desc()).named("last_priority")).group_by(O["o_custkey"]))
_put("having_or", "SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15 OR max(o_totalprice) > 400000")(select_from(O, O["o_custkey"].named("customer"), Agg.count(O).named("n")).group_by(O["o_custkey"]).having(lambda h: h.or_(lambda g: g.gt(Agg.count(O), 15), lambda g: g.gt(Agg.max(O["o_totalprice"]), 400000))))
_put("group_by_expression", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")(select_from(O, function("year", O["o_orderdate"]).named("y"), Agg.count(O).named("n")).group_by(function("year", O["o_orderdate"])))
_put("group_over_joins", "SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")(select_from(O, OCN["n_name"].named("nation"), Agg.count(O).named("n")).group_by(OCN["n_name"]))
_put("custom_aggregate", "SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_totalprice > 100000) AS dear FROM orders GROUP BY 1")(select_from(O, O["o_orderstatus"].named("status"), Agg.of("dear", lambda c: F.count_if(c > 100000), O["o_totalprice"])).group_by(O["o_orderstatus"]))


# expressions
_put("case_expr", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 END AS done FROM orders")(select_from(O, O["o_orderkey"], cases().when(lambda f: f.gt(O["o_totalprice"], 200000), "high").when(lambda f: f.gt(O["o_totalprice"], 100000), "mid").otherwise("low").named("band"), cases().when(lambda f: f.eq(O["o_orderstatus"], "F"), 1).or_null().named("done")))
_put("coalesce_nullif", "SELECT d.doc_id, coalesce(l.quality, -1) AS q, nullif(d.lang, 'en') AS other FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(select_from(D, D["doc_id"], coalesce(DL["quality"], -1).named("q"), null_if(D["lang"], "en").named("other")))
_put("arithmetic", "SELECT l_orderkey, l_linenumber * 3 + l_orderkey - 1 AS a, -l_linenumber AS b, l_quantity / 4.0::DOUBLE AS c FROM lineitem")(select_from(L, L["l_orderkey"], minus(plus(times(L["l_linenumber"], 3), L["l_orderkey"]), 1).named("a"), negate(L["l_linenumber"]).named("b"), divided_by(L["l_quantity"], 4.0).named("c")))
_put("round_half_away", "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS r FROM orders")(select_from(O, O["o_orderkey"], Typed(rounded(_money(O["o_totalprice"]), 1), "double").named("r")))
_put("concat_fn", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label, upper(c_mktsegment) AS u, length(c_name) AS n FROM customer")(select_from(C, C["c_custkey"], concat(C["c_name"], "/", C["c_mktsegment"]).named("label"), function("upper", C["c_mktsegment"]).named("u"), function("length", C["c_name"]).named("n")))
_put("bound_param", _ORD + "o_orderstatus = 'P'")(_order(lambda f: f.compare(O["o_orderstatus"], "eq", param("status"))).bind(status="P"))
_OF = sub.sub(O).where(lambda g: g.compare(O["o_custkey"], "eq", sub.outer(C["c_custkey"])))
_put("correlated_values", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS oldest, (SELECT count(*) > 0 FROM orders WHERE o_custkey = c_custkey) AS any_order, (SELECT CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_custkey = c_custkey) AS s FROM customer")(select_from(C, C["c_custkey"], sub.count(_OF).named("n"), sub.max_(_OF, O["o_totalprice"]).named("top"), sub.min_(_OF, O["o_orderkey"]).named("oldest"), sub.exists(_OF).named("any_order"), sub.sum_(_OF, O["o_orderkey"]).named("s")))
_put("correlated_first", "SELECT c_custkey, (SELECT arg_max(o_orderkey, (o_totalprice, -o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS dearest FROM customer")(select_from(C, C["c_custkey"], sub.first(_OF, O["o_orderkey"], O["o_totalprice"].desc()).named("dearest")))
_put("correlated_filter", "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12")(select_from(C, C["c_custkey"]).where(lambda f: f.gt(sub.count(_OF), 12)))

# sources
_RANKED = Source("ranked", select_from(O, O["o_orderkey"].named("id"), O["o_custkey"].named("customer"), O["o_totalprice"].named("price"), window("row_number", partition_by=[O["o_custkey"]], order_by=[O["o_totalprice"].desc()]).named("place")))
_R = _RANKED.table()
_put("window_row_number", "SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")(select_from(_R, *_R.cols("id", "customer", "price", "place")))
_put("top_k_per_group", "SELECT customer, id FROM (SELECT o_orderkey AS id, o_custkey AS customer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")(select_from(_R, *_R.cols("customer", "id")).where(lambda f: f.lte(_R["place"], 3)))


def _windows(name: str, sql: str, **calls) -> None:
    t = Source(name, select_from(O, O["o_orderkey"].named("id"), *(w.named(n) for n, w in calls.items()))).table()
    _put(name, sql)(select_from(t, *t.cols("id", *calls)))


_BY = {"partition_by": [O["o_custkey"]], "order_by": [O["o_orderdate"].asc()]}
_windows("window_ranks", "SELECT o_orderkey AS id, rank() OVER w AS r, dense_rank() OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)", r=window("rank", partition_by=[O["o_custkey"]], order_by=[O["o_orderpriority"].asc()]), d=window("dense_rank", partition_by=[O["o_custkey"]], order_by=[O["o_orderpriority"].asc()]))
_windows("window_lag_lead", "SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS a, lead(o_orderkey) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", a=window("lag", O["o_orderkey"], **_BY), b=window("lead", O["o_orderkey"], **_BY))
_windows("window_first_last", "SELECT o_orderkey AS id, first_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a, last_value(o_orderkey) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", a=window("first_value", O["o_orderkey"], **_BY, frame="rows_all"), b=window("last_value", O["o_orderkey"], **_BY, frame="rows_from_current"))
_windows("window_running", "SELECT o_orderkey AS id, CAST(sum(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, min(o_totalprice) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", s=window("sum", O["o_orderkey"], **_BY, frame="rows_to_current"), n=window("count", O["o_orderkey"], **_BY, frame="rows_to_current"), m=window("min", O["o_totalprice"], **_BY, frame="rows_from_current"))
_PEERS = {"partition_by": [O["o_custkey"]], "order_by": [O["o_orderpriority"].asc()]}
_windows("window_range_frames", "SELECT o_orderkey AS id, count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, max(o_orderkey) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b, count(*) OVER w AS c, avg(o_custkey) OVER (PARTITION BY o_orderstatus) AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)", a=window("count", **_PEERS, frame="range_to_current"), b=window("max", O["o_orderkey"], **_PEERS, frame="range_all"), c=window("count", **_PEERS), d=window("avg", O["o_custkey"], partition_by=[O["o_orderstatus"]]))

_TOTALS = Source("totals", select_from(O, O["o_custkey"].named("customer"), Agg.count(O).named("n"), Typed(Agg.sum(_money(O["o_totalprice"])), "double").named("total"), window("rank", order_by=[Agg.count(O).desc()], partition_by=[]).named("place")).group_by(O["o_custkey"]))
_T = _TOTALS.table()
_put("window_over_groups", "SELECT o_custkey AS customer, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM orders GROUP BY 1")(select_from(_T, *_T.cols("customer", "n", "place")))
_put("source_over_source", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")(select_from(_T, _T["n"].named("n"), Agg.count(_T).named("customers")).group_by(_T["n"]))
_CT = C.joined_source(_TOTALS, {"customer": C["c_custkey"]})
_put("source_join", "SELECT c_custkey, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")(select_from(C, C["c_custkey"], _CT["n"].named("n"), _CT["total"].named("total")))
_put("source_join_inner", "SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n > 10")(select_from(C, C["c_custkey"], C.joined_source(_TOTALS, {"customer": C["c_custkey"]}, "inner")["n"].named("n")).where(lambda f: f.gt(C.joined_source(_TOTALS, {"customer": C["c_custkey"]}, "inner")["n"], 10)))
_TC = _T.entity_join("customer", {"c_custkey": _T["customer"]}, schema=SCHEMA)
_put("entity_join_on_source", "SELECT o_custkey AS customer, c_name AS name FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey")(select_from(_T, _T["customer"].named("customer"), _TC["c_name"].named("name")))


def _half(name: str, test: Callable, **tags) -> Source:
    return Source(name, select_from(O, O["o_orderkey"].named("id"), O["o_orderstatus"].named("status")).where(test), discriminators=tags)


_A, _B = _half("a", lambda f: f.eq(O["o_orderpriority"], "1-URGENT")), _half("b", lambda f: f.eq(O["o_orderstatus"], "F"))


def _set(name: str, source: Source, sql: str) -> None:
    t = source.table()
    _put(name, sql)(select_from(t, *t.cols(*source.fields)))


_SA, _SB = "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT'", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'"
_set("union_distinct", _A.union(_B), f"{_SA} UNION {_SB}")
_set("union_all", _A.union_all(_B), f"{_SA} UNION ALL {_SB}")
_set("intersect", _A.intersect(_B), f"{_SA} INTERSECT {_SB}")
_set("except", _A.except_(_B), f"{_SA} EXCEPT {_SB}")
_set("set_chain_tags", _half("low", lambda f: f.lt(O["o_totalprice"], 20000), part="low").union_all(_half("done", lambda f: f.eq(O["o_orderstatus"], "P"), part="done")), "SELECT o_orderkey AS id, o_orderstatus AS status, 'low' AS part FROM orders WHERE o_totalprice < 20000 UNION ALL SELECT o_orderkey, o_orderstatus, 'done' FROM orders WHERE o_orderstatus = 'P'")

# recursion: customers as a tree, each below the one with half its number
_UP = Typed(function("floor", divided_by(Typed(C["c_custkey"], "double"), 2.0)), "bigint")
_NODES = select_from(C, C["c_custkey"].named("id"), _UP.named("parent"), C["c_name"].named("name"))
_LEVELS = Source("levels", _NODES.where(lambda f: f.eq(C["c_custkey"], 1)), key=("id",)).recursive("id", "parent", 40, depth="level", links=_NODES.where(lambda f: f.gt(C["c_custkey"], 1)))
_set("recursive_levels", _LEVELS, "WITH RECURSIVE t AS (SELECT c_custkey AS id, c_custkey // 2 AS parent, c_name AS name, 0::BIGINT AS level FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, c.c_custkey // 2, c.c_name, t.level + 1 FROM customer c JOIN t ON c.c_custkey // 2 = t.id WHERE c.c_custkey > 1) SELECT id, parent, name, level FROM t")
_TREE = Source("tree", _NODES.where(lambda f: f.eq(C["c_custkey"], 3)), key=("id",)).recursive("id", "parent", 40, tree=True)
_set("tree_check", _TREE, "WITH RECURSIVE t AS (SELECT c_custkey AS id, c_custkey // 2 AS parent, c_name AS name FROM customer WHERE c_custkey = 3 UNION ALL SELECT c.c_custkey, c.c_custkey // 2, c.c_name FROM customer c JOIN t ON c.c_custkey // 2 = t.id) SELECT id, parent, name FROM t")

# pages and keys
_PAGED = select_from(O, O["o_orderkey"], O["o_orderdate"]).order_by(O["o_orderdate"].desc())
_put("offset_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")(lambda e: e.page_frame(_PAGED, 40, 20))
_put("keys_first_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 500")(lambda e: e.page_frame(_PAGED.primary_key_first(), 500, 20))


_put("inline_count", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10)")(lambda e: (lambda p: e.catalog.spark.createDataFrame([(r["o_orderkey"], p.total) for r in p.items], "o_orderkey long, total long"))(e.page(_order(lambda f: f.eq(O["o_orderstatus"], "F")), 0, 10, "inline_count")))

_put("by_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 17, 3)")(lambda e: e.catalog.spark.createDataFrame([tuple(r) for r in e.by_keys(select_from(C, C["c_custkey"], C["c_name"]), [5, 999999999, 17, 3, 5]).values()], "c_custkey long, c_name string"))
_put("by_composite_keys", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) IN ((1, 0), (2, 1))")(lambda e: e.catalog.spark.createDataFrame([tuple(r) for r in e.by_keys(select_from(CV, *CV.cols("conv_id", "turn", "role")), [(1, 0), (2, 1)]).values()], "conv_id long, turn long, role string"))
_put("field_index", "SELECT o_orderkey, c_name AS customer_name FROM orders JOIN customer ON o_custkey = c_custkey")(FieldIndex(select_from(O, O["o_orderkey"], O["o_totalprice"], OC["c_name"].named("customer_name"))).select("o_orderkey,customer_name,nothing"))

# children
_put("fetch_children", "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(CAST(sum(l_linenumber) AS BIGINT), 0) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(
    lambda e: e.frame(select_from(O, O["o_orderkey"]).child(child("lines", O, "lines", lambda t: [t["l_linenumber"], t["l_quantity"]], "o_orderkey", lambda t: [t["l_linenumber"].asc()]))).select("o_orderkey", F.size("lines").cast("long").alias("n"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["l_linenumber"]).alias("s"))
)
_put("fetch_through_link", "SELECT o_orderkey, p_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")(
    lambda e: e.frame(_order(lambda f: f).child(child("parts", O, "parts", lambda t: [t["p_partkey"]], "o_orderkey"))).select("o_orderkey", F.explode("parts.p_partkey").alias("p_partkey"))
)

# writes
_put("update_rows", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer")(lambda e: Writer(e).update(Update(C).set("c_acctbal", plus(C["c_acctbal"], 100.0)).where(lambda f: f.eq(C["c_mktsegment"], "BUILDING"))).after.select("c_custkey", "c_acctbal"))
_put("update_by_join", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey")(lambda e: Writer(e).update(Update(O).set("o_orderstatus", "X").where(lambda f: f.eq(OC["c_mktsegment"], "MACHINERY"))).after.select("o_orderkey", "o_orderstatus"))
_put("delete_rows", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")(lambda e: Writer(e).delete(Delete(O).where(lambda f: f.exists(O.join("lines"), lambda g: g.gt(O.join("lines")["l_quantity"], 40)))).after.select("o_orderkey"))
_put("insert_select", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey < 5")(lambda e: Writer(e).insert(Insert(N, select_from(N, plus(N["n_nationkey"], 100).named("id"), N["n_name"].named("name")).where(lambda f: f.lt(N["n_nationkey"], 5))).map("n_nationkey", "id").map("n_name", "name").set("n_regionkey", 0)).after.select("n_nationkey", "n_name"))
_put("upsert", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'NEW' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 90, 'ADDED'")(lambda e: Writer(e).insert(Insert(N, rows=({"n_nationkey": 3, "n_name": "NEW", "n_regionkey": 1}, {"n_nationkey": 90, "n_name": "ADDED", "n_regionkey": 1})).on_conflict(Conflict(("n_nationkey",)).set_from_row("n_name"))).after.select("n_nationkey", "n_name"))
_put("insert_do_nothing", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 90, 'ADDED'")(lambda e: Writer(e).insert(Insert(N, rows=({"n_nationkey": 3, "n_name": "NEW", "n_regionkey": 1}, {"n_nationkey": 90, "n_name": "ADDED", "n_regionkey": 1})).on_conflict(Conflict(("n_nationkey",)).do_nothing())).after.select("n_nationkey", "n_name"))
