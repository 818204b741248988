"""What is refused, case by case: each query gives (case, code) as found, its SQL as it must be."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from skeinql.entries.common import table
from skeinql.errors import Refused
from skeinql.functions import correlated as sub
from skeinql.functions.expr import Agg, Typed, cases, constant, divided_by, function, next_value, null_if, param, plus, rounded, window
from skeinql.functions.operators import ILIKE
from skeinql.operators.engine import Engine, KeyGroups
from skeinql.operators.fetch import Enricher, child
from skeinql.operators.write import Conflict, Delete, Insert, Update, Writer
from skeinql.plans.filters import Filters
from skeinql.plans.query import FieldIndex, Nested, Source, select_from
from skeinql.plans.schema import Entity, Schema
from skeinql.queries import _NODES, _OF, _TOTALS, DL, SCHEMA, C, D, E, L, N, O, _half, _money, _put
from skeinql.declare import column, model
from skeinql.sources.catalog import Catalog


def _refusals(name: str, **wanted: tuple[str, Callable]) -> None:
    """Registers a query of cases, each (code's name, function of an engine)."""
    rows = ", ".join(f"('{case}', '{code}')" for case, (code, _) in wanted.items())

    def run(e: Engine):
        return table(e, [(case, _code(lambda f=f: f(e))) for case, (_, f) in wanted.items()], "refused string, code string")

    _put(name, f"SELECT * FROM (VALUES {rows}) t(refused, code)")(run)


def _code(call: Callable) -> str:
    try:
        call()
    except Refused as r:
        return r.code.name
    except Exception as x:  # raised by rows, on an executor
        found = re.search(r"SK\d{3} ([A-Z_]+)", str(x))
        return found[1] if found else type(x).__name__
    return "nothing"


_Q = select_from(O, O["o_orderkey"])
_LINES = O.join("lines")
_FLAT = Source("flat", select_from(L, L["l_orderkey"].named("id")), key=("id",))
_STATUS = select_from(O, O["o_orderstatus"].named("status"), Agg.count(O).named("n")).group_by(O["o_orderstatus"])


@model(SCHEMA, "orders")
class _Mistyped:
    id = column("o_orderkey", type="string")


_refusals(
    "refusals_columns",
    another_root=("FOREIGN_COLUMN", lambda e: e.frame(select_from(O, C["c_name"]))),
    same_join_other_condition=("SAME_JOIN_OTHER_CONDITION", lambda e: e.frame(select_from(O, O.join("lines", alias="x", on=lambda f: f.gt(_LINES["l_quantity"], 1))["l_tax"].named("a"), O.join("lines", alias="x", on=lambda f: f.gt(_LINES["l_quantity"], 2))["l_discount"].named("b")))),
    condition_without_alias=("CONDITION_NEEDS_ALIAS", lambda e: O.join("lines", on=lambda f: f.gt(_LINES["l_quantity"], 1))),
    no_such_relation=("UNKNOWN_NAME", lambda e: O.join("nobody")),
    two_items_of_a_name=("DUPLICATE_NAME", lambda e: e.frame(select_from(O, O["o_orderkey"].named("a"), O["o_custkey"].named("a")))),
    nothing_selected=("NO_SELECTION", lambda e: e.frame(select_from(O))),
    expression_without_name=("NO_SELECTION", lambda e: e.frame(select_from(O, plus(O["o_orderkey"], 1)))),
    declared_type=("TYPE_MISMATCH", lambda e: e.list(_Mistyped.query(), 1)),
    right_join=("UNKNOWN_NAME", lambda e: O.join("customer", "right")),
)
_refusals(
    "refusals_keys",
    keyset_without_key=("NEEDS_KEY", lambda e: e.keyset(select_from(L, L["l_orderkey"]), 5)),
    keys_first_without_key=("NEEDS_KEY", lambda e: e.page(select_from(L, L["l_orderkey"]).primary_key_first(), 0, 5)),
    by_keys_without_key=("NEEDS_KEY", lambda e: e.by_keys(select_from(L, L["l_orderkey"]), [1])),
    float_keyset=("FLOAT_KEYSET", lambda e: e.keyset(_Q.order_by(O["o_totalprice"].asc()), 5)),
    expression_keyset=("EXPRESSION_KEYSET", lambda e: e.keyset(_Q.order_by(plus(O["o_custkey"], 1).asc()), 5)),
    null_in_keyset=("NULL_IN_KEYSET", lambda e: e.keyset(select_from(D, D["doc_id"]).order_by(DL["quality"].asc()), 5)),
    keyset_of_groups=("KEYSET_ON_GROUPS", lambda e: e.keyset(_STATUS, 5)),
    foreign_cursor=("FOREIGN_CURSOR", lambda e: e.keyset(_Q, 5, after=e.keyset(_Q.order_by(O["o_orderdate"].asc()), 5).next_cursor)),
    rubbish_cursor=("FOREIGN_CURSOR", lambda e: e.keyset(_Q, 5, after="rubbish")),
    keyset_to_many=("TO_MANY_SELECTION", lambda e: e.keyset(select_from(O, O["o_orderkey"], _LINES["l_tax"].named("t")), 5)),
    by_keys_to_many=("TO_MANY_SELECTION", lambda e: e.by_keys(select_from(O, O["o_orderkey"], _LINES["l_tax"].named("t")), [1])),
    keyset_of_a_source_that_repeats=("SOURCE_NOT_UNIQUE", lambda e: e.keyset(select_from(_FLAT.table(), _FLAT.table()["id"]), 5)),
    null_group=("NULL_GROUP", lambda e: e.by_keys(_Q, [1], KeyGroups.by(lambda k: None, O["o_custkey"]))),
    two_groups_for_all=("TWO_CATCH_ALLS", lambda e: KeyGroups.by(lambda k: k).group_when(lambda k, g: True, 1).verify_missing(2)),
)
_refusals(
    "refusals_filters",
    null_value=("NULL_VALUE", lambda e: _Q.where(lambda f: f.eq(O["o_orderstatus"], None))),
    outside_the_path=("OUTSIDE_PATH", lambda e: _Q.where(lambda f: f.exists(_LINES, lambda g: g.gt(O["o_totalprice"], 1)))),
    path_without_relation=("OUTSIDE_PATH", lambda e: _Q.where(lambda f: f.exists(O))),
    builder_escaped=("BUILDER_ESCAPED", lambda e: _escaped().eq(O["o_orderkey"], 1)),
    nothing_lifted=("NOTHING_LIFTED", lambda e: _Q.where(lambda f: f.exists_sub(sub.sub(C).where(lambda g: g.eq(C["c_custkey"], 1))))),
    lifted_to_many=("LIFT_TO_MANY", lambda e: sub.outer(_LINES["l_tax"])),
    unknown_comparison=("UNKNOWN_NAME", lambda e: _Q.where(lambda f: f.compare(O["o_orderkey"], "like", O["o_custkey"]))),
    join_filter_of_inner=("JOIN_FILTER", lambda e: _Q.join_filter(O.join("customer", "inner"), lambda f: f.eq(O.join("customer", "inner")["c_name"], "x"))),
    join_filter_of_another=("JOIN_FILTER", lambda e: _Q.join_filter(O.join("customer"), lambda f: f.eq(O["o_orderkey"], 1))),
    correlated_group_key=("CORRELATED_GROUP_KEY", lambda e: e.frame(select_from(C, Agg.count(C).named("n")).group_by(sub.count(_OF)))),
)


def _escaped() -> Filters:
    kept: list = []
    _Q.where(lambda f: kept.append(f.eq(O["o_orderkey"], 1)))
    return kept[0]


_refusals(
    "refusals_groups",
    no_key=("NOT_GROUPED", lambda e: e.frame(select_from(O, O["o_custkey"], Agg.count(O).named("n")).group_by(O["o_orderstatus"]))),
    nested_in_groups=("NOT_GROUPED", lambda e: e.frame(_STATUS.select(Nested("c", O.join("customer"), (O.join("customer")["c_name"],))))),
    sum_of_text=("SUM_TYPE", lambda e: e.frame(select_from(O, Agg.sum(O["o_orderstatus"]).named("s")).group_by())),
    sum_of_ints=("SUM_TYPE", lambda e: e.frame(select_from(C, Agg.sum(C["c_nationkey"]).named("s")).group_by())),
    key_is_an_aggregate=("GROUP_BY_AGGREGATE", lambda e: e.frame(select_from(O, Agg.count(O).named("n")).group_by(Agg.count(O)))),
    order_outside_groups=("ORDER_NOT_GROUPED", lambda e: e.frame(_STATUS.order_by(O["o_custkey"].asc()))),
    having_without_groups=("HAVING_WITHOUT_GROUPS", lambda e: e.frame(_Q.having(lambda h: h.gt(O["o_orderkey"], 1)))),
    exact_average_of_doubles=("EXACT_AVERAGE", lambda e: e.frame(select_from(O, Agg.avg_exact(O["o_totalprice"]).named("a")).group_by())),
    scale_of_31=("EXACT_AVERAGE", lambda e: Agg.round(Agg.avg_exact(_money(O["o_totalprice"])), 31)),
    rounded_count=("EXACT_AVERAGE", lambda e: Agg.round(Agg.count(O), 1)),
    two_aggregate_filters=("AGGREGATE_FILTER", lambda e: Agg.count(O).filter(lambda f: f.eq(O["o_orderkey"], 1)).filter(lambda f: f.eq(O["o_orderkey"], 2))),
    empty_aggregate_filter=("AGGREGATE_FILTER", lambda e: Agg.count(O).filter(lambda f: f)),
    filtered_custom_aggregate=("AGGREGATE_FILTER", lambda e: Agg.of("x", F.max, O["o_orderkey"]).filter(lambda f: f.eq(O["o_orderkey"], 1))),
    chosen_key_unknown=("UNKNOWN_NAME", lambda e: _STATUS.grouped_by("n")),
)
_refusals(
    "refusals_expressions",
    unbindable=("UNBINDABLE", lambda e: constant(object())),
    integral_division=("INTEGRAL_DIVISION", lambda e: e.frame(select_from(O, divided_by(O["o_orderkey"], O["o_custkey"]).named("x")))),
    empty_case=("EMPTY_CASE_CONDITION", lambda e: cases().when(lambda f: f, 1)),
    case_with_exists=("CASE_CONDITION", lambda e: cases().when(lambda f: f.exists(_LINES), 1)),
    case_with_operator=("CASE_CONDITION", lambda e: cases().when(lambda f: f.op(ILIKE, O["o_orderstatus"], "x"), 1)),
    case_with_predicate=("CASE_CONDITION", lambda e: cases().when(lambda f: f.add("x", lambda c: c > 1, O["o_orderkey"]), 1)),
    function_name=("BAD_FUNCTION", lambda e: function("drop table", O["o_orderkey"])),
    aggregate_as_function=("BAD_FUNCTION", lambda e: function("sum", O["o_orderkey"])),
    aggregate_of_correlated=("AGGREGATE_OF_CORRELATED", lambda e: e.frame(select_from(C, Agg.max(sub.count(_OF)).named("x")).group_by())),
    unbound_parameter=("UNBOUND_PARAM", lambda e: e.frame(_Q.where(lambda f: f.compare(O["o_orderstatus"], "eq", param("status"))))),
    sequence=("SEQUENCE", lambda e: next_value("ids")),
    rounding_scale=("EXACT_AVERAGE", lambda e: rounded(O["o_totalprice"], -1)),
    type_without_subtypes=("UNKNOWN_NAME", lambda e: __import__("skeinql.functions.expr", fromlist=["type_of"]).type_of(O)),
)
_refusals(
    "refusals_writes",
    no_rows_chosen=("EMPTY_WRITE_FILTER", lambda e: Writer(e).update(Update(O).set("o_orderstatus", "X"))),
    nothing_assigned=("EMPTY_WRITE_FILTER", lambda e: Writer(e).update(Update(O).all())),
    delete_without_rows=("EMPTY_WRITE_FILTER", lambda e: Writer(e).delete(Delete(O))),
    assigned_twice=("ASSIGNED_TWICE", lambda e: Update(O).set("o_orderstatus", "X").set("o_orderstatus", "Y")),
    null_assigned=("NULL_ASSIGNED", lambda e: Update(O).set("o_orderstatus", None)),
    key_assigned=("KEY_ASSIGNED", lambda e: Update(O).set("o_orderkey", 1)),
    conflict_without_word=("CONFLICT_CLAUSE", lambda e: Insert(N).on_conflict(Conflict(("n_nationkey",)))),
    conflict_on_nothing=("CONFLICT_CLAUSE", lambda e: Writer(e).insert(Insert(N, rows=({"n_nationkey": 1},)).on_conflict(Conflict(("nope",)).do_nothing()))),
    conflict_key_set=("KEY_ASSIGNED", lambda e: Conflict(("n_nationkey",)).set("n_nationkey", 1)),
    shared_conflict_key=("SHARED_CONFLICT_KEY", lambda e: Writer(e).insert(Insert(N, rows=({"n_nationkey": 1, "n_name": "a"}, {"n_nationkey": 1, "n_name": "b"})).on_conflict(Conflict(("n_nationkey",)).set_from_row("n_name"))).count()),
    unknown_column=("UNKNOWN_NAME", lambda e: Writer(e).insert(Insert(N, rows=({"nope": 1},)))),
    inserted_twice=("ASSIGNED_TWICE", lambda e: Insert(N).set("n_name", "a").set("n_name", "b")),
    stale_version=("STALE_VERSION", lambda e: _stale(e)),
    expected_without_version=("STALE_VERSION", lambda e: Writer(e).update(Update(N).set("n_name", "x").where_keys(1).expect_version(1))),
    chunks_of_no_size=("PAGE_SIZE", lambda e: next(Writer(e).chunks(Delete(C).all(), 0))),
    chunks_of_pairs=("NEEDS_KEY", lambda e: next(Writer(e).chunks(Delete(SCHEMA.root("conversations")).all(), 5))),
)


def _stale(e: Engine) -> None:
    schema = Schema(Entity("nation", ("n_nationkey",), version="version"))
    t = schema.root("nation")
    other = Engine(Catalog(e.catalog.spark, {"nation": e.catalog.frame("nation").withColumn("version", F.lit(2))}))
    Writer(other).update(Update(t).set("n_name", "x").where_keys(1).expect_version(1)).count()


_refusals(
    "refusals_sources",
    source_not_unique=("SOURCE_NOT_UNIQUE", lambda e: O.joined_source(_FLAT, {"id": O["o_orderkey"]})),
    part_of_the_key=("SOURCE_NOT_UNIQUE", lambda e: C.joined_source(_TOTALS, {"n": C["c_custkey"]})),
    entity_on_part_of_its_key=("SOURCE_NOT_UNIQUE", lambda e: O.entity_join("conversations", {"turn": O["o_orderkey"]})),
    no_depth=("RECURSION_STEP", lambda e: Source("x", _NODES).recursive("id", "parent", 0)),
    step_of_unknown_fields=("RECURSION_STEP", lambda e: Source("x", _NODES).recursive("id", "nope", 4)),
    recursion_over_groups=("RECURSION_STEP", lambda e: _TOTALS.recursive("customer", "n", 4)),
    discriminator_is_a_field=("DISCRIMINATOR", lambda e: Source("x", select_from(O, O["o_orderkey"].named("id")), discriminators={"id": 1})),
    two_branches_of_one_tag=("DISCRIMINATOR", lambda e: _half("a", lambda f: f, part="x").union_all(_half("b", lambda f: f, part="x"))),
    recursive_branch=("SHAPE", lambda e: Source("x", _NODES).recursive("id", "parent", 4).union(Source("y", _NODES))),
    other_fields=("SHAPE", lambda e: _half("a", lambda f: f).union(Source("y", select_from(O, O["o_orderkey"].named("id"))))),
    other_types=("SHAPE", lambda e: e.frame((lambda s: select_from(s.table(), s.table()["id"]))(Source("x", select_from(O, O["o_orderkey"].named("id"))).union(Source("y", select_from(O, O["o_orderstatus"].named("id")), key=("id",)))))),
    window_outside_a_source=("WINDOW", lambda e: e.frame(select_from(O, window("row_number", order_by=[O["o_orderkey"].asc()]).named("r")))),
    rank_without_order=("WINDOW", lambda e: window("rank")),
    first_value_without_frame=("WINDOW", lambda e: window("first_value", O["o_orderkey"], order_by=[O["o_orderkey"].asc()])),
    unknown_field=("UNKNOWN_NAME", lambda e: _TOTALS.table()["nope"]),
    within_a_relation=("UNKNOWN_NAME", lambda e: O.join("customer").within(O.join("lines"))),
)
_refusals(
    "refusals_reads",
    page_size=("PAGE_SIZE", lambda e: e.page(_Q, 0, 0)),
    list_limit=("PAGE_SIZE", lambda e: e.list(_Q, -1)),
    export_size=("PAGE_SIZE", lambda e: e.export(_Q, print, size=0)),
    offset=("OFFSET", lambda e: e.page(_Q, -1, 5)),
    two_rows=("TWO_ROWS", lambda e: e.one(_Q)),
    unknown_mode=("UNKNOWN_NAME", lambda e: e.page(_Q, 0, 5, "guess")),
    unknown_sort=("UNKNOWN_SORT", lambda e: _Q.ordered_by([("nope", "asc")])),
    unknown_path=("UNKNOWN_SORT", lambda e: e.list(_Q.ordered_by([("customer.nope", "asc")]), 1)),
    path_over_to_many=("UNKNOWN_SORT", lambda e: _Q.ordered_by([("lines.l_tax", "asc")])),
    duplicate_key=("DUPLICATE_KEY", lambda e: (lambda t: Engine(Catalog(e.catalog.spark, {"n": e.catalog.frame("nation").union(e.catalog.frame("nation"))})).by_keys(select_from(t, t["n_name"]), [1]))(Schema(Entity("n", ("n_nationkey",))).root("n"))),
    exported_twice=("REPEATED_KEY", lambda e: (lambda t: Engine(Catalog(e.catalog.spark, {"n": e.catalog.frame("nation").union(e.catalog.frame("nation"))})).export(select_from(t, t["n_name"]), lambda m: None))(Schema(Entity("n", ("n_nationkey",))).root("n"))),
    customizer_drops=("CUSTOMIZER", lambda e: e.frame(_Q.customized(lambda df: df.drop("o_orderkey")))),
    stream_with_finisher=("CUSTOMIZER", lambda e: next(e.stream(_Q.mapped(lambda r: r, lambda m: m)))),
    field_index_only=("UNKNOWN_NAME", lambda e: FieldIndex(_Q).only("nope")),
    field_index_empty_set=("UNKNOWN_NAME", lambda e: FieldIndex(_Q, sets={"s": ["gone"]}).only("s")),
)
_refusals(
    "refusals_children",
    two_for_one=("TWO_CHILDREN", lambda e: e.list(select_from(C, C["c_custkey"]).child(child("order", C, "orders", lambda t: [t["o_orderkey"]], "c_custkey", single=True)), 50)),
    more_than_most=("TOO_MANY_CHILDREN", lambda e: e.list(select_from(C, C["c_custkey"]).child(child("orders", C, "orders", lambda t: [t["o_orderkey"]], "c_custkey", most=1)), 50)),
    enricher_size=("ENRICHER_SIZE", lambda e: e.list(_Q.enrich(Enricher.of("x", lambda rows: [1])), 5)),
    enricher_of_nothing=("ENRICHER_SIZE", lambda e: e.list(_Q.enrich(Enricher.of("x", lambda rows: None)), 5)),
    lookup_of_nothing=("LOOKUP_NOTHING", lambda e: e.list(_Q.enrich(Enricher.by_key("x", "o_orderkey", lambda keys: None)), 5)),
    child_twice=("PLAN_TWICE", lambda e: _Q.child(_LINED).child(_LINED)),
    plan_of_no_join=("UNKNOWN_NAME", lambda e: _Q.join_plan("customer", _LINED)),
)
_LINED = child("lines", O, "lines", lambda t: [t["l_tax"]], "o_orderkey")
_LOOP = select_from(C, C["c_custkey"].named("id"), Typed(function("pmod", C["c_custkey"], 3), "bigint").named("parent"))
_CHAIN = select_from(C, C["c_custkey"].named("id"), plus(C["c_custkey"], -1).named("parent")).where(lambda f: f.lte(C["c_custkey"], 9))


def _walk(seeds, links, most: int, tree: bool = False):
    s = Source("walk", seeds, key=("id",)).recursive("id", "parent", most, tree=tree, links=links)
    t = s.table()
    return lambda e: e.list(select_from(t, t["id"]))


_LINKS = select_from(E, Typed(function("pmod", E["event_id"], 4), "bigint").named("id"), null_if(Typed(function("floor", divided_by(Typed(function("pmod", E["event_id"], 4), "double"), 2.0)), "bigint"), 0).named("parent")).where(lambda f: f.lt(E["event_id"], 8))
_refusals(
    "refusals_recursion",
    too_deep=("TOO_DEEP", _walk(_CHAIN.where(lambda f: f.eq(C["c_custkey"], 1)), _CHAIN, 3)),
    cycle=("CYCLE", _walk(_LOOP.where(lambda f: f.eq(C["c_custkey"], 1)), _LOOP.where(lambda f: f.lt(C["c_custkey"], 3)), 6)),
    node_twice=("DUPLICATE_NODE", _walk(_LINKS.where(lambda f: f.eq(E["event_id"], 1)), _LINKS, 6, True)),
)
