import pytest

from skeinql.errors import Code, Refused
from skeinql.functions import correlated as sub
from skeinql.functions.expr import Agg, cases, constant, divided_by, function, lifted, next_value, null_if, plus, rounded, times, window
from skeinql.functions.operators import ARRAY_CONTAINS, FULL_TEXT_MATCH, ILIKE, JSON_CONTAINS, REGEX_MATCH
from skeinql.plans.filters import conditions, maybe
from skeinql.plans.query import FieldIndex, Nested, Query, select_from
from tests.fixture import SCHEMA, engine, items_rows, orders_rows, sort_rows

O, C, I, S, G, NUM = map(SCHEMA.root, ("orders", "customers", "items", "sorts", "groups", "numbers"))


def ids(e, build, root=S):
    return sorted(r[0] for r in e.list(select_from(root, root["id"]).where(build)))


def refused(code):
    return pytest.raises(Refused, match=code.value)


def test_values_keep_nulls_where_they_should(spark):
    e, rows = engine(spark), sort_rows()
    assert ids(e, lambda f: f.eq(S["n"], 1)) == [r[0] for r in rows if r[1] == 1]
    assert ids(e, lambda f: f.ne(S["n"], 1)) == [r[0] for r in rows if r[1] != 1]
    assert ids(e, lambda f: f.not_in(S["n"], [1, 2])) == [r[0] for r in rows if r[1] not in (1, 2)]
    assert ids(e, lambda f: f.not_(lambda g: g.eq(S["n"], 1))) == [r[0] for r in rows if r[1] not in (1, None)]
    assert ids(e, lambda f: f.compare(S["n"], "ne", 1)) == [r[0] for r in rows if r[1] not in (1, None)]
    assert ids(e, lambda f: f.distinct_from(S["n"], 1)) == [r[0] for r in rows if r[1] != 1]
    assert ids(e, lambda f: f.not_distinct_from(S["n"], None)) == [r[0] for r in rows if r[1] is None]
    assert ids(e, lambda f: f.not_distinct_from_column(S["n"], null_if(S["n"], 2))) == [r[0] for r in rows if r[1] != 2]
    assert ids(e, lambda f: f.distinct_from_column(S["n"], null_if(S["n"], 2))) == [r[0] for r in rows if r[1] == 2]


def test_empty_sets_and_absent_values(spark):
    e, every = engine(spark), [r[0] for r in sort_rows()]
    assert ids(e, lambda f: f.is_in(S["n"], [])) == []
    assert ids(e, lambda f: f.not_in(S["n"], [])) == every
    assert ids(e, lambda f: f.or_list([])) == []
    assert ids(e, lambda f: f.or_(lambda g: g.eq(S["n"], maybe()))) == every
    assert ids(e, lambda f: f.not_(lambda g: g)) == every
    skipped = conditions(lambda f: f.eq(S["n"], maybe()).range(S["n"], maybe(), maybe()).between(S["n"], maybe(), maybe()).is_in(S["n"], maybe()).not_in(S["n"], maybe()).like(S["t"], maybe()).is_null(S["t"], maybe()).when(False, lambda g: g.eq(S["n"], 1)))
    assert skipped.terms == ()
    assert ids(e, lambda f: f.or_(lambda g: g.eq(S["n"], maybe()), lambda g: g.eq(S["n"], 1))) == [r[0] for r in sort_rows() if r[1] == 1]


def test_text(spark):
    e = engine(spark)
    assert ids(e, lambda f: f.like(C["name"], "C0", "starts").like(C["name"], "3", "ends"), C) == [3]
    assert ids(e, lambda f: f.like(C["name"], "C_3", "exact"), C) == [3]
    assert ids(e, lambda f: f.like(C["name"], "_3"), C) == []
    assert ids(e, lambda f: f.like_ignore_case(C["email"], "X.ORG", "ends").eq_ignore_case(C["name"], "c05"), C) == [5]
    assert ids(e, lambda f: f.op(ILIKE, C["name"], "c1%"), C) == [10, 11]
    assert ids(e, lambda f: f.op(REGEX_MATCH, C["name"], "^C0[12]$"), C) == [1, 2]
    assert ids(e, lambda f: f.op(ARRAY_CONTAINS, function("split", C["email"], "@"), ["c4", "X.org"]), C) == [4]
    assert ids(e, lambda f: f.op(FULL_TEXT_MATCH, C["email"], "x C7"), C) == [7]
    assert ids(e, lambda f: f.op(JSON_CONTAINS, constant('{"a": 1, "b": 2}'), '{"b": 2}').eq(C["id"], 1), C) == [1]
    assert ids(e, lambda f: f.not_(lambda g: g.op(REGEX_MATCH, S["t"], "t1"))) == [r[0] for r in sort_rows() if r[2] not in ("t1", None)]


def test_refusals_of_values():
    with refused(Code.NULL_VALUE):
        conditions(lambda f: f.eq(S["n"], None))
    with refused(Code.UNBINDABLE):
        lifted([1])
    kept = []
    conditions(kept.append)
    with refused(Code.BUILDER_ESCAPED):
        kept[0].eq(S["n"], 1)
    with refused(Code.BAD_FUNCTION):
        function("sum", S["n"])
    with refused(Code.EMPTY_CASE_CONDITION):
        cases().when(lambda f: f, 1)
    with refused(Code.SEQUENCE):
        next_value("s")
    with refused(Code.OUTSIDE_PATH):
        conditions(lambda f: f.exists(O.join("items"), lambda g: g.eq(O["id"], 1)))
    with refused(Code.NOTHING_LIFTED):
        conditions(lambda f: f.exists_sub(sub.sub(I)))
    with refused(Code.LIFT_TO_MANY):
        sub.outer(O.join("items")["id"])


def test_other_rows(spark):
    e = engine(spark)
    with_items = sorted({r[1] for r in items_rows()})
    lines = O.join("items")
    assert ids(e, lambda f: f.exists(lines), O) == with_items
    assert ids(e, lambda f: f.not_exists(lines), O) == [o for o in range(40) if o % 5 == 0]
    assert ids(e, lambda f: f.exists(lines, lambda g: g.gt(lines["quantity"], 4)), O) == sorted({r[1] for r in items_rows() if r[3] > 4})
    assert ids(e, lambda f: f.or_(lambda g: g.eq(O["id"], 0), lambda g: g.exists(lines, lambda h: h.gt(lines["quantity"], 4))), O) == sorted({0} | {r[1] for r in items_rows() if r[3] > 4})
    labels = O.join("labels")
    assert ids(e, lambda f: f.exists(labels, lambda g: g.eq(labels["name"], "L0")), O) == [0, 1, 4]
    s = sub.sub(O, O["referrer_id"])
    assert ids(e, lambda f: f.in_sub(C["id"], s), C) == sorted({r[5] for r in orders_rows() if r[5] is not None})
    assert ids(e, lambda f: f.not_in_sub(C["id"], s), C) == sorted(set(range(12)) - {r[5] for r in orders_rows()})
    more = sub.sub(O).where(lambda g: g.compare(O["customer_id"], "eq", sub.outer(C["id"])).gt(O["total"], 450))
    assert ids(e, lambda f: f.exists_sub(more), C) == sorted({r[1] for r in orders_rows() if r[3] > 450})
    through = O.join("customer")
    assert ids(e, lambda f: f.exists(through.join("orders"), lambda g: g.gt(through.join("orders")["total"], 500)), O) == [r[0] for r in orders_rows() if r[1] in {x[1] for x in orders_rows() if x[3] > 500}]


def test_filter_on_many_does_not_multiply(spark):
    e = engine(spark)
    lines = O.join("items")
    q = select_from(O, O["id"]).where(lambda f: f.gt(lines["quantity"], 0))
    assert len(e.list(q)) == e.count(q) == len({r[1] for r in items_rows() if r[3] > 0})
    both = q.select(lines["code"].named("code"))
    assert len(e.list(both)) == sum(r[3] > 0 for r in items_rows())
    assert "LeftSemi" in e.explain(q)
    grouped = select_from(O, Agg.count(O).named("n")).where(lambda f: f.gt(lines["quantity"], 0))
    assert e.list(grouped)[0]["n"] == e.count(q)


def test_joins(spark):
    e = engine(spark)
    r = O.join("referrer")
    q = select_from(O, O["id"], Nested("referrer", r, (r["id"].named("id"), r["name"].named("name"))))
    rows = {x["id"]: x["referrer"] for x in e.list(q)}
    assert rows[1] is None and rows[3]["name"] == "C04"
    assert len(e.list(select_from(O, O["id"], O.join("referrer", "inner")["name"].named("name")))) == sum(x[5] is not None for x in orders_rows())
    either = select_from(O, O["id"]).where(lambda f: f.or_(lambda g: g.eq(O.join("referrer", "inner")["name"], "C04"), lambda g: g.lt(O["id"], 2)))
    assert sorted(x[0] for x in e.list(either)) == sorted({0, 1} | {x[0] for x in orders_rows() if x[5] == 4})
    blank = select_from(O, O["id"], r["name"].named("name")).join_filter(r, lambda f: f.eq(r["country"], "DE"))
    assert {x["id"]: x["name"] for x in e.list(blank)} == {x[0]: f"C{x[5]:02d}" if x[5] is not None and x[5] % 4 == 0 else None for x in orders_rows()}
    with refused(Code.JOIN_FILTER):
        blank.join_filter(r, lambda f: f.eq(O["status"], "NEW"))
    with refused(Code.CONDITION_NEEDS_ALIAS):
        O.join("referrer", on=lambda f: f)
    n = SCHEMA.root("notes")
    assert [(x["id"], x["name"]) for x in e.list(select_from(n, n["id"], n.join("customer")["name"].named("name")).order_by(n["id"].asc()))] == [(1, "C01"), (2, None)]
    assert "Join" not in e.explain(select_from(O, O["id"]).where(lambda f: f.eq(O.join("customer")["name"], maybe())))
    h = SCHEMA.root("holders")
    assert [x["card"] for x in e.list(select_from(h, h["id"], h.join("card")["id"].named("card")).order_by(h["id"].asc()))] == [None, 10, 11, None]


def test_subtypes(spark):
    e, v = engine(spark), SCHEMA.root("vehicles")
    assert ids(e, lambda f: f.of_type(v, "Truck"), v) == [2, 3]
    assert ids(e, lambda f: f.of_type(v), v) == []
    assert ids(e, lambda f: f.not_of_type(v, "Truck"), v) == [1, 4]
    q = select_from(v, v["id"], v.treat("Car")["colour"].named("colour"), v.treat("Truck")["wheels"].named("wheels")).order_by(v["id"].asc())
    assert [tuple(r) for r in e.list(q)] == [(1, "red", None), (2, None, 6), (3, None, 8), (4, None, None)]


def test_definitions_are_checked():
    with refused(Code.NO_SELECTION):
        Query(O).checked()
    with refused(Code.DUPLICATE_NAME):
        select_from(O, O["id"], O["status"].named("id")).checked()
    with refused(Code.FOREIGN_COLUMN):
        select_from(O, C["id"]).checked()
    with refused(Code.NOT_GROUPED):
        select_from(O, O["id"], Agg.count(O).named("n")).checked()
    with refused(Code.ORDER_NOT_GROUPED):
        select_from(O, Agg.count(O).named("n")).order_by(O["id"].asc()).checked()
    with refused(Code.HAVING_WITHOUT_GROUPS):
        select_from(O, O["id"]).having(lambda h: h.eq(O["id"], 1)).checked()
    with refused(Code.GROUP_BY_AGGREGATE):
        select_from(O, Agg.count(O).named("n")).group_by(Agg.count(O)).checked()
    with refused(Code.WINDOW):
        select_from(O, window("row_number", order_by=[O["id"].asc()]).named("r")).checked()
    with refused(Code.UNKNOWN_NAME):
        O.join("nothing")
    a = O.join("items", alias="x", on=lambda f: f.gt(O.join("items", alias="x")["quantity"], 1))
    b = O.join("items", alias="x", on=lambda f: f.gt(O.join("items", alias="x")["quantity"], 2))
    with refused(Code.SAME_JOIN_OTHER_CONDITION):
        select_from(O, a["id"].named("a"), b["code"].named("b")).checked()
    count = sub.count(sub.sub(I).where(lambda g: g.compare(I["order_id"], "eq", sub.outer(O["id"]))))
    with refused(Code.AGGREGATE_OF_CORRELATED):
        select_from(O, Agg.max(count).named("n")).checked()
    with refused(Code.CORRELATED_GROUP_KEY):
        select_from(O, Agg.count(O).named("n")).group_by(count).checked()


def test_field_index():
    r = O.join("referrer")
    q = select_from(O, O["id"], O["status"], Nested("referrer", r, (r["id"].named("id"), r["name"].named("name"))))
    index = FieldIndex(q)
    assert index.resolve("id,referrer.name, nope") == (["id", "referrer.name"], ["nope"])
    assert [i.name if isinstance(i, Nested) else None for i in index.select("id,referrer.name").items] == [None, "referrer"]
    assert len(index.select("referrer.name").items[0].items) == 1


def test_expressions(spark):
    e = engine(spark)
    q = select_from(NUM, NUM["id"], rounded(NUM["d"], 2).named("r"), plus(NUM["i"], 1).named("p"), times(NUM["b"], 2).named("t"), divided_by(NUM["d"], 2).named("h")).order_by(NUM["id"].asc())
    rows = e.list(q)
    assert [float(r["r"]) for r in rows] == [2.35, -2.35, 2.5, -2.5]
    assert [(r["p"], r["t"]) for r in rows] == [(2, 20), (3, 40), (3, 60), (2, 80)]
    with refused(Code.INTEGRAL_DIVISION):
        e.list(select_from(NUM, divided_by(NUM["i"], 2).named("x")))
    assert e.one(select_from(C, C["name"]), 3)["name"] == "C03"
