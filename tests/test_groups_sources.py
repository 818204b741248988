import decimal

import pytest
from pyspark.sql import functions as F

from skeinql import queries
from skeinql.errors import Code
from skeinql.functions import correlated as sub
from skeinql.functions.expr import Agg, window
from skeinql.plans.query import Source, select_from
from skeinql.plans.schema import Table
from tests.fixture import SCHEMA, engine, items_rows, orders_rows
from tests.test_filters import refused

O, C, I, G, NUM, FO = map(SCHEMA.root, ("orders", "customers", "items", "groups", "numbers", "folders"))
D = decimal.Decimal


def test_aggregates(spark):
    e = engine(spark)
    r = e.list(select_from(NUM, Agg.sum(NUM["d"]).named("s"), Agg.sum_as_long(NUM["i"]).named("l"), Agg.avg(NUM["i"]).named("a"), Agg.round(Agg.avg_exact(NUM["i"]), 1).named("x"), Agg.count_distinct(NUM["i"]).named("n")))[0]
    assert (r["s"], r["l"], r["a"], r["x"], r["n"]) == (D("0.000"), 6, 1.5, D("1.5"), 2)
    none = e.list(select_from(NUM, Agg.sum(NUM["d"]).named("s"), Agg.count(NUM).named("n"), Agg.avg_exact(NUM["d"]).named("a")).where(lambda f: f.lt(NUM["id"], 0)))[0]
    assert tuple(none) == (None, 0, None)
    with refused(Code.SUM_TYPE):
        e.list(select_from(NUM, Agg.sum(NUM["i"]).named("s")))
    with refused(Code.AGGREGATE_FILTER):
        Agg.count(NUM).filter(lambda f: f)


def test_missed_joins_count_for_none(spark):
    e = engine(spark)
    lines = O.join("items")
    rows = e.list(select_from(O, O["id"].named("id"), Agg.count(lines).named("n"), Agg.sum_as_long(lines["quantity"]).named("q")).group_by(O["id"]))
    assert {r["id"]: r["n"] for r in rows} == {o: 3 if o % 5 else 0 for o in range(40)}
    assert all(r["q"] is None for r in rows if r["id"] % 5 == 0)


def test_filtered_aggregates_and_having(spark):
    e = engine(spark)
    q = select_from(O, O["status"].named("s"), Agg.count(O).filter(lambda f: f.lt(O["id"], 6)).named("few"), Agg.max(O["total"]).filter(lambda f: f.lt(O["id"], 0)).named("none")).group_by(O["status"])
    assert sorted(map(tuple, e.list(q))) == [("CANCELLED", 1, None), ("NEW", 2, None), ("PAID", 2, None), ("SHIPPED", 1, None)]
    h = q.having(lambda f: f.not_(lambda g: g.is_in(Agg.count(O).filter(lambda x: x.lt(O["id"], 6)), [1])))
    assert {r["s"] for r in e.list(h)} == {"NEW", "PAID"}
    assert e.count(h) == 2


def test_first_by_with_ties_and_nulls(spark):
    e = engine(spark)
    q = select_from(G, G["g"].named("g"), Agg.first_by(G["v"], G["k"].desc().nulls_last()).named("d"), Agg.first_by(G["v"], G["k"].asc().nulls_first()).named("a"), Agg.first_by(G["v"], G["state"].desc().nulls_last()).named("s"), Agg.first_by(G["v"], G["k"].asc()).filter(lambda f: f.eq(G["state"], "x")).named("x")).group_by(G["g"])
    assert {r["g"]: tuple(r)[1:] for r in e.list(q)} == {1: ("b", None, None, "b"), 2: (None, "z", None, None), 3: ("n", "n", "n", "n")}


def test_correlated(spark):
    e = engine(spark)
    mine = sub.sub(I).where(lambda f: f.compare(I["order_id"], "eq", sub.outer(O["id"])))
    q = select_from(O, O["id"], sub.count(mine).named("n"), sub.first(mine, I["code"], I["price"].desc()).named("c"), sub.exists(mine).named("x")).order_by(sub.count(mine).desc(), O["id"].asc())
    rows = e.list(q)
    assert [r["id"] for r in rows] == [o for o in range(40) if o % 5] + [o for o in range(40) if o % 5 == 0]
    assert rows[0]["c"] == "P2" and rows[-1]["c"] is None and (rows[0]["x"], rows[-1]["x"]) == (True, False)


def test_windows_order_is_made_total(spark):
    e = engine(spark)
    s = Source("w", select_from(G, G["id"].named("id"), G["g"].named("g"), window("row_number", partition_by=[G["g"]], order_by=[G["k"].desc()]).named("r"), window("rank", partition_by=[G["g"]], order_by=[G["k"].desc()]).named("k"), window("sum", G["id"], partition_by=[G["g"]], order_by=[G["k"].desc()], frame="rows_to_current").named("s")))
    t = s.table()
    rows = {r["id"]: (r["r"], r["k"], r["s"]) for r in e.list(select_from(t, *t.cols("id", "r", "k", "s")))}
    assert rows[1] == (1, 1, 1) and rows[2] == (2, 1, 3) and rows[3] == (3, 3, 6)
    for bad in (lambda: window("first_value", G["v"]), lambda: window("rank"), lambda: window("ntile", G["v"])):
        with refused(Code.WINDOW):
            bad()


def test_outer_filters_come_after_the_window(spark):
    e = engine(spark)
    t = Source("w", select_from(O, O["id"].named("id"), O["customer_id"].named("c"), window("row_number", partition_by=[O["customer_id"]], order_by=[O["total"].desc()]).named("r"))).table()
    top = e.list(select_from(t, *t.cols("id", "c")).where(lambda f: f.lte(t["r"], 1)))
    best = {}
    for o in orders_rows():
        best[o[1]] = max(best.get(o[1], (D(-1), 0)), (o[3], -o[0]))
    assert {r["c"]: r["id"] for r in top} == {c: -b[1] for c, b in best.items()}


def _part(name, test, **tags):
    return Source(name, select_from(O, O["id"].named("id"), O["status"].named("s")).where(test), discriminators=tags)


def test_sets_and_uniqueness(spark):
    e = engine(spark)
    a, b = _part("a", lambda f: f.lt(O["id"], 10)), _part("b", lambda f: f.gte(O["id"], 5).lt(O["id"], 12))
    for s, want in ((a.union(b), 12), (a.union_all(b), 17), (a.intersect(b), 5), (a.except_(b), 5), (a.union(b).except_(a), 2)):
        t = s.table()
        assert e.count(select_from(t, *t.cols("id", "s"))) == want
    assert a.unique and a.intersect(b).unique and a.except_(b).unique and not a.union_all(b).unique and not a.union(b).unique
    x, y = _part("x", lambda f: f, k="x"), _part("y", lambda f: f, k="y")
    tagged = [Source(s.name, s.query.without("k"), key=("id", "k"), discriminators=s.discriminators) for s in (x, y)]
    assert tagged[0].union_all(tagged[1]).unique
    with refused(Code.DISCRIMINATOR):
        x.union_all(_part("z", lambda f: f, k="x"))
    with refused(Code.SHAPE):
        a.union(x)
    with refused(Code.SOURCE_NOT_UNIQUE):
        C.joined_source(a.union_all(b), {"id": C["id"]})


def test_source_and_entity_joins(spark):
    e = engine(spark)
    totals = Source("totals", select_from(O, O["customer_id"].named("customer"), Agg.count(O).named("n")).group_by(O["customer_id"]))
    j = C.joined_source(totals, {"customer": C["id"]})
    assert {r["id"]: r["n"] for r in e.list(select_from(C, C["id"], j["n"].named("n")))} == {i: 4 if i < 10 else None for i in range(12)}
    when = O.entity_join("customers", {"id": O["customer_id"]}, {O["status"]: "NEW"})
    assert all((r["n"] is not None) == (r["status"] == "NEW") for r in e.list(select_from(O, O["status"], when["name"].named("n"))))
    t = totals.table()
    over = e.list(select_from(t, t["n"].named("n"), Agg.count(t).named("c")).group_by(t["n"]))
    assert [tuple(r) for r in over] == [(4, 10)]
    assert isinstance(t, Table)


def _walk(seed, depth, tree=False):
    nodes = select_from(FO, FO["id"].named("id"), FO["parent"].named("parent"))
    return Source("walk", nodes.where(lambda f: f.eq(FO["id"], seed)), key=("id",)).recursive("id", "parent", depth, depth="level", tree=tree).table()


def test_recursion(spark):
    e = engine(spark)
    t = _walk(1, 5)
    assert sorted((r["id"], r["level"]) for r in e.list(select_from(t, *t.cols("id", "level")))) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    for seed, depth, tree, code in ((1, 1, False, Code.TOO_DEEP), (100, 6, False, Code.CYCLE), (200, 6, True, Code.DUPLICATE_NODE)):
        t = _walk(seed, depth, tree)
        with pytest.raises(Exception, match=code.value):
            e.list(select_from(t, t["id"]))
    t = _walk(200, 6)
    assert len(e.list(select_from(t, t["id"]))) == 5
    with refused(Code.RECURSION_STEP):
        _walk(1, 0)


def test_recursion_by_composite_keys(spark):
    e, n = engine(spark), SCHEMA.root("nodes")
    nodes = select_from(n, n["tenant"].named("tenant"), n["id"].named("id"), n["tenant"].named("up_tenant"), n["parent"].named("up"))
    t = Source("nodes", nodes.where(lambda f: f.eq(n["id"], 1)), key=("tenant", "id")).recursive("tenant,id", "up_tenant,up", 4, depth="level", tree=True).table()
    assert sorted(map(tuple, e.list(select_from(t, *t.cols("tenant", "id", "level"))))) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 0), (2, 2, 1)]


def test_items_fixture_is_as_described():
    assert len(items_rows()) == 96


def test_registered_walks_of_a_deep_tree(spark, tmp_path):
    n = 98_400
    spark.range(1, n + 1).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    levels = {r.level: r["count"] for r in queries.QUERIES["recursive_levels"](spark, str(tmp_path)).groupBy("level").count().collect()}
    assert levels == {d: min(2 ** (d + 1), n + 1) - 2**d for d in range(n.bit_length())}
    below, first, last = 0, 3, 3
    while first <= n:
        below, first, last = below + min(last, n) - first + 1, 2 * first, 2 * last + 1
    assert queries.QUERIES["tree_check"](spark, str(tmp_path)).count() == below
