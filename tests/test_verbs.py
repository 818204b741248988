import itertools

import pytest

from skeinql.declare import Converter, aggregate, children, column, computed, group_key, model, nested
from skeinql.errors import Code, Refused
from skeinql.functions.expr import Agg, concat, param, plus
from skeinql.inspection import filters_of, filters_on, joins_of
from skeinql.operators import write
from skeinql.operators.engine import KeyGroups, Page
from skeinql.operators.fetch import Enricher, child
from skeinql.operators.write import Conflict, Delete, Insert, Update, Writer
from skeinql.plans.query import select_from
from skeinql.plans.schema import Entity, Schema
from skeinql.repository import Repository
from skeinql.streaming.stateless import file_stream, streamed, windowed_counts
from tests.fixture import SCHEMA, engine, items_rows, orders_rows, sort_rows
from tests.test_filters import refused

O, C, S, P = map(SCHEMA.root, ("orders", "customers", "sorts", "pairs"))
Q = select_from(O, O["id"], O["status"]).order_by(O["status"].asc())


def test_list_one_first(spark):
    e = engine(spark)
    assert e.list(Q, 0) == [] and len(e.list(Q)) == 40
    assert [r["id"] for r in e.list(Q, 2)] == [3, 7]
    assert e.first(Q)["id"] == 3
    assert e.one(Q, 5)["status"] == "PAID" and e.one(Q, 999) is None
    with refused(Code.TWO_ROWS):
        e.one(Q)
    with refused(Code.PAGE_SIZE):
        e.list(Q, -1)


def test_by_keys(spark):
    e = engine(spark)
    assert list(e.by_keys(Q, [7, 99, 3, 7])) == [7, 3]
    assert e.by_keys(Q, []) == {}
    pairs = e.by_keys(select_from(P, *P.cols("tenant", "no", "label")), [(2, 1), (0, 3)])
    assert [r["label"] for r in pairs.values()] == ["2-1", "0-3"]
    with refused(Code.TO_MANY_SELECTION):
        e.by_keys(select_from(O, O["id"], O.join("items")["code"].named("c")), [1])


@pytest.mark.parametrize("first", [False, True])
def test_offset_pages_cover_everything(spark, first):
    e = engine(spark)
    q = Q.primary_key_first() if first else Q
    got = list(itertools.chain.from_iterable([r["id"] for r in e.page(q, o, 15).items] for o in (0, 15, 30)))
    assert got == [r["id"] for r in e.list(Q, 40)] and len(set(got)) == 40
    assert [e.page(q, 30, 15, m).total for m in ("count", "no_count", "only_count", "inline_count")] == [40, None, 40, 40]
    assert [e.page(q, o, 20, "no_count").has_next for o in (0, 20)] == [True, False]
    for o, s, code in ((0, 0, Code.PAGE_SIZE), (-1, 5, Code.OFFSET)):
        with refused(code):
            e.page(q, o, s)


@pytest.mark.parametrize("down,nulls", list(itertools.product([False, True], ["first", "last"])))
def test_keyset_walks_both_ways(spark, down, nulls):
    e = engine(spark)
    order = [S["n"].desc() if down else S["n"].asc(), S["t"].asc().nulls_last()]
    order[0] = order[0].nulls_first() if nulls == "first" else order[0].nulls_last()
    q = select_from(S, S["id"]).order_by(*order)
    whole = [r["id"] for r in e.list(q, 100)]
    seen, cursor, last = [], None, None
    while True:
        p = e.keyset(q, 17, after=cursor)
        seen += [r["id"] for r in p.items]
        last = p
        if not p.has_next:
            break
        cursor = p.next_cursor
    assert seen == whole and len(whole) == len(sort_rows())
    back, p = [[r["id"] for r in last.items]], last
    while p.has_previous:
        p = e.keyset(q, 17, before=p.previous_cursor)
        back.insert(0, [r["id"] for r in p.items])
    assert list(itertools.chain.from_iterable(back)) == whole


def test_keyset_refusals(spark):
    e = engine(spark)
    with refused(Code.NULL_IN_KEYSET):  # nulls, and no word on where they go
        e.keyset(select_from(S, S["id"]).order_by(S["n"].asc()), 5)
    cursor = e.keyset(Q, 5).next_cursor
    with refused(Code.FOREIGN_CURSOR):
        e.keyset(select_from(O, O["id"]).order_by(O["total"].asc()), 5, after=cursor)
    with refused(Code.FOREIGN_CURSOR):
        e.keyset(Q, 5, after="rubbish")
    with refused(Code.EXPRESSION_KEYSET):
        e.keyset(select_from(O, O["id"]).order_by(plus(O["id"], 1).asc()), 5)
    with refused(Code.KEYSET_ON_GROUPS):
        e.keyset(select_from(O, Agg.count(O).named("n")), 5)


def test_export_and_stream(spark):
    e = engine(spark)
    got, pages = [], []
    assert e.export(Q, got.append, lambda p: (pages.append(len(p)), p)[1], 15) == 40
    assert pages == [15, 15, 10] and [r["id"] for r in got] == [r["id"] for r in e.list(Q, 40)]
    again = []
    assert e.export_keyset(Q, again.append, 13)[0] == 40 and again == got
    assert [r["id"] for r in e.stream(Q, 3)] == [3, 7, 11]
    assert e.count(Q) == 40


def test_children_and_enrichers(spark):
    e = engine(spark)
    lines = child("lines", O, "items", lambda t: [t["code"], t["quantity"]], "id", lambda t: [t["price"].desc()])
    rows = {r["id"]: r["lines"] for r in e.list(Q.child(lines))}
    assert [x["code"] for x in rows[1]] == ["P2", "P1", "P0"] and rows[0] == []
    tags = child("labels", O, "labels", lambda t: [t["name"]], "id", lambda t: [t["name"].asc()])
    assert {r["id"]: [x["name"] for x in r["labels"]] for r in e.list(Q.child(tags)) if r["id"] in (0, 1, 9)} == {0: ["L0"], 1: ["L0", "L1"], 9: []}
    few = child("lines", O, "items", lambda t: [t["code"]], "id", most=2)
    with pytest.raises(Exception, match=Code.TOO_MANY_CHILDREN.value):
        e.list(Q.child(few))
    asked = []
    q = Q.enrich(Enricher.by_key("size", "status", lambda k: (asked.append(k), {s: len(s) for s in k})[1]))
    assert all(r["size"] == len(r["status"]) for r in e.list(q)) and len(asked) == 1 and len(asked[0]) == 4
    with refused(Code.ENRICHER_SIZE):
        e.list(Q.enrich(Enricher.of("x", lambda rows: [1])))


def test_children_of_children(spark):
    e = engine(spark)
    lines = child("items", O, "items", lambda t: [t["code"]], "id", lambda t: [t["code"].asc()])
    of = child("orders", C, "orders", lambda t: [t["id"], t["status"]], "id", lambda t: [t["id"].desc()]).child(lines)
    rows = {r["id"]: r["orders"] for r in e.list(select_from(C, C["id"]).child(of))}
    assert [o["id"] for o in rows[1]] == [31, 21, 11, 1] and rows[11] == [] and [o["items"] for o in rows[5]] == [[]] * 4
    assert [i["code"] for i in rows[1][0]["items"]] == ["P0", "P1", "P2"]

    @model(SCHEMA, "items")
    class Item:
        code = column("code")

    @model(SCHEMA, "orders")
    class Order:
        id = column("id")
        items = children("items", Item, "id", lambda t: [t["code"].asc()])

    @model(SCHEMA, "customers")
    class Customer:
        id = column("id")
        orders = children("orders", Order, "id", lambda t: [t["id"].asc()])

    found = {c.id: c for c in e.list(Customer.query())}
    assert [[i.code for i in o.items] for o in found[2].orders] == [["P0", "P1", "P2"]] * 4


def test_customizer_and_params(spark):
    e = engine(spark)
    assert len(e.list(Q.customized(lambda df: df.where("id < 5")))) == 5
    with refused(Code.CUSTOMIZER):
        e.list(Q.customized(lambda df: df.drop("id")))
    with refused(Code.UNKNOWN_SORT):
        Q.ordered_by([("nope", "asc")])
    assert e.list(Q.ordered_by([("id", "desc")]), 1)[0]["id"] == 39


def test_update_delete(spark):
    e = engine(spark)
    w = Writer(e)
    out = w.update(Update(O).set("status", "GONE").where(lambda f: f.eq(O.join("customer")["country"], "DE")))
    assert {(r["id"], r["status"], r["version"]) for r in out.affected.collect()} == {(o[0], "GONE", 2) for o in orders_rows() if o[1] % 4 == 0}
    assert out.after.count() == 40 and w.update(Update(O).set_null("referrer_id").where_keys(0, 3).keep_version()).count() == 2
    with pytest.raises(Exception, match=Code.STALE_VERSION.value):
        w.update(Update(O).set("status", "X").where_keys(1).expect_version(7)).count()
    for bad, code in ((lambda: w.update(Update(O).set("status", "X")), Code.EMPTY_WRITE_FILTER), (lambda: Update(O).set("status", "X").set("status", "Y"), Code.ASSIGNED_TWICE), (lambda: Update(O).set("id", 1), Code.KEY_ASSIGNED), (lambda: Update(O).set("status", None), Code.NULL_ASSIGNED)):
        with refused(code):
            bad()
    assert w.delete(Delete(O).where(lambda f: f.gt(O.join("items")["quantity"], 4))).after.count() == 40 - len({i[1] for i in items_rows() if i[3] > 4})
    steps = list(w.chunks(Delete(O).where(lambda f: f.eq(O["status"], "NEW")), 4))
    assert [s[0] for s in steps] == [12, 28, 36] and e.count(Q) == 30


def test_insert_and_upsert(spark, tmp_path):
    e = engine(spark)
    w = Writer(e)
    copy = Insert(C, select_from(C, plus(C["id"], 100).named("i"), C["name"].named("n")).where(lambda f: f.lt(C["id"], 2))).map("id", "i").map("name", "n").set("country", "XX").default("vip", lambda: False)
    assert sorted(map(tuple, w.insert(copy).affected.collect())) == [(100, "C00", None, "XX", False), (101, "C01", None, "XX", False)]
    rows = ({"id": 1, "name": "one"}, {"id": 50, "name": "fifty"})
    up = w.insert(Insert(C, rows=rows).on_conflict(Conflict(("id",)).set_from_row("name")))
    assert {r["id"]: r["name"] for r in up.affected.collect()} == {1: "one", 50: "fifty"} and up.after.count() == 13
    kept = w.insert(Insert(C, rows=rows).on_conflict(Conflict(("id",)).set_from_row("name").where(lambda old, new: old("country") == "DE")))
    assert {r["id"] for r in kept.affected.collect()} == {50}
    assert w.insert(Insert(C, rows=(rows[1], rows[1])).on_conflict(Conflict(("id",)).do_nothing())).count() == 1
    with pytest.raises(Exception, match=Code.SHARED_CONFLICT_KEY.value):
        w.insert(Insert(C, rows=(rows[1], rows[1])).on_conflict(Conflict(("id",)).set_from_row("name"))).count()
    with refused(Code.CONFLICT_CLAUSE):
        Insert(C, rows=rows).on_conflict(Conflict(("id",)))
    assert up.swap(f"{tmp_path}/c").count() == 13


def test_models(spark):
    e = engine(spark)
    shout = Converter(str.lower, str.upper)

    @model(SCHEMA, "customers")
    class Customer:
        id = column("id")
        name = column("name", converter=shout)

    @model(SCHEMA, "items")
    class Item:
        code = column("code")

    @model(SCHEMA, "orders")
    class Order:
        id = column("id")
        status = column("status")
        total = column("total", default=False)
        label = computed(lambda t: concat(t["status"], "!"))
        referrer = nested("referrer", Customer)
        items = children("items", Item, "id", lambda t: [t["code"].asc()])

    @model(SCHEMA, "orders")
    class ByStatus:
        status = group_key("status")
        n = aggregate(lambda t: Agg.count(t))

    found = {o.id: o for o in e.list(Order.query())}
    assert found[3].referrer.name == "c04" and found[1].referrer is None and found[3].label == "CANCELLED!"
    assert [i.code for i in found[1].items] == ["P0", "P1", "P2"]
    with pytest.raises(Refused):
        found[3].total
    assert sorted((g.status, g.n) for g in e.list(ByStatus.query())) == [("CANCELLED", 10), ("NEW", 10), ("PAID", 10), ("SHIPPED", 10)]
    assert Customer.insert_columns(Customer(id=7, name="bob")) == {"id": 7, "name": "BOB"} and Customer.changes_of(Customer(id=7, name="bob")) == {"name": "BOB"}


def test_streams(spark, tmp_path):
    schema = Schema(Entity("ev", ("id",)))
    t = schema.root("ev")
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long")
    df.write.parquet(f"{tmp_path}/in")
    e = engine(spark, ev=df)
    q = select_from(t, t["id"]).where(lambda f: f.eq(t["k"], 1))
    run = streamed(e.catalog, q, file_stream(spark, f"{tmp_path}/in", df.schema)).writeStream.format("memory").queryName("got").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("got").count() == 10
    with refused(Code.TO_MANY_SELECTION):
        streamed(e.catalog, q.order_by(t["id"].asc()), df)
    batch = df.selectExpr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10) as at", "k")
    assert sum(r["n"] for r in windowed_counts(batch, "at", "k").collect()) == 30


def test_key_groups_prune_partitions(spark, tmp_path):
    schema = Schema(Entity("parted", ("id",)))
    t = schema.root("parted")
    spark.range(100).selectExpr("id", "id % 3 as v", "cast(id div 10 as int) as month").write.partitionBy("month").parquet(f"{tmp_path}/parted")
    e = engine(spark, parted=spark.read.parquet(f"{tmp_path}/parted"))
    groups = KeyGroups(t["month"], lambda k: k // 10)
    q = select_from(t, t["id"], t["v"])
    assert list(e.by_keys(q, [42, 7, 41], groups)) == [42, 7, 41]
    narrowed = groups.narrowed(q, [(42,), (7,)])
    assert filters_of(narrowed) == [("in", "month", (0, 4))] and "PartitionFilters: [isnotnull(month" in e.explain(narrowed) or "PartitionFilters: [month" in e.explain(narrowed)
    assert filters_of(KeyGroups(t["month"], lambda k: k // 10, most=1).narrowed(q, [(42,), (7,)])) == [("gte", "month", 0), ("lte", "month", 4)]


def test_a_page_reads_its_own_children_only(spark):
    e = engine(spark)
    lines = child("lines", O, "items", lambda t: [t["code"]], "id", lambda t: [t["price"].desc()], most=3)
    q = Q.child(lines)
    plan = e.frame(q, limit=4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")  # a plan's text goes from the result down: the semi-join is below the window
    assert [len(r["lines"]) for r in e.page(q, 1, 4).items] == [3, 3, 0, 3]  # order 15 has none
    assert "LeftSemi" not in e.frame(q)._jdf.queryExecution().optimizedPlan().toString()  # all rows' children need none
    assert [r["id"] for r in e.page(q, 0, 40).items] == [r["id"] for r in e.list(Q)]  # in the page's order, children or not


def test_key_groups_in_rounds(spark, tmp_path):
    schema = Schema(Entity("parted", ("id",)))
    t = schema.root("parted")
    e = engine(spark, parted=spark.range(60).selectExpr("id", "cast(id div 10 as int) as month"))
    q = select_from(t, t["id"]).where(lambda f: f.compare(t["month"], "eq", param("month")))
    right = KeyGroups.by(lambda k: k // 10).bind("month", lambda g: g)
    assert list(e.by_keys(q, [42, 7, 999, 41], right.assume_in_range())) == [42, 7, 41]
    wrong = KeyGroups.by(lambda k: 0, t["month"])
    plain = select_from(t, t["id"])
    assert list(e.by_keys(plain, [42, 7], wrong.assume_in_range())) == [7] and list(e.by_keys(plain, [42, 7], wrong.verify_missing())) == [42, 7]
    assert [len(ks) for _, ks in right.rounds(q, [(42,), (7,), (41,)])] == [2, 1]
    seen = []
    ruled = right.group_when(lambda keys, groups: seen.append((keys, groups)), 4)
    assert list(e.by_keys(q, [42, 7, 41], ruled)) == [42, 41] and seen == [(3, 2)]


def test_chunks_keep_their_plan_small(spark, tmp_path):
    e = engine(spark)
    up = Update(O).set("status", "X").where(lambda f: f.ne(O["status"], "NEW"))
    sizes, w = [], Writer(e)
    for _, out in w.chunks(up, 3):
        sizes.append(len(out.after._jdf.queryExecution().optimizedPlan().toString()))
    assert len(sizes) == 10 and max(sizes) < 1.3 * min(sizes)
    assert e.count(Q.where(lambda f: f.eq(O["status"], "X"))) == 30
    e = engine(spark)
    steps = list(Writer(e).chunks(up, 7, commit=True))
    assert sum(out.affected.count() for _, out in steps[-1:]) == 2 and e.count(Q.where(lambda f: f.eq(O["status"], "X"))) == 30
    assert "parquet" in e.catalog.frame("orders")._jdf.queryExecution().toString().lower()


def test_first_by_does_not_bend_with_a_zone(spark):
    e = engine(spark, groups=spark.sql("SELECT * FROM VALUES (1L, 1, timestamp_ntz'2024-03-10 02:30:00', 'lost hour'), (2L, 1, timestamp_ntz'2024-03-10 03:15:00', 'later') AS t(id, g, k, v)"))
    t = SCHEMA.root("groups")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert e.list(select_from(t, Agg.first_by(t["v"], t["k"].desc()).named("v")).group_by(t["g"]))[0]["v"] == "later"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_an_inline_count_is_of_the_same_pass(spark):
    e = engine(spark)
    reads = []
    e.compiled = lambda q, narrowed=None, f=e.compiled: (reads.append(q), f(q, narrowed))[1]
    assert e.page(Q, 35, 10, "inline_count").total == 40 and len(reads) == 1
    assert e.page(Q, 90, 10, "inline_count") == Page([], 40, False)


def test_upserts_broadcast_few_rows(spark):
    e = engine(spark)
    rows = ({"id": 1, "name": "one"}, {"id": 50, "name": "fifty"})
    up = Insert(C, rows=rows).on_conflict(Conflict(("id",)).set_from_row("name"))
    got = Writer(e).insert(up)
    assert "FullOuter" not in got.after._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(str, got.after.collect()))
    write.BROADCAST_ROWS, kept = 0, write.BROADCAST_ROWS
    try:
        other = Writer(e).insert(up)
        assert "FullOuter" in other.after._jdf.queryExecution().optimizedPlan().toString() and sorted(map(str, other.after.collect())) == want
    finally:
        write.BROADCAST_ROWS = kept


def test_long_lists_keep_the_meaning_of_null(spark):
    e = engine(spark)
    many = [*range(2, 2000, 2), 3]
    for build in (lambda f, v: f.is_in(S["n"], v), lambda f, v: f.not_in(S["n"], v), lambda f, v: f.not_(lambda g: g.is_in(S["n"], v))):
        got, want = ([r["id"] for r in e.list(select_from(S, S["id"]).where(lambda f, v=v: build(f, v)).order_by(S["id"].asc()))] for v in (many, [2, 3]))
        assert got == want and got


def test_inspection():
    q = Q.where(lambda f: f.ne(O["status"], "NEW").or_(lambda g: g.gt(O["total"], 5), lambda g: g.eq(O.join("customer")["name"], "x")))
    assert filters_of(q) == [("or", ("ne", "status", "NEW"), ("is_null", "status")), ("or", ("gt", "total", 5), ("eq", "customer.name", "x"))]
    assert joins_of(q) == {"customer"} and filters_on(q, O["total"]) == [filters_of(q)[1]]


def test_repository(spark):
    r = Repository(engine(spark), Q)
    assert r.find(5)["id"] == 5 and r.count(lambda f: f.eq(O["status"], "NEW")) == 10 and not r.exists(lambda f: f.lt(O["id"], 0))
    assert [x["id"] for x in r.find_all(sort=[("id", "desc")], limit=2)] == [39, 38] and list(r.find_by_keys([3, 1])) == [3, 1]
    assert r.page(38, 10).total == 40 and len(r.slice(7).items) == 7
    assert r.update({"status": "X"}, lambda f: f.lt(O["id"], 3)).count() == 3 and r.delete(lambda f: f.lt(O["id"], 3)).after.count() == 37
    assert r.insert({"id": 77, "status": "NEW"}).after.count() == 41
