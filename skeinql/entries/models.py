"""Queries through declared models, sources, write shapes and the repository."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinql.declare import Converter, aggregate, auditing, children, column, computed, depth, discriminator, filter_only, group_key, model, nested, source_model, subtype, windowed, write_model
from skeinql.entries.common import table
from skeinql.errors import Refused
from skeinql.functions.expr import Agg, Typed, concat, divided_by, function, window
from skeinql.operators.write import Insert, Update, Writer
from skeinql.plans.query import select_from
from skeinql.queries import _TOTALS, SCHEMA, C, N, O, _put
from skeinql.repository import Repository

_LOWER = Converter(str.lower, str.upper)


@model(SCHEMA, "lineitem")
class Line:
    number = column("l_linenumber")
    quantity = column("l_quantity")


@model(SCHEMA, "customer")
class Customer:
    id = column("c_custkey")
    name = column("c_name")
    segment = column("c_mktsegment", converter=_LOWER)


@model(SCHEMA, "orders")
class Order:
    id = column("o_orderkey", type="bigint")
    status = column("o_orderstatus")
    price = column("o_totalprice", default=False)
    label = computed(lambda t: concat(t["o_orderstatus"], "/", t["o_orderpriority"]))
    customer = nested("customer", Customer, "inner")
    maker = "not a column"


@model(SCHEMA, "orders")
class OrderLines:
    id = column("o_orderkey")
    lines = children("lines", Line, "id", lambda t: [t["l_linenumber"].asc()])


@model(SCHEMA, "orders")
class ByStatus:
    status = group_key("o_orderstatus")
    year = group_key(lambda t: function("year", t["o_orderdate"]))
    orders = aggregate(lambda t: Agg.count(t))
    dearest = aggregate(lambda t: Agg.max(t["o_totalprice"]))


@model(SCHEMA, "orders", single_group=True)
class Overall:
    orders = aggregate(lambda t: Agg.count(t))
    customers = aggregate(lambda t: Agg.count_distinct(t["o_custkey"]))


@model(SCHEMA, "events")
class Event:
    id = column("event_id")
    kind = subtype()
    clicked = column("value", treat="Click")


@model(SCHEMA, "orders")
class Joined:
    id = column("o_orderkey")
    buyer = column("c_name", via=lambda t: t.entity_join("customer", {"c_custkey": t["o_custkey"]}, {t["o_orderstatus"]: "F"}))
    siblings = column("n", via=lambda t: t.joined_source(_TOTALS, {"customer": t["o_custkey"]}))
    bought = nested(lambda t: t.entity_join("customer", {"c_custkey": t["o_custkey"]}), Customer)
    date = filter_only("o_orderdate")


@model(SCHEMA, "nation")
class Nation:
    id = column("n_nationkey")
    name = column("n_name")
    region = column("n_regionkey", inserted=False)


@write_model(Customer)
class NewCustomer:
    pass


@write_model(Customer, update=True)
class CustomerChange:
    pass


@write_model(Nation)
class NewNation:
    pass


@source_model(SCHEMA, "orders", "ranked_orders")
class Ranked:
    id = column("o_orderkey")
    customer = column("o_custkey")
    place = windowed(lambda t: window("row_number", partition_by=[t["o_custkey"]], order_by=[t["o_totalprice"].desc()]))


@source_model(SCHEMA, "orders", "done", ("id", "part"))
class Done:
    id = column("o_orderkey")
    part = discriminator("done")


@source_model(SCHEMA, "orders", "pending", ("id", "part"))
class Pending:
    id = column("o_orderkey")
    part = discriminator("pending")


@source_model(SCHEMA, "customer", "walk", ("id",))
class Below:
    id = column("c_custkey")
    parent = computed(lambda t: Typed(function("nullif", function("floor", divided_by(Typed(t["c_custkey"], "double"), 2.0)), 0), "bigint"))
    level = depth()


_put("model_read", "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderstatus || '/' || o_orderpriority AS label, c_name AS customer, lower(c_mktsegment) AS segment FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")(
    lambda e: e.map(Order.query().where(lambda f: f.gt(O["o_totalprice"], 300000)), lambda o: (o.id, o.status, o.label, o.customer.name, o.customer.segment), "id long, status string, label string, customer string, segment string")
)
_put("model_chosen", "SELECT o_orderkey AS id, o_totalprice AS price, 'id,price' AS selected FROM orders WHERE o_totalprice > 300000")(
    lambda e: e.map(Order.query(["id", "price"]).where(lambda f: f.gt(O["o_totalprice"], 300000)), lambda o: (o.id, o.price, ",".join(sorted(o.selected))), "id long, price double, selected string")
)
_put("model_children", "SELECT o_orderkey AS id, count(l_orderkey) AS n, coalesce(min(l_linenumber), 0) AS least FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 40) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(
    lambda e: table(e, [(o.id, len(o.lines), o.lines[0].number if o.lines else 0) for o in e.list(OrderLines.query().order_by(O["o_totalprice"].desc()), 40)], "id long, n long, least int")
)
_put("model_groups", "SELECT o_orderstatus AS status, year(o_orderdate)::INT AS year, count(*) AS orders, max(o_totalprice) AS dearest FROM orders GROUP BY 1, 2")(lambda e: table(e, [(g.status, g.year, g.orders, g.dearest) for g in e.list(ByStatus.query())], "status string, year int, orders long, dearest double"))
_put("model_one_key", "SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY 1")(lambda e: table(e, [(g.status, g.orders) for g in e.list(ByStatus.query(["status", "orders"]))], "status string, orders long"))
_put("model_single_group", "SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders")(lambda e: table(e, [(g.orders, g.customers) for g in e.list(Overall.query())], "orders long, customers long"))
_put("model_subtypes", "SELECT event_id AS id, event_type AS kind, CASE WHEN event_type = 'click' THEN value END AS clicked FROM events")(lambda e: e.frame(Event.query()))
_put("model_joins", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN c_name END AS buyer, n AS siblings, c_custkey AS bought FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = o_custkey")(lambda e: e.frame(Joined.query()).select("id", "buyer", "siblings", F.col("bought.id").alias("bought")))
_put("model_filter_only", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")(lambda e: e.frame(Joined.query(["id"]).where(lambda f: f.gte(Joined.filters()["date"], Typed(function("to_timestamp_ntz", "1997-01-01 00:00:00"), "timestamp_ntz")))))
_put("model_fields", "SELECT unnest(['id', 'name', 'region']) AS known")(lambda e: table(e, [(n,) for n in Nation.fields().resolve("id,name,region,colour")[0]], "known string"))
_put("model_source_window", "SELECT o_custkey AS customer, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")(lambda e: (lambda t: e.frame(select_from(t, *t.cols("customer", "id")).where(lambda f: f.lte(t["place"], 2))))(Ranked.source().table()))
_put("model_discriminator", "SELECT o_orderkey AS id, 'done' AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'pending' FROM orders WHERE o_orderstatus = 'P'")(
    lambda e: (lambda t: e.frame(select_from(t, *t.cols("id", "part"))))(Done.source(lambda f: f.eq(O["o_orderstatus"], "F")).union_all(Pending.source(lambda f: f.eq(O["o_orderstatus"], "P"))).table())
)
_put("model_depth", "WITH RECURSIVE t AS (SELECT c_custkey AS id, 0::BIGINT AS level FROM customer WHERE c_custkey = 5 UNION ALL SELECT c_custkey, t.level + 1 FROM customer JOIN t ON c_custkey // 2 = t.id) SELECT id, level FROM t")(
    lambda e: (lambda t: e.frame(select_from(t, *t.cols("id", "level"))))(Below.source(lambda f: f.eq(C["c_custkey"], 5), ("id", "parent", 40)).table())
)
_put("model_insert", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = -1 UNION ALL SELECT 900000000, 'bob', 'MACHINERY'")(lambda e: Writer(e).insert(Insert(C, rows=(NewCustomer(id=900000000, name="bob", segment="machinery").row(),))).affected.select("c_custkey", "c_name", "c_mktsegment"))
_put("model_insert_excluded", "SELECT 90 AS n_nationkey, 'x' AS n_name, CAST(NULL AS INT) AS n_regionkey")(lambda e: Writer(e).insert(Insert(N, rows=(NewNation(id=90, name="x").row(),))).affected.select("n_nationkey", "n_name", "n_regionkey"))
_put("model_update", "SELECT c_custkey, 'ann' AS c_name, 'BUILDING' AS c_mktsegment FROM customer WHERE c_custkey IN (5, 6)")(lambda e: Writer(e).update(Update(C).changes(CustomerChange(name="ann", segment="building").changes()).where_keys(5, 6)).affected.select("c_custkey", "c_name", "c_mktsegment"))


def _audited(e):
    with auditing() as found:
        for o in e.list(Order.query(["id"]).where(lambda f: f.eq(O["o_orderkey"], 1))):
            assert o.id == 1 and o.status is None and o.customer is None
    try:
        e.list(Order.query(["id"]), 1)[0].status
        refused = False
    except Refused:
        refused = True
    return table(e, [(*f, refused) for f in found], "model string, attribute string, refused boolean")


_put("select_audit", "SELECT 'Order' AS model, unnest(['status', 'customer']) AS attribute, true AS refused")(_audited)
_put("repository_reads", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS n, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3) AS least, true AS any_row, (SELECT count(*) FROM customer) AS total, 'Customer#000000004' AS found")(lambda e: _repository(e))


def _repository(e):
    r = Repository(e, Customer.query())

    def third(f):
        f.eq(C["c_nationkey"], 3)

    return table(e, [(r.count(third), r.find_all(third, [("id", "asc")], 1)[0].id, r.exists(third), r.page(0, 5).total, r.find(4).name)], "n long, least long, any_row boolean, total long, found string")


_put("repository_writes", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS changed, (SELECT count(*) FROM customer WHERE c_nationkey <> 3) AS left_over, (SELECT count(*) + 1 FROM customer) AS after_insert")(
    lambda e: (lambda r: table(e, [(r.update({"c_name": "x"}, lambda f: f.eq(C["c_nationkey"], 3)).count(), r.delete(lambda f: f.eq(C["c_nationkey"], 3)).after.count(), r.insert({"c_custkey": 900000000}).after.count())], "changed long, left_over long, after_insert long"))(Repository(e, Customer.query()))
)
