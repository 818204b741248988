"""Queries through the verbs: lists, single rows, pages, cursors, keys, exports, children and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinql.entries.common import table
from skeinql.functions.expr import Agg, param
from skeinql.operators.engine import COUNT_MODES, Engine, KeyGroups
from skeinql.operators.fetch import Enricher, child
from skeinql.plans.filters import maybe
from skeinql.plans.query import FieldIndex, Nested, select_from
from skeinql.plans.schema import Entity, Relation, Schema
from skeinql.queries import DL, OC, SCHEMA, C, D, N, O, _order, _put
from skeinql.sources.catalog import Catalog
from skeinql.sources.scratch import folder

_DATED = select_from(O, O["o_orderkey"], O["o_orderdate"]).order_by(O["o_orderdate"].desc())
_NAMES = select_from(C, C["c_custkey"], C["c_name"])
_BY_DATE = "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25"

# lists and single rows
_put("list_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 15")(lambda e: table(e, e.list(select_from(O, O["o_orderkey"]).order_by(O["o_totalprice"].desc()), 15), "o_orderkey long"))
_put("list_whole", "SELECT c_custkey, c_name FROM customer")(lambda e: table(e, e.list(_NAMES), "c_custkey long, c_name string"))
_put("list_none", "SELECT c_custkey, c_name FROM customer WHERE false")(lambda e: table(e, e.list(_NAMES, 0), "c_custkey long, c_name string"))
_put("one_row", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")(lambda e: table(e, [e.one(select_from(N, *N.cols("n_nationkey", "n_name")).where(lambda f: f.eq(N["n_nationkey"], 7)))], "n_nationkey int, n_name string"))
_put("one_by_key", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 11")(lambda e: table(e, [r for k in (11, -1) if (r := e.one(_NAMES, k)) is not None], "c_custkey long, c_name string"))
_put("first_row", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")(lambda e: table(e, [e.first(select_from(O, O["o_orderkey"]).order_by(O["o_totalprice"].desc()))], "o_orderkey long"))
_put("stream_limit", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40")(lambda e: table(e, e.stream(_DATED, 40), "o_orderkey long, o_orderdate timestamp_ntz"))
_put("stream_whole", "SELECT c_custkey, c_name FROM customer")(lambda e: table(e, e.stream(_NAMES), "c_custkey long, c_name string"))
_put("mapper_finisher", "SELECT c_custkey, 'c' || c_custkey AS label, (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS of_all FROM customer WHERE c_nationkey = 3")(
    lambda e: table(e, e.list(select_from(C, C["c_custkey"]).where(lambda f: f.eq(C["c_nationkey"], 3)).mapped(lambda r: (r["c_custkey"], f"c{r['c_custkey']}"), lambda models: [(*m, len(models)) for m in models])), "c_custkey long, label string, of_all long")
)
_put("customizer", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 1")(lambda e: e.frame(select_from(O, O["o_orderkey"], O["o_custkey"]).customized(lambda df: df.where("o_orderkey % 3 = 1"))))
_put("select_set", "SELECT o_orderkey, o_custkey, true AS has_key, false AS has_price FROM orders")(
    lambda e: (lambda q: e.frame(q).withColumn("has_key", F.lit(q.contains("o_orderkey", "o_custkey"))).withColumn("has_price", F.lit(q.contains("o_totalprice"))))(select_from(O, *O.cols("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")).without("o_totalprice").only("o_orderkey", "o_custkey"))
)

# orders
_LABELS = select_from(D, D["doc_id"], DL["quality"].named("quality"))
_DOCS = "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY "
_put("nulls_last", _DOCS + "l.quality ASC NULLS LAST, d.doc_id LIMIT 60")(lambda e: table(e, e.list(_LABELS.order_by(DL["quality"].asc().nulls_last()), 60), "doc_id long, quality int"))
_put("nulls_first", _DOCS + "l.quality DESC NULLS FIRST, d.doc_id DESC LIMIT 60")(lambda e: table(e, e.list(_LABELS.order_by(DL["quality"].desc().nulls_first()), 60), "doc_id long, quality int"))
_put("nulls_last_down", _DOCS + "l.quality DESC NULLS LAST, d.doc_id DESC LIMIT 60")(lambda e: table(e, e.list(_LABELS.order_by(DL["quality"].desc().nulls_last()), 60), "doc_id long, quality int"))
_put("run_time_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30")(lambda e: table(e, e.list(select_from(O, O["o_orderkey"], O["o_totalprice"]).ordered_by([("o_totalprice", "asc")]), 30), "o_orderkey long, o_totalprice double"))
_put("order_by_path", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey ORDER BY n_name DESC, c_name ASC, o_orderkey ASC LIMIT 40")(lambda e: table(e, e.list(select_from(O, O["o_orderkey"]).ordered_by([("customer.nation.n_name", "desc"), ("customer.c_name", "asc")]), 40), "o_orderkey long"))

# counts and pages
_DONE = select_from(O, O["o_orderkey"]).where(lambda f: f.eq(O["o_orderstatus"], "F"))
_put("count_rows", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")(lambda e: table(e, [(e.count(_DONE.order_by(O.join("customer")["c_name"].asc())),)], "n long"))
_put("count_groups", "SELECT count(*) AS n FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 5)")(lambda e: table(e, [(e.count(select_from(O, O["o_custkey"].named("customer")).group_by(O["o_custkey"]).having(lambda h: h.gt(Agg.count(O), 5))),)], "n long"))
_put(
    "count_modes",
    "WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F') SELECT 'count' AS mode, 10::BIGINT AS items, n AS total, true AS more FROM n UNION ALL SELECT 'no_count', 10, NULL, true FROM n UNION ALL SELECT 'only_count', 0, n, true FROM n UNION ALL SELECT 'inline_count', 10, n, true FROM n",
)(lambda e: table(e, [(m, len(p.items), p.total, p.has_next) for m in COUNT_MODES for p in [e.page(_DONE, 5, 10, m)]], "mode string, items long, total long, more boolean"))
_put("inline_count_groups", "SELECT o_custkey AS customer, n, (SELECT count(DISTINCT o_custkey) FROM orders) AS total FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, o_custkey DESC LIMIT 12 OFFSET 3")(
    lambda e: (lambda p: table(e, [(*r, p.total) for r in p.items], "customer long, n long, total long"))(e.page(select_from(O, O["o_custkey"].named("customer"), Agg.count(O).named("n")).group_by(O["o_custkey"]).order_by(Agg.count(O).desc()), 3, 12, "inline_count"))
)
_put("page_beyond_the_end", "SELECT count(*) AS total, 0::BIGINT AS items FROM orders WHERE o_orderstatus = 'F'")(lambda e: (lambda p: table(e, [(p.total, len(p.items))], "total long, items long"))(e.page(_DONE, 2_000_000_000, 10, "inline_count")))


# cursors
def _second(e: Engine):
    return e.keyset(_DATED, 25, after=e.keyset(_DATED, 25).next_cursor)


_PAGE = "o_orderkey long, o_orderdate timestamp_ntz"
_put("keyset_after", _BY_DATE + " OFFSET 25")(lambda e: table(e, _second(e).items, _PAGE))
_put("keyset_before", _BY_DATE)(lambda e: table(e, e.keyset(_DATED, 25, before=_second(e).previous_cursor).items, _PAGE))
_put("keyset_nulls", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id DESC LIMIT 50 OFFSET 50")(
    lambda e: (lambda q: table(e, e.keyset(q, 50, after=e.keyset(q, 50).next_cursor).items, "doc_id long, quality int"))(_LABELS.order_by(DL["quality"].desc().nulls_first()))
)
_put("keyset_walk", "SELECT n_nationkey, n_name FROM nation")(lambda e: table(e, _walk(e, select_from(N, *N.cols("n_nationkey", "n_name")).order_by(N["n_name"].asc()), 7), "n_nationkey int, n_name string"))


def _walk(e: Engine, q, size: int) -> list:
    out, cursor = [], None
    while True:
        p = e.keyset(q, size, after=cursor)
        out += p.items
        if not p.has_next:
            return out
        cursor = p.next_cursor


# exports
def _exported(e: Engine, q, schema: str, **more):
    got: list = []
    e.export(q, got.append, **more)
    return table(e, got, schema)


def _resumed(e: Engine, q, schema: str, size: int):
    """A first page, then the rest from its cursor."""
    got: list = list((p := e.keyset(q, size)).items)
    if p.has_next:
        e.export_keyset(q, got.append, size, p.next_cursor)
    return table(e, got, schema)


_put("export_offset", "SELECT c_custkey, c_name FROM customer")(lambda e: _exported(e, _NAMES.order_by(C["c_nationkey"].asc()), "c_custkey long, c_name string", transform=lambda page: page, size=1000))
_put("export_keyset", "SELECT c_custkey, c_name FROM customer")(lambda e: _resumed(e, _NAMES.order_by(C["c_nationkey"].asc()), "c_custkey long, c_name string", 4000))
_put("export_grouped", "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")(lambda e: _exported(e, select_from(C, C["c_nationkey"].named("nation"), Agg.count(C).named("n")).group_by(C["c_nationkey"]).order_by(Agg.count(C).desc()), "nation int, n long", size=4))


# keys and their groups
def _parted(e: Engine) -> tuple[Engine, Schema]:
    """Orders in 16 partitions by the remainder of their key, their lines in 8."""
    spark = e.catalog.spark
    where = folder(spark, "parted")
    e.catalog.frame("orders").withColumn("bucket", (F.col("o_orderkey") % 16).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{where}/orders")
    e.catalog.frame("lineitem").withColumn("part", (F.col("l_orderkey") % 8).cast("int")).repartition("part").write.partitionBy("part").parquet(f"{where}/lines")
    frames = {"orders": spark.read.parquet(f"{where}/orders"), "lines": spark.read.parquet(f"{where}/lines")}
    schema = Schema(Entity("orders", ("o_orderkey",), (Relation("lines", "lines", (("o_orderkey", "l_orderkey"),), many=True),)), Entity("lines"))
    return Engine(Catalog(spark, frames)), schema


_KEYS = [3, 64, 5, 1000, 7, 777, -4]
_IN = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (3, 64, 5, 1000, 7, 777)"


def _grouped_keys(make):
    def run(e: Engine):
        other, schema = _parted(e)
        t = schema.root("orders")
        q = select_from(t, t["o_orderkey"], t["o_custkey"])
        q, groups = make(t, q)
        return table(e, other.by_keys(q, _KEYS, groups).values(), "o_orderkey long, o_custkey long")

    return run


_put("key_groups_column", _IN)(_grouped_keys(lambda t, q: (q, KeyGroups.by(lambda k: k % 16, t["bucket"]).assume_in_range())))
_put("key_groups_bind", _IN)(_grouped_keys(lambda t, q: (q.where(lambda f: f.compare(t["bucket"], "eq", param("bucket"))), KeyGroups.by(lambda k: k % 16).bind("bucket", lambda g: g).assume_in_range())))
_put("key_groups_verify", _IN)(_grouped_keys(lambda t, q: (q.where(lambda f: f.compare(t["bucket"], "gte", param("low")).compare(t["bucket"], "lte", param("high"))), KeyGroups.by(lambda k: (k % 3, k % 3)).bind("low", lambda g: g[0]).bind("high", lambda g: g[1]).verify_missing((0, 15)))))
_put("key_groups_when", _IN)(_grouped_keys(lambda t, q: (q.where(lambda f: f.compare(t["bucket"], "lte", param("high"))), KeyGroups.by(lambda k: k % 16).bind("high", lambda g: g).group_when(lambda keys, groups: keys > 100 * groups, 15).assume_in_range())))
_put("key_groups_composite", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) IN ((1, 0), (2, 1), (3, 0))")(
    lambda e: (lambda t: table(e, e.by_keys(select_from(t, *t.cols("conv_id", "turn", "role")), [(1, 0), (2, 1), (3, 0)], KeyGroups.by_composite(lambda k: k[0], t["conv_id"]).assume_in_range()).values(), "conv_id long, turn long, role string"))(SCHEMA.root("conversations"))
)
_put("key_groups_one", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 64")(
    lambda e: (lambda other, t: table(e, [other.one(select_from(t, t["o_orderkey"], t["o_custkey"]), 64, KeyGroups.by(lambda k: k % 16, t["bucket"]))], "o_orderkey long, o_custkey long"))(*(lambda p: (p[0], p[1].root("orders")))(_parted(e)))
)


def _parted_children(e: Engine):
    other, schema = _parted(e)
    t = schema.root("orders")
    lines = child("lines", t, "lines", lambda x: [x["l_linenumber"], x["l_quantity"]], "o_orderkey", lambda x: [x["l_linenumber"].asc()])
    lines = lines.key_groups(KeyGroups.by(lambda k: k % 8, lines.table["part"]))
    page = other.page(select_from(t, t["o_orderkey"]).child(lines).order_by(t["o_totalprice"].desc()), 10, 15)
    return table(e, [(r["o_orderkey"], len(r["lines"]), sum((x["l_quantity"] for x in r["lines"] if x["l_quantity"] is not None), 0.0)) for r in page.items], "o_orderkey long, n long, quantity double")


_put("key_groups_children", "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(sum(l_quantity), 0) AS quantity FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 15 OFFSET 10) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(_parted_children)

# children
_LINES = child("lines", O, "lines", lambda t: [t["l_linenumber"], t["l_quantity"]], "o_orderkey", lambda t: [t["l_quantity"].desc(), t["l_linenumber"].asc()])
_KEYED = select_from(O, O["o_orderkey"])
_COUNTED = "count(l_orderkey) AS n, coalesce(max(l_quantity), 0) AS most FROM"


def _lines_of(e: Engine, rows):
    return table(e, [(r["o_orderkey"], len(r["lines"]), r["lines"][0]["l_quantity"] if r["lines"] else 0.0) for r in rows], "o_orderkey long, n long, most double")


_put("fetch_children_page", f"SELECT o_orderkey, {_COUNTED} (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(lambda e: _lines_of(e, e.page(_KEYED.child(_LINES).order_by(O["o_orderdate"].desc()), 40, 20).items))
_put("fetch_children_keyset", f"SELECT o_orderkey, {_COUNTED} (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(lambda e: _lines_of(e, e.keyset(_KEYED.child(_LINES).order_by(O["o_orderdate"].desc()), 20).items))
_put("fetch_children_by_keys", f"SELECT o_orderkey, {_COUNTED} orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (1, 2, 3, 40) GROUP BY 1")(lambda e: _lines_of(e, e.by_keys(_KEYED.child(_LINES), [3, 40, 1, 2]).values()))
_put("fetch_children_filtered", f"SELECT o_orderkey, {_COUNTED} orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE o_totalprice > 400000 GROUP BY 1")(
    lambda e: e.frame(_KEYED.where(lambda f: f.gt(O["o_totalprice"], 400000)).child(_LINES.where(lambda f: f.eq(_LINES.table["l_returnflag"], "R")))).select("o_orderkey", F.size("lines").cast("long").alias("n"), F.coalesce(F.get("lines", F.lit(0))["l_quantity"], F.lit(0.0)).alias("most"))
)
_put("fetch_most", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(
    lambda e: e.frame(select_from(C, C["c_custkey"]).child(child("orders", C, "orders", lambda t: [t["o_orderkey"]], "c_custkey", most=1000))).select("c_custkey", F.size("orders").cast("long").alias("n"))
)
_put("fetch_single", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(
    lambda e: e.frame(select_from(D, D["doc_id"]).child(child("label", D, "label", lambda t: [t["quality"]], "doc_id", single=True))).select("doc_id", F.col("label.quality").alias("quality"))
)
_OF_CUSTOMER = child("orders", C, "orders", lambda t: [t["o_orderkey"], t["o_totalprice"]], "c_custkey", lambda t: [t["o_totalprice"].desc()])
_put("fetch_nested", "SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 30) LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(
    lambda e: table(e, [(r["c_custkey"], len(r["orders"]), sum(len(o["lines"]) for o in r["orders"])) for r in e.page(select_from(C, C["c_custkey"]).child(_OF_CUSTOMER.child(_LINES)).order_by(C["c_acctbal"].desc()), 0, 30).items], "c_custkey long, orders long, lines long")
)
_put("fetch_join_plan", "SELECT o.o_orderkey, c_name AS customer, (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey) AS siblings FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25) o JOIN customer ON c_custkey = o_custkey")(
    lambda e: table(e, [(r["o_orderkey"], r["customer"]["c_name"], len(r["customer"]["orders"])) for r in e.list(select_from(O, O["o_orderkey"], Nested("customer", OC, (OC["c_custkey"].named("c_custkey"), OC["c_name"].named("c_name")))).join_plan("customer", _OF_CUSTOMER).order_by(O["o_totalprice"].asc()), 25)], "o_orderkey long, customer string, siblings long")
)

# look-ups
_NATIONS = select_from(C, C["c_custkey"], C["c_nationkey"]).order_by(C["c_custkey"].asc())


def _names(e: Engine):
    return lambda keys: {k: r["n_name"] for k, r in e.by_keys(select_from(N, N["n_nationkey"], N["n_name"]), keys).items()}


_put("enrich_by_key", "SELECT c_custkey, c_nationkey, n_name AS nation FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 200) JOIN nation ON n_nationkey = c_nationkey")(lambda e: table(e, e.list(_NATIONS.enrich(Enricher.by_key("nation", "c_nationkey", _names(e))), 200), "c_custkey long, c_nationkey int, nation string"))
_put("enrich_by_keys", "SELECT c_custkey, a.n_name AS home, b.n_name AS other FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 200) JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_custkey")(
    lambda e: table(e, [(r["c_custkey"], r["home"], r["other"]) for r in e.list(_NATIONS.enrich(Enricher.by_keys(_names(e), batch=10, home="c_nationkey", other="c_custkey")), 200)], "c_custkey long, home string, other string")
)
_put("enrich_of", "SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 200)")(lambda e: table(e, e.list(_NATIONS.enrich(Enricher.of("place", lambda rows: list(range(len(rows))))), 200), "c_custkey long, c_nationkey int, place long"))

# names that a client asks for
_INDEX = FieldIndex(select_from(O, O["o_orderkey"], O["o_totalprice"], Nested("customer", OC, (OC["c_name"].named("name"), OC["c_mktsegment"].named("segment")))).child(_LINES), {"status": O["o_orderstatus"]}, {"basics": ["o_orderkey", "o_totalprice"]})
_put("field_index_set", "SELECT o_orderkey, o_totalprice, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")(lambda e: e.frame(_INDEX.only("basics", "o_orderkey", "o_totalprice", "customer.name").select("basics,customer.name,customer.segment,nothing")).select("o_orderkey", "o_totalprice", F.col("customer.name").alias("name")))
_put("field_index_filter", _IN.split(" WHERE")[0].replace(", o_custkey", "") + " WHERE o_orderstatus = 'P' AND o_totalprice > 100000")(lambda e: e.frame(_INDEX.select(["o_orderkey"]).where(lambda f: f.eq(_INDEX.filter("status"), maybe("P")).gt(_INDEX.filter("o_totalprice"), 100000))))
_put("field_index_child", f"SELECT o_orderkey, {_COUNTED} orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(lambda e: e.frame(_INDEX.select("o_orderkey,lines")).select("o_orderkey", F.size("lines").cast("long").alias("n"), F.coalesce(F.get("lines", F.lit(0))["l_quantity"], F.lit(0.0)).alias("most")))
_put("long_list", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 2 AND 4000 AND o_orderkey % 2 = 0")(_order(lambda f: f.is_in(O["o_orderkey"], range(2, 4001, 2))))
_put("long_list_out", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.doc_id NOT IN (SELECT * FROM range(0, 3000, 3))")(_LABELS.where(lambda f: f.not_in(DL["doc_id"], range(0, 3000, 3))))
