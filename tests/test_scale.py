"""What has to hold when tables are large, on small ones."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

import skeinql.entries  # noqa: F401
from skeinql.errors import Code
from skeinql.operators.fetch import child
from skeinql.operators.write import Delete, Update, Writer
from skeinql.plans.query import Nested, select_from
from skeinql.plans.schema import Entity, Schema
from skeinql.queries import QUERIES
from tests.fixture import SCHEMA, engine
from tests.test_filters import refused

SF = "/root/testdata/sf0.001"


@pytest.fixture
def ungathered(monkeypatch):
    """No rows come to the driver."""

    def refuse(self, *_, **__):
        raise AssertionError("rows were gathered on the driver")

    for verb in ("collect", "toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, verb, refuse)


@pytest.mark.parametrize("name", ["fetch_children_filtered", "model_chosen", "model_read"])
def test_whole_tables_stay_on_the_executors(spark, ungathered, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_map_gives_what_list_gives(spark):
    e = engine(spark)
    o, c = SCHEMA.root("orders"), SCHEMA.root("orders").join("referrer")
    q = select_from(o, o["id"], o["total"], o["placed_at"], Nested("by", c, (c["name"].named("name"),))).child(child("items", o, "items", lambda t: [t["code"], t["price"]], "id", lambda t: [t["code"].asc()]))

    def flat(r):
        return r["id"], r["total"], r["placed_at"], r["by"] and r["by"]["name"], ",".join(f"{x.code}{x['price']}" for x in r["items"])

    got = e.map(q, flat, "id long, total decimal(12,2), placed_at timestamp_ntz, name string, items string")
    assert sorted(map(tuple, got.collect())) == sorted(map(flat, e.list(q)))
    assert e.map(q.mapped(lambda r: r["id"] * 2), lambda n: (n,), "n long").agg({"n": "sum"}).first()[0] == 2 * sum(range(40))
    assert e.map(q.where(lambda f: f.lt(o["id"], 0)), flat, "id long, total decimal(12,2), placed_at timestamp_ntz, name string, items string").count() == 0
    with refused(Code.CUSTOMIZER):
        e.map(q.mapped(None, list), flat, "id long")


def test_parents_without_lines_and_lines_without_quantity(spark, tmp_path):
    """Orders 9 to 23 are on the page: those that 4 divides have no lines, of the others the second has no quantity."""
    spark.createDataFrame([(i, 100.0 - i) for i in range(-1, 40)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, n, None if n == 2 else 1.5) for i in range(40) if i % 4 for n in (1, 2, 3)], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in QUERIES["key_groups_children"](spark, str(tmp_path)).collect()}
    assert got == {(i, 3 if i % 4 else 0, 3.0 if i % 4 else 0.0) for i in range(9, 24)}


ORDERS = SCHEMA.root("orders")
PAID = Update(ORDERS).set("status", "X").where(lambda f: f.ne(ORDERS["status"], "NEW"))
CHOSEN = [i for i in range(40) if i % 4]


def _changed(frame):
    return sorted(r["id"] for r in frame.collect() if r["status"] == "X")


def test_committed_chunks_write_each_row_twice_at_most(spark, monkeypatch):
    written = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, f=DataFrameWriter.parquet, **b: (written.append(self._df.count()), f(self, path, *a, **b))[1])
    e = engine(spark)
    steps = []
    for last, step in Writer(e).chunks(PAID, 1, commit=True):
        steps.append((last, step))
        assert e.catalog.frame("orders") is step.after and _changed(step.after) == CHOSEN[: len(steps)] and step.after.count() == 40
    assert [last for last, _ in steps] == CHOSEN and len(written) < 10 and sum(written) <= 80
    for i in (0, 7, 29):  # a step's rows can be read when others are done
        assert _changed(steps[i][1].after) == CHOSEN[: i + 1] and _changed(steps[i][1].affected) == [CHOSEN[i]]
        assert {r["version"] for r in steps[i][1].affected.collect()} == {2}
    assert e.catalog.frame("orders").columns == engine(spark).catalog.frame("orders").columns


def test_committed_chunks_are_taken_up_again(spark):
    e = engine(spark)
    todo = Writer(e).chunks(PAID, 4, commit=True)
    ends = [next(todo)[0] for _ in range(3)]
    todo.close()
    assert ends == [CHOSEN[3], CHOSEN[7], CHOSEN[11]] and _changed(e.catalog.frame("orders")) == CHOSEN[:12]
    assert [last for last, _ in Writer(e).chunks(PAID, 5, ends[-1], True)] == [CHOSEN[16], CHOSEN[21], CHOSEN[26], CHOSEN[29]]
    assert _changed(e.catalog.frame("orders")) == CHOSEN and e.catalog.frame("orders").count() == 40
    assert not list(Writer(e).chunks(PAID, 5, CHOSEN[-1], True)) and e.catalog.frame("orders").count() == 40


def test_committed_chunks_stop_at_the_step_that_fails(spark):
    e = engine(spark)
    orders = e.catalog.frame("orders")
    e.catalog.frames["orders"] = orders.selectExpr(*(c if c != "version" else "if(id = 23, 9, version) AS version" for c in orders.columns))
    done = []
    with pytest.raises(Exception, match=Code.STALE_VERSION.value):
        for last, _ in Writer(e).chunks(PAID.expect_version(1), 1, commit=True):
            done.append(last)
    assert done == [i for i in CHOSEN if i < 23] and _changed(e.catalog.frame("orders")) == done and e.catalog.frame("orders").count() == 40


@pytest.mark.parametrize("commit", [True, False])
def test_chunks_by_text_keys(spark, commit):
    schema = Schema(Entity("texts", ("id",)))
    t = schema.root("texts")
    keys = ["", "Z", "a", "ab", "\u00e9", "\U0001f600", "it's"]
    e = engine(spark, texts=spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + ([(None, 50)] if commit else []), "id string, n int"))
    ends = [last for last, _ in Writer(e).chunks(Delete(t).where(lambda f: f.ne(t["n"], 2)), 2, commit=commit)]
    assert ends == ["Z", "it's", "\U0001f600"]
    assert {tuple(r) for r in e.catalog.frame("texts").collect()} == {("a", 2)} | ({(None, 50)} if commit else set())
