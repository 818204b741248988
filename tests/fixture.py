"""Small tables with nulls, ties and cycles, and their schema."""

from __future__ import annotations

import datetime
import decimal

from skeinql.operators.engine import Engine
from skeinql.plans.schema import Entity, Relation, Schema, Subtype
from skeinql.sources.catalog import Catalog

SCHEMA = Schema(
    Entity("customers", ("id",), (Relation("orders", "orders", (("id", "customer_id"),), many=True),)),
    Entity(
        "orders", ("id",),
        (
            Relation("customer", "customers", (("customer_id", "id"),)), Relation("referrer", "customers", (("referrer_id", "id"),)), Relation("items", "items", (("id", "order_id"),), many=True),
            Relation("labels", "labels", (), many=True, through=("order_labels", (("id", "order_id"),), (("label_id", "id"),))),
        ),
        version="version",
    ),
    Entity("items", ("id",), (Relation("order", "orders", (("order_id", "id"),)),)),
    Entity("labels", ("id",)),
    Entity("pairs", ("tenant", "no")),
    Entity("sorts", ("id",)),
    Entity("groups", ("id",)),
    Entity("numbers", ("id",)),
    Entity("holders", ("id",), (Relation("card", "cards", (("id", "holder_id"),)),)),
    Entity("cards", ("id",)),
    Entity("folders", ("id",)),
    Entity("nodes", ("tenant", "id")),
    Entity("notes", ("id",), (Relation("customer", "customers", (("lower(email)", "lower(email)"),)),)),
    Entity("vehicles", ("id",), discriminator="kind", subtypes=(Subtype("Car", "car", "cars"), Subtype("Truck", "truck"), Subtype("Tanker", "tanker", parent="Truck"))),
)

STATUSES, COUNTRIES = ("NEW", "PAID", "SHIPPED", "CANCELLED"), ("DE", "FR", "ES", "IT")
START = datetime.datetime(2020, 1, 1)


def orders_rows() -> list[tuple]:
    """40 orders of 10 customers; every third has a referrer."""
    return [(i, i % 10, STATUSES[i % 4], decimal.Decimal(i * 1317 % 100000) / 100, START + datetime.timedelta(minutes=17 * i), (i + 1) % 10 if i % 3 == 0 else None, 1) for i in range(40)]


def items_rows() -> list[tuple]:
    """Three items for each order but every fifth."""
    return [(o * 3 + k, o, f"P{k}", k + o % 4, decimal.Decimal("1.50") * (k + 1)) for o in range(40) if o % 5 for k in range(3)]


def sort_rows() -> list[tuple]:
    return [(i, None if i % 5 == 0 else i % 4, None if i % 7 == 0 else f"t{i % 3}", None if i % 11 == 0 else START + datetime.timedelta(days=i % 6)) for i in range(60)]


def engine(spark, **more) -> Engine:
    f = spark.createDataFrame
    frames = {
        "customers": f([(i, f"C{i:02d}", f"c{i}@X.org", COUNTRIES[i * 7 % 4], i % 10 == 0) for i in range(12)], "id long, name string, email string, country string, vip boolean"),
        "orders": f(orders_rows(), "id long, customer_id long, status string, total decimal(12,2), placed_at timestamp_ntz, referrer_id long, version int"),
        "items": f(items_rows(), "id long, order_id long, code string, quantity int, price decimal(12,2)"),
        "labels": f([(i, f"L{i}") for i in range(4)], "id long, name string"),
        "order_labels": f([(i % 4, i) for i in range(8)] + [(0, 1)], "label_id long, order_id long"),
        "pairs": f([(t, n, f"{t}-{n}") for t in range(3) for n in range(4)], "tenant int, no int, label string"),
        "sorts": f(sort_rows(), "id long, n int, t string, at timestamp_ntz"),
        "groups": f([(1, 1, 2, "b", "x"), (2, 1, 2, "a", "x"), (3, 1, None, None, "y"), (4, 2, 5, None, "x"), (5, 2, 1, "z", None), (6, 3, None, "n", "x")], "id long, g int, k int, v string, state string"),
        "numbers": f([(1, 1, 10, decimal.Decimal("2.345")), (2, 2, 20, decimal.Decimal("-2.345")), (3, 2, 30, decimal.Decimal("2.500")), (4, 1, 40, decimal.Decimal("-2.500"))], "id long, i int, b long, d decimal(12,3)"),
        "holders": f([(i, f"H{i}") for i in range(4)], "id long, name string"),
        "cards": f([(10, 1), (11, 2), (12, None), (13, 99)], "id long, holder_id long"),
        "folders": f([(1, None, "root"), (2, 1, "a"), (3, 1, "b"), (4, 2, "c"), (100, 101, "x"), (101, 100, "y"), (200, None, "d"), (201, 200, "e"), (202, 200, "f"), (203, 201, "g"), (203, 202, "g")], "id long, parent long, name string"),
        "nodes": f([(1, 1, None), (1, 2, 1), (1, 3, 2), (2, 1, None), (2, 2, 1), (2, 9, 7)], "tenant int, id int, parent int"),
        "notes": f([(1, "C1@x.ORG", "hello"), (2, "nobody@x.org", "bye")], "id long, email string, body string"),
        "vehicles": f([(1, "car", 4), (2, "truck", 6), (3, "tanker", 8), (4, None, 2)], "id long, kind string, wheels int"),
        "cars": f([(1, "red")], "id long, colour string"),
    }
    return Engine(Catalog(spark, frames | more))
