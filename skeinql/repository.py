"""One entity's reads and writes behind a small facade."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from skeinql.operators.engine import Engine, KeysetPage, Page
from skeinql.operators.write import Delete, Insert, Update, Writer, Written
from skeinql.plans.query import Query


class Repository:
    """Reads of a query (as a model's) and writes of its entity."""

    def __init__(self, engine: Engine, query: Query):
        self.engine, self.query, self.writer = engine, query, Writer(engine)

    def _where(self, build: Callable | None) -> Query:
        return self.query.where(build) if build else self.query

    def find_all(self, where: Callable | None = None, sort: list[tuple[str, str]] | None = None, limit: int | None = None) -> list:
        q = self._where(where)
        return self.engine.list(q.ordered_by(sort) if sort else q, limit)

    def find(self, key: Any) -> Any:
        return self.engine.one(self.query, key)

    def find_by_keys(self, keys: Iterable) -> dict:
        return self.engine.by_keys(self.query, keys)

    def count(self, where: Callable | None = None) -> int:
        return self.engine.count(self._where(where))

    def exists(self, where: Callable | None = None) -> bool:
        return not self.engine.frame(self._where(where)).isEmpty()

    def page(self, offset: int, size: int, where: Callable | None = None, mode: str = "count") -> Page:
        return self.engine.page(self._where(where), offset, size, mode)

    def slice(self, size: int, after: str | None = None, before: str | None = None, where: Callable | None = None) -> KeysetPage:
        return self.engine.keyset(self._where(where), size, after, before)

    def update(self, changes: dict[str, Any], where: Callable) -> Written:
        return self.writer.update(Update(self.query.root).changes(changes).where(where))

    def delete(self, where: Callable) -> Written:
        return self.writer.delete(Delete(self.query.root).where(where))

    def insert(self, *rows: dict[str, Any]) -> Written:
        return self.writer.insert(Insert(self.query.root, rows=rows))
