"""Named predicates: a catalogue, and what to make one's own with."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from skeinql.errors import Code, Refused
from skeinql.functions.expr import Custom, Scalar, Value


@dataclass(frozen=True)
class Operator:
    """``test`` gets the column and the value (a column if the value is an expression) and gives a boolean column."""

    name: str
    test: Callable

    def over(self, of: Scalar, v: Any) -> Custom:
        if v is None:
            raise Refused(Code.NULL_VALUE, self.name)
        if isinstance(v, Scalar):
            return Custom(self.name, self.test, (of, v))
        if isinstance(v, (str, int, float, bool)):
            return Custom(self.name, self.test, (of, Value(v)))
        frozen = tuple(v) if isinstance(v, list) else v
        return Custom(f"{self.name}{frozen!r}", lambda c: self.test(c, v), (of,))


def _column(v: Any):
    from pyspark.sql import functions as F

    return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else v


def _words(c: Any):
    from pyspark.sql import functions as F

    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _contains(c, v):
    from pyspark.sql import functions as F

    return F.size(F.array_except(_column(v), c)) == 0


def _overlaps(c, v):
    from pyspark.sql import functions as F

    return F.arrays_overlap(c, _column(v))


class _JsonContains(Operator):
    """JSON that is known when the query is made is compared at any depth, a column's as flat objects."""

    def over(self, of: Scalar, v: Any) -> Custom:
        if v is None or isinstance(v, Scalar):
            return super().over(of, v)
        known = json.loads(v) if isinstance(v, str) else v
        return Custom(f"{self.name}{json.dumps(known, sort_keys=True)}", lambda c: _holds(c, known), (of,))


def _holds(c: Any, v: Any) -> Any:
    """Does the JSON text ``c`` contain ``v``? Objects by their keys, arrays by their elements in any order; a null is an absent value."""
    from pyspark.sql import functions as F

    no = F.lit(False)
    if isinstance(v, dict):
        out = F.coalesce(F.ltrim(c).startswith("{"), no)
        for k, x in v.items():
            out = out & _holds(F.get_json_object(c, f"$['{k}']"), x)
        return out
    if isinstance(v, list):
        out = F.coalesce(F.ltrim(c).startswith("["), no)
        for x in v:
            out = out & F.coalesce(F.exists(F.from_json(c, "array<string>"), _element(x)), no)
        return out
    if v is None:
        return c.isNull()
    if isinstance(v, bool):
        return F.coalesce(c == str(v).lower(), no)
    if isinstance(v, (int, float)):
        return F.coalesce(c.try_cast("double") == float(v), no)
    return F.coalesce(c == F.lit(v), no)


def _element(v: Any) -> Callable:
    return lambda e: _holds(e, v)


def _json(c, v):
    from pyspark.sql import functions as F

    # flat objects: every pair of the value is among the column's pairs
    kind = "map<string,string>"
    return F.size(F.array_except(F.map_entries(F.from_json(v, kind)), F.map_entries(F.from_json(c, kind)))) == 0


#: Words that the english configuration leaves out, and endings that it cuts off.
_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "or", "the", "to", "with")
_ENDINGS = "(?<=[a-z]{3})(?:ings?|ed|es|s)$"


def full_text(configuration: str = "simple") -> Operator:
    """All words of the value are words of the column, in any order and case; ``english`` ignores stop words and endings."""
    if configuration not in ("simple", "english"):
        raise Refused(Code.UNKNOWN_NAME, configuration)

    def test(c, v):
        from pyspark.sql import functions as F

        def words(x):
            x = F.lit(x) if isinstance(x, str) else x
            if configuration == "simple":
                return _words(x)
            return F.transform(F.filter(_words(x), lambda w: ~w.isin(*_STOP)), lambda w: F.regexp_replace(w, _ENDINGS, ""))

        return F.size(F.array_except(words(v), words(c))) == 0

    return Operator("full_text_match" if configuration == "simple" else f"full_text_match_{configuration}", test)


def _ilike(c, v):
    from pyspark.sql import functions as F

    return F.call_function("like", F.lower(c), F.lower(v))


def _rlike(c, v):
    from pyspark.sql import functions as F

    return F.rlike(c, v)


ILIKE = Operator("ilike", _ilike)
REGEX_MATCH = Operator("regex_match", _rlike)
ARRAY_CONTAINS = Operator("array_contains", _contains)
ARRAY_OVERLAPS = Operator("array_overlaps", _overlaps)
#: Containment of JSON: objects, arrays and values at any depth.
JSON_CONTAINS = _JsonContains("json_contains", _json)
FULL_TEXT_MATCH = full_text()
