"""Refusals, each with a stable code."""

from __future__ import annotations

from enum import Enum


class Code(Enum):
    """What is refused; the name says when."""

    TYPE_MISMATCH = "SK101"
    FOREIGN_COLUMN = "SK102"
    SAME_JOIN_OTHER_CONDITION = "SK103"
    CONDITION_NEEDS_ALIAS = "SK104"
    UNKNOWN_NAME = "SK105"
    DUPLICATE_NAME = "SK106"
    NEEDS_KEY = "SK110"
    NO_SELECTION = "SK111"
    FLOAT_KEYSET = "SK112"
    EXPRESSION_KEYSET = "SK113"
    NULL_VALUE = "SK120"
    OUTSIDE_PATH = "SK121"
    BUILDER_ESCAPED = "SK122"
    NOTHING_LIFTED = "SK123"
    LIFT_TO_MANY = "SK124"
    CORRELATED_GROUP_KEY = "SK125"
    NOT_GROUPED = "SK130"
    KEYSET_ON_GROUPS = "SK131"
    SUM_TYPE = "SK132"
    GROUP_BY_AGGREGATE = "SK133"
    ORDER_NOT_GROUPED = "SK134"
    HAVING_WITHOUT_GROUPS = "SK135"
    EXACT_AVERAGE = "SK136"
    AGGREGATE_FILTER = "SK137"
    UNBINDABLE = "SK140"
    INTEGRAL_DIVISION = "SK141"
    EMPTY_CASE_CONDITION = "SK142"
    CASE_CONDITION = "SK143"
    BAD_FUNCTION = "SK144"
    AGGREGATE_OF_CORRELATED = "SK145"
    CORRELATED_TO_MANY = "SK146"
    UNBOUND_PARAM = "SK147"
    SEQUENCE = "SK148"
    EMPTY_WRITE_FILTER = "SK150"
    ASSIGNED_TWICE = "SK151"
    NULL_ASSIGNED = "SK152"
    KEY_ASSIGNED = "SK153"
    CONFLICT_CLAUSE = "SK154"
    SHARED_CONFLICT_KEY = "SK155"
    STALE_VERSION = "SK156"
    SOURCE_NOT_UNIQUE = "SK160"
    RECURSION_STEP = "SK161"
    DISCRIMINATOR = "SK162"
    SHAPE = "SK163"
    WINDOW = "SK164"
    JOIN_FILTER = "SK165"
    PAGE_SIZE = "SK170"
    OFFSET = "SK171"
    TWO_ROWS = "SK172"
    NULL_IN_KEYSET = "SK173"
    TO_MANY_SELECTION = "SK174"
    REPEATED_KEY = "SK175"
    FOREIGN_CURSOR = "SK176"
    DUPLICATE_KEY = "SK177"
    UNKNOWN_SORT = "SK178"
    CUSTOMIZER = "SK179"
    TWO_CHILDREN = "SK180"
    ENRICHER_SIZE = "SK181"
    TOO_MANY_CHILDREN = "SK182"
    PLAN_TWICE = "SK183"
    LOOKUP_NOTHING = "SK184"
    NULL_GROUP = "SK185"
    TWO_CATCH_ALLS = "SK186"
    TOO_DEEP = "SK190"
    CYCLE = "SK191"
    DUPLICATE_NODE = "SK192"


class Refused(Exception):
    """A definition or a call that would not give a defined result."""

    def __init__(self, code: Code, why: str):
        super().__init__(f"{code.value} {code.name}: {why}")
        self.code = code
