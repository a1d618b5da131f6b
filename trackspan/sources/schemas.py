"""Explicit schemas of every JSON source."""

from __future__ import annotations

from pyspark.sql import types as T

from .. import values as V

_NAMED = T.StructType([T.StructField("name", T.StringType())])
_KEYED = T.StructType([T.StructField("key", T.StringType())])
_PERSON = T.StructType([T.StructField("displayName", T.StringType())])


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ISSUE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("fields", T.StructType([
        *_strings("summary", "description"),
        T.StructField("status", _NAMED),
        T.StructField("priority", _NAMED),
        T.StructField("assignee", _PERSON),
        T.StructField("reporter", _PERSON),
        T.StructField("project", _KEYED),
        T.StructField("issuetype", _NAMED),
        *_strings("created", "updated", V.EPIC_LINK_FIELD),
        T.StructField(V.STORY_POINTS_FIELD, T.DoubleType()),
    ])),
])

PAGE = T.StructType([
    T.StructField("issues", T.ArrayType(ISSUE)),
    T.StructField("isLast", T.BooleanType()),
    T.StructField("nextPageToken", T.StringType()),
    *_strings("pageToken", "export"),
])

USER = T.StructType([
    *_strings("accountId", "displayName", "emailAddress"),
    T.StructField("active", T.BooleanType()),
])

# A page of records that are asked for by offset.
USER_PAGE = T.StructType([
    T.StructField("startAt", T.LongType()),
    T.StructField("maxResults", T.LongType()),
    T.StructField("values", T.ArrayType(USER)),
    *_strings("export"),
])

PROJECT = T.StructType([
    *_strings("key", "name", "id", "description"),
    T.StructField("lead", _PERSON),
])

BOARD = T.StructType([T.StructField("id", T.LongType()), *_strings("name", "type")])

SPRINT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("board_id", T.LongType()),
    *_strings("name", "state", "self"),
])

_ACCOUNT = T.StructType(_strings("id", "name"))

ACTIVITY = T.StructType([
    *_strings("type", "text", "id", "serviceUrl"),
    T.StructField("conversation", T.StructType(_strings("id"))),
    T.StructField("from", _ACCOUNT),
    T.StructField("recipient", _ACCOUNT),
])

CHAT_TURN = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    *_strings("role", "text"),
])

# The columns read from each Parquet table.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz",
    "documents": "doc_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}
