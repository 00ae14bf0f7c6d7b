"""Governance tables derived from the provided tables.

Each view is a union of parts ``(table, expressions[, condition])``. The expressions are SQL that Spark and an ANSI
engine read alike, so one definition feeds the queries and the SQL they are compared with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_KEY9 = "lpad(CAST(c_custkey AS STRING), 9, '0')"
_EMAIL = "lower(replace(c_name, '#', '.')) || '@example.com'"
_SSN = f"substr({_KEY9}, 1, 3) || '-' || substr({_KEY9}, 4, 2) || '-' || substr({_KEY9}, 6, 4)"
_CARD = f"'4000-0000-' || substr({_KEY9}, 2, 4) || '-' || substr({_KEY9}, 6, 4)"
_TENANT_OF_NATION = "'tenant_' || CAST(c_nationkey AS STRING)"

_KYC = [
    "CAST(c_custkey AS STRING) AS customer_id",
    f"{_TENANT_OF_NATION} AS tenant_id",
    "'user_' || CAST(c_custkey AS STRING) AS user_id",
    "c_name AS full_name",
    f"CASE WHEN c_acctbal < 0 THEN NULL ELSE {_EMAIL} END AS email",
    f"{_SSN} AS ssn",
    f"{_CARD} AS card",
    "c_mktsegment AS segment",
    "CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN 'NULL' WHEN 'FURNITURE' THEN NULL ELSE c_name END AS note",
    "c_acctbal AS balance",
    "c_acctbal > 5000 AS premium",
]

_KYC_RECORD = (
    "CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 9000 THEN '[\"' || CAST(c_custkey AS STRING) || '\"]' ELSE "
    "'{\"customer_id\":\"' || CAST(c_custkey AS STRING) || '\",\"full_name\":\"' || c_name || '\"' || "
    "CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 2000 THEN '' WHEN c_acctbal < 0 THEN ',\"email\":null' "
    f"ELSE ',\"email\":\"' || {_EMAIL} || '\"' END || "
    "CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 8000 THEN '' "
    f"ELSE ',\"ssn\":\"' || {_SSN} || '\"' END || '}}' END AS record"
)

_AUDIT = [
    "'ev-' || CAST(event_id AS STRING) AS event_id",
    "ts",
    "event_type AS action",
    "'user_' || CAST(user_id AS STRING) AS actor",
    "'tenant_' || CAST(user_id % 5 AS STRING) AS tenant_id",
    "'rec-' || CAST(event_id AS STRING) AS record_id",
    "CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status",
    "CASE WHEN event_type = 'error' THEN 'error at ' || CAST(event_id AS STRING) ELSE NULL END AS error_message",
]

_AUDIT_RAW = [
    "'ev-' || CAST(event_id AS STRING) AS event_id",
    "ts",
    "CASE WHEN event_type = 'view' AND value < 2 THEN '' ELSE event_type END AS action",
    "CASE WHEN event_type = 'click' AND value < 2 THEN NULL ELSE 'user_' || CAST(user_id AS STRING) END AS actor",
    "CASE WHEN event_type = 'purchase' AND value < 2 THEN '' ELSE 'tenant_' || CAST(user_id % 5 AS STRING) END AS tenant_id",
    "CASE WHEN event_type = 'error' THEN 'FAILURE' WHEN event_type = 'signup' AND value < 2 THEN 'UNKNOWN' ELSE 'SUCCESS' END AS status",
    "CASE WHEN event_type = 'error' AND value >= 10 THEN 'error at ' || CAST(event_id AS STRING) ELSE NULL END AS error_message",
]

_METRICS = [
    "'m-' || CAST(event_id AS STRING) AS metric_id",
    "event_type || '_ms' AS name",
    "value",
    "ts",
    "'tenant_' || CAST(user_id % 5 AS STRING) AS tenant_label",
    "CASE WHEN value < 20 THEN 'fast' ELSE 'slow' END AS speed_label",
]


def _edge(event: str, source: str, target: str, transformation: str, actor: str, tenant: str) -> list[str]:
    return [
        f"{event} AS event_id", f"{source} AS source_dataset", f"{target} AS destination_dataset",
        f"{transformation} AS transformation", f"{actor} AS actor", f"{tenant} AS tenant_id",
    ]


def _name(kind: str, key: str) -> str:
    return f"'{kind}:' || CAST({key} AS STRING)"


_REQUESTS = [
    "'req-' || CAST(c_custkey AS STRING) AS request_id",
    "'user_' || CAST(c_custkey AS STRING) AS user_id",
    f"{_TENANT_OF_NATION} AS tenant_id",
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'GDPR_REQUEST' WHEN 'MACHINERY' THEN 'DATA_RETENTION' ELSE 'USER_REQUEST' END AS reason",
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'email' WHEN 'MACHINERY' THEN 'email,ssn' WHEN 'FURNITURE' THEN 'card' ELSE 'ssn' END AS fields",
    "CASE WHEN c_acctbal < -900 THEN 'IN_PROGRESS' WHEN c_acctbal < -800 THEN 'COMPLETE' WHEN c_acctbal < -700 THEN 'FAILED' ELSE 'PENDING' END AS status",
]

VIEWS: dict[str, list[tuple]] = {
    "kyc": [("customer", _KYC)],
    "kyc_json": [("customer", [
        "CAST(c_custkey AS STRING) AS customer_key", f"{_TENANT_OF_NATION} AS tenant_id", _KYC_RECORD,
    ])],
    "entities": [
        ("customer", ["'customer_v1' AS schema_id", "'c' || CAST(c_custkey AS STRING) AS entity_id",
                      "'{\"customer_id\":\"' || CAST(c_custkey AS STRING) || '\",\"name\":\"' || c_name || '\"' || "
                      "CASE WHEN c_acctbal < 0 THEN '' ELSE ',\"email\":null' END || '}' AS record"]),
        ("part", ["CASE WHEN p_size > 40 THEN 'part_v9' ELSE 'part_v1' END AS schema_id",
                  "'p' || CAST(p_partkey AS STRING) AS entity_id",
                  "'{\"part_id\":\"' || CAST(p_partkey AS STRING) || '\"' || "
                  "CASE p_type WHEN 'PROMO' THEN '' ELSE ',\"brand\":\"' || p_brand || '\"' END || '}' AS record"]),
        ("supplier", ["'supplier_v1' AS schema_id", "'s' || CAST(s_suppkey AS STRING) AS entity_id",
                      "CASE WHEN s_acctbal < 1000 THEN '\"' || s_name || '\"' ELSE '{\"supplier_id\":' || CAST(s_suppkey AS STRING) || '}' END AS record"]),
    ],
    "audit": [("events", _AUDIT)],
    "audit_raw": [("events", _AUDIT_RAW)],
    "metrics": [("events", _METRICS)],
    "edges": [
        ("nation", _edge("'n' || CAST(n_nationkey AS STRING)", _name("region", "n_regionkey"), _name("nation", "n_nationkey"),
                         "'COPY'", "'loader'", "'tenant_' || CAST(n_nationkey AS STRING)")),
        ("customer", _edge("'c' || CAST(c_custkey AS STRING)", _name("nation", "c_nationkey"), _name("customer", "c_custkey"),
                           "'ENRICH'", "CASE WHEN c_acctbal < 0 THEN '' ELSE 'crm' END", _TENANT_OF_NATION)),
        ("orders", _edge("'o' || CAST(o_orderkey AS STRING)", _name("customer", "o_custkey"), _name("order", "o_orderkey"),
                         "CASE o_orderstatus WHEN 'F' THEN 'FILTER' WHEN 'P' THEN 'JOIN' ELSE 'AGGREGATE' END",
                         "'sales'", "'tenant_' || CAST(o_custkey % 25 AS STRING)")),
        ("lineitem", _edge("'l' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)",
                           _name("order", "l_orderkey"), _name("supplier", "l_suppkey"),
                           "CASE l_returnflag WHEN 'A' THEN 'MASK' WHEN 'N' THEN 'HASH' ELSE 'TOKENIZE' END",
                           "'shop'", "'tenant_' || CAST(l_suppkey % 25 AS STRING)")),
        ("supplier", _edge("'s' || CAST(s_suppkey AS STRING)", _name("supplier", "s_suppkey"), _name("nation", "s_nationkey"),
                           "'REDACT'", "'loader'", "'tenant_' || CAST(s_nationkey AS STRING)")),
        ("supplier", _edge("'t' || CAST(s_suppkey AS STRING)", _name("supplier", "s_suppkey"), _name("supplier", "s_suppkey"),
                           "'COPY'", "'loader'", "'tenant_' || CAST(s_nationkey AS STRING)"), "s_acctbal < 0"),
    ],
    "requests": [("customer", _REQUESTS, "c_acctbal < 0")],
    "access": [
        ("documents", [
            "CASE lang WHEN 'en' THEN 'tenant_' || CAST(doc_id % 6 AS STRING) WHEN 'fr' THEN 'tenant_ghost' "
            "WHEN 'de' THEN 'acme/' || source ELSE '' END AS tenant_id",
            "'s3://' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS resource",
            "'s3' AS connector_type",
        ]),
        ("pages", [
            "CASE WHEN url LIKE '%#top' THEN repeat('t', 256) ELSE 'tenant_' || CAST(page_id % 6 AS STRING) END AS tenant_id",
            "url AS resource", "'kafka' AS connector_type",
        ]),
    ],
    "paths": [
        ("pages", ["CASE WHEN url LIKE 'http://%' THEN substr(url, 7) WHEN url LIKE '%#top' THEN replace(url, '#top', '/../top') "
                   "ELSE url END AS path"]),
        ("documents", ["CASE lang WHEN 'es' THEN '' ELSE source || '/' || CAST(doc_id AS STRING) || '.txt' END AS path"]),
    ],
    "messages": [("events", [
        "event_id AS offset", "CAST(user_id % 4 AS INT) AS partition", "ts AS timestamp", "props AS value",
        "'tenant_' || CAST(user_id % 5 AS STRING) AS tenant_id", "'msg-' || CAST(event_id AS STRING) AS message_id",
    ])],
    "migrated_orders": [("orders", [
        "o_orderkey", "o_custkey", "o_orderstatus",
        "CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 50000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice",
        "o_orderpriority",
    ], "NOT (o_orderstatus = 'P' AND o_totalprice > 450000)")],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; ``actor`` becomes the ``user`` column of the log tables."""
    parts = []
    for part in VIEWS[name]:
        base = table(spark, sf_dir, part[0])
        parts.append((base.where(part[2]) if len(part) > 2 else base).selectExpr(*part[1]))
    df = reduce(DataFrame.unionByName, parts)
    return df.withColumnRenamed("actor", "user") if "actor" in df.columns else df


def view_sql(name: str) -> str:
    """The same table as a SELECT for another engine."""
    parts = []
    for part in VIEWS[name]:
        where = f" WHERE {part[2]}" if len(part) > 2 else ""
        parts.append(f"SELECT {', '.join(part[1])} FROM {part[0]}{where}")
    return " UNION ALL ".join(parts)


def with_views(names: list[str], body: str) -> str:
    """``body`` with the named views in front as common table expressions."""
    defined = ", ".join(f"{n} AS ({view_sql(n)})" for n in names)
    text = body.strip()
    if not names:
        return text
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            return f"{start}{defined}, {text[len(start):]}"
    return f"WITH {defined} {text}"
