"""Declared schemas. Every export cell is text; operators parse into typed columns once."""
from __future__ import annotations

from pyspark.sql import types as T

TICKET_COLUMNS = [
    "ticket_id", "created_at", "first_response_at", "resolved_at", "status", "channel",
    "customer_id", "order_id", "product_sku", "category", "priority", "assigned_team",
    "agent_id", "transfers", "csat_score", "refund_amount_inr", "refund_reason_code",
    "replacement_issued", "customer_message", "agent_notes", "source_system",
]
ROSTER_COLUMNS = ["agent_id", "name", "site", "team", "shift", "tier", "from_date", "to_date"]
SAMPLE_COLUMNS = [
    "item_id", "stratum", "ticket_id", "pair_id", "channel", "source_system", "predicted",
    "method", "text", "human_label", "notes",
]
BOARD_COLUMNS = ["agent_id", "agent_name", "team", "shift", "site", "tickets_completed"]
THEME_COLUMNS = ["ticket_id", "theme", "confidence", "method"]


def text_schema(columns: list[str]) -> T.StructType:
    """All-string schema for an export."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


TAXONOMY_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("themes", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("definition", T.StringType()),
    ]))),
    T.StructField("emerging_other_note", T.StringType()),
    T.StructField("adjudication_note", T.StringType()),
])
