"""Request payloads for a text model, and acceptance of what it returns.

No model is called here: the operators build the request rows and check reply rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import scale
from ..functions import text as X
from ..functions.clean import ratio

# Characters of each text that a request carries unless told otherwise.
MESSAGE_CUT = 800
NOTES_CUT = 400

def payload_items(tickets: DataFrame, message_cut: int = MESSAGE_CUT, notes_cut: int = NOTES_CUT) -> DataFrame:
    """One request item per ticket as JSON."""
    item = F.struct(
        "ticket_id",
        F.substring(F.coalesce("customer_message", F.lit("")), 1, message_cut).alias("customer_message"),
        F.substring(F.coalesce("agent_notes", F.lit("")), 1, notes_cut).alias("agent_notes"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("product_family", F.lit("")).alias("product_family"),
    )
    return tickets.select("ticket_id", "first_seq", F.to_json(item).alias("item"))


def payload_batches(tickets: DataFrame, batch_size: int = 20) -> DataFrame:
    """Requests of exactly ``batch_size`` tickets in order of arrival; only the last one may have fewer.

    The tickets at hand are numbered without gaps first, so filters and de-duplication leave no request part-filled.
    """
    placed = scale.numbered(payload_items(tickets), [F.col("first_seq").asc(), F.col("ticket_id").asc()], "place")
    return (
        placed.groupBy(F.expr(f"place div {batch_size}").alias("batch_id"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "ticket_id", "item"))).alias("rows"))
        .select(
            "batch_id", F.col("rows.ticket_id").alias("ticket_ids"),
            F.concat(F.lit('{"tickets":['), F.array_join("rows.item", ","), F.lit("]}")).alias("payload"))
    )


def parsed_replies(responses: DataFrame) -> DataFrame:
    """(batch_id, themes): the themes of a reply that is one JSON object of the expected form, else NULL.

    The reply is put into an outer object before it is parsed, since the parser ignores what follows a
    value: trailing text, a second object and single quotes make the whole unreadable. Ids must be
    strings.
    """
    whole = F.expr("try_parse_json(concat('{\"reply\":', response, ',\"reply_end\":true}'))")
    rows = responses.select("batch_id", whole.alias("v")).select(
        "batch_id",
        F.expr("try_variant_get(v, '$.reply.themes', 'array<struct<theme:string,evidence_ticket_ids:array<variant>>>')").alias("themes"),
        (F.coalesce(F.expr("try_variant_get(v, '$.reply_end', 'boolean')"), F.lit(False))
         & (F.size(F.expr("map_keys(try_variant_get(v, '$', 'map<string,variant>'))")) == 2)).alias("closed"))
    texts = F.transform("themes", lambda t: F.struct(
        t["theme"].alias("theme"),
        F.transform(t["evidence_ticket_ids"], lambda i: F.when(
            F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string"))).alias("evidence_ticket_ids")))
    return rows.select("batch_id", F.when(F.coalesce("closed", F.lit(False)), texts).alias("themes"))


def label_rows(parsed: DataFrame) -> DataFrame:
    """Every (batch, ticket, theme) a parsed reply claims, checked or not."""
    return (
        parsed.select("batch_id", F.explode("themes").alias("t"))
        .select("batch_id", F.col("t.theme").alias("theme"),
                F.explode("t.evidence_ticket_ids").alias("ticket_id"))
    )


def check_responses(parsed: DataFrame, members: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Accept or reject each reply of ``parsed_replies`` as a whole.

    Rejected: a reply that does not parse, a theme that ``taxonomy`` (name) does not list, a ticket id
    that was not in the batch, and an id used twice. ``members`` holds (batch_id, ticket_id).
    """
    ids = F.array_compact(F.flatten(F.array_compact(F.transform("themes", lambda t: t["evidence_ticket_ids"]))))
    judged = parsed.select(
        "batch_id",
        (F.col("themes").isNull() | F.coalesce(F.exists("themes", lambda t: t.isNull() | t["theme"].isNull()
         | t["evidence_ticket_ids"].isNull() | F.exists(t["evidence_ticket_ids"], lambda i: i.isNull())), F.lit(False))).alias("broken"),
        F.coalesce(F.size(ids) != F.size(F.array_distinct(ids)), F.lit(False)).alias("repeated_id"),
    )
    names = taxonomy.select(F.col("name").alias("theme")).distinct()
    foreign = (
        parsed.select("batch_id", F.explode("themes").alias("t")).select("batch_id", F.col("t.theme").alias("theme"))
        .join(names, "theme", "left_anti").select("batch_id").distinct().withColumn("off_taxonomy", F.lit(True))
    )
    strangers = (
        label_rows(parsed).where(F.col("ticket_id").isNotNull()).join(members, ["batch_id", "ticket_id"], "left_anti")
        .groupBy("batch_id").agg(F.count(F.lit(1)).alias("unknown_ids"))
    )
    return (
        judged.join(foreign, "batch_id", "left").join(strangers, "batch_id", "left")
        .withColumn("off_taxonomy", F.coalesce("off_taxonomy", F.lit(False)))
        .withColumn("unknown_ids", F.coalesce("unknown_ids", F.lit(0).cast("long")))
        .withColumn("accepted", ~F.col("broken") & ~F.col("off_taxonomy") & ~F.col("repeated_id")
                    & (F.col("unknown_ids") == 0))
    )


def accepted_labels(parsed: DataFrame, checked: DataFrame) -> DataFrame:
    """Labels of the accepted replies; a ticket id occurs once per batch there."""
    return label_rows(parsed).join(
        checked.where("accepted").select("batch_id"), "batch_id", "left_semi")


def merge_labels(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Accepted labels replace the rule theme; tickets without one keep it.

    A ticket with labels from several batches takes that of the latest one, so it stays one row.
    """
    given = labels.groupBy("ticket_id").agg(F.max_by("theme", "batch_id").alias("_given"))
    return (
        assigned.join(given, "ticket_id", "left")
        .withColumn("from_model", F.col("_given").isNotNull())
        .withColumn("theme", F.coalesce("_given", "theme")).drop("_given")
    )


def label_coverage(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of each batch's tickets that received an accepted label."""
    asked = members.groupBy("batch_id").agg(F.count(F.lit(1)).alias("asked"))
    got = labels.groupBy("batch_id").agg(F.count(F.lit(1)).alias("labelled"))
    return asked.join(got, "batch_id", "left").select(
        "batch_id", "asked", F.coalesce("labelled", F.lit(0).cast("long")).alias("labelled"),
        ratio(F.coalesce("labelled", F.lit(0)), F.col("asked")).alias("coverage"))


def check_polished(drafts: DataFrame, draft: str = "draft", polished: str = "polished") -> DataFrame:
    """Keep a polished text only when every figure of its draft is still in it."""
    return drafts.withColumn("kept", X.figures_kept(draft, polished))
