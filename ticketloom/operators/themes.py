"""Complaint themes: stored category first, then keyword rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import scale
from ..functions import clean as C
from ..functions.text import hit_counts, ticket_text
from ..policy import DEFAULT_RULES, ThemeRules


def stored_theme(category: Column | str, rules: ThemeRules = DEFAULT_RULES) -> Column:
    """Theme of a stored category, NULL when it has none. Case matters."""
    out = F.lit(None).cast("string")
    for name, theme in rules.category_themes.items():
        out = F.when(C.strip(category) == name, F.lit(theme)).otherwise(out)
    return out


def score_array(text: Column, rules: ThemeRules = DEFAULT_RULES) -> Column:
    """One (hits, order, theme) per theme; the maximum is the winner, ties to the earliest."""
    names = F.array(*[F.lit(theme) for theme in rules.patterns])
    return F.transform(hit_counts(text, rules.patterns), lambda n, i: F.struct(
        n.alias("hits"), (-i).alias("order"), F.get(names, i).alias("theme")))


def theme_scores(tickets: DataFrame, rules: ThemeRules = DEFAULT_RULES) -> DataFrame:
    """Number of matching patterns per ticket and theme, long form."""
    text = ticket_text("customer_message", "agent_notes")
    return (
        tickets.select("ticket_id", score_array(text, rules).alias("s"))
        .select("ticket_id", F.explode_outer("s").alias("s"))
        .select("ticket_id", F.col("s.theme").alias("theme"), F.col("s.hits").alias("hits"))
    )


def explain(tickets: DataFrame, rules: ThemeRules = DEFAULT_RULES) -> DataFrame:
    """Stored theme against the keyword winner, per ticket.

    ``agree`` compares with the winner even when it has no hits, in which case the winner is the
    first theme while ``rule_theme`` is NULL.
    """
    text = ticket_text("customer_message", "agent_notes")
    keyed = tickets.select(
        "ticket_id", C.strip("category").alias("category"),
        stored_theme("category", rules).alias("taxonomy_theme"), text.alias("_text"))
    scored = scale.once(keyed, "scores", score_array(F.col("_text"), rules))
    won = scale.once(scored, "winner", F.array_max("scores"))
    stored = F.get(F.filter("scores", lambda s: s["theme"] == F.col("taxonomy_theme")), F.lit(0))
    return won.select(
        "ticket_id", "category", "taxonomy_theme",
        F.coalesce(stored["hits"], F.lit(0)).alias("stored_hits"),
        F.col("winner.hits").alias("winner_hits"),
        F.when(F.col("winner.hits") > 0, F.col("winner.theme")).alias("rule_theme"),
        F.coalesce(F.col("taxonomy_theme") == F.col("winner.theme"), F.lit(False)).alias("agree"),
    )


def judge(tickets: DataFrame, rules: ThemeRules = DEFAULT_RULES) -> DataFrame:
    """Theme, method and whether category and keywords disagree, from one scoring of the texts."""
    stored, winner = F.col("taxonomy_theme"), F.col("rule_theme")
    return explain(tickets, rules).select(
        "ticket_id", F.coalesce(stored, winner, F.lit(rules.other)).alias("theme"),
        F.when(stored.isNotNull(), F.lit("taxonomy")).when(winner.isNotNull(), F.lit("rule"))
        .otherwise(F.lit("rule-fallback")).alias("method"),
        (stored.isNotNull() & winner.isNotNull() & ~F.col("agree")).alias("disagrees"))


def disagreements(explained: DataFrame) -> DataFrame:
    return explained.where(
        F.col("taxonomy_theme").isNotNull() & F.col("rule_theme").isNotNull() & ~F.col("agree"))


def assign(tickets: DataFrame, rules: ThemeRules = DEFAULT_RULES) -> DataFrame:
    """Add theme, confidence and method. Patterns run only where the category has no theme."""
    text = ticket_text("customer_message", "agent_notes")
    staged = scale.once(
        tickets.withColumn("_stored", stored_theme("category", rules)), "_winner",
        F.when(F.col("_stored").isNull(), F.array_max(score_array(text, rules))))
    by_rule = F.col("_winner.hits") > 0
    return (
        staged.withColumn("theme", F.when(F.col("_stored").isNotNull(), F.col("_stored"))
                          .when(by_rule, F.col("_winner.theme")).otherwise(F.lit(rules.other)))
        .withColumn("confidence", F.when(F.col("_stored").isNotNull(), F.lit(1.0))
                    .when(by_rule, F.lit(0.7)).otherwise(F.lit(0.3)))
        .withColumn("method", F.when(F.col("_stored").isNotNull(), F.lit("taxonomy"))
                    .when(by_rule, F.lit("rule")).otherwise(F.lit("rule-fallback")))
        .drop("_stored", "_winner")
    )


def count_themes(assigned: DataFrame) -> DataFrame:
    """Tickets per week and theme; ``position`` orders by count, then first appearance."""
    counts = assigned.where(F.col("week_start").isNotNull()).groupBy("week_start", "theme").agg(
        F.count(F.lit(1)).alias("n"), F.min("first_seq").alias("seen"))
    order = W.partitionBy("week_start").orderBy(F.desc("n"), "seen")
    return counts.withColumn("position", F.row_number().over(order)).drop("seen")
