"""Mixing of sources to target weights, budgeted down a tree of domain, language and source.

A leaf offers its tokens once for each of ``max_epochs`` epochs. The budget is handed down level by
level: siblings share their parent's tokens by weight, and one that offers less than its share
gives the shortage to its siblings; only if all of them together offer less does the parent's parent
redistribute it, because a node's offer is the sum of its leaves'. A leaf's tokens are then
taken as a prefix of its seeded epochs: whole epochs first, then the first documents of one more, in
the order of md5("seed:epoch:doc_id").

Running sums are taken in pieces: a leaf's epoch is cut by leading digits of the md5, the
pieces' sums are added up first, and each piece is then summed by itself, so that a leaf
with a third of all documents is spread like any other. Only whole numbers are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import SPACE_RE, WHITE, cut_lineage

LEVELS = ("domain", "lang", "source")


def _weight(column: str, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, weight in sorted(weights.items()):
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out.cast("long")


def n_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, SPACE_RE))).otherwise(0).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def share_out(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds ``granted``: each parent's ``budget`` divided among its children by ``weight`` up to their ``offer``.

    Children whose offer is at most their share at the level of those not yet settled take it
    whole; taken in the order of offer / weight these come first. The rest divide what is left; rounding
    down leaves less than a token a child. A child of weight 0 gets nothing.
    """
    nodes = nodes.withColumn("_r", F.when(F.col("weight") > 0, F.col("offer") / F.col("weight")).otherwise(F.lit(float("inf"))))
    order = Window.partitionBy(*parent).orderBy("_r", key)
    before = F.coalesce(F.sum("offer").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavier = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumns({"_before": before, "_heavier": heavier})
    settled = (F.col("weight") > 0) & (F.col("offer").cast("decimal(38,0)") * F.col("_heavier") <= (F.col("budget") - F.col("_before")).cast("decimal(38,0)") * F.col("weight"))
    nodes = nodes.withColumn("_settled", settled)
    group = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("_settled"), F.col("offer"))).over(group), F.lit(0))
    weights = F.sum(F.when(~F.col("_settled"), F.col("weight"))).over(group)
    nodes = nodes.withColumns({"_left": left, "_weights": weights})
    part = F.when(F.col("weight") > 0, F.expr("cast((cast(_left as decimal(38,0)) * weight) div _weights as bigint)")).otherwise(F.lit(0))
    return nodes.withColumn("granted", F.when(F.col("_settled"), F.col("offer")).otherwise(part)).drop("_r", "_before", "_heavier", "_settled", "_left", "_weights")


def leaf_budgets(leaves: DataFrame, percent: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]], default: int = 1) -> DataFrame:
    """(domain, lang, source, tokens, target) from (domain, lang, source, tokens); the budget is ``percent`` of all tokens."""
    tree = leaves.withColumn("offer", F.col("tokens") * max_epochs)
    level = tree.agg(F.expr(f"cast(coalesce(sum(tokens), 0) * {int(percent)} div 100 as bigint)").alias("budget"))
    above: list[str] = []
    for name in LEVELS:
        nodes = tree.groupBy(*above, name).agg(F.sum("offer").alias("offer"))
        nodes = nodes.withColumn("weight", _weight(name, weights.get(name, {}), default))
        nodes = nodes.join(level, above) if above else nodes.crossJoin(F.broadcast(level))  # one row: the budget of the root
        level = share_out(nodes, above or [F.lit(0)], name).select(*above, name, F.col("granted").alias("budget"))
        above = [*above, name]
    return tree.join(level, above).select(*above, "tokens", F.col("budget").alias("target"))


def mix(
    docs: DataFrame,
    domain: Column,
    tokens: Column | None = None,
    percent: int = 100,
    max_epochs: int = 4,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    seed: int = 1,
    piece_docs: int = 2048,
    most_broadcast: int = 100_000,
    key: Column | None = None,
) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, start, n_taken): a row for each document and epoch taken.

    With ``key``, a number that tells rows of one doc_id apart, there is a last column of that name.

    ``start`` is the document's place in its leaf's stream of epochs and ``n_taken`` what the target has room
    for, less than n_tokens at the end only. ``weights`` gives whole numbers by level and name (default 1).
    Null lang or source count as an empty name. Documents without tokens or without doc_id are never taken;
    repeated rows are taken each. The leaves' targets go to every task while there are at most ``most_broadcast``
    leaves (some 10 MB), and are joined by a shuffle beyond that.
    """
    tokens = n_words(F.coalesce(F.col("text").cast("string"), F.lit(""))) if tokens is None else tokens
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        domain.alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        tokens.alias("n_tokens"),
        (F.lit(0) if key is None else key).cast("long").alias("key"),
    )
    own = cut_lineage(own.where("doc_id is not null and n_tokens > 0"))
    leaves = cut_lineage(own.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    budgets = leaf_budgets(leaves.drop("docs"), percent, max_epochs, weights or {})
    # Leading digits of the md5 so that a piece has about piece_docs documents.
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("docs") / piece_docs) / F.log(F.lit(16.0)))).cast("int")
    plan = leaves.join(budgets.drop("tokens"), list(LEVELS)).select(*LEVELS, "tokens", "target", digits.alias("digits"))
    plan = cut_lineage(plan.where("target > 0"))
    plan = F.broadcast(plan) if plan.count() <= most_broadcast else plan
    last = F.expr("cast((target - 1) div tokens as int)")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    rows = (
        own.join(plan, list(LEVELS))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("mark", mark)
        .withColumn("piece", F.expr("substring(mark, 1, digits)"))
        .select("doc_id", *LEVELS, "n_tokens", "key", "tokens", "target", "epoch", "mark", "piece")
    )
    keys = [*LEVELS, "epoch"]
    whole = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy(*keys, "piece").agg(F.sum("n_tokens").alias("n")).select(*keys, "piece", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "piece").orderBy("mark", "doc_id", "n_tokens", "key").rowsBetween(Window.unboundedPreceding, -1)
    started = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offset, [*keys, "piece"])
    return (
        started.withColumn("start", F.col("epoch") * F.col("tokens") + F.col("offset") + F.col("inside"))
        .where("start < target")
        .select("doc_id", *LEVELS, "epoch", "n_tokens", "start", F.least("n_tokens", F.col("target") - F.col("start")).alias("n_taken"), *["key"] * (key is not None))
    )
