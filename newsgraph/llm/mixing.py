"""Source mixtures: token budgets down a tree, then a seeded prefix of every leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.common import checkpoint

# Leaves of a plan that may be broadcast; a larger plan is joined by shuffle.
BROADCAST_LEAVES = 50_000
_BUCKET = 3  # hex digits: 4096 buckets for each leaf

# The mixture of the production query; the expressions hold in Spark and ANSI SQL.
DOMAIN = ("CASE WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 10 THEN 'web' "
          "WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) >= 10 THEN 'reference' ELSE 'other' END")
LEVELS = {"domain": DOMAIN, "language": "lang", "origin": "source"}
WEIGHTS = {"domain": {"web": 3, "reference": 2}, "language": {"en": 4, "de": 2, "fr": 2, "es": 1}, "origin": {"src0": 2}}
SHARE = (4, 5)  # tokens wanted, as a fraction of the tokens there are
MAX_EPOCHS = 2
SEED = 17


def tokens(text: str = "text") -> Column:
    """Runs of non-blank characters (none in a null text)."""
    return F.coalesce(F.expr(rf"regexp_count({text}, r'[^\x20\x09-\x0D]+')"), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Deal every parent's ``budget`` to its children in proportion to ``w``, none above its ``cap``.

    What a child cannot use goes to its siblings, so budget leaves a parent only
    if all its children are full (the caller caps a parent by their sum).
    Children are met in the order of cap / w: one is full if the budget covers
    all before it and lifts the rest to its level.  The others share what is
    left, rounded on running sums, so no token is lost.  Adds ``share``.
    """
    part = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    run = part.orderBy(F.col("cap") / F.col("w"), name)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    wide = lambda c: F.col(c).cast("decimal(17,0)")
    n = nodes.withColumn("_before", F.sum("cap").over(run) - F.col("cap"))
    n = n.withColumn("_from", F.sum("w").over(part) - F.sum("w").over(run) + F.col("w"))
    n = n.withColumn("_full", big("cap") * wide("_from") + big("_before") * wide("w") <= big("budget") * wide("w"))
    n = n.withColumn("_left", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(part))
    n = n.withColumn("_open", F.when(F.col("_full"), 0).otherwise(F.col("w")))
    n = n.withColumn("_all", F.greatest(F.sum("_open").over(part), F.lit(1))).withColumn("_upto", F.sum("_open").over(run))
    upto = F.expr("cast(_left as decimal(20,0)) * cast(_upto as decimal(17,0)) div _all")
    less = F.expr("cast(_left as decimal(20,0)) * cast(_upto - _open as decimal(17,0)) div _all")
    return n.withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(upto - less).cast("long")).drop(
        "_before", "_from", "_full", "_left", "_open", "_all", "_upto")


def budgets(leaves: DataFrame, levels: list[str], weights: dict, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """Token budget of every leaf; ``leaves`` has the levels and ``tokens``.  Leaves keep their ``tokens``."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("cap"), F.lit(0))).first()
    above = None
    for i, level in enumerate(levels):
        up, down = levels[:i], levels[:i + 1]
        nodes = leaves.groupBy(*down).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("w", _weight(level, weights))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(min(total[0] * share[0] // share[1], total[1])).cast("long"))
        else:
            nodes = nodes.join(above, up)
        above = fill(nodes, up, level).select(*down, "tokens", F.col("share").alias("budget"))
        above = above if i == len(levels) - 1 else above.drop("tokens")
    return above


def mix(docs: DataFrame, levels: dict[str, str] | None = None, weights: dict[str, dict[str, int]] | None = None,
        share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Documents chosen to meet target weights, one row for each epoch in which a document is used.

    ``levels`` names the tree from the root (SQL expressions over the documents;
    null is the empty name), ``weights`` the whole-number weight of a name at
    its level (default 1).  The budget is ``share`` of all tokens; a leaf holds
    its tokens times ``max_epochs``.  Budgets go down the tree by weight; what a
    node cannot use goes to its siblings, and past them only through their
    ancestors' siblings.  A leaf takes whole epochs, then the longest prefix
    within its rest of a last epoch, in the order of an md5 of seed, epoch,
    doc_id and text; rows equal in doc_id and text enter together.  Documents
    without tokens cost nothing and enter with the prefix before them.

    Only DataFrame operations.  Adds ``epoch`` (from 1), ``n_tokens`` and the
    level columns (columns of the input with these names are replaced).
    Texts are read twice and do not shuffle unless the plan has more than
    ``BROADCAST_LEAVES`` leaves.  The prefix of a hot leaf is found from the
    totals of its 4096 hash buckets; only the bucket of the cut is summed row by
    row.
    """
    levels, weights = levels or LEVELS, WEIGHTS if weights is None else weights
    names = [f"_l{i}" for i in range(len(levels))]
    weights = {n: weights.get(k, {}) for n, k in zip(names, levels, strict=True)}
    leaf_of = {n: F.coalesce(F.expr(x).cast("string"), F.lit("")) for n, x in zip(names, levels.values(), strict=True)}
    ident = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    base = docs.select(F.struct(*docs.columns).alias("_row"), *[x.alias(n) for n, x in leaf_of.items()],
                       ident.alias("_id"), tokens().alias("_tokens"))
    slim = checkpoint(base.select(*names, "_id", "_tokens"))
    leaves = slim.groupBy(*names).agg(F.sum("_tokens").alias("tokens"))
    plan = budgets(leaves, names, weights, share, max_epochs)
    plan = plan.withColumn("_full", F.expr("if(tokens = 0, 0L, budget div tokens)"))
    plan = checkpoint(plan.withColumn("_rest", F.col("budget") - F.col("_full") * F.col("tokens")))
    bounded = plan.count() <= BROADCAST_LEAVES
    small = lambda df: F.broadcast(df) if bounded else df
    key = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("_full").cast("string"), F.col("_id")))
    bucket = F.substring("_key", 1, _BUCKET)
    # a leaf that its whole epochs use up takes nothing of another
    last = small(plan.where("_rest > 0 or _full = 0"))
    keyed = slim.join(last, names).withColumn("_key", key).withColumn("_bucket", bucket)
    upto = Window.partitionBy(*names).orderBy("_bucket")
    sums = keyed.groupBy(*names, "_bucket", "_rest").agg(F.sum("_tokens").alias("n"))
    sums = sums.withColumn("_sum", F.sum("n").over(upto))
    edge = sums.where("_sum > _rest").groupBy(*names).agg(
        F.min("_bucket").alias("_edge"), F.min_by(F.col("_sum") - F.col("n"), "_bucket").alias("_before"))
    edge = checkpoint(edge)
    row = Window.partitionBy(*names).orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    # equal rows are one before the window
    inside = keyed.join(small(edge), names).where("_bucket = _edge").groupBy(*names, "_key", "_before", "_rest").agg(F.sum("_tokens").alias("_tokens"))
    inside = inside.withColumn("_sum", F.col("_before") + F.sum("_tokens").over(row))
    upper = inside.where("_sum <= _rest").groupBy(*names).agg(F.max("_key").alias("_upper"))
    cut = plan.join(edge, names, "left").join(upper, names, "left").select(
        *names, "_full", F.when(F.expr("_rest > 0 or _full = 0"), F.coalesce("_upper", "_edge", F.lit("g"))).alias("_cut"))
    cut = checkpoint(cut)
    chosen = base.join(small(cut), names).withColumn("_copies", F.col("_full") + F.coalesce((key <= F.col("_cut")).cast("long"), F.lit(0)))
    chosen = chosen.where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    added = {"epoch": F.col("_epoch").cast("int"), "n_tokens": F.col("_tokens"),
             **{k: F.col(n) for n, k in zip(names, levels, strict=True)}}
    return chosen.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])
