"""Mixing sources to target weights, with DataFrame functions only (operator 1).

Documents hang on a tree domain - language - source. A token budget flows down it: a node shares
its budget among its children by their weights; a child that cannot take its share (its
documents, repeated ``max_epochs`` times, hold fewer tokens) is filled, and what it leaves goes
to its siblings by their weights. Since a node never gets more than its subtree can take, a
shortage is made up among siblings first and reaches an ancestor's other children only when a
whole subtree is exhausted.

Each leaf then reads epochs of its documents, every epoch in its own seeded order (MD5 of seed,
epoch and id), and takes the prefix of that token stream that its budget allows: whole epochs,
then the documents before a cut in the last one, the last of them in part (``mix_taken``
tokens).

Scale: leaves are summed with partial aggregation. The cut of a leaf is found without sorting
it: token sums by the order's first two hex digits, then by the next two within the boundary
bucket, and only that bucket's documents are ranked. The documents are read twice and joined
to one row per leaf; whether that table is broadcast is left to its measured size.

Defined cases: a null language, source or domain is a branch of its own; a missing weight is
``default_weight``; nodes of weight zero or less get nothing; a document without words is never
taken; a null id is replaced by the text's MD5; repeated rows of a document are ranked together
and cut alike (each row up to the cut's tokens); a budget over what the tree can take yields
all epochs of all leaves; an empty table yields no rows. Shares are rounded down to tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricecast.llm.common import checkpoint, fresh_name

WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = ("mix_domain", "mix_lang", "mix_source")


def domain_of(source: Column) -> Column:
    """The production rule for a source's domain: by the first hex digit of its MD5."""
    c = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.when(c < "4", "web").when(c < "8", "books").when(c < "c", "forum").otherwise("code")


def _weight(name: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    if weights:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        out = F.coalesce(F.element_at(F.create_map(*pairs), name), out)
    return out


def share(children: DataFrame, parents: list[str], name: str, budget: str, capacity: str, weight: Column) -> DataFrame:
    """``children`` with ``budget`` replaced by each child's share; budget holds the parent's.

    Children are ordered by capacity per weight; those that the remaining budget cannot fill are
    exactly the ones after the first that takes less than its capacity, so one pass over a
    running sum finds them.
    """
    kids = children.withColumn("__w", weight).where("__w > 0")
    by = Window.partitionBy(*parents)
    run = by.orderBy(F.col(capacity) / F.col("__w"), F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    full = (F.col(capacity) * (F.col("__all") - F.col("__pw"))) <= ((F.col(budget) - F.col("__pc")) * F.col("__w"))
    return (kids.withColumn("__all", F.sum("__w").over(by))
            .withColumn("__pw", F.coalesce(F.sum("__w").over(run), F.lit(0.0)))
            .withColumn("__pc", F.coalesce(F.sum(capacity).over(run), F.lit(0.0)))
            .withColumn("__full", full)
            .withColumn("__used", F.sum(F.when(F.col("__full"), F.col(capacity)).otherwise(0.0)).over(by))
            .withColumn("__rest", F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("__w"))).over(by))
            .withColumn(budget, F.when(F.col("__full"), F.col(capacity)).otherwise(
                F.floor((F.col(budget) - F.col("__used")) * F.col("__w") / F.col("__rest")).cast("double")))
            .drop("__w", "__all", "__pw", "__pc", "__full", "__used", "__rest"))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], default_weight: float,
            budget_share: float, max_epochs: int) -> DataFrame:
    """Leaves (LEVELS, tokens) with each leaf's ``budget`` in tokens (double, a whole number).

    The whole budget is ``budget_share`` of all tokens, rounded down.
    """
    # a leaf that a weight on its path leaves without a share can take nothing
    open_ = F.lit(True)
    for level in LEVELS:
        open_ = open_ & (_weight(F.col(level), weights.get(level.removeprefix("mix_"), {}), default_weight) > 0)
    out = leaves.withColumn("cap", F.when(open_, F.col("tokens").cast("double") * max_epochs).otherwise(0.0))
    # one number, so the first level needs no join
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(float(budget_share))).cast("double")).first()[0]
    held = None
    keys = ["__root"]
    out = out.withColumn("__root", F.lit(0))
    for level in LEVELS:
        nodes = out.groupBy(*keys, level).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("budget", F.lit(total or 0.0)) if held is None else _join(nodes, held, keys)
        # no node is offered more than it can take
        room = F.sum("cap").over(Window.partitionBy(*keys))
        nodes = nodes.withColumn("budget", F.least("budget", room))
        w = _weight(F.col(level), weights.get(level.removeprefix("mix_"), {}), default_weight)
        held = share(nodes, keys, level, "budget", "cap", w).drop("cap")
        keys = [*keys, level]
    return _join(leaves, held.drop("__root"), list(LEVELS))


def _join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b``, joined on equal or both null ``on`` columns."""
    r = b.select(*(F.col(c).alias(f"__r_{c}") for c in b.columns))
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return a.join(r, cond, how).select(*a.columns, *(F.col(f"__r_{c}").alias(c) for c in b.columns if c not in on))


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key))


def _cuts(rows: DataFrame, alloc: DataFrame, seed: int) -> DataFrame:
    """Per leaf: whole epochs, the order value at which the last epoch is cut, and the tokens left for it."""
    leaf = list(LEVELS)
    part = alloc.where("rest > 0")

    def ordered(table: DataFrame) -> DataFrame:
        return _join(rows, table, leaf).withColumn("o", _order(seed, F.col("epochs"), F.col("key")))

    extra: list[str] = []
    table = part.select(*leaf, "epochs", "rest")
    for k in (1, 2):   # narrow the cut to one bucket of the order's first, then next two hex digits
        got = ordered(table)
        if k == 2:
            got = got.where(F.substring("o", 1, 2) == F.col("b1"))
        sums = got.groupBy(*table.columns, F.substring("o", 2 * k - 1, 2).alias(f"b{k}")).agg(F.sum("n").alias("s"))
        upto = F.sum("s").over(Window.partitionBy(*leaf).orderBy(f"b{k}"))
        edge = (sums.withColumn("c", upto).where((F.col("c") >= F.col("rest")) & (F.col("c") - F.col("s") < F.col("rest"))))
        extra = [*extra, f"b{k}"]
        table = checkpoint(edge.select(*leaf, "epochs", (F.col("rest") - F.col("c") + F.col("s")).alias("rest"), *extra))
    got = ordered(table).where((F.substring("o", 1, 2) == F.col("b1")) & (F.substring("o", 3, 2) == F.col("b2")))
    sums = got.groupBy(*leaf, "b1", "b2", "rest", "o").agg(F.sum("n").alias("s"))
    upto = F.sum("s").over(Window.partitionBy(*leaf, "b1", "b2").orderBy("o"))
    cut = (sums.withColumn("c", upto).where((F.col("c") >= F.col("rest")) & (F.col("c") - F.col("s") < F.col("rest")))
           .select(*leaf, F.col("o").alias("cut"), (F.col("rest") - F.col("c") + F.col("s")).alias("left")))
    return _join(alloc.select(*leaf, "epochs"), cut, leaf, "left")


def mix(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, budget_share: float = 0.8,
        max_epochs: int = 3, seed: int = 7, default_weight: float = 1.0, domain: Column | None = None) -> DataFrame:
    """Selected rows of ``docs`` with mix_domain, mix_lang, mix_source, mix_epoch, mix_tokens, mix_taken.

    A document taken in several epochs comes once for each. Should ``docs`` use one of these
    names, the added column gets a suffix.
    """
    names = {c: fresh_name(docs, c) for c in (*LEVELS, "mix_epoch", "mix_tokens", "mix_taken")}
    dom = domain_of(F.col("source")) if domain is None else domain
    keyed = {"mix_domain": dom, "mix_lang": F.col("lang"), "mix_source": F.col("source"),
             "key": F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))),
             "n": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")}
    rows = checkpoint(docs.select(*(v.alias(k) for k, v in keyed.items())).where("n > 0"))
    leaves = checkpoint(rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")))
    alloc = budgets(leaves, weights or {}, default_weight, budget_share, max_epochs)
    whole = F.floor(F.col("budget") / F.col("tokens"))
    alloc = checkpoint(alloc.where("budget > 0").withColumn("epochs", whole)
                       .withColumn("rest", F.col("budget").cast("long") - F.col("epochs") * F.col("tokens"))
                       .select(*LEVELS, "epochs", "rest"))
    cuts = checkpoint(_cuts(rows, alloc, seed))
    cuts = cuts.select(*(F.col(c).alias(f"__{c}") for c in cuts.columns))

    full = docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(v.alias(f"__d_{k}") for k, v in keyed.items()))
    cond = F.col("__d_n") > 0
    for c in LEVELS:
        cond = cond & F.col(f"__d_{c}").eqNullSafe(F.col(f"__{c}"))
    got = full.join(cuts, cond, "inner")
    o = _order(seed, F.col("__epochs"), F.col("__d_key"))
    last = F.when(o < F.col("__cut"), F.col("__d_n")).when(o == F.col("__cut"), F.least("__d_n", F.col("__left").cast("long")))
    epoch = F.when(F.col("__epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("__epochs") - 1)).otherwise(F.array().cast("array<long>"))
    takes = F.concat(F.transform(epoch, lambda e: F.struct(e.alias("e"), F.col("__d_n").alias("t"))),
                     F.when(last.isNotNull(), F.array(F.struct(F.col("__epochs").alias("e"), last.alias("t"))))
                     .otherwise(F.array().cast("array<struct<e:bigint,t:bigint>>")))
    got = got.withColumn("__take", F.explode(takes))
    return got.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"__d_{c}").alias(names[c]) for c in LEVELS),
                      F.col("__take.e").alias(names["mix_epoch"]), F.col("__d_n").alias(names["mix_tokens"]),
                      F.col("__take.t").alias(names["mix_taken"]))
