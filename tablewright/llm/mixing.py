"""Mixing sources to target weights: token budgets down a domain-language-source tree, prefixes of seeded epochs.

Everything is a DataFrame expression. Budgets are whole numbers of tokens: a node hands its budget to its children by weight;
a child that cannot use its share, even when every document below it is repeated as often as allowed, gets what it can use,
and its siblings share the rest. So a shortage is met among siblings first, and reaches a node's own siblings only as far as
the node as a whole is short.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.shared import broadcast_if_small, private_names
from tablewright.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 3  # hex digits of the order hash whose token sums are kept for each leaf: 4096 sums

Weights = Mapping[str, Mapping[str, int]]


def word_count(text: str) -> Column:
    """Tokens of a text: its words. NULL has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def order_hash(key: str, epoch: str, seed: int) -> Column:
    """Place of a document in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _weight(level: str, weights: Weights) -> Column:
    given = weights.get(level, {})
    if any(w < 0 for w in given.values()):
        raise ValueError("a weight must not be negative")
    out = F.lit(int(given.get("*", 1)))
    for value, weight in given.items():
        if value != "*":
            out = F.when(F.col(level) == value, F.lit(int(weight))).otherwise(out)
    return out.cast("bigint")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Weights, percent: int, epochs: int) -> DataFrame:
    """``leaves(*levels, tokens)`` with the token ``budget`` of each leaf.

    The total is ``percent`` % of all tokens, or all that ``epochs`` passes hold if that is less. Shares are exact: what rounding
    leaves over goes to the next sibling. A node of weight 0 gets nothing.
    """
    wide = "decimal(20,0)"
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    # a subtree of weight 0 can use nothing
    for level in levels:
        nodes = nodes.withColumn(f"w_{level}", _weight(level, weights))
        nodes = nodes.withColumn("cap", F.when(F.col(f"w_{level}") > 0, F.col("cap")).otherwise(F.lit(0)))
    nodes = cut_lineage(nodes)
    total = nodes.agg(F.coalesce(F.least(F.expr(f"sum(tokens) * {int(percent)} div 100"), F.sum("cap")), F.lit(0)).cast("bigint")).first()[0]
    plan, above = None, []
    for level in levels:
        path = [*above, level]
        children = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"w_{level}").alias("w")).filter("cap > 0")
        if above:
            children = children.join(plan.withColumnRenamed("budget", "total"), above)
        else:
            children = children.withColumn("total", F.lit(total).cast("bigint"))
        order = Window.partitionBy(*above).orderBy((F.col("cap") / F.col("w")).asc(), F.col(level).asc())
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(0, Window.unboundedFollowing)
        children = children.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        children = children.withColumn("rest_w", F.sum("w").over(after))
        full = F.expr(f"cast(cap as {wide}) * cast(rest_w as decimal(18,0)) <= cast(w as decimal(18,0)) * cast(left as {wide})")
        children = children.withColumn("full", full)
        children = children.withColumn("open_w", F.when(~F.col("full"), F.col("w")).otherwise(F.lit(0)))
        children = children.withColumn("upto_w", F.sum("open_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        whole = Window.partitionBy(*above)
        children = children.withColumn("all_w", F.sum("open_w").over(whole)).withColumn(
            "shared", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(whole))
        share = (f"(cast(shared as {wide}) * cast(upto_w as decimal(18,0))) div all_w"
                 f" - (cast(shared as {wide}) * cast(upto_w - open_w as decimal(18,0))) div all_w")
        plan = children.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(F.expr(share)).cast("bigint").alias("budget"))
        plan, above = cut_lineage(plan), path
    return leaves.join(plan, list(levels), "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def leaf_cuts(tokens: DataFrame, levels: Sequence[str], key: str, weights: Weights, percent: int, epochs: int, seed: int) -> DataFrame:
    """For each leaf, the number ``full`` of whole epochs and the order hash ``cut`` up to which the next epoch is taken.

    ``tokens`` holds ``key``, the levels and ``tokens``. The place of the cut is found on sums over 4096 ranges of the hash; only
    the range that holds it is ordered document by document, so a leaf with most of the corpus is no single task.
    """
    keys = list(levels)
    leaves = cut_lineage(tokens.groupBy(*keys).agg(F.sum("tokens").alias("tokens")))
    plan = leaf_budgets(leaves, levels, weights, percent, epochs).withColumn(
        "full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int"))
    plan = cut_lineage(plan.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")).select(*keys, "full", "rest"))
    placed = tokens.join(broadcast_if_small(plan.filter("rest > 0")), keys).withColumn("h", order_hash(key, "full", seed))
    placed = placed.withColumn("range", F.substring("h", 1, BUCKETS)).select(*keys, "range", "h", "tokens", "rest")
    sums = placed.groupBy(*keys, "range", "rest").agg(F.sum("tokens").alias("t"), F.max("h").alias("last"))
    upto = F.sum("t").over(Window.partitionBy(*keys).orderBy("range"))
    sums = cut_lineage(sums.withColumn("upto", upto))
    whole = sums.filter("upto <= rest").groupBy(*keys).agg(F.max("last").alias("cut"))
    torn = sums.filter("upto > rest AND upto - t <= rest").groupBy(*keys).agg(F.min_by("range", "range").alias("range"), F.min_by(F.col("upto") - F.col("t"), F.col("range")).alias("done"))
    inside = placed.join(broadcast_if_small(torn), [*keys, "range"])
    inside = inside.withColumn("upto", F.col("done") + F.sum("tokens").over(Window.partitionBy(*keys, "range").orderBy("h")))
    inside = inside.filter("upto <= rest").groupBy(*keys).agg(F.max("h").alias("cut"))
    cuts = whole.unionByName(inside).groupBy(*keys).agg(F.max("cut").alias("cut"))
    return cut_lineage(plan.drop("rest").join(cuts, keys, "left"))


def mix_sources(df: DataFrame, levels: Mapping[str, Column], weights: Weights, percent: int = 100, epochs: int = 1, seed: int = 1,
                key: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """The mixture: the rows of ``df``, each once for every epoch it is taken in, with a column ``epoch`` from 0.

    ``levels`` names the tree's levels from the root down, with the expression of each; a NULL value is the node ``""``.
    ``weights`` gives whole numbers by level and value; ``"*"`` stands for all other values, 1 if not given. ``tokens`` counts a
    document's tokens, its words by default. NULL and empty texts hold no tokens: they go with their place in the order.
    Rows with equal keys stand at one place and are taken together. A document is taken only if the prefix up to it fits the
    budget. Columns of ``df`` are returned unchanged; one named ``epoch`` is replaced. An empty table gives no rows.
    """
    *names, full, cut, times = private_names(df.columns, *[f"_level_{n}" for n in levels], "_full", "_cut", "_times")
    source = df.drop("epoch").select("*", *[F.coalesce(e.cast("string"), F.lit("")).alias(n) for n, e in zip(names, levels.values())])
    count = (word_count(text) if tokens is None else tokens).cast("bigint")
    counted = cut_lineage(source.select(F.col(key).alias("_key"), *names, count.alias("tokens")))
    targets = {name: dict(weights[n]) for name, n in zip(names, levels) if n in weights}
    cuts = leaf_cuts(counted, names, "_key", targets, percent, epochs, seed)
    cuts = cuts.select(*names, F.col("full").alias(full), F.col("cut").alias(cut)).filter((F.col(full) > 0) | F.col(cut).isNotNull())
    taken = source.join(broadcast_if_small(cuts), names)
    count_taken = F.col(full) + F.coalesce(order_hash(key, full, seed) <= F.col(cut), F.lit(False)).cast("int")
    taken = taken.withColumn(times, count_taken).filter(F.col(times) > 0)
    return taken.select(*[c for c in df.columns if c != "epoch"], F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias("epoch"))


# The tree and the targets of the registered query, and the first hex digits that mark a domain.
DOMAINS = {"forum": "012345", "web": "6789a", "reference": "bcdef"}
WEIGHTS: Weights = {
    "domain": {"forum": 2, "web": 5, "reference": 3},
    "lang": {"en": 50, "de": 20, "fr": 15, "es": 15},
    "source": {"src0": 3},
}


def corpus_levels() -> dict[str, Column]:
    """Domain, language and source of a document. A source's domain follows from a hash of its name."""
    digit, domain = F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 1), F.lit("reference")
    for name in ("web", "forum"):
        domain = F.when(digit.isin(*DOMAINS[name]), F.lit(name)).otherwise(domain)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixture_sql(percent: int, epochs: int, seed: int, weights: Weights = WEIGHTS) -> str:
    """The mixture of ``documents`` as SQL: ``(doc_id, domain, lang, source, n_tokens, epoch)``."""

    def weight(level: str) -> str:
        given = weights.get(level, {})
        cases = " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in given.items() if v != "*")
        return f"CASE {cases} ELSE {given.get('*', 1)} END" if cases else str(given.get("*", 1))

    ctes = [f"""docs AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN contains('{DOMAINS["web"]}', substr(md5(coalesce(source, '')), 1, 1)) THEN 'web'
      WHEN contains('{DOMAINS["forum"]}', substr(md5(coalesce(source, '')), 1, 1)) THEN 'forum' ELSE 'reference' END AS domain
  FROM documents)""",
            f"leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {epochs})::BIGINT AS cap FROM docs GROUP BY ALL)",
            f"plan0 AS (SELECT least(sum(tokens)::BIGINT * {percent} // 100, sum(cap)::BIGINT) AS budget FROM leaves)"]
    above: list[str] = []
    for depth, level in enumerate(("domain", "lang", "source")):
        path = [*above, level]
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        ctes.append(f"""children{depth} AS (
  SELECT c.*, p.budget AS total FROM (SELECT {', '.join(path)}, sum(cap)::BIGINT AS cap, ({weight(level)})::BIGINT AS w FROM leaves GROUP BY {', '.join(path)} HAVING sum(cap) > 0) c
  {"JOIN plan" + str(depth) + " p USING (" + ", ".join(above) + ")" if above else "CROSS JOIN plan0 p"})""")
        ctes.append(f"""rest{depth} AS (
  SELECT *, total - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM children{depth})""")
        ctes.append(f"full{depth} AS (SELECT *, cap::HUGEINT * rest_w <= w::HUGEINT * rest AS is_full FROM rest{depth})")
        ctes.append(f"""open{depth} AS (
  SELECT *, CASE WHEN is_full THEN 0 ELSE w END AS open_w,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto_w,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) AS all_w, total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS shared FROM full{depth})""")
        ctes.append(f"""plan{depth + 1} AS (
  SELECT {', '.join(path)}, CASE WHEN is_full THEN cap ELSE (shared::HUGEINT * upto_w) // all_w - (shared::HUGEINT * (upto_w - open_w)) // all_w END AS budget FROM open{depth})""")
        above = path
    ctes.append("leaf AS (SELECT domain, lang, source, budget // tokens AS full_epochs, budget - (budget // tokens) * tokens AS rest FROM leaves JOIN plan3 USING (domain, lang, source) WHERE tokens > 0)")
    ctes.append(f"placed AS (SELECT d.*, full_epochs, rest, md5(concat_ws(':', '{seed}', full_epochs::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS h FROM docs d JOIN leaf USING (domain, lang, source))")
    ctes.append("summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS upto FROM placed)")
    ctes.append("taken AS (SELECT *, full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM summed)")
    return ("WITH " + ",\n".join(ctes) + "\nSELECT doc_id, domain, lang, source, n_tokens, unnest(range(times::BIGINT))::INTEGER AS epoch FROM taken WHERE times > 0")
