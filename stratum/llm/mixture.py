"""Mixing sources to target weights by hierarchical budgets.

Documents hang in a tree domain - language - source; a leaf is one source in one language
of one domain. The token budget (``budget_percent`` of all tokens) goes down the tree: a
node's budget is shared among its children by weight, and what a child cannot use goes to
its siblings by their weights. A child's capacity is all that its leaves hold in
``max_epochs`` passes, so a shortage stays among the siblings as long as they can take it
and only then reaches the ancestor's other children. For the children of one node, ordered
by capacity over weight, this is a running sum: the first child whose fair share of what is
left fits its capacity sets the level for all that follow.

A leaf's documents are put in a seeded order for each epoch (MD5 of seed, epoch and
``doc_id``). The leaf takes whole epochs while its budget lasts, then the shortest prefix of
the next epoch that reaches the rest, so it exceeds its budget by less than one document.
The prefix needs no order of the whole leaf: tokens are summed by the first three digits of
the hash, the running sum finds the digits where the budget ends, and only documents with
those digits are put in order. A hot leaf's documents are dealt out to several tasks where
they meet its budget. The leaves, their budgets and where each ends are written to the shared
folder on the way (a row a leaf), so that no query holds the plan of another several times.

Tokens are words (``[^\\x20\\x09-\\x0D]+``). All arithmetic is in integers, products in decimals. Only numbers
are shuffled, never texts.

Defined cases: NULL text and texts without words have no tokens and are never taken; NULL
``lang`` is the language ``und`` and NULL ``source`` the source of the empty name; a language
or domain without a weight gets ``OTHER_WEIGHT``; rows that repeat a ``doc_id`` are taken one by
one, ties in the order go by tokens; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm.common import materialize, salted_join, table

OTHER_WEIGHT = 5
LEAF = ["domain", "language", "origin"]
#: Products of tokens and sums of weights go beyond 64 bits.
WIDE = "decimal(20,0)"


@dataclass(frozen=True)
class Mix:
    """Target weights (whole numbers, relative among siblings) and limits."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 50, "books": 30, "reference": 20})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 40, "de": 20, "fr": 20, "es": 20})
    budget_percent: int = 100
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The domain of a source, by the number at the end of its name, twenty in a round:
    0 to 9 web, 10 to 14 books, 15 to 19 reference; web without a number."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    last = F.when(number == "", 0).otherwise(F.when(number == "", "0").otherwise(number).cast("int") % 20)
    return F.when(last < 10, "web").when(last < 15, "books").otherwise("reference")


def _weight(name: str, weights: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(known, F.col(name)), F.lit(OTHER_WEIGHT)).cast("bigint")


def share_out(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """``children`` (``parent`` columns, ``key``, ``weight``, ``capacity`` and the parent's
    ``parent_budget``) with each child's ``budget``."""
    own = Window.partitionBy(*parent)
    order = own.orderBy(F.col("capacity") / F.col("weight"), key)
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    wide = {c: F.col(c).cast(WIDE) for c in ("left", "weight", "capacity", "weights")}
    level = F.when(wide["left"] * wide["weight"] <= wide["capacity"] * wide["weights"], F.struct("left", "weights"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        children.withColumns({"left": left, "weights": weights})
        .withColumn("level", F.first(level, ignorenulls=True).over(whole))
        .withColumn(
            "budget",
            F.when(F.col("level").isNull(), F.col("capacity")).otherwise(
                F.least("capacity", F.expr(f"cast(level.left as {WIDE}) * weight div level.weights"))
            ),
        )
        .drop("left", "weights", "level")
    )


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``LEAF, tokens, budget`` of ``leaves(LEAF, tokens)``. One row a leaf, never a document."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    languages = leaves.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
    domains = languages.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.select(F.expr(f"cast(coalesce(sum(tokens), 0) as {WIDE}) * {int(mix.budget_percent)} div 100")).scalar()
    top = domains.withColumns({"weight": _weight("domain", mix.domains), "parent_budget": total, "root": F.lit(0)})
    top = share_out(top, ["root"], "domain").select("domain", F.col("budget").alias("parent_budget"))  # a row a domain
    middle = share_out(languages.join(top, "domain").withColumn("weight", _weight("language", mix.languages)), ["domain"], "language")
    middle = middle.select("domain", "language", F.col("budget").alias("parent_budget"))
    lowest = leaves.join(middle, ["domain", "language"]).withColumn("weight", F.lit(1).cast("bigint"))
    return share_out(lowest, ["domain", "language"], "origin").select(*LEAF, "tokens", "budget")


def select_mixture(sized: DataFrame, mix: Mix) -> DataFrame:
    """``doc_id, LEAF, n_tokens, epoch`` of what the mix takes of ``sized(doc_id, LEAF,
    n_tokens)``; a document comes once for each epoch that takes it."""
    sized = sized.filter("n_tokens > 0")
    leaves = materialize(sized.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = leaf_budgets(leaves, mix).select(
        *LEAF, F.expr("cast(budget div tokens as int)").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest")
    )
    plan = materialize(plan, "budgets")
    rows = salted_join(sized, plan, LEAF, "doc_id")
    columns = ["doc_id", *LEAF, "n_tokens"]
    full = rows.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), "whole"))).select(*columns, "epoch")
    said = F.concat_ws(":", F.lit(str(mix.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    partial = (
        rows.filter("rest > 0")
        .withColumn("epoch", F.col("whole") + 1)
        .withColumn("h", F.md5(said.cast("binary")))
        .withColumn("digits", F.substring("h", 1, 3))
    )
    by_leaf = Window.partitionBy(*LEAF)
    # at most 4096 rows a leaf
    digits = partial.groupBy(*LEAF, "digits", "rest").agg(F.sum("n_tokens").alias("sum"))
    running = digits.withColumn("upto", F.sum("sum").over(by_leaf.orderBy("digits")))
    last = running.filter("upto - sum < rest AND upto >= rest").select(*LEAF, F.col("digits").alias("last"), (F.col("upto") - F.col("sum")).alias("before"))
    last = materialize(last, "last")
    near = salted_join(partial, last, LEAF, "doc_id")
    sure = near.filter(F.col("digits") < F.col("last")).select(*columns, "epoch")
    order = by_leaf.orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        near.filter(F.col("digits") == F.col("last"))
        .withColumn("begin", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens"))
        .filter(F.col("begin") < F.col("rest"))
        .select(*columns, "epoch")
    )
    return full.unionAll(sure).unionAll(edge)


def sized_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, LEAF, n_tokens`` of ``docs(doc_id, text, lang, source)``."""
    origin = F.coalesce("source", F.lit(""))
    return docs.select(
        "doc_id",
        domain_of(origin).alias("domain"),
        F.coalesce("lang", F.lit("und")).alias("language"),
        origin.alias("origin"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("n_tokens"),
    )


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return select_mixture(materialize(sized_documents(docs), "sized"), Mix())


def _share_sql(children: str, parent: str, key: str) -> str:
    return f"""
  SELECT *, CASE WHEN lv IS NULL THEN capacity ELSE least(capacity, (lv.l * weight) // lv.w) END AS budget FROM (
    SELECT *, first_value(CASE WHEN l * weight <= capacity * w THEN {{'l': l, 'w': w}} END IGNORE NULLS) OVER (
      PARTITION BY {parent} ORDER BY capacity / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv
    FROM (SELECT *,
        parent_budget - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {key}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
        sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {key}
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w
      FROM ({children})))"""


def mixture_sql(mix: Mix, relation: str) -> str:
    """The same selection in DuckDB SQL over ``relation(doc_id, text, lang, source)``."""

    def weight(column: str, weights: dict[str, int]) -> str:
        return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {OTHER_WEIGHT} END"

    top = _share_sql(
        f"""SELECT 0 AS root, domain, {weight("domain", mix.domains)} AS weight, sum(capacity) AS capacity,
          any_value((SELECT coalesce(sum(tokens), 0) * {mix.budget_percent} // 100 FROM leaves)) AS parent_budget
        FROM leaves GROUP BY domain""",
        "root",
        "domain",
    )
    middle = _share_sql(
        f"""SELECT domain, language, {weight("language", mix.languages)} AS weight, sum(leaves.capacity) AS capacity,
          any_value(top.budget) AS parent_budget
        FROM leaves JOIN top USING (domain) GROUP BY domain, language""",
        "domain",
        "language",
    )
    lowest = _share_sql(
        "SELECT leaves.*, 1 AS weight, middle.budget AS parent_budget FROM leaves JOIN middle USING (domain, language)",
        "domain, language",
        "origin",
    )
    return f"""
WITH named AS (
  SELECT doc_id, coalesce(lang, 'und') AS language, coalesce(source, '') AS origin,
    coalesce(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), ''), '0')::INTEGER % 20 AS last_number,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::HUGEINT AS n_tokens
  FROM {relation}
), sized AS (
  SELECT doc_id, CASE WHEN last_number < 10 THEN 'web' WHEN last_number < 15 THEN 'books' ELSE 'reference' END AS domain,
    language, origin, n_tokens FROM named WHERE n_tokens > 0
), leaves AS (
  SELECT domain, language, origin, sum(n_tokens) AS tokens, sum(n_tokens) * {mix.max_epochs} AS capacity FROM sized GROUP BY ALL
), top AS ({top}
), middle AS ({middle}
), lowest AS ({lowest}
), planned AS (
  SELECT s.*, budget // tokens AS whole, budget % tokens AS rest
  FROM sized s JOIN lowest USING (domain, language, origin)
), taken AS (
  SELECT doc_id, domain, language, origin, n_tokens, unnest(range(1, whole::BIGINT + 1)) AS epoch FROM planned WHERE whole > 0
  UNION ALL
  SELECT doc_id, domain, language, origin, n_tokens, epoch FROM (
    SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY h, doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS begins
    FROM (SELECT *, whole + 1 AS epoch,
        md5('{mix.seed}:' || (whole + 1)::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM planned WHERE rest > 0)
  ) WHERE begins < rest
)
SELECT doc_id, domain, language, origin, n_tokens::BIGINT AS n_tokens, epoch::INTEGER AS epoch FROM taken
"""


OP9_SQL = mixture_sql(Mix(), "documents")
