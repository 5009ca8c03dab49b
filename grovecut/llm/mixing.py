"""Mixing sources to target weights with hash-threshold histograms.

A document's place is a hash of its id in [0, 1). For each source and each budget the kept documents are those whose
place is below a threshold, so a smaller budget's documents are among a larger one's. The threshold is found without
sorting: tokens are summed by source and hash bucket, the bucket in which the budget runs out is cut again into finer
buckets, and so on until it holds single hashes. Only documents of boundary buckets are summed again. Then one filter
by a threshold a source reads the documents. What is known of sources stays in tables, whatever their number.

A budget is met from below: the kept documents are the longest run in hash order whose tokens don't exceed it. Rows
whose ids have the same hash (repeated rows, null ids) stay or go together. A null source is a source of its own; a
source without a weight gets nothing. A null text has 0 tokens; documents of 0 tokens stay if their place is below the threshold.
Very long texts count whole. An empty table, or one without words, gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, small, table
from .text import words_of

#: Bits of the hash, and bits that one round of the histogram resolves.
HASH_BITS, ROUND_BITS = 60, 12
#: Nested budgets as shares of the largest mixture.
LEVELS = (0.25, 0.5, 1.0)


def place(id_col: str) -> Column:
    """The first 60 bits of md5 of the id as a number; a null id's is of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def weighted(totals: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """(source, n, w): the sources that have tokens and a weight; by default the square root of their tokens, which draws less from the largest."""
    totals = totals.where("n > 0")
    if weights is None:
        return totals.withColumn("w", F.sqrt("n"))
    rows = [(s, float(w)) for s, w in weights.items() if w > 0]
    given = totals.sparkSession.createDataFrame(rows, "s string, w double")
    return totals.join(given, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def largest(sources: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """(source, level, left): tokens that each source gives in shares of the largest mixture of these weights without repetition."""
    total = sources.agg(F.sum("w")).head()[0] or 1.0
    most = sources.agg(F.min(F.col("n") / (F.col("w") / total))).head()[0] or 0.0
    return _budgets(sources, F.lit(most) * (F.col("w") / total), levels)


def filled(sources: DataFrame, keep: float) -> DataFrame:
    """(source, level, left) for a share keep of all tokens: a source that has less than its weight asks for is taken whole, and the others share the rest by weight.

    So a source of a few tokens holds up nobody.
    """
    all_, total = sources.agg(F.sum("n"), F.sum("w")).head()
    want = keep * (all_ or 0)
    by = Window.orderBy(F.col("n") / F.col("w"), F.col("source")).rowsBetween(Window.unboundedPreceding, 0)  # one row a source
    steps = sources.select("n", "w", F.sum("n").over(by).alias("whole"), F.sum("w").over(by).alias("weight"))
    used = F.col("whole") + F.col("n") / F.col("w") * (F.lit(total or 0.0) - F.col("weight"))
    whole, weight = steps.where(used <= want).agg(F.max("whole"), F.max("weight")).head()
    whole, weight = whole or 0, weight or 0.0
    rest = (total or 0.0) - weight
    a_weight = (want - whole) / rest if rest > 1e-9 * (total or 1.0) else float("inf")
    return _budgets(sources, F.least(F.col("n").cast("double"), F.lit(a_weight) * F.col("w")), (1.0,))


def _budgets(sources: DataFrame, tokens: Column, levels: tuple[float, ...]) -> DataFrame:
    each = F.array(*[F.floor(tokens * share + 1e-9).cast("long") for share in levels])
    return sources.select("source", F.posexplode(each).alias("level", "left"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, level, at): documents whose place is below at stay. sized has source, place and tokens and should be cheap to read again."""
    now = cut(budgets.select("source", "level", "left", F.lit(0).cast("long").alias("start")))
    done = None
    for low in range(HASH_BITS - ROUND_BITS, -1, -ROUND_BITS):
        top = low + ROUND_BITS
        if top < HASH_BITS:  # only the buckets in which a budget ran out
            here = small(cut(now.select(F.col("source").alias("s"), F.shiftright("start", top).alias("high")).distinct()))
            sized = cut(sized.join(here, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", top) == F.col("high"))).select("source", "place", "tokens"))
        sums = sized.groupBy(F.col("source").alias("s"), F.shiftright("place", top).alias("high"), F.shiftright("place", low).bitwiseAND(F.lit((1 << ROUND_BITS) - 1)).alias("b")).agg(F.sum("tokens").alias("n"))
        by = Window.partitionBy("source", "level").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        met = now.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("start", top) == F.col("high"))).withColumn("upto", F.sum("n").over(by))
        over = met.where(F.col("upto") > F.col("left")).groupBy("source", "level").agg(F.min(F.struct("b", (F.col("left") - (F.col("upto") - F.col("n"))).alias("rest"))).alias("x"))
        over = over.select(F.col("source").alias("s"), F.col("level").alias("l"), "x.b", "x.rest")
        joined = cut(now.join(over, F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")), "left"))
        spot = F.col("start") + F.col("b") * F.lit(1 << low)
        ended = joined.where("b IS NULL").select("source", "level", (F.col("start") + F.lit(1 << top)).alias("at"))
        if low == 0:
            ended = ended.union(joined.where("b IS NOT NULL").select("source", "level", spot.alias("at")))
        done = ended if done is None else done.union(ended)
        now = joined.where("b IS NOT NULL").select("source", "level", F.col("rest").alias("left"), spot.alias("start"))
    return done


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, levels: tuple[float, ...] = LEVELS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: float | None = None) -> DataFrame:
    """docs with a column level: the number of the least budget that holds the document; the others are left out.

    weights: target share of tokens by source, by default in proportion to the square root of its tokens. levels: rising shares of the largest mixture that the sources can give. keep: instead of these one budget, see filled().
    """
    sized = cut(docs.select(F.col(source_col).cast("string").alias("source"), place(id_col).alias("place"), words_of(F.col(text_col)).alias("tokens")))
    sources = cut(weighted(sized.groupBy("source").agg(F.sum("tokens").alias("n")), weights))
    found = thresholds(sized, largest(sources, levels) if keep is None else filled(sources, keep))
    at, level, spot = fresh(docs, "mix_source"), fresh(docs, "level"), fresh(docs, "mix_at")
    n = len(levels) if keep is None else 1
    cuts = found.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("level", "at"))).alias("m"))
    cuts = small(cut(cuts.select(F.col("source").alias(at), F.array(*[F.coalesce(F.col("m")[k], F.lit(0).cast("long")) for k in range(n)]).alias(spot))))
    low = F.coalesce(*[F.when(place(id_col) < F.col(spot)[k], F.lit(k)) for k in range(n)])
    out = docs.join(cuts, F.col(source_col).cast("string").eqNullSafe(F.col(at))).withColumn(level, low)
    return out.where(F.col(level).isNotNull()).drop(at, spot)


def mixed(docs: DataFrame, keep: float, **how) -> DataFrame:
    """The documents of a mixture of a share keep of all tokens, with the columns of docs."""
    columns = docs.columns
    return mix(docs, keep=keep, **how).select(*columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, level) of the documents of the mixture, with nested budgets of a quarter, a half and all."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "source", words_of(F.col("text")).alias("tokens"), "level")


#: Words and mixtures as above, by running sums over the sorted hashes.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(string_split_regex(t, '[ \t\r\n]+')) * CAST(t <> '' AS INT) AS BIGINT) AS tokens,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM (SELECT *, regexp_replace(coalesce(text, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS t FROM documents)),
s AS (SELECT source, sum(tokens) AS n FROM d GROUP BY source HAVING sum(tokens) > 0),
w AS (SELECT source, n, sqrt(n) / (SELECT sum(sqrt(n)) FROM s) AS share FROM s),
m AS (SELECT source, share * (SELECT min(n / share) FROM w) AS budget FROM w),
r AS (SELECT d.*, m.budget, sum(tokens) OVER (PARTITION BY d.source ORDER BY place) AS upto
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, source, tokens, CAST(CASE WHEN upto <= floor(budget * 0.25 + 1e-9) THEN 0 WHEN upto <= floor(budget * 0.5 + 1e-9) THEN 1 ELSE 2 END AS INT) AS level
FROM r WHERE upto <= floor(budget + 1e-9)"""
