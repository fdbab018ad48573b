"""Temperature mixing of sources, with DataFrame and SQL functions only.

1. Tokens (here: words) are summed by source; a source's share is its part of all.
2. Weights are the shares raised to an exponent and normalised. The exponent is found by bisection: the one whose
   weights have the target entropy (as a part of the largest possible), or the smallest whose weights repeat no source
   more often than a limit at the budget that is used. Both are monotone in the exponent. Below 1 it evens sources out,
   above 1 it sharpens them, so a target is met on either side of the corpus's own entropy; the bracket's upper end is
   doubled until it holds the target. A target below the entropy of the largest sources alone can't be met: then the
   exponent is ``MOST`` (they share the mixture evenly). A single source has the exponent 1.
   A limit on repeats would let one tiny source keep the exponent near 1 for all others: sources that hold the part
   ``rare`` of all tokens, at most, may be beyond it, and are taken as often as the limit says.
3. A source's quota is its weight times the token budget. Its documents are dealt to blocks by a hash of doc_id, and
   blocks and documents within them are put in an order of hashes (a permutation that no row order changes). Whole
   passes and then a prefix of the permutation meet the quota: ``copies`` says how often each document is taken.
   Running sums are taken over the blocks of a source and inside each block, never over a whole source's documents.

Texts are read and counted once (``count_tokens``), however long they are. Tokens of null or empty texts: 0; such
documents are taken as often as their source's passes. A null source is the source ''. Repeated rows, and documents
that tie in the permutation's hashes, are rows of their own in all sums, in the order of doc_id. A source without tokens
has weight 0 and, as it costs nothing, is taken once. An empty table gives no rows. Columns that are not asked for are
not read, so their names can't clash. Documents per block follow ``block_docs``. Any number of sources will do: each
step of the bisection is a sum over them, and their quotas are broadcast only up to ``BROADCAST_SOURCES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.llm.common import materialise

BROADCAST_SOURCES = 100_000
#: Largest exponent; exponents weighed in one job (so many, and one more, parts of an interval); precision in decimals.
MOST, AT_ONCE, DECIMALS = 1024, 255, 6
BLOCK_DOCS = 1024


def tokens(text: Column) -> Column:
    """Words between runs of space and 0x09-0x0D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def luck(*parts: Column) -> Column:
    """A number below 2**32 drawn by hash: the same in any SQL dialect that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def exponent(sums: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | str = "corpus", rare: float = 0.0) -> tuple[float, float]:
    """The exponent, and the sum of (tokens / largest tokens) ** exponent, from rows (source, tokens); pass either
    ``entropy`` or ``repeats``. ``budget``: tokens of the mixture, "corpus" (as many as there are) or "cover" (the
    least at which every source is taken once). ``rare``, for repeats at "cover": the part of all tokens that sources
    beyond the limit may hold."""
    if rare and (repeats is None or budget != "cover"):
        raise ValueError("rare goes with a limit on repeats at the budget that covers every source")
    some = sums.filter("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    n, total, top = some.agg(F.count("*"), F.sum("t"), F.max("t")).first()
    if n < 2:
        return 1.0, 1.0
    ratio = F.col("t") / top  # at most 1, so that no power overflows and the largest never vanishes

    # exponents are rows, so that the plan is small however many are weighed
    def reached(alphas: list[float]) -> list[bool]:
        """Whether the sought exponent is at most each of these: one job."""
        tried = some.select(ratio.alias("ratio"), F.posexplode(F.array(*map(F.lit, alphas))).alias("i", "a"))
        power, rest = F.pow("ratio", "a"), F.pow(F.col("ratio"), F.col("a") - 1)
        beyond = F.sum(F.when(rest > repeats, F.col("ratio")).otherwise(0.0)) if rare else F.lit(0.0)
        sums = tried.groupBy("i", "a").agg(F.sum(power).alias("z"), F.sum(power * F.log("ratio")).alias("h"), F.max(rest).alias("high"), F.min(rest).alias("low"), beyond.alias("beyond"))
        if entropy is not None:
            # sum of -w ln w, with w = ratio ** alpha / z
            test = F.log("z") - F.col("a") / F.col("z") * F.col("h") <= F.lit(entropy) * F.log(F.lit(float(n)))
        elif rare:  # the largest source is taken once, so that this is how often the others are
            test = F.col("beyond") * top <= rare * total
        elif budget == "cover":
            test = F.col("high") / F.col("low") <= repeats
        else:
            test = F.col("high") / F.col("z") * (total if budget == "corpus" else budget) / top <= repeats
        return [r["ok"] for r in sorted(sums.select("i", test.alias("ok")).collect())]

    lo, hi = 0.0, 1.0
    if entropy is not None:
        ends = [1.0]
        while ends[-1] < MOST:
            ends.append(ends[-1] * 2)
        hi = next((a for a, ok in zip(ends, reached(ends)) if ok), float(MOST))
        lo = 0.0 if hi == 1.0 else hi / 2
    while hi - lo > 10.0 ** -(DECIMALS + 2):
        steps = [lo + (hi - lo) * (i + 1) / (AT_ONCE + 1) for i in range(AT_ONCE)]
        at = next((i for i, ok in enumerate(reached(steps)) if ok), AT_ONCE)
        lo, hi = ([lo, *steps][at], [*steps, hi][at])
    alpha = round(hi, DECIMALS)  # results don't hang on the last bits of a library's logarithm
    return alpha, some.agg(F.sum(F.pow(ratio, F.lit(alpha)))).first()[0]


def source_weights(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | str = "corpus", rare: float = 0.0) -> DataFrame:
    """(source, n_docs, tokens, share, alpha, weight, quota) by source, from rows (source, n_tokens)."""
    sums = materialise(docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")), "source-sums")
    alpha, norm = exponent(sums, entropy, repeats, budget, rare)
    total, top = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("tokens"), F.lit(0))).first()
    some = F.col("tokens") > 0
    power = F.pow(F.col("tokens") / top, F.lit(alpha))
    if rare:
        power = F.least(power, F.col("tokens") / top * repeats)
        norm = sums.filter(some).agg(F.coalesce(F.sum(power), F.lit(1.0))).first()[0]
    weight = F.when(some, power / norm).otherwise(F.lit(0.0))
    out = sums.select("source", "n_docs", "tokens", F.when(some, F.col("tokens") / total).otherwise(F.lit(0.0)).alias("share"), F.lit(alpha).alias("alpha"), weight.alias("weight"))
    size = total if budget == "corpus" else budget
    if budget == "cover":
        size = out.agg(F.coalesce(F.max(F.when(F.col("weight") > 0, F.ceil(F.col("tokens") / F.col("weight")))), F.lit(0))).first()[0]
    return out.withColumn("quota", F.round(F.col("weight") * F.lit(size)).cast("long"))


def realise(docs: DataFrame, thin: DataFrame, weights: DataFrame, seed: str = "mix", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` (doc_id, source, n_tokens, more) with block, copies: how often the mixture takes each document. ``thin``
    has the same rows without more columns."""
    plan = weights.select(
        "source",
        F.ceil(F.col("n_docs") / block_docs).alias("blocks"),
        F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).alias("passes"),
        F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0).alias("rest"),
    )
    few = weights.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    deal = lambda rows: rows.join(F.broadcast(plan) if few else plan, "source").withColumn("block", luck(F.lit(seed), F.col("doc_id")) % F.col("blocks"))
    sums = deal(thin).groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"))
    order = W.partitionBy("source").orderBy(luck(F.lit(seed), F.lit("block"), F.col("source"), F.col("block")), "block")
    ahead = sums.select("source", "block", F.coalesce(F.sum("in_block").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = deal(docs).join(ahead, ["source", "block"])
    within = W.partitionBy("source", "block").orderBy(luck(F.lit(seed), F.lit("doc"), F.col("doc_id")), "doc_id", "n_tokens")
    before = F.col("ahead") + F.sum("n_tokens").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    # a document is in the last, partial pass if it begins before the quota's rest is used up
    copies = F.col("passes") + (before < F.col("rest")).cast("long")
    return placed.withColumn("copies", copies.cast("long")).drop("blocks", "passes", "rest", "ahead")


def count_tokens(df: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, source, n_tokens) of every row, and the columns ``keep``."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), tokens(F.col("text")).alias("n_tokens"), *keep)


def mix(df: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | str = "corpus", seed: str = "mix", keep: tuple[Column, ...] = (), rare: float = 0.0) -> DataFrame:
    """doc_id, source, n_tokens, block, copies (and the columns ``keep``) of every row of ``df`` (doc_id, source, text)."""
    thin = materialise(count_tokens(df), "token-counts")
    weights = source_weights(thin, entropy, repeats, budget, rare)
    return realise(count_tokens(df, keep) if keep else thin, thin, weights, seed)


#: The registered query's target: entropy as a part of the largest possible.
ENTROPY = 0.95

ORACLE_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents
), sums AS (
  SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY source
), logs AS (SELECT source, ln(tokens) - max(ln(tokens)) OVER () AS l FROM sums WHERE tokens > 0),
-- exponents whose mixture has more entropy than the target: first powers of two, then halves of what lies between
tried AS (
  SELECT 2.0::DOUBLE ** k AS a, k FROM range(0, 11) r(k)
), spread AS (
  SELECT k, a, exp(a * l) / sum(exp(a * l)) OVER (PARTITION BY k) AS w FROM tried, logs
), roof AS (
  SELECT coalesce(min(a), 1024) AS hi FROM (SELECT a FROM spread GROUP BY k, a HAVING sum(CASE WHEN w > 0 THEN -w * ln(w) ELSE 0 END) <= {ENTROPY} * ln(count(*)))
), halve AS (
  SELECT 0 AS step, CASE WHEN hi = 1 THEN 0 ELSE hi / 2 END::DOUBLE AS lo, hi::DOUBLE AS hi FROM roof
  UNION ALL
  SELECT step + 1, CASE WHEN much THEN (lo + hi) / 2 ELSE lo END, CASE WHEN much THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT step, lo, hi, (
      SELECT sum(-exp((lo + hi) / 2 * l) / z * ((lo + hi) / 2 * l - ln(z))) > {ENTROPY} * ln(count(*)) FROM logs, (SELECT sum(exp((lo + hi) / 2 * l)) AS z FROM logs)
    ) AS much FROM halve WHERE step < 50)
), found AS (SELECT CASE WHEN (SELECT count(*) FROM logs) > 0 THEN round(hi, 6) ELSE 1 END AS alpha FROM halve WHERE step = 50),
weights AS (SELECT source, exp(alpha * l) / sum(exp(alpha * l)) OVER () AS w FROM logs, found),
plan AS (
  SELECT source, ceil(n_docs / {BLOCK_DOCS}.0)::BIGINT AS blocks, tokens, coalesce(round(w * sum(tokens) OVER ()), 0)::BIGINT AS quota FROM sums LEFT JOIN weights USING (source)
), dealt AS (
  SELECT doc_id, docs.source, n_tokens, ('0x' || substr(md5('mix-' || doc_id), 1, 8))::BIGINT % blocks AS block,
    CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest
  FROM docs JOIN plan ON docs.source = plan.source
), before AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('mix-block-' || source || '-' || block), 1, 8))::BIGINT, block,
    ('0x' || substr(md5('mix-doc-' || doc_id), 1, 8))::BIGINT, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS ahead FROM dealt
)
SELECT doc_id, source, n_tokens, block, (passes + CASE WHEN ahead < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM before
"""
