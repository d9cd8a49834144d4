"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

Everything here is DataFrame expressions.  Documents are cut into blocks of words,
the blocks of a source are put in a pseudo-random order, and its quota is a prefix of
that order (after as many full passes as the target holds).  A binary tree then deals
the quotas of all sources to output shards: every node gives its left child half of
its slots, and how many of them come from which source is a multivariate
hypergeometric draw.  A shard takes the next blocks of each source's order and
shuffles them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ropeway.llm.base import WORD, pack, query, stored, table
from ropeway.session import scratch_path

#: Words of one block; a longer document is drawn by parts.
BLOCK_WORDS = 2048
#: Words one output shard should hold.
SHARD_WORDS = 1 << 24
#: Weights of the sources in order, repeating, and what all targets add up to and may reach.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = "mix-1"
#: Neighbouring slots of a source that look up their shard together.
CHUNK = 1024


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, origin (a non-null key of the source), size in words and copies of equal rows."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint")
    origin = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return docs.select("doc_id", "source", origin.alias("origin"), size.alias("size")).groupBy(
        "doc_id", "source", "origin", "size").agg(F.count(F.lit(1)).alias("copies"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: origin, source_size, weight and target.

    ``share`` times all words are dealt by weight; a source stops at ``most`` times
    its own words and the excess is dealt again.  That settles where every source
    below its stop has the same words per unit of weight.  The windows see one row
    per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ordered) - 1) % len(weights)
    stops = Window.orderBy(F.col("_stop") / F.col("weight"), "origin")
    own = (
        sizes.groupBy("source", "origin").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
        .withColumn("weight", F.get(F.array(*map(F.lit, weights)), place))
        .withColumn("_stop", F.col("source_size") * most)
        .withColumn("_k", F.row_number().over(stops))
        .withColumn("_given", F.coalesce(F.sum("_stop").over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("weight").over(stops.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
        .withColumn("_level", (F.col("_all") * share - F.col("_given")) / F.col("_rest"))
    )
    free = F.when(F.col("_level") <= F.col("_stop") / F.col("weight"), F.col("_k"))
    level = F.min_by("_level", free).over(Window.partitionBy(F.lit(0)))
    # a level below the first stop that is not reached holds for all sources
    return own.withColumn("_settled", level).select(
        "origin", "source_size", "weight",
        F.least(F.col("_stop").cast("double"), F.col("_settled") * F.col("weight")).alias("target"))


def _log_factorial(n: str) -> str:
    series = f"({n} * ln({n}) - {n} + 0.5 * ln(2 * pi() * {n}) + 1 / (12D * {n}) - 1 / (360D * pow({n}, 3)) + 1 / (1260D * pow({n}, 5)))"
    return f"(CASE WHEN {n} <= 20 THEN ln(factorial(CAST({n} AS INT))) ELSE {series} END)"


def _hypergeometric(total: str, good: str, drawn: str, uniform: str) -> str:
    """SQL for the number of ``good`` items among ``drawn`` of ``total``, by inverting the distribution.

    The sum starts ten standard deviations below the mean, where the tail is below
    the resolution of the uniform number.
    """
    mean = f"({drawn} * CAST({good} AS DOUBLE) / greatest({total}, 1))"
    spread = f"sqrt({mean} * (1 - CAST({good} AS DOUBLE) / greatest({total}, 1)) * ({total} - {drawn}) / greatest({total} - 1, 1))"
    low = f"greatest(0, {drawn} - ({total} - {good}), CAST(floor({mean} - 10 * {spread} - 5) AS BIGINT))"
    high = f"least({good}, {drawn}, CAST(ceil({mean} + 10 * {spread} + 5) AS BIGINT))"
    f = _log_factorial
    first = (
        f"exp({f(good)} - {f('a')} - {f(f'({good} - a)')} + {f(f'({total} - {good})')} - {f(f'({drawn} - a)')}"
        f" - {f(f'({total} - {good} - {drawn} + a)')} - {f(total)} + {f(drawn)} + {f(f'({total} - {drawn})')})"
    )
    ratio = f"(CAST({good} - j AS DOUBLE) * ({drawn} - j) / (CAST(j + 1 AS DOUBLE) * ({total} - {good} - {drawn} + j + 1)))"
    return (
        f"element_at(transform(array({low}), a -> aggregate(sequence(a, {high}), "
        f"named_struct('p', {first}, 'below', 0D, 'n', a), "
        f"(s, j) -> named_struct('p', s.p * {ratio}, 'below', s.below + s.p, "
        f"'n', CASE WHEN s.below + s.p < {uniform} THEN least(j + 1, {high}) ELSE s.n END), s -> s.n)), 1)"
    )


def _split(seed: str) -> str:
    """SQL for the left child's slots of each source of a node."""
    uniform = f"((conv(substr(md5(concat_ws('|', '{seed}', level, node, x.origin)), 1, 13), 16, 10) + 0.5D) / pow(2D, 52))"
    draw = _hypergeometric("t.total", "x.n", "t.drawn", uniform)
    step = (
        f"element_at(transform(array({draw}), h -> named_struct('total', t.total - x.n, 'drawn', t.drawn - h, "
        "'lefts', concat(t.lefts, array(h)))), 1)"
    )
    return (
        "aggregate(quotas, named_struct('total', total, 'drawn', total div 2, 'lefts', CAST(array() AS ARRAY<BIGINT>)), "
        f"(t, x) -> {step}, t -> t.lefts)"
    )


def shard_quotas(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """(origin, shard, n): slots of every source in every one of ``shards`` shards, a power of two.

    ``quotas`` has origin and n.  Shards get equally many slots, give or take one, and
    the numbers of a source over all shards add up to its quota exactly.
    """
    nodes = quotas.where("n > 0").agg(
        F.sort_array(F.collect_list(F.struct("origin", "n"))).alias("quotas")
    ).select(F.lit(0).cast("bigint").alias("node"), "quotas")
    for level in range(int(math.log2(shards))):
        total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda t, x: t + x["n"])
        split = nodes.withColumn("total", total).withColumn("level", F.lit(level)).withColumn("lefts", F.expr(_split(seed)))
        left = "transform(quotas, (x, i) -> named_struct('origin', x.origin, 'n', lefts[i]))"
        right = "transform(quotas, (x, i) -> named_struct('origin', x.origin, 'n', x.n - lefts[i]))"
        nodes = split.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.expr(f"filter({left}, x -> x.n > 0)").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.expr(f"filter({right}, x -> x.n > 0)").alias("quotas")),
        )).alias("c")).select("c.*")
        if level % 5 == 4:
            nodes = nodes.repartition("node")
    return nodes.select(F.col("node").alias("shard"), F.explode("quotas").alias("q")).select("q.origin", "shard", "q.n")


def ordered_blocks(sizes: DataFrame, plan: DataFrame, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """The blocks of every source in its order, with the words before each.

    The order follows an MD5; its first three digits are buckets, so a hot source is
    ordered by many tasks and only the bucket totals meet in one.
    """
    index = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block_words).cast("int") - 1))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("block").cast("string")))
    blocks = (
        sizes.where("size > 0").select("*", index.alias("block"))
        .withColumn("words", F.least(F.lit(block_words).cast("bigint"), F.col("size") - F.col("block").cast("bigint") * block_words))
        .withColumn("key", key)
        .withColumn("bucket", F.substring("key", 1, 3))
    )
    totals = blocks.groupBy("origin", "bucket").agg(
        F.sum(F.col("words") * F.col("copies")).alias("_words"), F.count(F.lit(1)).alias("_blocks"))
    earlier = Window.partitionBy("origin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.select(
            "origin", "bucket",
            F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_words"),
            F.coalesce(F.sum("_blocks").over(earlier), F.lit(0)).alias("_rank"),
            F.sum("_blocks").over(Window.partitionBy("origin")).alias("blocks"))
        .join(plan, "origin")
    )
    inside = Window.partitionBy("origin", "bucket").orderBy("key", "doc_id", "size", "block")
    return (
        blocks.withColumn("_here", F.sum(F.col("words") * F.col("copies")).over(inside) - F.col("words") * F.col("copies"))
        .withColumn("_place", F.row_number().over(inside) - 1)
        .join(offsets, ["origin", "bucket"])
        .withColumn("before", F.col("_here") + F.col("_words"))
        .withColumn("rank", F.col("_place") + F.col("_rank"))
        .drop("_here", "_words", "_place", "_rank", "bucket")
    )


def mix(sizes: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """The manifest of the mix: which words of which document go to which shard, in shuffled order.

    ``sizes`` comes from ``sized``.  Returns shard, place (its order in the shard),
    doc_id, source, size, pass (from 0), block, start (its first word) and words (per
    copy of the row).  Each source takes its target rounded to words: whole passes
    over its blocks, then a prefix of their order whose last block is cut.  No
    document is taken more often than the passes of its source, at most twice.  A
    document without words has no block; rows equal in doc_id, source and size count
    as copies that are drawn together; a NULL source is a source of its own, a NULL
    doc_id is an id like others.  The result depends on the rows and ``seed`` alone.
    An empty table gives an empty manifest.
    """
    plan = targets(sizes).select(
        "origin",
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).alias("passes"),
        "source_size", "target",
    ).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("bigint")
    ).select("origin", "passes", "rest")
    plan = stored(plan, "mix-plan")
    extra = F.greatest(F.least(F.col("rest") - F.col("before"), F.col("words") * F.col("copies")), F.lit(0))
    blocks = stored(ordered_blocks(sizes, plan, block_words, seed).withColumn(
        "part", F.floor(extra / F.col("copies")).cast("bigint")), "mix-blocks")
    slots = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))).alias("pass")).withColumn(
        "words", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("part"))
    ).where("words > 0").withColumn("slot", F.col("pass") * F.col("blocks") + F.col("rank"))
    quotas = stored(
        slots.groupBy("origin").agg((F.max("slot") + 1).alias("n"), F.sum(F.col("words") * F.col("copies")).alias("w")), "mix-quotas")
    words = quotas.agg(F.sum("w")).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1, words) / shard_words)))
    upto = Window.partitionBy("origin").orderBy("shard")
    ranges = (
        shard_quotas(quotas.select("origin", "n"), shards, seed)
        .withColumn("high", F.sum("n").over(upto))
        .withColumn("low", F.col("high") - F.col("n"))
        .withColumn("chunk", F.explode(F.expr(f"sequence(low div {CHUNK}, (high - 1) div {CHUNK})")))
        .select("origin", "chunk", "low", "high", "shard")
    )
    dealt = slots.withColumn("chunk", F.expr(f"slot div {CHUNK}")).join(ranges, ["origin", "chunk"]).where(
        "slot >= low AND slot < high")
    return dealt.select(
        "shard", F.md5(F.concat_ws("|", F.lit(seed), "shard", "pass", "key")).alias("place"), "doc_id", "source", "size",
        "pass", "block", (F.col("block").cast("bigint") * block_words).alias("start"), "words")


def write_mix(manifest: DataFrame, path: str) -> None:
    """One or more files per shard, the rows of a shard in its shuffled order."""
    manifest.repartition("shard").sortWithinPartitions("shard", "place").write.parquet(path)


def _written(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    path = scratch_path(spark, "mix")
    manifest = mix(sizes)
    write_mix(manifest, path)
    return spark.read.schema(manifest.schema).parquet(path)


def _same(sizes: DataFrame, other: DataFrame):
    return [sizes[c].eqNullSafe(other[c]) for c in ("doc_id", "source", "size")]


def taken(sizes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every row with its size and the words the mix takes of it: doc_id, origin, size, taken."""
    drawn = manifest.groupBy("doc_id", "source", "size").agg(F.sum("words").alias("taken"))
    return (
        sizes.join(drawn, _same(sizes, drawn), "left")
        .select(sizes["doc_id"], "origin", sizes["size"], F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
                F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
        .drop("_copy")
    )


def materialised(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: one per pass, with all their columns.

    The text of a pass that takes all words is the text itself.  Otherwise it is the
    taken words, each with the white space after it; ``n_chars``, where there is such
    a column, follows the text.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = pack(docs, _doc=F.col("doc_id"), _source=F.col("source"), _size=size)
    parts = manifest.groupBy("doc_id", "source", "size", "pass").agg(
        F.sum("words").alias("_words"), F.collect_list(F.struct("start", (F.col("start") + F.col("words")).alias("stop"))).alias("_parts"))
    joined = rows.join(parts, [F.col("_doc").eqNullSafe(parts["doc_id"]), F.col("_source").eqNullSafe(parts["source"]),
                               F.col("_size") == parts["size"]])
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    chosen = F.filter(pieces, lambda p, i: F.exists("_parts", lambda b: (i >= b["start"]) & (i < b["stop"])))
    text = F.when(F.col("_words") == F.col("_size"), F.col("_row.text")).otherwise(F.array_join(chosen, ""))
    kind = dict(docs.dtypes)
    made = {"text": text}
    if "n_chars" in kind:
        whole = F.when(F.col("_words") == F.col("_size"), F.col("_row.n_chars"))
        made["n_chars"] = whole.otherwise(F.length(text)).cast(kind["n_chars"])
    return joined.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` mixed to the target weights; see ``mix`` and ``materialised`` for the cases."""
    return materialised(docs, _written(spark, stored(sized(docs), "sizes")))


@query(
    "op5_mix_sources",
    r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
k AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS stop,
  row_number() OVER (ORDER BY 2 * source_size / weight, source) AS k FROM w),
v AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM k),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, k) FROM v WHERE level <= stop) * weight) AS target FROM v),
p AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS passes FROM t),
r AS (SELECT *, CAST(round(target - passes * source_size) AS BIGINT) AS rest FROM p),
b AS (SELECT doc_id, source, size, unnest(range(CAST(ceil(size / 2048) AS BIGINT))) AS block FROM d WHERE size > 0),
o AS (SELECT *, least(2048, size - 2048 * block) AS words, md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || block) AS key FROM b),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key, doc_id, size, block ROWS UNBOUNDED PRECEDING) - words AS before FROM o),
x AS (SELECT c.doc_id, CAST(sum(greatest(least(rest - before, words), 0)) AS BIGINT) AS extra
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source GROUP BY c.doc_id)
SELECT d.doc_id, d.size, r.source_size, r.target, r.passes * d.size + coalesce(x.extra, 0) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN x ON x.doc_id = d.doc_id
""",
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of every document, added up from the written shards."""
    sizes = stored(sized(table(spark, sf, "documents")), "sizes")
    rows = taken(sizes, _written(spark, sizes))
    per_source = stored(targets(sizes), "targets").select("origin", "source_size", "target")
    return rows.join(per_source, "origin").select("doc_id", "size", "source_size", "target", "taken")
