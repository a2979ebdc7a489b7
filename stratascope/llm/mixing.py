"""Mixing sources to target weights, by nested hash-threshold histograms.

Every document has a 60-bit hash of its id and text. A source's target is met by whole copies of the source plus the
documents whose hash lies below the source's threshold, so a larger target always holds the mix of a smaller one. The
threshold is found from sums of words by source and hash bucket: 4,096 buckets of the first 12 bits, then 4,096 of the
next 12 bits within the one bucket where the target falls, and so on until that bucket holds a single hash. Nothing is
sorted by hash, and every histogram has at most 4,096 rows a source.

Cases: a null text has no words; a null source is a source of its own, last in order; sources without words have target
0; rows alike in id and text share one hash: where a threshold falls on it, as many of them are taken as come nearest to
the target; an empty table gives an empty result. Columns of the input never clash with those used here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words, drop_written, keeps, packed, unpacked, written

HASH_BITS, LEVEL_BITS = 60, 12


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of id and text, as a long."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cycle: Sequence[int], share: float, cap: int) -> DataFrame:
    """source, source_size, target: ``sizes`` has source and source_size.

    Weights repeat over the sources in code-point order. What a source's cap takes away is shared again by weight among
    the others until none is above its cap. The sources stay distributed; a pass brings four sums to the driver.
    """
    ordered = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    part, before, offsets = F.shiftright("at", 33), 0, []
    for row in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        offsets += [F.lit(row["part"]), F.lit(before)]
        before += row["count"]
    rank = (F.col("at").bitwiseAND((1 << 33) - 1) + (F.create_map(*offsets)[part] if offsets else F.lit(0))).cast("long")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int")).cast("long")
    weighed = ordered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    total, rest, weights, capped = int(total * share) if share != 1 else total, None, None, None
    while True:
        over = F.lit(False) if rest is None else F.col("weight").cast("double") * rest / weights > F.col("most")
        full, w, n = weighed.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == capped or not w:
            break
        rest, weights, capped = float(total - (full or 0)), float(w), n
    target = F.lit(0.0) if not weights else F.least(F.col("most").cast("double"), F.col("weight").cast("double") * rest / weights)
    return weighed.select("source", "source_size", target.alias("target"))


def source_thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, copies, threshold, ties and take.

    ``slim`` has source, size and h. A document gets ``copies`` copies, one more below the threshold, and so do ``take`` of
    the ``ties`` rows at it.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = written(targets.withColumn("copies", whole).withColumn("rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(0.0)), "targets")
    found, open_, used = [], plan.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), []
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        inside = slim.alias("d").join(open_.alias("o"), F.expr("d.source <=> o.source") & (F.shiftright("d.h", shift + LEVEL_BITS) == F.col("o.prefix")))
        buckets = inside.groupBy("o.source", "o.rest", "o.below", F.shiftright("d.h", shift).alias("bucket")).agg(F.sum("d.size").alias("words"), F.min("d.h").alias("low"), F.max("d.h").alias("high"), F.count("*").alias("ties"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))  # at most 4,096 rows a source
        edge = buckets.withColumn("upto", F.col("below") + upto).where("upto >= rest and upto - words < rest")
        edge = written(edge.select("source", "rest", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("words")).alias("below"), "words", "low", "high", "ties"), "edges")
        used.append(edge)
        found.append(edge.where("low = high").select("source", F.col("low").alias("threshold"), "ties", F.ceil((F.col("rest") - F.col("below")) / (F.col("words") / F.col("ties")) - 0.5).cast("long").alias("take")))
        open_ = edge.where("low < high").select("source", "rest", "prefix", "below")
        if open_.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    out = plan.alias("p").join(edges.alias("e"), F.expr("p.source <=> e.source"), "left")
    out = written(out.select("p.source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(-1)).alias("threshold"), F.coalesce("ties", F.lit(0)).alias("ties"), F.coalesce("take", F.lit(0)).alias("take")), "thresholds")
    drop_written(plan, *used)
    return out


SALTS = 1024


def _ties(slim: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rid of the rows taken where only some of those alike at a threshold are; each source's are dealt over SALTS groups."""
    split = thresholds.where("take > 0 AND take < ties").select("source", "threshold", "take")
    at = slim.alias("d").join(split.alias("t"), F.expr("d.source <=> t.source AND d.h = t.threshold")).select(F.struct("d.source").alias("s"), "rid", "take", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt"))
    counts = at.groupBy("s", "salt", "take").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("salt")) - F.col("n")  # SALTS rows a source
    share = counts.select(F.col("s").alias("s_"), F.col("salt").alias("salt_"), (F.col("take") - before).alias("share"))
    each = at.withColumn("i", F.row_number().over(Window.partitionBy("s", "salt").orderBy("rid")))
    return each.join(share, F.expr("s = s_ AND salt = salt_ AND i <= share")).select("rid")


def _copies(rows: DataFrame, cycle: Sequence[int], share: float, cap: int) -> DataFrame:
    """``rows`` (with rid, source, size and h) with source_size, target and n, the row's copies."""
    slim = rows.select("rid", "source", "size", "h")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    thresholds = source_thresholds(slim, source_targets(sizes, cycle, share, cap))
    out = rows.alias("d").join(thresholds.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "source_size", "target", "copies", "threshold", "ties", "take")
    extra = (F.col("h") < F.col("threshold")) | ((F.col("h") == F.col("threshold")) & (F.col("take") >= F.col("ties")))
    if thresholds.where("take > 0 AND take < ties").isEmpty():
        chosen = None
    else:
        chosen = written(_ties(slim, thresholds), "ties")
        out = out.join(chosen.withColumn("chosen", F.lit(True)), "rid", "left")
        extra = extra | F.coalesce("chosen", F.lit(False))
    return keeps(out.withColumn("n", F.col("copies") + extra.cast("long")), rows, thresholds, chosen)


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str) -> dict:
    return {"rid": F.monotonically_increasing_id(), "source": F.col(f"`{source}`"), "size": count_words(F.col(f"`{text}`")), "h": document_hash(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))}


def mix_plan(docs: DataFrame, cycle: Sequence[int] = (5, 2, 1), share: float = 1.0, cap: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size times copies) of every document."""
    keys = _keyed(docs, doc_id, text, source)
    rows = written(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *[c.alias(k) for k, c in keys.items()]), "sizes")
    out = _copies(rows, cycle, share, cap)
    return keeps(out.select("doc_id", "source", "size", "source_size", "target", F.col("n").alias("copies"), (F.col("size") * F.col("n")).alias("taken")), out)


def mixed(docs: DataFrame, cycle: Sequence[int] = (5, 2, 1), share: float = 1.0, cap: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    rows = written(packed(docs, **_keyed(docs, doc_id, text, source)), "rows")
    out = _copies(rows, cycle, share, cap)
    return keeps(unpacked(out.where("n > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))), out)


#: DuckDB's form of ``mix_plan`` with the default parameters, for a relation named by {docs}.
MIX_SQL = """
docs_ AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size_,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h_ FROM {docs}),
sources_ AS (SELECT source, sum(size_)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM docs_ GROUP BY source),
levels_ AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE AS rest, sum(w) OVER u AS ws FROM sources_
    WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level_ AS (SELECT rest, ws FROM levels_ WHERE w * rest / ws <= 3 * source_size ORDER BY 3 * source_size / w, source NULLS LAST LIMIT 1),
targets_ AS (SELECT source, source_size, least(3 * source_size::DOUBLE, w::DOUBLE * rest / ws::DOUBLE) AS target FROM sources_, level_),
plans_ AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies_ FROM targets_),
sums_ AS (SELECT d.*, p.source_size, p.target, p.copies_, CASE WHEN p.source_size > 0 THEN p.target - p.copies_ * p.source_size ELSE 0 END AS rest,
    sum(size_) OVER (PARTITION BY d.source ORDER BY h_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    coalesce(sum(size_) OVER (PARTITION BY d.source ORDER BY h_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM docs_ d JOIN plans_ p ON d.source IS NOT DISTINCT FROM p.source),
mixed_ AS (SELECT *, copies_ + CASE WHEN rest > 0 AND (upto < rest OR (below < rest AND upto - rest < rest - below)) THEN 1 ELSE 0 END AS n_ FROM sums_)
"""
