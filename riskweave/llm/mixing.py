"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("source_size", "target", "epochs", "taken")


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most_repeats: int = 3) -> DataFrame:
    """Words that each source gives to a mix as large as all sources together.

    ``sizes`` has one row per source: ``source`` (null allowed), ``source_size``. Sources in code
    point order, null last, take the weights in turn. A target stops at ``most_repeats`` times its
    source's size and what is left goes to the others by weight. Sorted by the ratio of that limit
    to the weight, the limited sources come first, so one pass of running sums finds them; the
    numbers up to the last division are whole. A source without words has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picks = "element_at(array({}), cast((n - 1) % {} AS int) + 1)".format(
        ", ".join(f"{int(w)}L" for w in weights), len(weights)
    )
    ranked = sizes.withColumn("n", F.row_number().over(order)).selectExpr(
        "source", "source_size", f"{picks} AS weight", f"source_size * {int(most_repeats)}L AS most"
    )
    whole = Window.orderBy(F.expr("most / weight"), F.col("source").asc_nulls_last())
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranked.withColumn("_most", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_words", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("limited", F.expr("most * (_weights - _weight) <= weight * (_words - _most)"))
        .withColumn("_most", F.sum(F.expr("if(limited, most, 0L)")).over(every))
        .withColumn("_weight", F.sum(F.expr("if(limited, weight, 0L)")).over(every))
        .selectExpr(
            "source",
            "source_size",
            "if(limited, cast(most AS double), cast(weight * (_words - _most) AS double) / (_weights - _weight)) AS target",
        )
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most_repeats: int = 3,
    rows_per_range: int = 256,
    ranges_per_block: int = 1024,
) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    ``docs`` has ``doc_id``, ``source`` and ``size`` (words); other columns are carried along, but
    for those named like an added one. Added: ``source_size``, ``target``, ``epochs`` (whole
    passes over the source), ``taken`` (words taken, repeats counted). Documents of a source are
    ordered by a hash of the id; ties (a repeated id) by the id and the size, so equal rows are
    interchangeable and reruns agree.

    The hash space is cut into ranges of about ``rows_per_range`` documents and blocks of ranges.
    Sums per range are made before the shuffle; prefix sums run over the ranges of a block, over
    the blocks of a source and over the documents of a range, so no task holds a source, however
    large. A null source is a source of its own; a null size counts as 0; an empty table gives
    an empty table.
    """
    carried = [c for c in docs.columns if c not in ADDED]
    keyed = docs.select(
        "source",
        F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        "doc_id",
        F.struct(*[f"`{c}`" for c in carried]).alias("doc"),
    )
    kept = stored(keyed, "mix")
    ranges = max(1, -(-kept.count() // rows_per_range))
    place = "cast(conv(substring(key, 1, 8), 16, 10) AS long)"
    ranged = kept.withColumn("part", F.expr(f"shiftright({place} * {ranges}L, 32)"))
    per_range = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"))
    per_range = stored(
        per_range.withColumn("block", F.expr(f"cast(floor(part / {ranges_per_block}) AS long)")), "mix"
    )
    by_source = Window.partitionBy("source").orderBy("block")
    per_block = per_range.groupBy("source", "block").agg(F.sum("words").alias("words"))
    per_block = per_block.withColumn("start", F.sum("words").over(by_source) - F.col("words")).drop("words")
    targets = source_targets(per_range.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most_repeats)

    in_block = Window.partitionBy("l.source", "l.block").orderBy("l.part")
    starts = (
        per_range.alias("l")
        .join(per_block.alias("r"), F.expr("l.source <=> r.source AND l.block = r.block"))
        .select("l.source", "part", (F.sum("words").over(in_block) - F.col("words") + F.col("start")).alias("start"))
    )
    starts = (
        starts.alias("l")
        .join(targets.alias("r"), F.expr("l.source <=> r.source"))
        .select("l.source", "part", "start", "source_size", "target")
    )
    in_range = (
        Window.partitionBy("l.source", "l.part")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.alias("l")
        .join(starts.alias("r"), F.expr("l.source <=> r.source AND l.part = r.part"))
        .withColumn("before", F.sum("size").over(in_range) - F.col("size") + F.col("start"))
        .withColumn("budget", F.expr("cast(floor(target) AS long)"))
        .withColumn("epochs", F.expr("if(source_size = 0, 0L, budget div source_size)"))
        .withColumn("rest", F.expr("budget - epochs * source_size"))
        .select(
            "doc.*",
            "source_size",
            "target",
            "epochs",
            F.expr("epochs * size + greatest(0L, least(size, rest - before))").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once per whole pass, then the document that the budget cuts
    up to its last word taken, or whole if it is not cut. Columns as in ``docs``; ``n_chars`` is
    that of the new text. A document without words is in no mix."""
    names = docs.columns
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("whole"))
    mixed = mix(sized, **options).withColumn("part", F.expr("taken - epochs * size"))
    copies = "concat(array_repeat(false, if(size > 0, cast(epochs AS int), 0)), array_repeat(true, if(part > 0, 1, 0)))"
    begun = r"array_join(slice(regexp_extract_all(whole.text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(part AS int)), '')"
    rows = mixed.withColumn("last", F.explode(F.expr(copies))).withColumn(
        "new_text", F.expr(f"if(last AND part < size, {begun}, whole.text)")
    )
    new = {"text": F.col("new_text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in names])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight,
         3 * source_size AS most FROM s
), b AS (
  SELECT *, coalesce(sum(most) OVER w, 0) AS mb, coalesce(sum(weight) OVER w, 0) AS wb,
         sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM r WINDOW w AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, most * (weights - wb) <= weight * (words - mb) AS limited FROM b
), t AS (
  SELECT source, source_size, CASE WHEN limited THEN CAST(most AS DOUBLE) ELSE
    CAST(CAST(weight * (words - sum(CASE WHEN limited THEN most ELSE 0 END) OVER ()) AS BIGINT) AS DOUBLE)
    / CAST(weights - sum(CASE WHEN limited THEN weight ELSE 0 END) OVER () AS BIGINT) END AS target
  FROM l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS before,
    CAST(floor(t.target) AS BIGINT) AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE CAST((budget // source_size) * size
    + greatest(0, least(size, budget % source_size - before)) AS BIGINT) END AS taken
FROM o
"""
