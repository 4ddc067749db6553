"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

A source's target over its size is the number of copies that each of its documents should have on average. Its whole part
is certain: so many copies of every document. The fraction left is the inclusion probability of one more copy; documents
are ranked by the odds of a random number over the odds of their inclusion, and the first are taken up to the words
still wanted. Random numbers come from MD5 of the doc_id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hybridlake.llm.stored import stored
from hybridlake.llm.texts import documents

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of a source are cut by their random number into so many cells; only the cell at the limit is ranked row by row.
CELLS = 1 << 16


def word_count(text: Column | str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number between 0 and 1 from 52 bits of the key's MD5; NULL keys share one."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def odds(p: Column) -> Column:
    return p / (1 - p)


def numbered(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with ``position`` (from 0) and, per name in ``sums``, the sum over all rows before, in ``order``.

    Rows are sorted in ranges and written once; only one row per range meets in one place.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    measures = {"position": F.lit(1), **sums}
    before = ranged.groupBy("range").agg(*[F.sum(m).alias(f"all_{n}") for n, m in measures.items()])
    before = before.select("range", *[F.coalesce(F.sum(f"all_{n}").over(over), F.lit(0)).alias(f"before_{n}") for n in measures])
    local = ranged.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"local_{n}") for n, m in measures.items()])
    return local.join(before, "range").select(
        *df.columns, *[(F.col(f"local_{n}") + F.col(f"before_{n}")).alias(n) for n in measures])


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size)`` per source → also ``target``.

    Sources in code point order (NULL last) weigh ``weights``, repeating, and share all sizes. A target stops at ``most``
    times its source's size; the excess is shared again by weight until none is above. The end of that is a water level:
    in order of saturation (size over weight), a source is full if the level that fills it needs no more than there is.
    """
    binary = F.encode(F.col("source"), "UTF-8")
    placed = numbered(sources, [F.col("source").isNull(), binary], {})
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % n + 1).cast("int"))
    weighed = placed.select("source", "source_size", weight.cast("decimal(20,0)").alias("weight"),
                            (F.col("source_size") * most).cast("decimal(38,0)").alias("limit"))
    level = F.col("limit").cast("double") / F.col("weight").cast("double")
    ranked = numbered(weighed.withColumn("level", level), [F.col("level"), binary.isNull(), binary],
                      {"full": F.col("limit"), "light": F.col("weight")})
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return sources.select("source", "source_size", F.lit(0.0).alias("target"))
    whole = lambda x: F.lit(x).cast("decimal(38,0)")
    behind = whole(all_weight) - F.col("light")  # the weight of this source and of those that fill later
    is_full = F.col("full") * F.col("weight") + F.col("limit") * behind <= whole(total) * F.col("weight")
    ranked = ranked.withColumn("is_full", is_full)
    filled, left = ranked.agg(
        F.sum(F.when(F.col("is_full"), F.col("limit"))), F.sum(F.when(~F.col("is_full"), F.col("weight")))).first()
    share = F.lit(float(total - int(filled or 0))) * F.col("weight").cast("double") / F.lit(float(left or 1))
    return ranked.select(
        "source", "source_size",
        F.when(F.col("is_full"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(doc_id, source, size, source_size, target, n_copies)`` per row of ``docs``.

    NULL and empty texts have size 0 and never get more than the certain copies; NULL is a source of its own, the last.
    Rows with one doc_id share their random number and are ranked by size. The words taken from a source differ from its
    target by less than half of the document at the limit. A source that holds most documents is cut into cells, so
    no task ranks more than one cell of it.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    rows = stored(rows, "sizes")
    by_source = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = by_source.select("*", F.floor(ratio).alias("certain"), (ratio - F.floor(ratio)).alias("inclusion"))
    goals = goals.withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size"))

    same = F.col("r.source").eqNullSafe(F.col("g.source"))
    drawn = rows.alias("r").join(goals.alias("g"), same).select("r.*", "source_size", "target", "certain", "inclusion", "wanted")
    u = uniform(F.col("doc_id"))
    rank = odds(u) / odds(F.col("inclusion"))
    drawn = drawn.withColumns({"cell": F.floor(u * CELLS), "rank": F.when(F.col("inclusion") > 0, rank)})

    cells = drawn.where("inclusion > 0").groupBy("source", "cell", "wanted").agg(F.sum("size").alias("cell_size"))
    up_to = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("before", F.sum("cell_size").over(up_to) - F.col("cell_size"))
    limit = cells.where("before <= wanted").groupBy("source").agg(F.max(F.struct("cell", "before")).alias("at")).select(
        F.col("source").alias("limit_source"), F.col("at.cell").alias("limit_cell"), F.col("at.before").alias("limit_before"))

    placed = drawn.join(limit, F.col("source").eqNullSafe(F.col("limit_source")), "left").drop("limit_source")
    at_limit = F.coalesce(F.col("cell") == F.col("limit_cell"), F.lit(False))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("limit_before") + F.sum("size").over(order) - F.col("size")
    near = placed.where(at_limit).withColumn("before", before).withColumn(
        "more", F.when(F.col("before") + F.col("size") / 2 <= F.col("wanted"), 1).otherwise(0)).drop("before")
    far = placed.where(~at_limit).withColumn("more", F.when(F.col("cell") < F.col("limit_cell"), 1).otherwise(0))
    return near.unionByName(far).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("certain") + F.col("more")).cast("long").alias("n_copies"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix: every row of ``docs`` as often as the mix takes it, with all its columns.

    Rows with one doc_id, source and size are told apart by nothing the mix looks at: their copies, taken together, go
    to the rows in turn, the first in order of text hash.
    """
    drawn = copies(docs).groupBy("doc_id", "source", "size").agg(
        F.sum("n_copies").alias("all_copies"), F.count(F.lit(1)).alias("n_rows"))
    keys = [F.col("doc_id").alias("row_id"), F.col("source").alias("row_source"), word_count("text").alias("row_size")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *keys)
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("row_id", "doc_id"), ("row_source", "source"), ("row_size", "size"))]
    joined = rows.join(drawn.where("all_copies > 0"), same[0] & same[1] & same[2])
    each = F.floor(F.col("all_copies") / F.col("n_rows"))
    alone = joined.where("n_rows = 1").select("row", F.col("all_copies").alias("n"))
    turn = F.row_number().over(Window.partitionBy("row_id", "row_source", "row_size").orderBy(F.xxhash64("row.text")))
    shared = joined.where("n_rows > 1").withColumn("turn", turn).select(
        "row", (each + (F.col("turn") <= F.col("all_copies") % F.col("n_rows")).cast("long")).alias("n"))
    dealt = alone.unionByName(shared).where("n > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document, its source's target, and the words the mix takes of it."""
    found = copies(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


OP7_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight,
    sum(source_size) OVER () AS total
  FROM sources
), ranked AS (
  SELECT *, coalesce(sum(3 * source_size) OVER w, 0) AS full_before, coalesce(sum(weight) OVER w, 0) AS light,
    sum(weight) OVER () AS all_weight
  FROM weighed
  WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source IS NULL, encode(source)
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, full_before * weight + 3 * source_size * (all_weight - light) <= total * weight AS is_full FROM ranked
), level AS (
  SELECT *, sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER () AS full_all,
    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS left_all
  FROM filled
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE
    ELSE (total - full_all)::DOUBLE * weight::DOUBLE / left_all::DOUBLE END AS target
  FROM level
), goals AS (
  SELECT *, floor(ratio) AS certain, ratio - floor(ratio) AS inclusion, target - floor(ratio) * source_size AS wanted
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets)
), drawn AS (
  SELECT r.doc_id, r.size, g.*,
    (('0x' || substr(md5(coalesce(r.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (inclusion / (1 - inclusion)), doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM drawn WHERE inclusion > 0
  UNION ALL SELECT *, NULL FROM drawn WHERE NOT inclusion > 0
)
SELECT doc_id, size, source_size, target,
  (size * (certain + CASE WHEN before + size / 2 <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
