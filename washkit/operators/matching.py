"""Join of names that are spelt differently: edit distance inside blocks of shared q-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_name(c: Column) -> Column:
    """A name without case and outer or repeated white space."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _grams(name: Column, q: int) -> Column:
    padded = F.concat(F.lit("\u0001"), name, F.lit("\u0001"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(padded) - q + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(q))))


def _posted(names: DataFrame, block: Sequence[str], most: int, q: int) -> DataFrame:
    """(block..., name, gram): the ``q * most + 1`` rarest grams of each name. Names one edit apart
    differ in at most q grams, so two names within ``most`` edits share one of these; names with so
    few grams that they may share none also meet under the empty gram."""
    each = names.select(*block, "name", F.explode(_grams(F.col("name"), q)).alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("c"))
    own = each.join(common, "gram").groupBy(*block, "name").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("grams"))
    rarest = F.transform(F.slice("grams", 1, q * most + 1), lambda g: g["gram"])
    return own.select(*block, "name", F.explode(F.when(F.size("grams") <= 2 * q * most, F.array_append(rarest, F.lit(""))).otherwise(rarest)).alias("gram"))


def match_names(left: DataFrame, right: DataFrame, name: str = "name", block: Sequence[str] = (), *, most: int = 2, q: int = 2) -> DataFrame:
    """(block..., name, match, distance): for each distinct name of ``left`` the name of ``right`` that
    is nearest within ``most`` edits, the least one of equals; NULL where there is none.

    Names and ``block`` columns are compared without case and outer white space (:func:`normal_name`),
    names only inside their block. Equal names match by an equi-join and are done (distance 0). The
    rest meet where they share one of their rarest q-grams, counted over both sides, and only those
    pairs are compared, by ``levenshtein`` with a bound. Repeated names are one before anything is
    joined. NULL names are left out; NULL blocks are a block of their own.
    """
    keys = [*block, "name"]

    def names(df: DataFrame) -> DataFrame:
        blocks = [F.coalesce(normal_name(F.col(b)), F.lit("\u0000")).alias(b) for b in block]
        return df.select(*blocks, normal_name(F.col(name)).alias("name")).where("name IS NOT NULL").distinct()

    lefts, rights = names(left), names(right)
    same = lefts.join(rights, keys, "left_semi").select(*keys, F.col("name").alias("match"), F.lit(0).alias("distance"))
    rest = lefts.join(rights, keys, "left_anti")
    posted = _posted(rest.withColumn("of", F.lit(0)).unionByName(rights.withColumn("of", F.lit(1))), [*block, "of"], most, q)
    theirs = posted.where("of = 1").select(*block, F.col("name").alias("match"), "gram")
    pairs = posted.where("of = 0").select(*keys, "gram").join(theirs, [*block, "gram"]) \
        .where(F.abs(F.char_length("name") - F.char_length("match")) <= most).select(*keys, "match").distinct()
    scored = pairs.withColumn("distance", F.levenshtein("name", "match", most)).where("distance >= 0")
    best = scored.groupBy(*keys).agg(F.min(F.struct("distance", "match")).alias("__best")).select(*keys, "__best.match", "__best.distance")
    near = rest.join(best, keys, "left").select(*keys, "match", "distance")
    return same.unionByName(near).select(*[F.nullif(F.col(b), F.lit("\u0000")).alias(b) for b in block], "name", "match", "distance")
