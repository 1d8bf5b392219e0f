"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is normalised (runs of ASCII white space become one space) and cut into chunks whose ends depend on the
content: a chunk ends at the first sentence end past the least size; where there is none up to the greatest size (code,
other scripts, encoded data) at a mark of those, at a doubled character or at a space, and by size if all lack.  A
document's recipe is the ordered list of its chunk identifiers.  Each distinct chunk moves once and is compared byte by
byte with those of the same digest; where different chunks share a digest, a version number tells them apart.  After
that only recipes move, about a tenth of the text: documents are equal when their lists of (digest, version) are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverspark.llm.common import cut, text_of

#: Recipes of more characters aren't sent to the executors whole.
SENT = 1 << 16

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(text_of(text), WHITE, " ")


def chunks(norm: Column, least: int = 256, most: int = 2048) -> Column:
    """The content-defined chunks of a text; joined they are the text again."""
    ends = ("[.!?,] ", "[;{}。！？，、；：।۔؟]", r"(.)\1", " ")
    found = [rf".{{{least},{most}}}?{end}" for end in ends]
    return F.regexp_extract_all(norm, F.lit("(?s)" + "|".join([*found, rf".{{1,{most}}}"])), 0)


def chunk_digest(chunk: Column) -> Column:
    return F.md5(chunk)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 256, most: int = 2048, digest=chunk_digest
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null text counts as empty, and all empty texts are equal.  Of equal texts the smallest id stays; rows that repeat
    that id are kept too (``kept`` is ``id = keep_id``).  A null id never stays unless its whole group has null ids;
    then keep_id is null and kept true.  Other columns of the input, whatever their names, are not read.
    Very long texts are read whole, chunk by chunk; an empty table gives no rows.

    Recipes that a thousandth of the rows share are at most a thousand; those of at most ``SENT`` characters are sent to
    their rows, so that the copies of one text don't meet in one task.
    """

    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    cutup = norm.withColumn("chunks", chunks(F.col("norm"), least, most))
    recipe = F.array_join(F.transform("chunks", digest), "")
    known = cut(cutup.select("id", recipe.alias("recipe"), F.sha2("norm", 256).alias("sha")))

    # every distinct chunk moves once; digests that several chunks share are hardly ever found
    distinct = cutup.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk").distinct()
    shared = distinct.groupBy("digest").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.sha2("chunk", 512))).alias("all"))
    shared = cut(shared.filter("n > 1").drop("n"))
    if shared.isEmpty():
        told = known.withColumn("versions", F.lit(""))
    else:
        pieces = cutup.select(recipe.alias("recipe"), F.sha2("norm", 256).alias("sha"), F.posexplode("chunks").alias("pos", "chunk"))
        pieces = pieces.select("recipe", "sha", "pos", digest(F.col("chunk")).alias("digest"), F.sha2("chunk", 512).alias("strong"))
        at = F.struct("pos", F.array_position("all", F.col("strong")).alias("version"))
        versions = pieces.join(shared, "digest").groupBy("recipe", "sha").agg(F.to_json(F.sort_array(F.collect_set(at))).alias("versions"))
        told = known.join(versions, ["recipe", "sha"], "left").withColumn("versions", F.coalesce("versions", F.lit("")))

    groups = told.groupBy("recipe", "versions").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut(groups.filter("group_size > 1"))
    keys = ["recipe", "versions"]
    common = (F.col("group_size") * 1000 >= known.count()) & (F.length("recipe") + F.length("versions") <= SENT)
    common = F.broadcast(groups.filter(common))
    out = told.join(common, keys).unionByName(told.join(common.select(*keys), keys, "left_anti").join(groups, keys, "left"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
