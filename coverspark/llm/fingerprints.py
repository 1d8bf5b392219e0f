"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, with DataFrame functions only.

Leaves are sentence-sized pieces, a paragraph is a line, and a section is a run of paragraphs that ends behind a
paragraph whose hash begins with 0 or 1 (one in eight), so that an edit moves no other section's ends.  Every hash
above the leaves covers the ordered hashes below it: equal roots mean equal texts, and where roots differ the branches
that differ lead to the edited sections and paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverspark.llm.common import bucket_of, partitions, text_of

#: Pieces that end behind sentence marks or a line end, of 256 characters at most; joined they are the text again.
LEAF = r"(?:[^.!?\n]{1,256}[.!?]{0,8}|[.!?]{1,8}) ?\n?|\n"


def leaves(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LEAF), 0)


def _short(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def merkle(pieces: Column) -> Column:
    """struct(root, sections, paragraphs, leaves) of a text's leaves.

    sections and paragraphs are ordered arrays of hashes; leaves are 64-bit marks of the distinct leaf hashes.
    """
    ended = lambda p: F.concat(_short(p), F.when(p.endswith("\n"), F.lit(";")).otherwise(F.lit(",")))
    paragraphs = F.transform(F.split(F.array_join(F.transform(pieces, ended), ""), ";"), _short)
    closed = lambda h: F.concat(h, F.when(h < "2", F.lit(";")).otherwise(F.lit(",")))
    sections = F.transform(F.split(F.array_join(F.transform(paragraphs, closed), ""), ";"), _short)
    leaves = F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(_short(p))))
    return F.struct(F.sha2(F.array_join(sections, ","), 256).alias("root"), sections.alias("sections"), paragraphs.alias("paragraphs"), leaves.alias("leaves"))


def likeness(a: Column, b: Column) -> Column:
    """How alike two trees are, 0 to 1: one if the roots are equal, else the Dice coefficient of their leaves."""
    x, y = a.getField("leaves"), b.getField("leaves")
    return F.when(a.getField("root") == b.getField("root"), 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def changed(a: Column, b: Column) -> Column:
    """0-based positions of the hashes in ``a`` (sections or paragraphs of one tree) that ``b`` lacks: where it was edited."""
    found = F.transform(a, lambda h, i: F.when(~F.array_contains(b, h), i))
    return F.filter(found, lambda i: i.isNotNull())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and tree (struct of root, sections, paragraphs, leaves) of every text.

    Null text counts as empty; an empty text has one empty paragraph and section and no leaves.  Very long texts are
    read whole, repeated rows give repeated results, an empty table gives no rows, and extra columns are not read.
    """
    return docs.select(F.col(id_col), merkle(leaves(text_of(text_col))).alias("tree"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and an edited form of it, whose last quarter is the beginning of the next text by id.

    Returns id, n_chars, text, edited, tree, edited_tree, edited_sections (positions of the sections that the edit
    changed), near_edited and near_next.  Null text counts as empty.  Null ids come first; rows with one id follow
    each other by text hash; after the last row comes the first.  A single row is its own next.  Very long texts are
    read whole, an empty table gives no rows, and extra columns are not read.

    Rows are dealt out by ranges of ids whose bounds are ids of the table, so that a range's first row is known
    without looking: that row goes to the range before it as well, and each range then finds its own next rows.
    """
    lowest = -(2**63)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    base = base.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(lowest)))
    n = min(10_000, 4 * partitions(docs.sparkSession))
    share = [i / n for i in range(1, n)]
    first, found = base.agg(F.min("key"), F.percentile_approx("key", share, 10 * n)).first()
    bounds = sorted(set(found or ()) - {first})
    last = len(bounds)

    rows = base.withColumn("pieces", leaves(F.col("text")))
    rows = rows.select("id", "key", "text", merkle(F.col("pieces")).alias("tree"))
    part = bucket_of(F.col("key"), bounds, "bigint")
    opens = F.col("key").isin(bounds) if last <= 32 else F.array_contains(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), F.col("key"))
    home = F.struct(part.alias("part"), F.lit(False).alias("guest"))
    before = F.struct(F.when(F.col("key") == F.lit(first), F.lit(last)).otherwise(part - 1).alias("part"), F.lit(True).alias("guest"))
    at_start = (F.col("key") == F.lit(first)) | opens if first is not None else F.lit(False)
    rows = rows.withColumn("at", F.explode(F.when(at_start, F.array(home, before)).otherwise(F.array(home))))
    order = Window.partitionBy("at.part").orderBy("at.guest", "key", F.xxhash64("text"))
    following = F.lead(F.struct("text", "tree")).over(order)
    rows = rows.withColumn("next", following).filter("not at.guest")

    n_chars, edit = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - edit), F.substring(F.col("next.text"), F.lit(1), edit))
    rows = rows.select("id", "text", "tree", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), F.col("next.tree").alias("next_tree"))
    rows = rows.withColumn("pieces", leaves(F.col("edited"))).withColumn("edited_tree", merkle(F.col("pieces")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "text",
        "edited",
        "tree",
        "edited_tree",
        changed(F.col("edited_tree.sections"), F.col("tree.sections")).alias("edited_sections"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )
