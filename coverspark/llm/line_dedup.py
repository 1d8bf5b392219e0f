"""Line deduplication by site-relative frequency, with DataFrame functions only.

For each host, the number of its pages that contain a line is divided by its page total; lines whose ratio exceeds the
limit are the host's boilerplate and are dropped from all of its pages.

Pages are counted before anything moves.  A host's boilerplate is bounded by its lines a page over the ratio, so it
travels to the pages: the whole table is sent to all executors while it has at most ``FEW`` lines, counted first; beyond
that pages and boilerplate are joined by host and a salt, so that no host is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverspark.llm.common import cut, partitions, text_of

#: So many boilerplate lines (a host's name and a digest of 32 characters each) are sent to the executors whole.
FEW = 200_000


def _host(column: str) -> Column:
    """The host, and a mark for pages without one, which are a host of their own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\0"))


def site_lines(pages: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int, distinct_pages: bool) -> DataFrame:
    """host and line (digest) of every boilerplate line."""
    digests = F.array_distinct(F.transform(F.filter(F.split(text_of(text_col), "\n"), lambda x: F.trim(x) != ""), F.md5))
    base = pages.select(_host(host_col).alias("host"), digests.alias("seen"), *([F.md5(text_of(text_col)).alias("page")] if distinct_pages else []))
    own = base.columns[2:]
    held = base.select("host", *own, F.explode("seen").alias("line"))
    if distinct_pages:
        base, held = base.select("host", *own).distinct(), held.distinct()
    totals = base.groupBy("host").agg(F.count("*").alias("pages"))
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return counts.join(totals, "host").filter(F.col("n") / F.col("pages") > max_ratio).select("host", "line")


def drop_site_lines(
    pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.02, min_pages: int = 2, distinct_pages: bool = False, few: int = FEW
) -> DataFrame:
    """The input's rows and columns, with boilerplate lines gone from the text, plus ``n_lines`` and ``n_dropped``.

    A line is boilerplate on its host if at least ``min_pages`` pages and more than ``max_ratio`` of the host's pages
    contain it; repeated rows are pages each.  With ``distinct_pages`` pages of one text (by md5) count once, where
    copies of whole pages should say nothing about their lines.  Lines of white space only stay.  A null host is a host
    of its own; a null text stays null with no lines, and counts as an empty page; a text that loses all its lines
    becomes empty.  Very long texts are read whole, and an empty table gives no rows.  Input columns that are called
    n_lines or n_dropped are replaced; other extra columns pass unchanged.
    """
    found = cut(site_lines(pages, host_col, text_col, max_ratio, min_pages, distinct_pages))
    bad = found.groupBy("host").agg(F.collect_list("line").alias("bad"))
    rows = pages.select(F.struct("*").alias("row"), _host(host_col).alias("host"))
    if found.count() <= few:
        rows = rows.join(F.broadcast(bad), "host", "left")
    else:
        salts = partitions(pages.sparkSession)
        rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        rows = rows.join(bad, ["host", "salt"], "left")
    rows = rows.withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))
    text = F.col("row").getField(text_col)
    rows = rows.withColumn("lines", F.split(text, "\n"))
    rows = rows.withColumn("kept", F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("bad", F.md5(x))))
    own = [
        (F.when(F.size("bad") == 0, text).otherwise(F.array_join("kept", "\n")) if c == text_col else F.col("row").getField(c)).alias(c)
        for c in pages.columns
        if c not in ("n_lines", "n_dropped")
    ]
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return rows.select(*own, count("lines").alias("n_lines"), (count("lines") - count("kept")).alias("n_dropped"))
