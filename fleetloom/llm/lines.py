"""Line de-duplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.textops import free_name
from fleetloom.session import cut_lineage

#: A line on more than this share of its site's distinct texts is boilerplate, if at least so many of them carry it.
MOST_SHARE = 0.1
LEAST_PAGES = 5
#: A page of which more than this share of characters is in such lines is a copy of others rather than a page with
#: boilerplate: it keeps them.
MOST_OF_PAGE = 0.5


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate_lines(docs: DataFrame, most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES, site: str = "source") -> DataFrame:
    """(site, drop) as a written table: the keys of the lines that are boilerplate on each site that has some.

    A line is what stands between newlines, compared without white space at its ends; blank lines never count. Pages of
    equal text are one page of their site, and a line counts once a page. A null site is a site of its own; a null text
    is the empty one.

    Distinct texts are found by their keys, and each of n equal texts weighs 1/n, so texts and lines never travel and
    copies need no representative: what sums up for a line is a whole number but for rounding. Sites and lines are counted
    by partial sums, so neither a site with most of the pages nor a line on most of its pages is gathered anywhere. A
    site has at most (lines a page / share) such lines, which bounds its list. A 96-bit key stands for a line or text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.transform(F.split(text, "\n"), _trimmed)
    keys = F.array_distinct(F.transform(F.filter(trimmed, lambda x: x != ""), _key))
    pages = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"), _key(text).alias("page"), keys.alias("keys"))
    texts = cut_lineage(pages.groupBy("site", "page").agg(F.count(F.lit(1)).alias("copies")))
    totals = texts.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    held = pages.join(texts.where("copies > 1"), ["site", "page"], "left").select("site", F.explode("keys").alias("key"), (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    counts = held.groupBy("site", "key").agg(F.round(F.sum("weight")).cast("long").alias("carrying")).where(F.col("carrying") >= least_pages)
    common = counts.join(totals, "site").where(F.col("carrying") > F.lit(most_share) * F.col("pages"))
    return cut_lineage(common.groupBy("site").agg(F.collect_set("key").alias("drop")))


def drop_boilerplate(docs: DataFrame, most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES, site: str = "source", most_of_page: float = MOST_OF_PAGE) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; added are ``_lines`` and ``_dropped`` counts.

    What is boilerplate tells :func:`boilerplate_lines`. Whole lines go, the others keep their bytes and order. A text that
    loses nothing is unchanged, a null stays null with no lines. A page whose boilerplate lines hold more than
    ``most_of_page`` of the characters of its lines (without white space at their ends) is what near copies of a text look
    like, and keeps them all, so a text that was copied is never emptied. Repeated rows are treated alike. All other
    columns are handed through; the two new ones have an underscore more where ``docs`` has such a name.
    """
    common = boilerplate_lines(docs, most_share, least_pages, site)
    # the columns stay one struct, so that none of their names can clash
    pages = docs.select(F.struct(*docs.columns).alias("doc")).select(
        "doc", F.coalesce(F.col(f"doc.`{site}`").cast("string"), F.lit("\0")).alias("site"), F.split(F.col("doc.text").cast("string"), "\n").alias("lines")
    )
    # Spark picks the join by the size of the table; only pages of sites with boilerplate look at their lines
    flagged = pages.join(common, "site", "left").withColumn("trimmed", F.when(F.col("drop").isNotNull(), F.transform("lines", _trimmed)))
    gone = F.transform("trimmed", lambda x: (x != "") & F.array_contains(F.col("drop"), _key(x)))
    size = lambda chosen: F.aggregate(chosen, F.lit(0), lambda total, x: total + F.char_length(x))
    lost = size(F.filter("trimmed", lambda x, i: F.get("gone", i)))
    flagged = flagged.withColumn("gone", gone).withColumn("copied", F.coalesce(lost > F.lit(most_of_page) * size(F.col("trimmed")), F.lit(True)))
    kept = F.when(F.col("copied"), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.get("gone", i)))
    out = flagged.select("doc", "lines", kept.alias("kept"))
    columns = [F.when(F.col("lines").isNotNull(), F.array_join("kept", "\n")).alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    n_lines, n_kept = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("kept"), F.lit(0))
    return out.select(*columns, n_lines.alias(free_name("_lines", docs.columns)), (n_lines - n_kept).alias(free_name("_dropped", docs.columns)))
