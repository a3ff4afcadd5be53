"""Line dedup by site-relative frequency, in DataFrame operations only.

The pages of a site are counted, and for each of its lines the pages that contain
it.  A line whose share of its site's pages exceeds ``max_ratio`` is boilerplate and
is dropped from every page of that site.

Lines are laid out once, as rows with two 64-bit hashes; only hashes are shuffled, counted
per site before the shuffle.  Each row meets the boilerplate of its site in a hash join,
and the places of the lines that go are gathered per text, sorted.  From them a mark for
every line is laid out, place by place, and lines and marks are walked together: texts
are cut where they lie, in time that grows with their lines.

Defined cases: lines are what LF separates; a line is compared without the white
space around it, and blank lines are never dropped; null text has no lines and stays
null; null is a site of its own; a line found on fewer than ``min_pages`` pages of a
site is never boilerplate; equal rows are pages of their own and get equal results; an
empty table gives an empty result; columns of any name keep their values: where ``pages``
has an ``n_lines`` or ``n_dropped`` itself, the count is named with a ``_`` after it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwright.functions.naming import unused
from leakwright.sources.shared_tables import stash

#: So many boilerplate lines, and texts that lose lines, are broadcast at most; more are joined.
BROADCAST_LINES, BROADCAST_TEXTS = 500_000, 100_000
#: Tags of HTML that begin or end a line.
BLOCK_TAGS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|meta|nav|ol|p|script|section|style|table|td|th|title|tr|ul)(?:[ /][^>]*)?>"
_BLANK = " \t\x0b\f\r"


def host_of(url: Column) -> Column:
    """The lower-cased host of an url, empty without one: a site key for web pages."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))


def html_lines(html: Column) -> Column:
    """Text of a page with a line feed in place of each block tag; other tags stay in their lines."""
    return F.regexp_replace(html, BLOCK_TAGS, "\n")


def _bare(line: Column) -> Column:
    """A line without the white space around it.  Most have none, which their first and last bytes tell."""
    ends = reduce(or_, [at(blank) for blank in _BLANK for at in (line.startswith, line.endswith)])
    return F.when(ends, F.trim(line, F.lit(_BLANK))).otherwise(line)


def _site(site: Column) -> Column:
    return F.when(site.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), site.cast("string")))


def _marks() -> list[Column]:
    return [F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")]


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """``(site, a, b)``: the hashes of the boilerplate lines of each site of ``(site, text)``, as a written table."""
    bare = F.transform(F.filter(F.split("text", "\n"), lambda line: line != ""), _bare)
    lines = pages.select("site", F.explode(F.array_distinct(bare)).alias("line")).where("line <> ''")
    counts = lines.select("site", *_marks()).groupBy("site", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = stash(pages.groupBy("site").agg(F.count("*").alias("pages")), "totals")
    return stash(counts.join(totals, "site").where(F.col("n") > F.col("pages") * F.lit(max_ratio)).select("site", "a", "b"), "boilerplate")


def without_places(lines: Column, gone: Column) -> Column:
    """An array without the places, ascending from 0, of a second array; each of them is read once."""
    size = F.size(lines)
    before = F.concat(F.array(F.lit(-1)), gone)
    marks = F.flatten(F.zip_with(before, F.concat(gone, F.array(size)), lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False)))))
    return F.filter(F.zip_with(lines, marks, lambda line, stays: F.when(stays, line)), lambda line: line.isNotNull())


def _sized(small: DataFrame, most: int) -> DataFrame:
    return F.broadcast(small) if small.count() <= most else small


def drop_boilerplate(pages: DataFrame, site: Column | str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """``pages`` with ``text`` free of boilerplate, and the counts ``n_lines`` and ``n_dropped`` added."""
    site = _site(F.col(site) if isinstance(site, str) else site)
    text = F.col(text_col)
    slim = pages.select(site.alias("site"), text.alias("text"))
    found = boilerplate(slim, max_ratio, min_pages)
    # Texts go by two hashes of site and text: equal ones lose equal lines.
    name = [F.xxhash64("site", "text").alias("k1"), F.xxhash64(F.lit(1), "site", "text").alias("k2")]
    lines = slim.select("site", *name, F.posexplode(F.split("text", "\n")).alias("place", "line")).where("line <> ''")
    hits = lines.withColumn("line", _bare(F.col("line"))).select("site", "k1", "k2", "place", *_marks()).join(_sized(found, BROADCAST_LINES), ["site", "a", "b"], "left_semi")
    gone = stash(hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("place")).alias("gone")), "gone")
    # Other columns travel by number, apart from those of this step; the text travels once.
    others = {c: f"c{i}" for i, c in enumerate(pages.columns) if c != text_col}
    rows = pages.select(F.struct("*").alias("row"), site.alias("site"), text.alias("text")).select(*(F.col("row").getField(c).alias(n) for c, n in others.items()), "text", *name)
    # A text is split once, in a step of its own, for the lines that stay and for their number.
    joined = rows.join(_sized(gone, BROADCAST_TEXTS), ["k1", "k2"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(without_places(F.col("lines"), F.col("gone")), "\n"))
    n_lines, n_dropped = unused(pages.columns, "n_lines", "n_dropped")
    rest = [F.col(others[c]).alias(c) if c in others else kept.alias(c) for c in pages.columns]
    return joined.select(*rest, F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias(n_lines), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias(n_dropped))
