"""Elements of HTML as intervals of a tag stream, and what hidden ones hold, as rows and without Python.

One stage reads the pages and gives a row for each tag: its place in the stream, its name, whether it begins or ends,
and how much text stands before it. All else are windows over the tags of a page, which one exchange brings together:
a level of its own for every name pairs start and end tags by (level, order), and what an element holds is the
difference of two running sums, so every ancestor counts the text below it and no element is joined to its texts.

Void elements hold nothing. An end tag without a start counts for nothing. An element without an end tag reaches to
the end of the element around it, or of the page; a paragraph also ends where a block begins, and list items, cells,
rows, terms and options where the next of their kind does. Scripts, styles and comments are no text; one that is not
closed takes the rest of the page. Text is counted in UTF-16 units besides white space;
references count as they are written. Attributes end at the next angle bracket. Elements that
overlap keep their own ends. Null pages have no elements, and rows of one id stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.functions.rules import pattern
from quillward.operators.places import units

#: Tokens of the stream: raw elements and comments with all they hold, and tags.
TOKEN = r"(?is)<script\b[^<>]*>(?:.*?</script\s*>|.*\z)|<style\b[^<>]*>(?:.*?</style\s*>|.*\z)|<!--(?:.*?-->|.*\z)|</?[a-z][^<>]*>"
NAME = r"^</?([a-zA-Z][^\s/>]*)"
#: Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "script", "style"]
#: Start tags that end an open paragraph.
BLOCKS = ["address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"]
#: Elements that end without an end tag, and the start tags that end them.
ENDED = {"p": BLOCKS, "li": ["li"], "option": ["option"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "dt": ["dt", "dd"], "dd": ["dt", "dd"]}
#: White space, a non-breaking space by reference too.
BLANK = r"[ \t\n\f\r]+|&nbsp;|&#160;"
STYLE = r"(?i)\sstyle\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
HIDDEN = r"(?i)\shidden[\s=/>]"
QUOTED = r"\"[^\"]*\"|'[^']*'"
FRONT, BACK = r"(?:^|;)\s*color\s*:\s*([^;]+)", r"background(?:-color)?\s*:\s*([^;]+)"


def inked(text: Column) -> Column:
    """Units of a text besides white space."""
    return units(F.regexp_replace(text, BLANK, ""))


def tags(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(rid, id, k, delta, name, tag, text) of every tag: delta is 1, -1 or 0 for void elements, scripts and comments; text is
    what stands before it. A row behind the last tag has no name. tag is kept where it may hide something."""
    own = pages.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("html"))
    pair = F.zip_with(F.split("html", TOKEN, -1), F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)), lambda gap, tag: F.struct(inked(gap).alias("text"), tag.alias("tag")))
    rows = own.select("rid", "id", F.posexplode(pair).alias("k", "t")).select("rid", "id", "k", "t.*")
    name = F.coalesce(F.lower(F.regexp_extract("tag", NAME, 1)), F.lit(""))
    ends = F.col("tag").startswith("</")
    delta = F.when((F.col("name") == "") | F.col("name").isin(VOID), 0).when(ends, -1).otherwise(1)
    hides = ~ends & (F.col("tag").rlike(STYLE) | F.col("tag").rlike(HIDDEN))
    rows = rows.withColumn("name", name).withColumn("delta", delta)
    return rows.select("rid", "id", "k", "delta", "name", F.when(hides, F.col("tag")).alias("tag"), "text").repartition("rid")


def elements(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(rid, id, k, name, tag, depth, text_len) of every element of pages: depth counts the elements with both tags
    around it and itself, text_len is the text that it holds."""
    page = Window.partitionBy("rid").orderBy("k")
    to, after = page.rowsBetween(Window.unboundedPreceding, 0), page.rowsBetween(1, Window.unboundedFollowing)
    rows = tags(pages, id_col, text_col).withColumn("text", F.sum("text").over(to))
    # A level for every name, which no end tag takes below zero.
    same = Window.partitionBy("rid", "name").orderBy("k")
    rows = rows.withColumn("_sum", F.sum("delta").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_level", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(same.rowsBetween(Window.unboundedPreceding, 0))))
    before = F.coalesce(F.lag("_level").over(same), F.lit(0))
    rows = rows.withColumn("_at", F.when(F.col("delta") > 0, F.col("_level")).when((F.col("delta") < 0) & (before > 0), before))
    pair = Window.partitionBy("rid", "name", "_at").orderBy("k")
    here = F.struct("k", "text")
    known = F.col("_at").isNotNull()
    rows = rows.withColumn("_end", F.when(known & (F.col("delta") > 0) & (F.lead("delta").over(pair) < 0), F.lead(here).over(pair)))
    rows = rows.withColumn("_closed", F.when(known & (F.col("delta") < 0), True).otherwise(F.col("_end").isNotNull()))
    # Where an element without end tag ends: with the element around it, by the level of those that have one.
    rows = rows.withColumn("depth", F.coalesce(F.sum(F.when(F.col("_closed"), F.col("delta"))).over(to), F.lit(0)))
    ends = F.col("_closed") & (F.col("delta") < 0)
    rows = rows.withColumn("_in", F.when(ends, F.col("depth") + 1).otherwise(F.col("depth")))
    outer = F.first(F.when(ends, here), ignorenulls=True).over(Window.partitionBy("rid", "_in").orderBy("k").rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("_outer", F.when(F.col("_in") > 0, outer))
    starts = F.col("delta") > 0
    begins = starts | F.col("name").isin("hr")
    next_of = F.lit(None).cast("struct<k:int,text:bigint>")
    for name, by in ENDED.items():
        next_of = F.when(F.col("name") == name, F.first(F.when(begins & F.col("name").isin(by), here), ignorenulls=True).over(after)).otherwise(next_of)
    last = F.max(here).over(Window.partitionBy("rid"))
    rows = rows.withColumn("_next", next_of).withColumn("_last", last)
    open_end = F.least("_outer", "_next", "_last")  # nulls do not count
    end = F.when(F.col("name") == "p", F.least("_end", "_next", F.when(F.col("_end").isNull(), open_end))).otherwise(F.coalesce("_end", open_end))
    depth = F.col("depth") + F.when(F.col("_end").isNull(), 1).otherwise(0)
    return rows.where(starts).select("rid", "id", "k", "name", "tag", depth.cast("int").alias("depth"), (end["text"] - F.col("text")).alias("text_len"))


def techniques(tag: Column) -> Column:
    """How a start tag hides its element: the style rules in order, the attribute, letters in the colour behind them."""
    style = F.concat(*[F.coalesce(F.regexp_extract(tag, STYLE, k), F.lit("")) for k in (1, 2, 3)])

    def found(s):
        hits = [F.when(s.rlike(pattern(p)), t) for p, t in rules.ELEMENT_STYLES]
        hits.append(F.when(F.regexp_replace(tag, QUOTED, "").rlike(HIDDEN), "hidden attribute"))
        front, back = (F.lower(F.trim(F.regexp_extract(s, pattern(p), 1))) for p in (FRONT, BACK))
        hits.append(F.when((front != "") & (front == back), F.concat(F.lit("Same fg/bg color ("), front, F.lit(")"))))
        return F.array_compact(F.array(*hits))

    return F.element_at(F.transform(F.array(style), found), 1)


def hidden(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(id, element, technique, text_len) of every hidden element that holds text, once for each technique."""
    rows = elements(pages, id_col, text_col).where("tag is not null and text_len > 0")
    return rows.select("id", F.col("name").alias("element"), F.explode(techniques(F.col("tag"))).alias("technique"), "text_len")
