"""Nested markup to a tree of text blocks and their reading order, in DataFrame functions.

A page's markup is cut into tokens by one regular expression. Depth is a sum over the tokens so far: containers open and
close a level. The container of level L that a block lies in is the last one of that level before it, so that one sort by
page gives all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import lines
from lexloom.session import kept

#: Comments, declarations, scripts and styles, tags, text; a lone < is text.
TOKEN = r"(?is)<!--.*?-->|<![a-z][^>]*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>|[^<]+|<"
#: Elements that nest, and those that only end a block. All others stand within a line.
CONTAINERS = "html head body title nav header main article section aside footer div ul ol li table tr td th h1 h2 h3 h4 h5 h6 blockquote form".split()
BREAKS = ["p", "br", "hr"]
#: Columns of a page by the container that a block lies in: (from, to) of a width of 600; others are the left column.
LAYOUT = {"nav": (0, 600), "header": (0, 600), "title": (0, 600), "footer": (0, 600), "aside": (310, 600), "div": (310, 600)}
LEFT, WIDTH = (0, 290), 600


def tokens(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, pos, tag, kind, piece): kind is open, close, break, text or none; tag is in lower case."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(markup), F.lit(TOKEN), F.lit(0))).alias("pos", "piece"))
    tag = F.lower(F.regexp_extract("piece", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    closes, selfish = F.startswith("piece", F.lit("</")), F.endswith("piece", F.lit("/>"))
    markup_piece = F.regexp_like("piece", F.lit("^<[!/a-zA-Z]"))
    kind = (
        F.when(~markup_piece, "text").when(tag.isin("script", "style") | (tag == ""), "none").when(tag.isin(*BREAKS), "break")
        .when(tag.isin(*CONTAINERS), F.when(closes, "close").when(selfish, "break").otherwise("open")).otherwise("none")
    )
    return each.select(key, "pos", tag.alias("tag"), kind.alias("kind"), F.when(kind == "text", F.col("piece")).alias("piece"))


def block_tree(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, block, depth, path, text): the text blocks of pages, numbered in the order of the markup, with open containers.

    A closing tag ends the innermost open container, whatever its name; where none is open, nothing. What is never closed
    stays open. Entities are decoded once, blanks collapsed; blocks without text are left out. Null markup has no blocks.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    edge = F.when(F.col("kind").isin("open", "close", "break"), 1).otherwise(0)
    run = tokens(pages, key, markup).withColumn("level", F.sum(step).over(w))
    # a close that has nothing to end lifts all that follows
    run = run.withColumn("depth", F.col("level") - F.least(F.lit(0), F.min("level").over(w))).withColumn("block", F.sum(edge).over(w))
    run = kept(run.drop("level"), "tokens")
    deepest = run.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    at = [F.when(F.col("depth") >= d, F.last(F.when((F.col("kind") == "open") & (F.col("depth") == d), F.col("tag")), ignorenulls=True).over(w)) for d in range(1, deepest + 1)]
    path = F.concat_ws("/", *at) if at else F.lit("")
    text = run.withColumn("path", path).where(F.col("kind") == "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    blocks = text.groupBy(key, "block").agg(F.first("depth").alias("depth"), F.first("path").alias("path"), joined.alias("text"))
    return blocks.withColumn("text", F.trim(F.regexp_replace(T.unescape("text"), "[\\s\\u00A0]+", " "))).where("text <> ''").select(key, "block", F.col("depth").cast("int").alias("depth"), "path", "text")


def placed(blocks: DataFrame, layout: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Add width, x_min, x_max and y_min to blocks of ``block_tree``, as a style sheet would: by the innermost container of ``layout``."""
    layout = LAYOUT if layout is None else layout
    names = F.filter(F.split("path", "/"), lambda x: x.isin(*layout))
    inner = F.try_element_at(names, F.lit(-1))

    def side(i: int) -> Column:
        out = F.lit(LEFT[i])
        for name, extent in layout.items():
            out = F.when(inner == name, F.lit(extent[i])).otherwise(out)
        return out.cast("double")

    return blocks.withColumns({"width": F.lit(float(WIDTH)), "x_min": side(0), "x_max": side(1), "y_min": F.col("block").cast("double")})


def reading_text(blocks: DataFrame, key: str) -> DataFrame:
    """(key, n_blocks, text): a page's blocks in reading order, one a line. blocks: as of ``placed``."""
    ordered = lines.reading_order(blocks, [key])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
    return ordered.groupBy(key).agg(F.count(F.lit(1)).alias("n_blocks"), joined.alias("text"))
