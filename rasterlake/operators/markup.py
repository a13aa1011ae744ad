"""SVG text as a relation of tokens: depth by running sums, subtrees removed by a segmented scan.

A document is split into tokens by one expression, a token a row. The depth of a tag is the
running sum of opened and closed elements; tags of one level and document alternate, so a
closing tag is checked against the one before it at its level; a token is inside a dropped
subtree where more such elements have opened up to it than closed before it. What is
kept is put together again in order. No Python runs in any of it; a document's tokens meet in
one task, documents are spread by key.

Defined results: a null text gives a null text and no error; an empty one stays empty; text
that no token matches, closing tags that don't fit and elements left open are ``Parse``
errors with a null text; keys are unique; other columns are dropped. Compressed
documents are expanded before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Comments, CDATA, instructions, declarations, tags, text.
TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^\[\]<>"']*+(?:(?:"[^"]*+"|'[^']*+'|\[.*?\])[^\[\]<>"']*+)*+>|<[^"'<>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'<>]*+)*+>|[^<]++"""
#: Elements that carry no picture.
DROPPED = ("metadata", "desc", "title")


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, at, token, kind, name, level): every token in order; kind is open, close, single, comment, instruction, declaration or text.

    ``level`` is the depth of the element that a tag opens or closes, and of what a token stands in otherwise.
    """
    found = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    t = F.col("token")
    kind = F.when(~t.startswith("<"), "text").when(t.startswith("<!--"), "comment").when(t.startswith("<?"), "instruction").when(t.startswith("<!"), "declaration").when(t.startswith("</"), "close").when(t.endswith("/>"), "single").otherwise("open")
    found = found.withColumn("kind", kind)
    name = F.when(F.col("kind") == "close", F.trim(F.regexp_extract("token", r"(?s)^</(.*)>$", 1))).when(F.col("kind").isin("open", "single"), F.regexp_extract("token", r"^<([^\s/>]*)", 1))
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = F.sum(step).over(upto)
    return found.withColumn("name", name).withColumn("level", (depth + F.when(F.col("kind") == "close", 1).otherwise(0)).cast("int"))


def minify(df: DataFrame, key: str, text: str = "text", comments: bool = True, instructions: bool = True, dropped: tuple[str, ...] = DROPPED, whitespace: bool = True) -> DataFrame:
    """(key, text, error): documents without what the options drop; everything else is kept as written.

    Subtrees of ``dropped`` local names go, self-closing elements of these names stay. Text is
    trimmed at both ends; runs of white space inside stay. The XML declaration stays.
    """
    found = tokens(df.where(F.col(text).isNotNull()), key, text)
    tag = F.col("kind").isin("open", "close")
    before = Window.partitionBy(key, F.when(tag, F.col("level"))).orderBy("at")
    fits = F.when(F.col("kind") == "close", (F.lag("kind").over(before) == "open") & (F.lag("name").over(before) == F.col("name")) & (F.col("level") > 0))
    fits = fits.when(F.col("kind") == "open", F.coalesce(F.lag("kind").over(before) == "close", F.lit(True)))
    found = found.withColumn("_fits", F.coalesce(F.when(tag, F.coalesce(fits, F.lit(False))), F.lit(True)))
    gone = F.element_at(F.split("name", ":"), -1).isin(*dropped) if dropped else F.lit(False)
    own = Window.partitionBy(key).orderBy("at")
    count = lambda kind, last: F.coalesce(F.sum(F.when((F.col("kind") == kind) & gone, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, last)), F.lit(0))
    inside = count("open", 0) > count("close", -1)
    stays = ~inside & ~((F.col("kind") == "comment") & F.lit(comments)) & ~((F.col("kind") == "instruction") & F.lit(instructions) & ~F.col("token").rlike(r"^<\?xml\s"))
    space = F.lit(" \t\r\n")
    written = F.when((F.col("kind") == "text") & F.lit(whitespace), F.trim("token", space)).otherwise(F.col("token"))
    found = found.withColumns({"_stays": stays, "_written": written})
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    whole = found.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_stays"), F.struct("at", "_written")))), lambda x: x["_written"]), "").alias("_text"),
        F.sum(F.length("token")).alias("_length"), F.min("_fits").alias("_good"), F.sum(step).alias("_open"),
    )
    joined = df.select(key, F.col(text).alias("_source")).join(whole, key, "left")
    bad = (F.coalesce("_length", F.lit(0)) != F.length("_source")) | ~F.coalesce("_good", F.lit(True)) | (F.coalesce("_open", F.lit(0)) != 0)
    error = F.when(bad, "Parse")
    return joined.select(key, F.when(F.col("_source").isNotNull() & error.isNull(), F.coalesce("_text", F.lit(""))).alias("text"), error.alias("error"))

