"""An outline of web pages by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outline(pages: DataFrame) -> DataFrame:
    """Title, language, links and paragraphs of each page (page_id, html)."""
    h = F.col("html")
    n = lambda p: F.size(F.regexp_extract_all(h, F.lit(f"({p})"), 1)).cast("long")
    return pages.select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), n("<a ").alias("n_links"), n("<p>").alias("n_paragraphs"), F.regexp_extract(h, 'lang="([a-z]+)"', 1).alias("lang"))
