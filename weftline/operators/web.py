"""Web pages: main text, titles and normalised addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entities that are decoded, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def main_text(html: Column) -> Column:
    """The text without scripts, styles, navigation, comments and tags; blocks end lines, entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|noscript)\b.*?</(script|style|nav|header|footer|noscript)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/h[1-6]|/li|/div|/tr)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for entity, character in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(character))
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, host, url (scheme and host in lower case, no fragment, no final slash), title, text."""
    low = F.concat(F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1))
    return pages.select("page_id", F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)).alias("host"), F.regexp_replace(low, "/$", "").alias("url"), title(F.col("html")).alias("title"), main_text(F.col("html")).alias("text"))
