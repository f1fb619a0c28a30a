"""Records straight from listing pages: by rules, or by a caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions import text as X
from ..functions.page_structure import entries_of
from ..functions.urls import resolve
from ..spec import RecordSpec


def listing_rows(pages: DataFrame) -> DataFrame:
    """Candidate rows: every list item or table row that holds a link or email.

    A rule stand-in for a model: url, pos, name (link text), profile_url, email,
    title prefix and whether the text names an included role.
    """
    blocks = pages.select(
        "url", F.posexplode(H.listing_blocks(H.clean("html"))).alias("pos", "_block")
    )
    rows = blocks.select(
        "url",
        F.col("pos").cast("bigint").alias("pos"),
        F.regexp_extract("_block", r'(?i)<a\s[^>]*href="([^"]*)"', 1).alias("_href"),
        X.strip(
            F.regexp_replace(
                F.regexp_extract("_block", r"(?is)<a(?:\s[^>]*)?>(.*?)</a>", 1), "<[^>]+>", " "
            )
        ).alias("name"),
        X.strip(H.visible_text("_block")).alias("_text"),
    )
    email = F.try_element_at(X.emails_in(X.deobfuscate_emails("_text")), F.lit(1))
    return (
        rows.withColumn("email", email)
        .where((F.col("_href") != "") | F.col("email").isNotNull())
        .select(
            "url",
            "pos",
            "name",
            F.when(F.col("_href") != "", resolve("url", "_href")).alias("profile_url"),
            "email",
            X.title_prefix("_text").alias("title"),
            X.has_included_role("_text").alias("is_academic_role"),
        )
    )


def records_mined(pages: DataFrame, min_repeats: int = 3) -> DataFrame:
    """Candidate rows from repeated structure: cards, lists in lists, terms, table rows.

    An entry is what stands ``min_repeats`` times at the same path of tags and classes of a
    page (see ``page_structure.entries_of``). Columns as in ``listing_rows``, and the
    text; ``name`` is that of its first link to a page, or else its first piece of text
    up to a comma or an address. Pages are parsed where they are read, without a shuffle; NULL pages have
    no entries.
    """

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (url, pos, *entry)
                for url, html in zip(batch["url"], batch["html"], strict=True)
                for pos, entry in enumerate(entries_of(html, min_repeats))
            ]
            yield pd.DataFrame(rows, columns=["url", "pos", "_name", "_href", "_mail", "text"])

    schema = "url string, pos bigint, _name string, _href string, _mail string, text string"
    rows = pages.where("html is not null").select("url", "html").mapInPandas(mine, schema)
    written = F.try_element_at(X.emails_in(X.deobfuscate_emails("text")), F.lit(1))
    name = F.regexp_replace("_name", r"(?s)[,:;|].*|\S+@.*", "")
    return rows.select(
        "url",
        "pos",
        X.strip(name).alias("name"),
        F.when(F.col("_href") != "", resolve("url", "_href")).alias("profile_url"),
        F.when(F.col("_mail") != "", F.lower("_mail")).otherwise(written).alias("email"),
        X.title_prefix("text").alias("title"),
        X.has_included_role("text").alias("is_academic_role"),
        "text",
    )



Extractor = Callable[[str, str], Iterable[dict[str, str | None]]]


def extract_records(
    pages: DataFrame,
    spec: RecordSpec,
    extractor: Extractor,
    max_tasks: int | None = None,
) -> DataFrame:
    """Run a caller's ``extractor(url, html)`` over pages, batch by batch.

    It yields one dict per record, keyed by column name. ``max_tasks`` bounds
    how many run at once, for extractors that call a limited service. Pages are
    read in whole; each Python batch is an Arrow batch of its partition.
    """
    names = [c.name for c in spec.extractable()]
    schema = T.StructType(
        [T.StructField("url", T.StringType()), T.StructField("pos", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in (*names, "profile_url")]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                {"url": url, "pos": pos, **{n: rec.get(n) for n in (*names, "profile_url")}}
                for url, html in zip(batch["url"], batch["html"], strict=True)
                for pos, rec in enumerate(extractor(url, html))
            ]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    source = pages.select("url", "html")
    if max_tasks is not None:
        source = source.repartition(max_tasks)
    return source.mapInPandas(run, schema)
