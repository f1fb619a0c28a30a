"""Links: extraction, host filter and page series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import html as H
from ..functions import urls as U

SERIES_BUCKET = 4096


def page_links(pages: DataFrame) -> DataFrame:
    """(src, pos, href, dst) for every anchor; dst is absolute or NULL."""
    return pages.select(
        F.col("url").alias("src"), F.posexplode(H.hrefs("html")).alias("pos", "href")
    ).select(
        "src", F.col("pos").cast("bigint").alias("pos"), "href", U.resolve("src", "href").alias("dst")
    )


def allowed_urls(df: DataFrame, url: str = "url", mode: str = "host") -> DataFrame:
    """Drop URLs on blocked hosts; ``mode="substring"`` searches the whole URL."""
    return df.where(~U.on_host(url, fv.BLOCKED_HOSTS, mode))


_SERIES = (
    r"([^#]*[?&]page=)(\d{1,18})((?:[&#].*)?)",
    r"([^?#]*/page/)(\d{1,18})((?:[/?#].*)?)",
    r"([^?#]*/)(\d{1,18})((?:/|\.html)?(?:[?#].*)?)",
    r"([^?#]*/)([A-Z])((?:/|\.html)(?:[?#].*)?)",
)
_CUT = "\u0001"


def series_place(url: Column | str) -> Column:
    """Array with the (template, seq) of a URL in a series, else empty.

    The first form that fits counts: ``page=N``, ``/page/N``, a last path
    segment N, a last path segment of one capital letter; ``{}`` stands for the
    number or letter. All forms are one pattern, matched once per URL.
    """
    url = F.col(url) if isinstance(url, str) else url
    groups = [[f"${3 * i + part}" for i in range(len(_SERIES))] for part in (1, 2, 3)]
    marked = F.regexp_replace(
        url, "^(?:" + "|".join(_SERIES) + ")$", _CUT.join("".join(g) for g in groups)
    )

    def place(parts: Column) -> Column:
        letter = F.ascii(parts[1]).cast("bigint") - ord("A") + 1
        return F.struct(
            F.concat(parts[0], F.lit("{}"), parts[2]).alias("template"),
            F.coalesce(parts[1].try_cast("bigint"), letter).alias("seq"),
        )

    cut = F.filter(F.array(F.split(marked, _CUT)), lambda parts: F.size(parts) == 3)
    return F.transform(cut, place)


def pagination_series(urls: DataFrame, bucket: int = SERIES_BUCKET) -> DataFrame:
    """Successor of every page inside its series, with the gap to it.

    One series may hold a large part of all pages, so a series is cut into
    buckets of sequence numbers. Successors are found inside the buckets, and
    only the last page of a bucket looks at the first page of the next one. Numbers
    aren't negative, so the first pages of buckets after 0 are all that is looked
    at: short series, however many, give none. URLs are matched and shuffled once.
    """
    placed = (
        urls.select("url", F.inline(series_place("url")))
        .withColumn("_bucket", F.floor(F.col("seq") / bucket))
        # what the join below would ask of one of the two uses, which share the shuffle
        .where("template is not null and _bucket is not null")
        .repartition("template", "_bucket")
    )
    this = F.struct("seq", "url")
    inside = W.partitionBy("template", "_bucket").orderBy("seq", "url")
    # repeats of a URL follow each other in the order that its successor needs anyway
    pages = placed.withColumn("_same", F.lag("url").over(inside)).where("_same is null or _same <> url").drop("_same")
    firsts = (
        placed.groupBy("template", "_bucket")
        .agg(F.min(F.when(F.col("_bucket") > 0, this)).alias("_next_head"))
        .where("_next_head is not null")
    )
    before = F.lag("_bucket").over(W.partitionBy("template").orderBy("_bucket"))
    heads = firsts.select("template", F.coalesce(before, F.lit(0)).alias("_bucket"), "_next_head")
    return (
        pages.withColumn("_in", F.lead(this).over(inside))
        .join(heads, ["template", "_bucket"], "left")
        .withColumn("_next", F.coalesce("_in", "_next_head"))
        .select(
            "url",
            "template",
            "seq",
            F.col("_next.url").alias("next_url"),
            (F.col("_next.seq") - F.col("seq") - 1).alias("gap"),
            F.col("_next").isNull().alias("is_last"),
        )
    )
