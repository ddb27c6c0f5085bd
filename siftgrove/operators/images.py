"""Images of pages: stored records, replacement per page, known contents, file names, images of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

PER_PAGE = 12


def records(images: DataFrame) -> DataFrame:
    """Image rows with the defaults of the store: empty texts, zero sizes, format ``unknown``, ratio from the sizes."""
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    width, height = zero("width"), zero("height")
    known = F.lower(F.trim(F.coalesce("img_format", F.lit(""))))
    ratio = F.when(height > 0, F.round(width / height, 4)).otherwise(0.0)
    return images.select("image_id", "doc_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("alt", F.lit("")).alias("alt"), width.alias("width"), height.alias("height"), F.when(known == "", "unknown").when(known == "jpg", "jpeg").otherwise(known).alias("img_format"), zero("size_bytes").alias("size_bytes"), ratio.alias("aspect_ratio"))


def replaced(stored: DataFrame, fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """The image store after the images of some pages were read anew: their old rows go, also where nothing new came."""
    return stored.join(pages.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh.join(pages.select("doc_id").distinct(), "doc_id", "left_semi"))


def unknown(images: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Images whose content (or address) isn't stored yet; an empty key is never known."""
    return images.join(known.filter(F.col(key) != "").select(key).distinct(), key, "left_anti")


def first_of_page(images: DataFrame, limit: int = PER_PAGE) -> DataFrame:
    """At most ``limit`` images of each page, by id; cut in every task before the shuffle."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("image_id"))
    return images.filter("doc_id is not null").withColumn("at", at).filter(F.col("at") <= limit).drop("at")


def extension(img_format: Column, url: Column) -> Column:
    """File name ending: the format, else that of the address' path, else ``bin``."""
    known = F.lower(F.coalesce(img_format, F.lit("")))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    ending = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.when((known != "") & (known != "unknown"), known).when(ending != "", ending).otherwise(F.lit("bin"))


def of_results(images: DataFrame, results: DataFrame, documents: DataFrame, per_page: int = 3) -> DataFrame:
    """(rank, doc_id, image_id, url, site): images of search results, a few of each page, in rank order."""
    few = first_of_page(images.join(F.broadcast(results.select("doc_id", "rank")), "doc_id").filter("url is not null"), per_page)
    sites = documents.join(F.broadcast(results.select("doc_id")), "doc_id", "left_semi").select("doc_id", urls.netloc(F.col("url")).alias("site"))
    return few.select("rank", "doc_id", "image_id", "url").join(F.broadcast(sites), "doc_id").select("rank", "doc_id", "image_id", "url", "site")
