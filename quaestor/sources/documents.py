"""Readers of saved documents as DataFrames. Every schema is given, none inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what stands before the array of sales in a saved result page.
MARKER = r"acsearch\.initSearchResults = \s*"
PAGE_BYTES = 2 * 1024 * 1024
SALE = "array<struct<id:string,title:string,date:string,price:string,description:string>>"
MONEY = "struct<currency:string,minor:bigint>"
SNAPSHOT = f"""schemaVersion int, revision bigint,
lots array<struct<id:string,revision:bigint,title:string,reference:string,lotNumber:string,auctionEventId:string,activeBid:struct<amount:{MONEY},buyerPremiumBps:int>,outcome:struct<status:string,hammer:{MONEY}>>>,
auctionEvents array<struct<id:string,name:string,precision:string,localDate:string,localTime:string,startsAt:string,timeZone:string>>,
collectionEntries array<struct<id:string,lotId:string,title:string,acquisitionDate:string,hammer:{MONEY},actualInvoice:{MONEY}>>,
wants array<struct<id:string,reference:string,maxPrice:{MONEY},foundLotId:string>>, _corrupt string"""


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """JSON roots, one a file; a root that can't be read is kept in _corrupt."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def collection(roots: DataFrame, name: str) -> DataFrame:
    """The rows of one collection of the roots, in order (row_idx)."""
    return roots.select(F.posexplode(name).alias("row_idx", "row")).select("row_idx", "row.*")


def embedded_sales(html: Column, marker: str = MARKER) -> Column:
    """The array of sales that a page holds behind its marker; null if there is none.

    Only the first 2 MiB are read. The JSON reader ends at the array's own end, so brackets
    and '];' inside strings do no harm.
    """
    page = F.substring(html.cast("binary"), 1, PAGE_BYTES).cast("string")
    found = F.regexp_extract(page, rf"(?s){marker}(\[.*)", 1)
    return F.when(found != "", F.from_json(found, SALE))


def result_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each sale embedded in pages, numbered as on the page."""
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.posexplode(embedded_sales(F.col(html))).alias("row_idx", "sale")).select(*keep, "row_idx", "sale.*")


def feed_entries(xml: Column) -> Column:
    """Titles and ids of an Atom feed, in order."""
    plain = F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', "")
    return F.arrays_zip(F.xpath(plain, F.lit("/feed/entry/id/text()")).alias("id"), F.xpath(plain, F.lit("/feed/entry/title/text()")).alias("title"))


def english(values: Column) -> Column:
    """Of language-tagged literals array<struct<language, value>> the English one, else the first."""
    return F.coalesce(F.get(F.filter(values, lambda v: v["language"] == "en"), F.lit(0)), F.get(values, F.lit(0)))["value"]


def rdf_types(spark: SparkSession, path: str, row_tag: str = "nmo:TypeSeriesItem") -> DataFrame:
    """Type records of an RDF/XML export; repeated subjects are left to fold_subjects."""
    ref = "struct<`_rdf:resource`:string>"
    schema = f"`_rdf:about` string, `skos:prefLabel` array<struct<`_VALUE`:string,`_xml:lang`:string>>, `nmo:hasAuthority` array<{ref}>, `nmo:hasMint` array<{ref}>, `nmo:hasMaterial` array<{ref}>, `dcterms:isReplacedBy` array<{ref}>"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    many = lambda c: F.transform(F.col(f"`{c}`"), lambda x: F.substring_index(x["_rdf:resource"], "/", -1))
    label = F.transform(F.col("`skos:prefLabel`"), lambda v: F.struct(v["_xml:lang"].alias("language"), v["_VALUE"].alias("value")))
    return raw.select(F.substring_index(F.col("`_rdf:about`"), "/", -1).alias("id"), english(label).alias("title"), many("nmo:hasAuthority").alias("authorities"), many("nmo:hasMint").alias("mints"), many("nmo:hasMaterial").alias("materials"), many("dcterms:isReplacedBy").alias("replaced_by"))


def page_metadata(html: Column) -> Column:
    """What a page says of itself: title, canonical address, OpenGraph title, declared language."""
    meta = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    og = meta(r"""(?is)<meta[^>]*\bproperty\s*=\s*["']og:title["'][^>]*\bcontent\s*=\s*["']([^"']*)""")
    title = meta(r"(?is)<title[^>]*>(.*?)</title>")
    canonical = meta(r"""(?is)<link[^>]*\brel\s*=\s*["']canonical["'][^>]*\bhref\s*=\s*["']([^"']*)""")
    return F.struct(F.coalesce(og, title).alias("title"), canonical.alias("canonical_url"), meta(r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z-]+)""").alias("lang"))
