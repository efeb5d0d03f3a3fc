"""Fetching of pages and genomes into a cache table, with retries.

The transport (a function from url to text) is a parameter: tests pass their own, and nothing
here opens a connection by itself.  Results and errors are rows; a cache is a table of earlier
results, so only urls it lacks are fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.sources.scratch import once

Transport = Callable[[str, float, int], str]  # url, seconds, most bytes

_PAGE = "key string, url string, body string, tries int, error string"


def fetch(wanted: DataFrame, transport: Transport, tries: int = 3, seconds: float = 60, more_seconds: float = 300, size: int = 100_000_000, more_size: int = 100_000_000, least_lines: int = 0) -> DataFrame:
    """``key, url, body, tries, error`` for ``wanted(key, url)``; body is null where all tries failed.

    Each try allows more time and size than the one before.  A body of fewer than ``least_lines`` lines
    is a failure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, url in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), strict=True):
                body, error, n = None, None, 0
                for n in range(1, tries + 1):
                    try:
                        text = transport(url, seconds + (n - 1) * more_seconds, size + (n - 1) * more_size)
                        if text and text.count("\n") + 1 >= least_lines:
                            body, error = text, None
                            break
                        error = "too short"
                    except Exception as e:  # a failed transfer is a row, not a failed task
                        error = f"{type(e).__name__}: {e}"
                out.append((key, url, body, n, error))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "url", "body", "tries", "error"])

    return wanted.select("key", "url").mapInArrow(run, _PAGE)


def fetch_missing(wanted: DataFrame, cache: DataFrame, transport: Transport, valid: Column | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(``key, body`` of all wanted that are cached or fetched, ``key, url, error`` of the others).

    A cached body counts if it isn't empty and ``valid`` (a condition on ``body``) holds: a page that parses to nothing
    is fetched again.  Every url is fetched once.
    """
    good = F.col("body").isNotNull() & (F.col("body") != "") & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    held = cache.where(good).select("key", "body").dropDuplicates(["key"])
    got = once(fetch(wanted.join(held.select("key"), "key", "left_anti"), transport, **options), "fetched")
    pages = wanted.select("key").distinct().join(held, "key").unionByName(got.where("body is not null").select("key", "body"))
    return pages, got.where("body is null").select("key", "url", "error")


#: Pages of the gene database: for each kind, the addresses that may have it, in the order in which they are tried.
PAGE_URLS = {
    "gene": ("{base}/ECOLI/substring-search?type=GENE&object={key}&geneSearch=Gene+Search",),
    "tu": ("{base}/gene?orgid=ECOLI&id={key}#tab=TU",),
    "promoter": tuple("{base}/tmp/ptools-images/ECOLI/TU_dir=1_topdir=%d%s_NO-PLOC_{key}.wg" % (d, x) for x in ("", "_NO-INDEX") for d in (-1, 1)),
    "summary": ("{base}/gene-tab?id={key}&orgid=ECOLI&tab=SUMMARY",),
    "go": ("{base}/gene-tab?id={key}&orgid=ECOLI&tab=GO",),
}
#: Page that makes the server draw a layout: asked for between the first and the last round.
WARM_UP = "{base}/tmp/ptools-images/ECOLI/{key}_REG-SUMMARY.wg"

#: (url, seconds, whether it is the last round, in which cookies and compression are used) to text.
PageTransport = Callable[[str, float, bool], str]


def fetch_pages(wanted: DataFrame, transport: PageTransport, base: str, urls: dict[str, tuple[str, ...]] | None = None, seconds: float = 30) -> DataFrame:
    """``kind, key, body, url, error`` for ``wanted(kind, key)``: the first candidate address that answers, in three rounds.

    The first round asks plainly, the second only warms the server up, the last asks with the transport's
    cookies.  Where none answers, body is null and error is the last one.
    """
    known = urls or PAGE_URLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True):
                body, at, error = None, None, None
                for turn, candidates in enumerate((known[kind], (WARM_UP,), known[kind])):
                    for template in candidates:
                        url = template.format(base=base, key=key)
                        try:
                            text = transport(url, seconds, turn == 2)
                        except Exception as e:  # a failed transfer is a row, not a failed task
                            error = f"{type(e).__name__}: {e}"
                            continue
                        if turn != 1:
                            body, at, error = text, url, None
                            break
                    if body is not None:
                        break
                out.append((kind, key, body, at, error))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["kind", "key", "body", "url", "error"])

    return wanted.select("kind", "key").mapInArrow(run, "kind string, key string, body string, url string, error string")


def fetch_records(keys: DataFrame, transport: Transport, lookup_url: str, data_url: str, uid_name: str, size: int = 100_000_000, **options) -> tuple[DataFrame, DataFrame]:
    """(``key, body``, ``key, url, error``) of records that are found in two steps.

    The page at ``lookup_url`` with the key names a uid in its ``meta`` element ``uid_name``; the record is at
    ``data_url`` with ``{uid}`` and ``{size}``.  A record of fewer than 10 lines is a failure.
    """
    from seqloom.sources.pages import meta_udf

    looked = once(fetch(keys.select("key", F.concat(F.lit(lookup_url), "key").alias("url")), transport), "lookups")
    named = once(looked.withColumn("uid", F.when(F.col("body").isNotNull(), meta_udf("body", F.lit(uid_name)))), "uids")
    url = F.replace(F.replace(F.lit(data_url), F.lit("{uid}"), F.col("uid")), F.lit("{size}"), F.lit(str(size)))
    got = once(fetch(named.where("uid is not null and uid <> ''").select("key", url.alias("url")), transport, size=size, least_lines=10, **options), "records")
    lost = named.where("uid is null or uid = ''").select("key", "url", F.coalesce("error", F.lit("no uid")).alias("error"))
    return got.where("body is not null").select("key", "body"), got.where("body is null").select("key", "url", "error").unionByName(lost)


def search_urls(names: DataFrame, keywords: list[str], template: str) -> DataFrame:
    """``key, url`` for each name and keyword; the key has ``_`` for ``+``, the url keeps it."""
    both = names.select("name", F.explode(F.array(*map(F.lit, keywords))).alias("keyword"))
    url = F.replace(F.replace(F.lit(template), F.lit("{name}"), F.col("name")), F.lit("{keyword}"), F.col("keyword"))
    return both.select("name", "keyword", F.concat_ws("_", "name", F.replace("keyword", F.lit("+"), F.lit("_"))).alias("key"), url.alias("url"))
