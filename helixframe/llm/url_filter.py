"""URL filters with redirect equivalence: block decisions reach every alias of a page.

Explicit rules decide a page first: the longest rule that fits its host (or a parent domain) and path. Pages without a
rule take the verdict of their alias component: components are found by distributed connected components over redirect
edges (``<meta http-equiv=refresh>``) and canonical-link edges (``<link rel=canonical>``). Every such tag counts; its link is
resolved as RFC 3986 says, against the page's ``<base>`` if it has one, with entities decoded; tags in comments and scripts
don't count. Inside a component an explicit allow takes precedence over any block; a component without either is allowed.

Two addresses are one only if they agree in scheme, host (both without regard to case), path (empty is ``/``) and query;
nothing but an edge joins different addresses.

Defined results: a null url, or one without ``://``, has an empty host and path, joins no component and is allowed.
Repeated rows each get their row; of a page that occurs with several contents all links count. An empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, small, written
from .components import min_label_components

Rule = tuple[str, str]  # ("allow" | "block", "host/path")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as text; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Rules are few and literal: one expression, no join."""
    hit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        domain, prefix = rule[:at], rule[at:]
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        hit = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
    return hit


def address(url: Column) -> Column:
    """What tells pages apart: scheme, host, path and query; null if there is no host."""
    host, path = url_parts(url)
    scheme = ascii_lower(F.regexp_extract(url, "(?s)^(.*?)://", 1))
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*(\\?[^#]*)", 1)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


class _Links(HTMLParser):
    """The links of a page's refresh and canonical tags, and its first base."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[str] = []
        self.base: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in ("link", "meta", "base"):
            return
        found = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        if tag == "base" and self.base is None and "href" in found:
            self.base = found["href"]
        elif tag == "link" and "href" in found and "canonical" in found.get("rel", "").lower().split():
            self.links.append(found["href"])
        elif tag == "meta" and found.get("http-equiv", "").strip().lower() == "refresh":
            m = _REFRESH.match(found.get("content", ""))
            if m:
                self.links.append(next(x for x in m.groups() if x is not None))


_REFRESH = re.compile(r"""(?is)\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(\S.*))""")
_MARKS = re.compile("(?i)canonical|refresh")
_SPACE = re.compile("[\t\n\r]")


def links_of(url: str, html: str) -> list[str]:
    """Full addresses of a page's refresh and canonical links."""
    if not _MARKS.search(html):
        return []
    parser = _Links()
    parser.feed(html)
    parser.close()
    clean = lambda x: _SPACE.sub("", x.strip())
    out = []
    for link in parser.links:
        try:
            out.append(urljoin(urljoin(url, clean(parser.base or "")), clean(link)))
        except ValueError:  # no address
            continue
    return [x for x in out if "://" in x]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = [links_of(u or "", h or "") for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["_id", "url", "links"])


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", html_col: str | None = "html", id_col: str = "page_id") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, component (an address that stands for it), by ("rule" or "component")."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    html = F.col(html_col) if html_col else F.lit(None).cast("string")
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"), html.cast("string").alias("html"))
    host, path = url_parts(F.col("url"))
    # One pass over the html; what follows works on this narrow table.
    kind = dict(src.dtypes)["_id"]
    found = src.mapInArrow(_links, f"_id {kind}, url string, links array<string>")
    targets = F.array_compact(F.transform("links", address))
    base = found.select(F.col("_id").alias(id_col), host.alias("host"), path.alias("path"), address(F.col("url")).alias("node"), targets.alias("links"))
    base = written(base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)), folder, "pages")
    edges = base.where("node is not null").select("node", F.explode("links").alias("to")).where("node != to").distinct()
    labels = min_label_components(edges.select(F.col("node").alias("a"), F.col("to").alias("b")), f"{folder}/cc")
    # Verdicts of components: pages sum up to nodes, nodes to components; each step is pre-aggregated.
    marks = base.where("node is not null and hit is not null").groupBy("node").agg(
        F.max((F.col("hit.verdict") == "allow").cast("int")).alias("allow"), F.max((F.col("hit.verdict") == "block").cast("int")).alias("block"))
    marks = marks.join(labels, marks["node"] == labels["id"], "left").select(F.coalesce("label", "node").alias("component"), "allow", "block")
    verdicts = marks.groupBy("component").agg(F.when(F.max("allow") == 1, "allow").when(F.max("block") == 1, "block").otherwise("allow").alias("by_component"))
    named = base.join(labels, base["node"] == labels["id"], "left").withColumn("component", F.coalesce("label", "node")).drop("id", "label")
    out = named.join(verdicts, "component", "left")
    return out.select(
        id_col, "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.col("by_component"), F.lit("allow")).alias("verdict"),
        "component", F.when(F.col("hit").isNotNull(), "rule").otherwise("component").alias("by"),
    )
