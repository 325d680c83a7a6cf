"""Links and image texts of pages, addresses resolved as column expressions, and the graph of pages that link to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"


def _unescaped(text: Column) -> Column:
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def attributes(html: Column, tag: str, name: str) -> Column:
    """The values of an attribute of all tags of a kind, in order, outside of comments, scripts and styles."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    found = F.regexp_extract_all(plain, F.lit(rf"(?is)<{tag}\b[^>]*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), F.lit(1))
    return F.transform(found, lambda v: F.trim(_unescaped(F.regexp_replace(v, r"^[\"']|[\"']$", ""))))


def _without_dots(path: Column) -> Column:
    """A path without its . and .. parts; above the top there is nothing."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    end = F.when(path.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    out = F.concat(F.lit("/"), F.array_join(kept, "/"), end)
    return F.regexp_replace(out, "^//+", "/")


def resolve_url(base: Column, href: Column) -> Column:
    """The address that a link of a page leads to, without its fragment. Null if the base has no scheme and host and the link none of its own."""
    base, href = F.regexp_replace(base, "#.*$", ""), F.regexp_replace(href, "(?s)#.*$", "")
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    rest = F.substr(base, F.length(host) + 1)
    path = F.regexp_replace(rest, r"(?s)\?.*$", "")
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    asked, own = F.regexp_extract(href, r"(?s)(\?.*)$", 1), F.regexp_replace(href, r"(?s)\?.*$", "")
    at = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    resolved = F.when(href == "", base).when(own == "", F.concat(host, path, asked)).otherwise(F.concat(host, _without_dots(at), asked))
    return F.when(href.rlike(_SCHEME), href).when(href.startswith("//"), F.concat(scheme, href)).when(host != "", resolved)


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, place, href, target): every link of every page, in order. Links to other things than pages (mail, scripts) have no target."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_base"), F.posexplode(attributes(F.col(html_col), "a", "href")).alias("place", "href"))
    target = F.when(~F.lower("href").rlike("^(javascript|mailto|tel|data):"), resolve_url(F.col("_base"), F.col("href")))
    return rows.select("page_id", "place", "href", target.alias("target"))


def image_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, place, alt) of images with a text."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(attributes(F.col(html_col), "img", "alt")).alias("place", "alt"))
    return rows.where("alt <> ''")


def link_graph(pages: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, target, n, to_page): what pages link to, how often, and the page that has the address, the smallest id of several; null for
    a dangling end. Addresses are compared without fragments."""
    known = pages.where(F.col(url_col).isNotNull()).groupBy(F.regexp_replace(url_col, "#.*$", "").alias("target")).agg(F.min(id_col).alias("to_page"))
    edges = links.where("target is not null").groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))
    return edges.join(known, "target", "left").select("page_id", "target", "n", "to_page")
