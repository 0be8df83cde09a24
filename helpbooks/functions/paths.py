"""Paths, addresses and media types inside help books, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by extension.
MIME_TYPES = {
    "htm": "text/html; charset=windows-1252",
    "html": "text/html; charset=windows-1252",
    "css": "text/css",
    "js": "text/javascript",
    "mjs": "text/javascript",
    "json": "application/json",
    "xml": "application/xml",
    "svg": "image/svg+xml",
    "gif": "image/gif",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "bmp": "image/bmp",
    "ico": "image/x-icon",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "ttf": "font/ttf",
}
OTHER_TYPE = "application/octet-stream"
SCHEME = "chm://"


def path_key(path: Column) -> Column:
    """Paths are the same file whatever their case."""
    return F.lower(path)


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/\z", ""), "/", -1)


def strip_fragment(local: Column) -> Column:
    return F.substring_index(local, "#", 1)


def internal_path(local: Column) -> Column:
    """A link's target as a listed path: no fragment, one leading slash."""
    bare = strip_fragment(local)
    return F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.lit("/"), bare))


def page_url(book_id: Column, local: Column) -> Column:
    """Address of a page, its fragment kept; null for an empty or missing link."""
    slash = F.when(F.startswith(local, F.lit("/")), "").otherwise("/")
    return F.when(F.coalesce(local, F.lit("")) != "", F.concat(F.lit(SCHEME), book_id, slash, local))


def mime_type(path: Column) -> Column:
    """By what follows the last dot; a path without a dot counts as its own extension."""
    known = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(path, ".", -1))), F.lit(OTHER_TYPE))


def is_safe_path(path: Column) -> Column:
    return F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..")


def percent_decoded(path: Column) -> Column:
    """Null for a bad escape or bad UTF-8; a plus sign is a plus sign."""
    out = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    broken = F.contains(out, F.lit("�")) & ~F.contains(F.lower(path), F.lit("%ef%bf%bd")) & ~F.contains(path, F.lit("�"))
    return F.when(~broken, out)


def request_book(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def folded(path: Column) -> Column:
    """A path without its dot segments, as browsers resolve them: ``.`` stands for nothing, ``..`` takes the segment before it away, and either may be escaped. One at the end leaves a slash there. Escaped slashes part no segments."""
    plain = F.transform(F.split(path, "/"), lambda x: F.struct(x.alias("text"), F.regexp_replace(F.lower(x), "%2e", ".").alias("dots")))
    parts = F.slice(plain, F.lit(2), F.size(plain))

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part["dots"] == "..", up).when(part["dots"] == ".", kept).otherwise(F.concat(kept, F.array(part["text"])))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.when(F.element_at(plain, -1)["dots"].isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))).otherwise(path)


def request_path(url: Column, fold: bool = False) -> Column:
    """Decoded path of a request; null if the address is malformed. With ``fold`` dot segments are resolved before it is decoded."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return percent_decoded(folded(path) if fold else path)


def display_title(title: Column, path: Column) -> Column:
    """The page's title or else its file name without .htm or .html."""
    return F.coalesce(F.nullif(title, F.lit("")), F.regexp_replace(basename(path), r"(?i)\.html?\z", ""))


def book_title(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?i)\.chm\z", "")


def menu_label(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def node_label(name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("(untitled)"))


def html_page(path: Column, size: Column) -> Column:
    """Whether an entry is a page with bytes."""
    return path.rlike(r"(?i)\.html?\z") & (size > 0)
