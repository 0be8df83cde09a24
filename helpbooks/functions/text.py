"""Page text as column expressions: decoding, markup stripping, titles, excerpts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' scripts define it; Java's \s is ASCII only. The same spelling works in RE2.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# What browsers read bytes 80 to 9F of windows-1252 as; 81, 8D, 8F, 90 and 9D stay.
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

# The markup patterns and the order in which they become one space each.
TAG, ENTITY = r"<[^>]+>", r"&[a-zA-Z#0-9]+;"
MARKUP = (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", TAG, r"(?i)&nbsp;", ENTITY, f"{SPACE}+")
TITLE = r"(?i)<title[^>]*>([\s\S]*?)</title>"


def decode_bytes(content: Column, charset: str = "windows-1252") -> Column:
    """Bytes as text. windows-1252 is spelt out, as Spark has no such charset."""
    if charset.lower() in ("windows-1252", "cp1252"):
        return F.translate(F.decode(content, "ISO-8859-1"), CP1252_BYTES, CP1252_CHARS)
    return F.decode(content, charset)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value being made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _closed(text: Column, end: str, cut: Callable[[Column], Column]) -> Column:
    """A text of pieces that ``end`` closes, ``cut`` applied to each; what follows the last end stays as it is."""

    def whole(pieces: Column) -> Column:
        return F.concat(F.array_join(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), cut), ""), F.element_at(pieces, -1))

    return let(F.split(text, end, -1), whole)


def _without_elements(html: Column, tag: str) -> Column:
    """Each stretch from an opening tag to the next closing one as a space. A piece between two closing tags is looked at once, so many openings without an end cost no more than others."""

    def cut(piece: Column) -> Column:
        opened = F.split(piece, f"(?i)<{tag}", 2)
        return let(opened, lambda x: F.when(F.size(x) > 1, F.concat(F.get(x, F.lit(0)), F.lit(" "))).otherwise(F.concat(piece, F.lit(f"</{tag}>"))))

    return F.when(html.rlike(f"(?i)</{tag}>"), _closed(html, f"(?i)</{tag}>", cut)).otherwise(html)


def _without_tags(html: Column) -> Column:
    """Each tag as a space, from its first < to the next >, for pages where some < have no end."""

    def cut(piece: Column) -> Column:
        before = F.substring_index(piece, "<", 1)
        is_tag = F.contains(piece, F.lit("<")) & (F.concat(before, F.lit("<")) != piece)
        return F.when(is_tag, F.concat(before, F.lit(" "))).otherwise(F.concat(piece, F.lit(">")))

    return _closed(html, ">", cut)


def strip_html(html: Column) -> Column:
    """Plain text of a page; the title's text stays in.

    What ``MARKUP`` replaces, in that order, in time linear in the page: scripts and
    styles first, piece by piece; then tags, entities and white space separate
    the words, in one pass over the rest.
    """

    def words_of(body: Column) -> Column:
        unclosed = F.contains(F.substring_index(body, ">", -1), F.lit("<"))
        return F.when(unclosed, F.split(_without_tags(body), f"{ENTITY}|{SPACE}+", -1)).otherwise(F.split(body, f"{TAG}|{ENTITY}|{SPACE}+", -1))

    body = _without_elements(_without_elements(html, "script"), "style")
    return F.array_join(F.array_remove(let(body, words_of), ""), " ")


def html_title(html: Column) -> Column:
    """Text of the first title element, entities undecoded; '' if there is none."""
    return trim_space(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"<[^>]+>", ""))


def excerpt(text: Column, query: Column, radius: int = 80) -> Column:
    """Text around the first hit of the query's first word, or the start of the text, with marks where it is cut."""
    term = F.lower(F.split(query, f"{SPACE}+", 2)[0])
    at = F.when(term == "", 0).otherwise(F.position(term, F.lower(text)))
    start = F.greatest(F.lit(0), at - 1 - radius)
    end = F.least(F.length(text), at - 1 + F.length(term) + radius)
    around = F.concat(F.when(start > 0, "…").otherwise(""), trim_space(F.substring(text, start + 1, end - start)), F.when(end < F.length(text), "…").otherwise(""))
    head = F.concat(trim_space(F.substring(text, F.lit(1), F.lit(2 * radius))), F.when(F.length(text) > 2 * radius, "…").otherwise(""))
    return F.when(at > 0, around).otherwise(head)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
