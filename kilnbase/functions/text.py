"""Text functions of the knowledge base, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is taken out of a page, in this order.
HTML_STEPS = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?is)<nav[^>]*>.*?</nav>", " "),
    (r"(?s)<[^>]*>", " "),
    (r"&amp;", "&"),
    (r"\s+", " "),
)


def html_text(html: Column) -> Column:
    """Visible text of a page, lexically: comments, scripts, styles, navigation and tags go."""
    for pattern, by in HTML_STEPS:
        html = F.regexp_replace(html, pattern, by)
    return F.trim(html)


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def canonical_url(url: Column) -> Column:
    """Lower case, without scheme, www or m host prefix, query, fragment and end slash."""
    url = F.regexp_replace(F.lower(url), r"^[a-z]+://", "")
    url = F.regexp_replace(url, r"^(www|m)\.", "")
    url = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(url, r"/$", "")


def chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of passages of `size` characters, each beginning `size - overlap` after the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1 - overlap, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    square = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
