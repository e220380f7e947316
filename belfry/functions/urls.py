"""URL columns: resolution against a base, provider link rules, stored-HTML anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from belfry.functions.text import empty_to_null, is_blank, let, strip

# URL grammar, provider hosts and link shapes.
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
ECATHOLIC_HOST = "files.ecatholic.com"
DISCOVER_HOST = "bulletins.discovermass.com"
DISCOVER_PATH = "/download.php"
PARISHES_ONLINE_HOST = "parishesonline.com"
PARISHES_ONLINE_FILES = "https://container.parishesonline.com/"
PROVIDER_KEYWORDS = [
    ("files.ecatholic.com", "ecatholic"),
    ("parishesonline", "parishes_online"),
    ("discovermass", "discover_mass"),
]
PROVIDER_ID_PATTERNS = [
    r"(?i)parishesonline\.com/(?:organization|find)/([a-z0-9-]+)",
    r"(?i)/publication-page/([a-z0-9-]+)",
]
PAGE_TEMPLATES = {
    "parishes_online": "https://parishesonline.com/organization/{id}",
    "discover_mass": "https://discovermass.com/church/{id}/",
}
HTML_PDF_PATTERN = "(?i)https?://[^\\s\"'<>]+?\\.pdf"
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
HREF = r"""(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, URL_PARTS, i)


def host(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query_value(url: Column, key: str) -> Column:
    """First value of a query parameter, form-decoded; null when absent."""
    pairs = F.split(_part(url, 4), "&")
    hits = F.filter(pairs, lambda p: p.startswith(f"{key}=") & (F.length(p) > len(key) + 1))
    return F.try_url_decode(F.regexp_replace(F.get(hits, F.lit(0)), "^[^=]*=", ""))


def remove_dots(joined: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path."""
    segments = F.split(joined, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from ``base``, after the generic URL syntax."""
    scheme, b_scheme = F.lower(_part(href, 1)), F.lower(_part(base, 1))
    h_path, b_path = _part(href, 3), _part(base, 3)
    has_query = href.rlike(r"^[^#]*\?")
    query = F.when(_part(href, 4) != "", F.concat(F.lit("?"), _part(href, 4))).otherwise("")
    b_query = F.when(_part(base, 4) != "", F.concat(F.lit("?"), _part(base, 4))).otherwise("")
    fragment = F.when(_part(href, 5) != "", F.concat(F.lit("#"), _part(href, 5))).otherwise("")
    root = F.concat(b_scheme, F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(b_path, "[^/]*$", "")
    merged = F.when(h_path.startswith("/"), h_path).otherwise(
        F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), h_path), "(?<=.)/{2,}", "/"))
    clean = remove_dots(merged)
    clean = F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit("/"), clean))
    same_page = F.concat(root, b_path, F.when(has_query, query).otherwise(b_query), fragment)
    return (F.when(href == "", base)
            .when((scheme != "") & ((scheme != b_scheme) | (_part(href, 2) != "")), href)
            .when(href.startswith("//"), F.concat(b_scheme, F.lit(":"), href))
            .when(h_path == "", same_page)
            .otherwise(F.concat(root, clean, query, fragment)))


def unescape_html(text: Column) -> Column:
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def anchors(html: Column) -> Column:
    """Array of (href, text) in document order, for anchors that carry an href."""
    tags = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))

    def read(tag: Column) -> Column:
        attributes = F.regexp_extract(tag, ANCHOR, 1)
        href = F.concat(*[F.regexp_extract(attributes, HREF, i) for i in (1, 2, 3)])
        label = F.regexp_replace(F.regexp_extract(tag, ANCHOR, 2), "(?s)<[^>]*>", "")
        return F.struct(
            F.when(attributes.rlike(HREF), unescape_html(href)).alias("href"),
            strip(unescape_html(label)).alias("text"))

    return F.filter(F.transform(tags, read), lambda a: a["href"].isNotNull())


def html_pdf_urls(html: Column, pattern: str = HTML_PDF_PATTERN) -> Column:
    """Distinct PDF URLs anywhere in the page source, first seen first; ``\\/`` is unescaped."""
    plain = F.replace(html, F.lit("\\/"), F.lit("/"))
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)))


def provider_id(html: Column, patterns=None) -> Column:
    return F.coalesce(*[empty_to_null(F.regexp_extract(html, p, 1))
                        for p in (patterns or PROVIDER_ID_PATTERNS)])


def detect_provider(html: Column, keywords=None, id_provider: str = "parishes_online",
                    id_patterns=None) -> Column:
    """Struct (provider, provider_id): the first keyword of the list found in the page."""
    lower, provider = F.lower(html), None
    for word, name in keywords or PROVIDER_KEYWORDS:
        hit = lower.contains(word)
        provider = F.when(hit, name) if provider is None else provider.when(hit, name)
    provider = provider.otherwise("other")
    ident = F.when(provider == id_provider, provider_id(html, id_patterns))
    return F.struct(provider.alias("provider"), ident.alias("provider_id"))


def ecatholic_url(base: Column, href: Column, allowed_host: str = ECATHOLIC_HOST) -> Column:
    def accept(url: Column) -> Column:
        p = F.lower(path(url))
        return F.when((F.lower(host(url)) == allowed_host) & p.contains("bulletins") & p.endswith(".pdf"), url)
    return let(resolve_url(base, href), accept)


def discover_url(base: Column, href: Column) -> Column:
    def accept(url: Column) -> Column:
        ok = ((F.lower(host(url)) == DISCOVER_HOST) & (F.lower(path(url)) == DISCOVER_PATH)
              & ~is_blank(query_value(url, "bulletin")))
        return F.when(ok, url)
    return let(resolve_url(base, href), accept)


def parishes_online_url(base: Column, href: Column, org_id: Column) -> Column:
    """Struct (source_url, fetch_url): the publication page and the file embedded in it."""
    def decoded(url: Column) -> Column:
        inner = query_value(url, "selectedPublication")
        for _ in range(2):  # percent-decoded twice more; a plus sign stays a plus sign
            inner = let(inner, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))
        return F.struct(url.alias("source_url"), inner.alias("fetch_url"))

    def accept(link: Column) -> Column:
        url, inner = link["source_url"], F.lower(link["fetch_url"])
        ok = ((host(url) == PARISHES_ONLINE_HOST)
              & (path(url) == F.concat(F.lit("/publication-page/"), org_id))
              & inner.startswith(PARISHES_ONLINE_FILES) & inner.endswith(".pdf"))
        return F.when(ok, link)

    return let(let(resolve_url(base, href), decoded), accept)


def percent_encode(text: Column) -> Column:
    """Path-segment encoding that leaves ``A-Z a-z 0-9 - _ . ! ~ * ' ( )`` alone."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, raw in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def canonical_url(origin: str, slug: Column) -> Column:
    return F.concat(F.lit(origin.rstrip("/") + "/churches/"), percent_encode(slug), F.lit("/"))
