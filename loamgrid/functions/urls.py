"""URL functions as Column expressions; no Python runs on the executors.

URLs are taken apart by the RFC 3986 pattern, which, unlike ``parse_url``, keeps
URLs with blanks and never fails. A URL with an unbalanced bracket in its authority
counts as unparseable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import SiteProfile

_RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
PERMALINK_KEYS = ("p", "page_id", "attachment_id", "author", "cat", "tag", "taxonomy", "term")
ASSET_TREES = ("/wp-content/", "/wp-includes/")
ADMIN_PATHS = ("/wp-admin/", "/wp-login.php", "/xmlrpc.php")
LONGEST = 4096
#: File suffixes by the folder that external assets of the kind go to.
BUCKETS = {
    "/assets/fonts/": (".woff", ".woff2", ".ttf", ".otf", ".eot"),
    "/assets/css/external/": (".css",),
    "/assets/js/external/": (".js", ".mjs"),
    "/assets/img/external/": (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp"),
}

#: The suffix of a file whose URL has none, by its type; else a server would call it text.
_SUBTYPES = {
    ".css": ("text/css",),
    ".js": ("text/javascript", "application/javascript"),
    ".woff": ("font/woff", "application/font-woff"),
    ".woff2": ("font/woff2", "application/font-woff2"),
    ".ttf": ("font/ttf", "application/x-font-ttf", "application/x-font-truetype"),
    ".otf": ("font/otf",),
    ".eot": ("application/vnd.ms-fontobject",),
    ".ico": ("image/x-icon", "image/vnd.microsoft.icon"),
    ".svg": ("image/svg+xml",),
    **{f".{k}": (f"image/{v}",) for k, v in (("jpg", "jpeg"), ("png", "png"), ("gif", "gif"), ("webp", "webp"))},
}


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _RFC, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _RFC, 2)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(netloc(url), r"^[^@]*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    """As text; empty where there is none."""
    return F.regexp_extract(netloc(url), r":(\d+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _RFC, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _RFC, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _RFC, 5)


def unparseable(url: Column) -> Column:
    at = netloc(url)
    return F.coalesce(F.contains(at, F.lit("[")) != F.contains(at, F.lit("]")), F.lit(True))


def decode_unreserved(s: Column) -> Column:
    """%XX of letters, digits and ``-._~`` become characters; the hex digits of others are upper-cased."""
    parts = F.split(s, "%", -1)
    tail = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        code = F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
        char = F.char(code.cast("bigint"))
        rest = F.substring(p, 3, 1 << 30)
        known = F.when(char.rlike(r"^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2)), rest))
        return F.when(p.rlike("^[0-9a-fA-F]{2}"), known).otherwise(F.concat(F.lit("%"), p))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(tail, one), ""))


def resolve_dots(p: Column) -> Column:
    """No empty, ``.`` or ``..`` segments are left; a trailing slash stays."""
    stack = F.aggregate(
        F.split(p, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    out = F.concat(F.lit("/"), F.array_join(stack, "/"))
    return F.when(F.endswith(p, F.lit("/")) & ~F.endswith(out, F.lit("/")), F.concat(out, F.lit("/"))).otherwise(out)


def last_segment(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)$", 1)


def directory_like(p: Column) -> Column:
    return ~F.contains(last_segment(p), F.lit("."))


def query_pairs(q: Column) -> Column:
    """Non-empty ``key=value`` parts, decoded and encoded again in the one canonical way."""
    def canon(x: Column) -> Column:
        enc = F.url_encode(F.try_url_decode(x))
        return F.replace(F.replace(F.coalesce(enc, x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    parts = F.filter(F.split(q, "&", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(canon(F.regexp_extract(x, r"^([^=]*)", 1)).alias("k"), canon(F.regexp_extract(x, r"^[^=]*=?(.*)$", 1)).alias("v")))


def joined_query(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def permalink_query(q: Column) -> Column:
    return joined_query(F.filter(query_pairs(q), lambda p: p["k"].isin(*PERMALINK_KEYS)))


def unsplit(scheme_: Column, netloc_: Column, path_: Column, query_: Column) -> Column:
    base = F.when(netloc_ != "", F.concat(F.lit("//"), netloc_, F.when((path_ != "") & ~F.startswith(path_, F.lit("/")), F.lit("/")).otherwise(F.lit("")), path_)).otherwise(path_)
    return F.concat(F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(F.lit("")), base, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(F.lit("")))


def normalize(url: Column, owned: Column, canonical_host: Column, *, use_https: bool = True, trailing_slash: bool = True, pretty: bool = False) -> Column:
    """The one spelling of a URL; NULL where it is unparseable.

    Owned hosts fold to ``canonical_host`` and https, take the site's slash
    preference on directory-like paths and keep permalink keys of the query only
    (none where a pretty permalink is known). Other hosts keep their query.
    """
    s0, h0, p0 = scheme(url), host(url), port(url)
    s = F.when(owned & F.lit(use_https), F.lit("https")).otherwise(s0)
    h = F.when(owned, canonical_host).otherwise(h0)
    default = ((p0 == "80") & ((s0 == "http") | (s == "http"))) | ((p0 == "443") & ((s0 == "https") | (s == "https")))
    at = F.when((p0 != "") & ~default, F.concat(h, F.lit(":"), p0)).otherwise(h)
    p = resolve_dots(decode_unreserved(path(url)))
    if trailing_slash:
        slashed = F.when(F.endswith(p, F.lit("/")), p).otherwise(F.concat(p, F.lit("/")))
    else:
        slashed = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    p = F.when(owned & directory_like(p), slashed).otherwise(p)
    own_query = F.lit("") if pretty else permalink_query(query(url))
    q = F.when(owned, own_query).otherwise(joined_query(query_pairs(query(url))))
    return F.when(~unparseable(url), unsplit(s, at, p, q))


def normalize_for(url: Column, profile: SiteProfile, **options) -> Column:
    h = host(url)
    return normalize(url, profile.owns(h), profile.canonical(h), use_https=profile.use_https, trailing_slash=profile.trailing_slash, **options)


def in_scope(url: Column, profile: SiteProfile) -> Column:
    """Owned and below the base path; an extra host is in scope whole."""
    h, p = host(url), path(url)
    below = F.startswith(p, F.lit(profile.base_path)) | (p == profile.base_path.rstrip("/"))
    extra = h.isin(*sorted(profile.extra_hosts)) if profile.extra_hosts else F.lit(False)
    return ~unparseable(url) & profile.owns(h) & (extra | below)


def resolve(base: Column, link: Column) -> Column:
    """RFC 3986 reference resolution, fragment kept off."""
    ref = F.regexp_replace(link, "#.*$", "")
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    s, n = scheme(base), netloc(base)
    rp = path(ref)
    target = F.when(F.startswith(rp, F.lit("/")), resolve_dots(rp)).otherwise(resolve_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), rp)))
    return (
        F.when(scheme(ref) != "", ref)
        .when(netloc(ref) != "", F.concat(s, F.lit(":"), ref))
        .when(ref == "", F.regexp_replace(base, "#.*$", ""))
        .when(rp == "", unsplit(s, n, path(base), query(ref)))
        .otherwise(unsplit(s, n, target, query(ref)))
    )


def url_shaped(v: Column) -> Column:
    return F.coalesce(F.trim(v).rlike(r"^(https?://|//|/)"), F.lit(False))


def bare_asset_directory(url: Column) -> Column:
    p = path(F.rtrim(url))
    under = F.lit(False)
    for tree in ASSET_TREES:
        under = under | F.startswith(p, F.lit(tree))
    return under & directory_like(p)


def bare_directory(url: Column) -> Column:
    return F.endswith(F.rtrim(url), F.lit("/")) | bare_asset_directory(url)


def admin_infrastructure(url: Column) -> Column:
    out = F.lit(False)
    for p in ADMIN_PATHS:
        out = out | F.startswith(path(url), F.lit(p))
    return out


def implausibly_long(url: Column) -> Column:
    return F.length(url) > LONGEST


def unlikely_real(url: Column) -> Column:
    return unparseable(url) | bare_directory(url) | implausibly_long(url) | admin_infrastructure(url)


def excluded(url: Column, patterns: list[str]) -> Column:
    return url.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def _stem(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.+?)(\.[^.]+)?$", 1)


def suffix(name: Column) -> Column:
    """The last ``.ext`` of a name, empty for none or for a leading dot alone."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def local_path(url: Column, owned: Column) -> Column:
    """Where the bytes of a URL lie: index.html for folders, a query's hash in the name, foreign hosts apart."""
    p = path(url)
    p = F.when((p == "") | F.endswith(p, F.lit("/")), F.concat(p, F.lit("index.html"))).otherwise(p)
    p = F.regexp_replace(p, "^/+", "")
    name, folder = last_segment(p), F.regexp_replace(p, r"[^/]*$", "")
    hashed = F.concat(folder, _stem(name), F.lit("__q-"), F.substring(F.sha2(query(url), 256), 1, 10), suffix(name))
    p = F.when(query(url) != "", hashed).otherwise(p)
    return F.when(owned, p).otherwise(F.concat(F.lit("_external/"), scheme(url), F.lit("_"), host(url), F.lit("/"), p))


def content_kind(content_type: Column, url: Column) -> Column:
    t = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return F.when(t.isin("text/html", "application/xhtml+xml") | url.rlike(r"\.html?$"), F.lit("html")).when((t == "text/css") | F.endswith(url, F.lit(".css")), F.lit("css"))


def internal_output_path(p: Column, base_path: str = "/") -> Column:
    """The file that a page of the site becomes."""
    bare = F.regexp_replace(p, "/+$", "")
    page = r"^(.*)/page/(\d+)$"
    return (
        F.when(bare == base_path.rstrip("/"), F.lit("/index.html"))
        .when(bare.rlike(page), F.concat(F.regexp_extract(bare, page, 1), F.lit("/page-"), F.regexp_extract(bare, page, 2), F.lit(".html")))
        .when(F.contains(last_segment(bare), F.lit(".")), p)
        .otherwise(F.concat(bare, F.lit(".html")))
    )


def asset_bucket(name: Column) -> Column:
    ext = F.lower(suffix(name))
    out = F.lit(None).cast("string")
    for folder, exts in BUCKETS.items():
        out = F.when(ext.isin(*exts), F.lit(folder)).otherwise(out)
    return out


def bare_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def type_suffix(content_type: Column) -> Column:
    """The suffix that a content type asks for, empty for others."""
    t, out = bare_type(content_type), F.lit("")
    for ext, types in _SUBTYPES.items():
        out = F.when(t.isin(*types), F.lit(ext)).otherwise(out)
    return out


def external_output_path(url: Column, content_hash: Column, disambiguate: Column, content_type: Column | None = None) -> Column:
    """Where another host's file goes: by kind, else by host; a name without a suffix gets that of its content type."""
    name = last_segment(F.regexp_replace(path(url), "/+$", ""))
    name = F.when(name == "", F.lit("index")).otherwise(name)
    if content_type is not None:
        name = F.when(suffix(name) == "", F.concat(name, type_suffix(content_type))).otherwise(name)
    name = F.when(disambiguate, F.concat(_stem(name), F.lit("-"), F.substring(content_hash, 1, 8), suffix(name))).otherwise(name)
    return F.concat(F.coalesce(asset_bucket(name), F.concat(F.lit("/assets/external/"), host(url), F.lit("/"))), name)


def relative_link(source: Column, target: Column) -> Column:
    """From one output file to another, as a relative path."""
    a = F.filter(F.split(F.regexp_replace(source, r"[^/]*$", ""), "/", -1), lambda x: x != "")
    b = F.filter(F.split(target, "/", -1), lambda x: x != "")
    # length of the common folder prefix
    common = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.least(F.size(a), F.size(b) - 1) - 1, F.lit(0))),
        F.lit(0),
        lambda n, i: F.when((n == i) & (i < F.least(F.size(a), F.size(b) - 1)) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n),
    )
    up = F.array_repeat(F.lit(".."), F.size(a) - common)
    return F.array_join(F.concat(up, F.slice(b, common + 1, F.size(b) - common)), "/")


def lookup_variants(url: Column, owned: Column) -> Column:
    """Every spelling of a URL worth a lookup, most specific first."""
    n, p, q, s = netloc(url), path(url), query(url), scheme(url)
    hosts = F.array(n, F.when(F.startswith(n, F.lit("www.")), F.substring(n, 5, 1 << 30)).otherwise(F.concat(F.lit("www."), n)))
    p = F.when(p == "", F.lit("/")).otherwise(p)
    other = F.when(F.endswith(p, F.lit("/")) & (F.length(p) > 1), F.regexp_replace(p, "/+$", "")).when(~F.endswith(p, F.lit("/")) & directory_like(p), F.concat(p, F.lit("/")))
    paths = F.array_compact(F.array(p, other))
    schemes = F.when(s == "http", F.array(F.lit("http"), F.lit("https"))).otherwise(F.array(F.lit("https"), F.lit("http")))
    reduced = F.when(owned & (q != ""), permalink_query(q))
    queries = F.array_distinct(F.array_compact(F.array(q, joined_query(query_pairs(q)), reduced)))
    each = F.flatten(F.transform(queries, lambda y: F.flatten(F.transform(schemes, lambda z: F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda x: unsplit(z, h, x, y))))))))
    return F.when(unparseable(url) | (n == ""), F.array(url)).otherwise(F.array_distinct(each))


def snapshot_time(url: Column) -> Column:
    """The 14 digits of an archived URL as a timestamp without zone, or NULL."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(url, r"/web/(\d{14})(?:id_)?/", 1), F.lit("")), F.lit("yyyyMMddHHmmss"))


def htaccess_safe(s: Column) -> Column:
    """Blanks, controls and DEL as %XX."""
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c).cast("bigint")), 2, "0"))).otherwise(c)), "")


def slug(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), "[^a-z0-9]+", "-")


def retry_after_seconds(v: Column, now: Column) -> Column:
    """Digits are seconds, an HTTP date the time until then (0 at least), anything else NULL."""
    t = F.trim(v)
    at = F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(t.rlike(r"^\d+$"), t.cast("double")).when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double")))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    h, m, x = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, x)).when(m > 0, F.format_string("%dm%02ds", m, x)).otherwise(F.format_string("%ds", x))


def unlikely_rewrite_target(url: Column) -> Column:
    """As ``unlikely_real``, but pages that end in a slash count: a failed lookup costs nothing."""
    return unparseable(url) | bare_asset_directory(url) | implausibly_long(url) | admin_infrastructure(url)


def parsed_for_links(kind: Column, final_url: Column, profile: SiteProfile) -> Column:
    """Whether a fetched resource is searched for links: HTML within the scope, CSS of any owned host."""
    return F.coalesce(F.when(kind == "css", profile.owns(host(final_url))).when(kind.isNotNull(), in_scope(final_url, profile)), F.lit(False))


def admitted(url: Column, kind: Column, context: Column, profile: SiteProfile) -> Column:
    """The normalised URL of a reference that may become a capture, else NULL.

    Hyperlinks stay within the scope; what renders may come from anywhere, but strings
    found in scripts and framed documents only from owned hosts.
    """
    n = normalize_for(url, profile)
    owned = profile.owns(host(n))
    ok = ((kind != "hyperlink") | in_scope(n, profile)) & (owned | ~(F.startswith(context, F.lit("script:")) | (context == "iframe[src]")))
    return F.when(ok, n)


def comparable(url: Column) -> Column:
    """A URL as home pages are compared: no slash at the end, lower case, no ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_replace(url, "/+$", "")), r"^([^:]*)://www\.", "$1://")


def snapshot_query(url: Column, api: str = "https://web.archive.org/cdx/search/cdx") -> Column:
    """The request for a URL's snapshots."""
    return F.concat(F.lit(api + "?url="), F.replace(F.replace(F.url_encode(url), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), F.lit("&output=json"))


def snapshot_url(timestamp: Column, original: Column, base: str = "https://web.archive.org") -> Column:
    """The address of a snapshot's bytes as they were."""
    return F.concat(F.lit(base + "/web/"), timestamp, F.lit("id_/"), original)
