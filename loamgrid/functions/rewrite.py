"""Document transforms: rewriting of references in place, policy removals, markup repairs.

Rewriting gets a page's own map from references as written to what they become and
leaves every other byte as it is. Removals and repairs are Column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import CSS_IMPORT, CSS_URL, HYPERLINK, RENDER, SHAPES

Resolve = Callable[[str], "str | None"]

_TOKEN = re.compile(r"(?is)<!--.*?-->|(<(script|style)\b[^>]*>)(.*?)(</\2\s*>)|(<[a-z][^>]*>)")
_ATTR = re.compile(r"""(?s)([a-zA-Z_:][-\w:.]*)(\s*=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)""")


def rewrite_srcset(value: str, resolve: Resolve) -> str:
    """Every candidate's URL, its descriptor kept."""
    out = []
    for part in value.split(","):
        words = part.split()
        if words:
            out.append(" ".join([resolve(words[0]) or words[0], *words[1:]]))
    return ", ".join(out)


def rewrite_css(css: str, resolve: Resolve) -> str:
    def swap(m: re.Match) -> str:
        new = resolve(m[1])
        return m[0] if new is None else m[0].replace(m[1], new)

    return re.sub(CSS_IMPORT, swap, re.sub(CSS_URL, swap, css))


def rewrite_json(value, resolve: Resolve):
    """Whole-string leaves only."""
    if isinstance(value, dict):
        return {k: rewrite_json(v, resolve) for k, v in value.items()}
    if isinstance(value, list):
        return [rewrite_json(v, resolve) for v in value]
    if isinstance(value, str):
        return resolve(value) or value
    return value


def rewrite_shaped(text: str, resolve: Resolve) -> str:
    """URL-shaped strings of a script; ``\\/`` counts as ``/`` and comes back where it stood."""
    plain, at, i = [], [], 0
    while i < len(text):
        at.append(i)
        i += 1 if text.startswith("\\/", i) else 0
        plain.append(text[i])
        i += 1
    at.append(len(text))
    whole = "".join(plain)
    found = sorted((m.start(1), m.end(1)) for p in SHAPES for m in re.finditer(p, whole))
    out, done = [], 0
    for a, b in found:
        new = resolve(whole[a:b]) if at[a] >= done else None
        if new is not None:
            escaped = "\\/" in text[at[a] : at[b]]
            out += [text[done : at[a]], new.replace("/", "\\/") if escaped else new]
            done = at[b]
    return "".join(out) + text[done:]


def rewrite_html(html: str, resolve: Resolve) -> str:
    def tag(text: str) -> str:
        name = re.match(r"<([a-zA-Z][\w:-]*)", text)[1].lower()

        def attribute(m: re.Match) -> str:
            key, quoted = m[1].lower(), m[3][0] in "\"'"
            value = m[3][1:-1] if quoted else m[3]
            plain = value.replace("&amp;", "&")
            if (name, key) in RENDER | HYPERLINK or (name, key) == ("link", "href") or (name == "meta" and key == "content") or key.startswith("data-") and "srcset" not in key:
                head, mark, tail = plain.partition("#")
                new = resolve(head) if head else None
                new = None if new is None else new + mark + tail
            elif "srcset" in key:
                new = rewrite_srcset(plain, resolve)
            elif key == "style":
                new = rewrite_css(plain, resolve)
            else:
                return m[0]
            if new is None or new == plain:
                return m[0]
            q = m[3][0] if quoted else '"'
            return f"{m[1]}{m[2]}{q}{new.replace('&', '&amp;')}{q}"

        return _ATTR.sub(attribute, text)

    def token(m: re.Match) -> str:
        if m[5]:
            return tag(m[5])
        if not m[1]:
            return m[0]
        body = m[3]
        if m[2].lower() == "style":
            body = rewrite_css(body, resolve)
        elif "json" in m[1].lower():
            try:
                body = json.dumps(rewrite_json(json.loads(body), resolve), ensure_ascii=False)
            except ValueError:
                body = rewrite_shaped(body, resolve)
        else:
            body = rewrite_shaped(body, resolve)
        return tag(m[1]) + body + m[4]

    return _TOKEN.sub(token, html)


def rewrite_pages(pages: DataFrame, targets: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, html) with each page's references replaced. ``targets``: (key, value, target); NULL targets change nothing.

    A page's map is built by one aggregate over its own references and travels with it.
    """
    maps = targets.where(F.col("target").isNotNull()).groupBy(key, "value").agg(F.min("target").alias("target"))
    maps = maps.groupBy(key).agg(F.collect_list(F.struct("value", "target")).alias("__map"))
    src = pages.select(key, html).join(maps, key, "left").select(F.col(key).alias("key"), F.col(html).alias("html"), "__map")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                new = [None if h is None else rewrite_html(h, {x["value"]: x["target"] for x in m or []}.get) for h, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=["key", "html"])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, html string").withColumnRenamed("key", key)


def reassemble_bundles(parts: DataFrame, bundle: str = "bundle", order: str = "pos", text: str = "text") -> DataFrame:
    """(bundle, text, n_parts, n_missing): component texts in order; a NULL text is a missing component."""
    got = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return parts.groupBy(bundle).agg(F.array_join(F.transform(got, lambda x: x[text]), "\n").alias("text"), F.count("*").alias("n_parts"), F.count_if(F.col(text).isNull()).alias("n_missing"))


#: Hosts that only measure: a reference whose host holds one of these is removed.
TELEMETRY = tuple(
    """analytics.tiktok.com bat.bing.com cdn.mxpnl.com cdn.segment.com clarity.ms connect.facebook.net doubleclick.net
    google-analytics.com googleadservices.com googlesyndication.com googletagmanager.com matomo.cloud pixel.wp.com
    quantserve.com s.pubmine.com scorecardresearch.com script.hotjar.com snap.licdn.com static.hotjar.com stats.wp.com""".split()
)
#: The same from a site's own host: parts of paths that plugins of that kind serve.
TELEMETRY_PATHS = tuple("/analytify /ga.js /gtag.js /gtag/js /matomo.js /matomo/ /piwik.js /piwik/ facebook-pixel frontend-gtag google-analytics googlesitekit wp-analytify wp-statistics".split())
#: What an inline script that measures says.
TELEMETRY_CALLS = tuple("MonsterInsights GoogleAnalyticsObject __gaTracker __gtagTracker _gaq.push _hjSettings _paq.push _stq.push clarity(' facebook.com/tr fbq('init' fbq('track' ga('create' ga('send' gtag( hj(' mi_track_user wp_analytify www.googletagmanager.com/gtm.js".split())


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace("/", "/") for w in words)


_URL = rf"(?:(?:https?:)?//[^/\"'?#]*(?:{_any(TELEMETRY)})|(?:(?:https?:)?//[^/\"'?#]*)?/?[^\"'?#]*(?:{_any(TELEMETRY_PATHS)}))"


def telemetry_reference(url: Column, keep: tuple[str, ...] = ()) -> Column:
    """A host that only measures, or a path of that kind on any host; hosts on the keep-list win."""
    from .urls import netloc, path, unparseable

    at, p = F.lower(netloc(url)), F.lower(path(url))
    has = lambda c, words: F.coalesce(c.rlike(_any(tuple(words))), F.lit(False)) if words else F.lit(False)
    return ~unparseable(url) & ~has(at, [k.lower() for k in keep if k]) & (has(at, TELEMETRY) | has(p, TELEMETRY_PATHS))


def strip_telemetry(html: Column) -> Column:
    """Without scripts, frames and pixels of measuring hosts or paths, and inline scripts that start them."""
    ref = rf"""[^>]*\b(?:src|href)=["']{_URL}[^"']*["'][^>]*"""
    out = F.regexp_replace(html, rf"(?is)<(script|iframe|noscript)\b{ref}>.*?</\1>", "")
    out = F.regexp_replace(out, rf"(?is)<(?:img|link){ref}/?>", "")
    inline = rf"(?s)<(?i:script)\b(?![^>]*\bsrc=)[^>]*>(?:(?!</script>).)*(?:{_any(TELEMETRY_CALLS)})(?:(?!</script>).)*</(?i:script)>"
    return F.regexp_replace(out, inline, "")


FORM = r"(?is)(<form\b.*?</form>)"


def forms(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(FORM), F.lit(1))


def strip_forms(html: Column, keep_search: bool = False) -> Column:
    """Without forms, search forms kept if asked for."""
    if not keep_search:
        return F.regexp_replace(html, FORM, "")
    return F.regexp_replace(html, r"""(?is)<form\b(?!(?:(?!</form>).)*(?:role="search"|name="s"|type="search")).*?</form>""", "")


def strip_feeds(html: Column) -> Column:
    """Without feed links and links to a site's machine interfaces."""
    out = F.regexp_replace(html, r"""(?i)<link\b[^>]*type=["']application/(?:rss|atom)\+xml["'][^>]*>""", "")
    return F.regexp_replace(out, r"""(?i)<link\b[^>]*rel=["'](?:pingback|EditURI|wlwmanifest|https://api\.w\.org/|shortlink|dns-prefetch)["'][^>]*>""", "")


def unwrap_login_links(html: Column) -> Column:
    """Anchors to log-in pages become their text."""
    return F.regexp_replace(html, r"""(?is)<a\b[^>]*href=["'][^"']*(?:/wp-login\.php|/wp-admin/?(?=["'?])|//wordpress\.com/log-in)[^"']*["'][^>]*>(.*?)</a>""", "$1")


def strip_action_bar(html: Column) -> Column:
    return F.regexp_replace(html, r"""(?is)<div\b[^>]*id=["']actionbar["'][^>]*>.*?</div>""", "")


def unwrap_dead_fragments(html: Column, ids: tuple[str, ...] = ("respond", "commentform", "comments")) -> Column:
    """Anchors to removed elements become their text."""
    return F.regexp_replace(html, rf"""(?is)<a\b[^>]*href=["'][^"'#]*#(?:{'|'.join(ids)})["'][^>]*>(.*?)</a>""", "$1")


def comment_count(text: Column) -> Column:
    """The first integer of a comments link, or NULL."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("int")


def apply_policy(html: Column, *, telemetry: bool = True, forms_: bool = True, keep_search: bool = False, feeds: bool = True, login: bool = True, action_bar: bool = True) -> Column:
    """The removals in their order; removal comes before rewriting, which would hide the hosts."""
    out = html
    for on, f in ((telemetry, strip_telemetry), (forms_, lambda h: unwrap_dead_fragments(strip_forms(h, keep_search))), (feeds, strip_feeds), (login, unwrap_login_links), (action_bar, strip_action_bar)):
        out = f(out) if on else out
    return out


def repair(html: Column) -> Column:
    """Five repairs: office tags unwrapped, border attributes and broken image sizes dropped, control
    characters removed, boolean attributes emptied."""
    out = F.regexp_replace(html, r"(?i)</?o:\w+[^>]*>", "")
    out = F.regexp_replace(out, r"""(?i)(<(?:a|img|object)\b[^>]*?)\s+border=(?:"[^"]*"|'[^']*'|\S+?)(?=[\s/>])""", "$1")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    out = F.regexp_replace(out, r"""(?i)(<img\b[^>]*?)\s+(?:width|height)=(?:"(?!\d+")[^"]*"|'(?!\d+')[^']*')""", "$1")
    return F.regexp_replace(out, r"""(?i)(<[a-z][^>]*?\s)(async|defer|checked|disabled|selected|autoplay|controls|loop|muted|required|readonly|multiple)=(?:"\2"|'\2'|"true"|'true')""", '$1$2=""')
