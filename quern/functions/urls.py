"""URL expressions. Each is a Column made of built-in functions, so scans stay in the JVM.

Parsing follows the generic form scheme://host/path?query#fragment; host names are not
punycoded and percent signs are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.binding import bound

#: Query parameters that do not tell pages apart.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_reader", "fbclid", "gclid", "gclsrc",
    "dclid", "msclkid", "mc_eid", "mc_cid", "_ga", "_gl", "ref", "referral", "source", "campaign", "medium", "yclid", "twclid",
    "igshid", "_hsenc", "_hsmi", "mkt_tok", "vero_id", "icid", "oly_enc_id", "oly_anon_id", "rb_clickid", "s_cid",
)
#: Schemes that are never followed, extensions and paths that are no pages.
BLOCKED_SCHEMES = ("mailto", "javascript", "tel", "sms", "data", "ftp", "file", "callto", "skype", "viber", "whatsapp", "tg")
BLOCKED_EXTENSION = (
    r"(?i)\.(jpg|jpeg|png|gif|webp|svg|avif|bmp|tiff|ico|pdf|zip|gz|tar|bz2|7z|rar|mp3|mp4|webm|ogg|wav|flac|aac|m4a|woff|woff2"
    r"|ttf|eot|otf|css|js|jsx|ts|tsx|json|xml|yaml|yml|csv|xls|xlsx|xlsm|doc|docx|ppt|pptx|exe|dmg|apk|pkg|deb|rpm|iso|img)$"
)
BLOCKED_PATH = (
    r"(?i)/(wp-admin|wp-json|wp-cron|wp-login|xmlrpc\.php|feed|rss|atom|login|logout|signup|register|cart|checkout|account"
    r"|my-account|\.well-known|cdn-cgi|__cf_chl|apple-app-site-association)\b"
)
#: Query keys that name a page of a list, in order of preference.
PAGE_KEYS = ("page", "p", "pg", "paged", "pagenum")
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
#: The host name without user, password and port.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: User, host and port.
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), HOST, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), AUTHORITY, 1))


def route(url: Column) -> Column:
    """The path, ``/`` where there is none."""
    path = F.regexp_extract(F.trim(url), PATH, 1)
    return F.when(path == "", "/").otherwise(path)


def normalize(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Scheme and host in lower case, no fragment, no ``tracking`` parameters, no slash at
    the end. What is no URL is lowered and cut at its fragment and last slash."""
    text = F.trim(url)
    path = route(url)
    kept = F.array_join(
        F.filter(F.split(F.regexp_extract(text, QUERY, 1), "&"), lambda x: (x != "") & ~F.substring_index(x, "=", 1).isin(*tracking)), "&"
    )
    good = F.concat(
        F.lower(F.regexp_extract(text, SCHEME, 1)), F.lit("://"), authority(url),
        F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path),
        F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)),
    )
    bad = F.regexp_replace(F.regexp_replace(F.lower(text), "#.*$", ""), "/$", "")
    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), good).otherwise(bad)


def skip_reason(url: Column, own_host: Column) -> Column:
    """Why a crawl leaves a link out, in order of the checks; null where it follows it."""
    text = F.trim(url)
    return (
        F.when(F.lower(F.regexp_extract(text, "^([A-Za-z]+):", 1)).isin(*BLOCKED_SCHEMES), "protocol")
        .when(~text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), "protocol")
        .when(host(url) != own_host, "external")
        .when(route(url).rlike(BLOCKED_EXTENSION), "extension")
        .when(route(url).rlike(BLOCKED_PATH), "path")
    )


def resolve(base: Column, href: Column) -> Column:
    """``href`` as a link on the page ``base``: absolute, with ``.`` and ``..`` taken out of its
    path and scheme and host in lower case; other schemes (mailto:) stay as they are. Null
    where the base is no URL and the link not absolute."""
    link = F.trim(href)
    start = F.regexp_extract(base, r"^\s*([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+)", 1)
    folder = F.regexp_extract(route(base), r"^(.*/)[^/]*$", 1)
    absolute = link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    whole = (
        F.when(absolute, link)
        .when(origin == "", F.lit(None))
        .when(link.startswith("//"), F.concat(start, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link == "", F.regexp_replace(F.trim(base), "#.*$", ""))
        .when(link.startswith("?"), F.concat(origin, route(base), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(F.trim(base), "#.*$", ""), link))
        .otherwise(F.concat(origin, folder, link))
    )
    return bound(whole, lambda w: F.when(w.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), _tidy(w)).otherwise(w))


def _tidy(url: Column) -> Column:
    """Scheme and host lowered, dot segments gone."""
    parts = F.slice(F.split(route(url), "/"), 2, 1 << 30)
    last = F.element_at(parts, -1)
    up = F.aggregate(
        parts, F.lit(""),
        lambda path, x: F.when(x == "..", F.regexp_replace(path, "/[^/]*$", "")).when(x == ".", path).otherwise(F.concat(path, F.lit("/"), x)),
    )
    path = F.concat(up, F.when(last.isin(".", ".."), "/").otherwise(""))
    rest = F.regexp_extract(url, r"^[^?#]*([?#].*)$", 1)
    return F.concat(F.lower(F.regexp_extract(url, SCHEME, 1)), F.lit("://"), authority(url), F.when(path == "", "/").otherwise(path), rest)


def resolve_normalized(base: Column, href: Column) -> Column:
    return bound(resolve(base, href), lambda link: normalize(link))


#: Paths and extensions that a page link may not have.
NO_PAGE_PATH = r"(?i)/(wp-admin|wp-json|wp-cron|xmlrpc\.php|feed|rss|atom|login|logout|signup|register|\.well-known)"
NO_PAGE_EXTENSION = (
    r"(?i)\.(jpg|jpeg|png|gif|webp|svg|avif|bmp|tiff|ico|pdf|zip|gz|tar|mp3|mp4|webm|ogg|wav|flac|woff|woff2|ttf|eot|css|js|json|xml|txt"
    r"|csv|xls|xlsx|doc|docx|exe|dmg|apk)$"
)


def is_page_link(url: Column, own_authority: Column) -> Column:
    """Whether a resolved link leads to a page of the same host and port."""
    path = route(url)
    ok = (authority(url) == own_authority) & (own_authority != "") & ~path.rlike(NO_PAGE_PATH) & ~path.rlike(NO_PAGE_EXTENSION)
    return F.coalesce(ok, F.lit(False))


def is_page_of_list(url: Column, number: Column) -> Column:
    """Whether a URL names page ``number`` of a list."""
    n = number.cast("string")
    keyed = F.lit(False)
    for k in PAGE_KEYS:
        keyed = keyed | (F.regexp_extract(url, rf"[?&]{k}=([^&#]*)", 1) == n)
    path = route(url)
    return keyed | F.contains(path, F.concat(F.lit("/page/"), n)) | F.endswith(path, F.concat(F.lit("/"), n)) | F.endswith(path, F.concat(F.lit("/"), n, F.lit("/")))


def page_number(url: Column) -> Column:
    """Which page of a list a URL names, 1 by default."""
    found = [F.regexp_extract(url, rf"[?&]{k}=([0-9]+)(&|#|$)", 1) for k in PAGE_KEYS]
    found += [F.regexp_extract(route(url), r"(?i)/page/([0-9]+)", 1), F.regexp_extract(route(url), r"/([0-9]+)/?$", 1)]
    return F.coalesce(*(F.when(f != "", f.cast("long")) for f in found), F.lit(1).cast("long"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def slug(path: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit("home"))


def parent_route(path: Column) -> Column:
    """The route above; null above the root."""
    parts = segments(path)
    up = F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    return F.when(F.size(parts) > 0, up)


def node_id(url: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of the URL without a slash or fragment at its end."""
    return F.substring(F.sha2(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "/$", ""), "#.*$", ""), 256), 1, 16)


def path_categories(path: Column, most: int = 4) -> Column:
    return F.slice(
        F.filter(F.transform(segments(path), F.lower), lambda s: ~s.rlike("^[0-9]+$") & ~s.rlike(r"\.(html|php|aspx)$")), 1, most
    )


def site(host_: Column) -> Column:
    return F.regexp_replace(host_, r"^www\.", "")


#: Hosts that deliver for others.
CDN_HOSTS = (
    "cdn.jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com", "cdn.skypack.dev",
    "ajax.googleapis.com", "fonts.googleapis.com", "fonts.gstatic.com",
    "d3js.org", "code.jquery.com", "maxcdn.bootstrapcdn.com",
    "stackpath.bootstrapcdn.com", "cdn.bootcss.com", "cdn.staticfile.org",
    "res.cloudinary.com", "img.cloudinary.com", "imagekit.io",
    "fastly.net", "akamaized.net", "cloudfront.net", "azureedge.net",
    "cdn.shopify.com", "static.wixstatic.com", "s3.amazonaws.com",
    "storage.googleapis.com", "blob.core.windows.net",
)


def host_origin(host_: Column, seed: Column) -> Column:
    """Where a resource lies as seen from a seed host; no host: a data URI."""
    cdn = F.lit(False)
    for c in CDN_HOSTS:
        cdn = cdn | (host_ == c) | host_.endswith(f".{c}")
    return (
        F.when(host_ == "", "data-uri")
        .when(host_ == seed, "same-domain")
        .when((host_ == site(seed)) | host_.endswith(F.concat(F.lit("."), site(seed))), "subdomain")
        .when(cdn, "cdn")
        .otherwise("external")
    )
