"""What HTML holds: tags, attributes, links, images, embeds, structured data. Built-in functions only.

Tags are found by regular expressions, as they stand in the text; a tag inside a comment
or a script counts as well. Null HTML gives null or empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import urls
from quern.functions.binding import bound

#: Attributes that hold the image of a lazily loaded tag, in order of preference.
LAZY = ("data-src", "data-original", "data-lazy-src", "data-lazy", "data-defer-src", "data-echo", "data-cfsrc", "data-img-src", "data-delayed-src")
LAZY_SRCSET = ("data-srcset", "data-lazy-srcset")
#: Parts of the names of images that stand in for others.
PLACEHOLDERS = (
    "blank.gif", "blank.png", "blank.jpg", "placeholder", "spacer", "spinner", "loading.gif", "loading.png", "1x1", "pixel.gif", "pixel.png",
    "transparent.gif", "transparent.png",
)
#: Endings of audio files.
AUDIO = (".mp3", ".ogg", ".wav", ".aac", ".flac", ".m4a", ".opus", ".weba")
#: Providers of embeds in order, with their media and what their host names hold.
PROVIDERS = (
    ("youtube", "embed", r"youtube\.com|youtube-nocookie\.com|^youtu\.be$"),
    ("vimeo", "embed", r"vimeo\.com"),
    ("tiktok", "embed", r"tiktok\.com"),
    ("dailymotion", "embed", r"dailymotion\.com"),
    ("wistia", "embed", r"wistia\.com|wistia\.net"),
    ("loom", "embed", r"loom\.com"),
    ("soundcloud", "audio", r"soundcloud\.com"),
    ("spotify", "audio", r"spotify\.com"),
)


def tags(html: Column, name: str) -> Column:
    """All opening tags ``name``, whole."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}(?:\s[^>]*)?>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in quotes, trimmed; null where the tag lacks it."""
    found = F.regexp_extract(tag, rf"""(?i)(?<=[\s"'])({name}\s*=\s*(?:"[^"]*"|'[^']*'))""", 1)
    return bound(found, lambda f: F.when(f != "", F.trim(F.regexp_extract(f, r"""=\s*["']([^"']*)["']$""", 1))))


def values(html: Column, name: str, attr: str) -> Column:
    """Values of an attribute of all tags ``name``, in order, without empty ones."""
    return F.filter(F.transform(tags(html, name), lambda t: attribute(t, attr)), lambda v: v != "")


def _with(html: Column, tag_name: str, **needs: str) -> Column:
    """Tags whose attributes hold the words given, as ``rel="preload"``."""
    return _of(tags(html, tag_name), **needs)


def _of(found: Column, **needs: str) -> Column:

    def fits(tag: Column) -> Column:
        ok = F.lit(True)
        for k, v in needs.items():
            ok = ok & F.coalesce(F.lower(attribute(tag, k.rstrip("_"))).rlike(rf"(^|\s){v}(\s|$)"), F.lit(False))
        return ok

    return F.filter(found, fits)


def hrefs(html: Column) -> Column:
    """What ``<a href>`` holds, in order."""
    return F.filter(F.transform(tags(html, "a"), lambda t: attribute(t, "href")), lambda h: h.isNotNull())


def meta_content(html: Column, name: str, key: str = "name") -> Column:
    """The content of the first ``<meta name=...>`` (or another ``key``); null where there is none."""
    return content_of(tags(html, "meta"), name, key)


def content_of(metas: Column, name: str, key: str = "name") -> Column:
    """As :func:`meta_content`, of the meta tags of a page."""
    return F.nullif(attribute(F.get(_of(metas, **{key: name}), 0), "content"), F.lit(""))


def meta_tags(html: Column) -> Column:
    """Map of lowered names to contents; of a repeated name the last counts."""
    entries = F.transform(tags(html, "meta"), lambda t: F.struct(F.lower(attribute(t, "name")).alias("key"), attribute(t, "content").alias("value")))
    entries = F.filter(entries, lambda e: e["key"].isNotNull() & (e["value"] != ""))
    return bound(F.reverse(entries), lambda rows: F.map_from_entries(F.reverse(_first_of(rows, "key"))))


def cookies(header: Column) -> Column:
    """``name=value`` of each cookie of a Set-Cookie header; commas inside dates do not part cookies."""
    parts = F.transform(F.split(header, r",(?=\s*[A-Za-z0-9_-]+=)"), lambda c: F.trim(F.substring_index(F.trim(c), ";", 1)))
    return F.filter(parts, lambda c: F.contains(c, F.lit("=")) & ~c.rlike("^[0-9]"))


def srcset(value: Column) -> Column:
    """Entries of a srcset: array of (url, width, density), data URIs left out."""
    def entry(part: Column) -> Column:
        words = F.split(part, r"\s+")
        what = F.get(words, 1)
        return F.struct(
            words[0].alias("url"),
            F.nullif(F.regexp_extract(what, r"(?i)^([0-9]{1,9})w$", 1), F.lit("")).cast("int").alias("width"),
            F.nullif(F.regexp_extract(what, r"(?i)^([0-9]+\.?[0-9]*|\.[0-9]+)x$", 1), F.lit("")).cast("double").alias("density"),
        )

    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith("data:"))
    return F.transform(parts, entry)


def best_of_srcset(value: Column) -> Column:
    """The widest entry's URL, without widths the densest, else the first; the first of equals."""
    order = F.transform(
        srcset(value),
        lambda e, i: F.struct(F.coalesce(e["width"], F.lit(-1)).alias("w"), F.coalesce(e["density"], F.lit(-1.0)).alias("d"), (-i).alias("i"), e["url"].alias("url")),
    )
    return F.array_max(order)["url"]


def css_backgrounds(css: Column) -> Column:
    found = F.regexp_extract_all(css, F.lit(r"""(?i)background(?:-image)?\s*:\s*url\s*\(\s*['"]?([^'")\s]+)['"]?\s*\)"""), F.lit(1))
    return F.filter(found, lambda u: (u != "") & ~u.startswith("data:"))


def css_colors(css: Column) -> Column:
    """Hexadecimal colours of three or six digits, in order, lowered."""
    return F.transform(F.regexp_extract_all(css, F.lit(r"#([0-9a-fA-F]{6}\b|[0-9a-fA-F]{3}\b)"), F.lit(0)), F.lower)


def is_placeholder(src: Column) -> Column:
    named = src.rlike("(?i)" + "|".join(p.replace(".", "[.]") for p in PLACEHOLDERS))
    return F.coalesce((src == "") | (src == "about:blank") | (src.startswith("data:") & (F.length(src) < 200)) | named, F.lit(True))


def images(html: Column, url: Column) -> Column:
    """Images of a page: array of (url, method), resolved, each normalised URL once, by the
    first method that finds it: head tags, noscript, picture sources, posters, lazy
    attributes, src, srcset, inline backgrounds."""
    resolved = _resolved_images(F.filter(_image_candidates(html), lambda c: ~c["raw"].startswith("data:")), url)
    return bound(F.filter(resolved, lambda c: c["url"].isNotNull()), lambda rows: _first_of(rows, "url"))


def image_report(html: Column, url: Column) -> Column:
    """How the images of a page came about, as a struct: discovered, how many candidates there
    are; data_uris, invalid and duplicates, how many of them are left out for that; lazy,
    srcset, picture, backgrounds, noscript and og, how many of those kinds; final, how many
    are left. Each candidate is in one of data_uris, invalid, duplicates and final."""

    def told(rows: Column) -> Column:
        valid = F.filter(rows, lambda c: c["url"].isNotNull() & ~c["raw"].startswith("data:"))

        def counts(valid: Column, final: Column) -> Column:
            n = lambda rows_, *methods: F.size(F.filter(rows_, lambda c: c["method"].isin(*methods)))
            data = F.size(F.filter(rows, lambda c: c["raw"].startswith("data:")))
            return F.struct(
                F.size(rows).alias("discovered"), data.alias("data_uris"), (F.size(rows) - data - F.size(valid)).alias("invalid"), (F.size(valid) - F.size(final)).alias("duplicates"),
                n(final, "lazy").alias("lazy"), n(final, "srcset_best", "noscript_srcset_best", "picture_srcset").alias("srcset"), n(rows, "picture_srcset", "picture_src").alias("picture"),
                n(rows, "css_background_inline").alias("backgrounds"), n(final, "noscript_src", "noscript_srcset_best").alias("noscript"), n(rows, "og_meta").alias("og"), F.size(final).alias("final"),
            )

        return bound(valid, lambda v: bound(_first_of(v, "url"), lambda final: counts(v, final)))

    return bound(_resolved_images(_image_candidates(html, sources="picture_"), url), told)


def image_urls(html: Column, url: Column) -> Column:
    """The URLs of :func:`images` as a set, without what found them."""
    raw = F.transform(F.filter(_image_candidates(html), lambda c: ~c["raw"].startswith("data:")), lambda c: c["raw"])
    return F.array_distinct(F.array_compact(F.transform(F.array_distinct(raw), lambda r: _full_image(r, url))))


def _full_image(raw: Column, url: Column) -> Column:
    return bound(urls.resolve(url, raw), lambda link: urls.normalize(link, ("",)))


def _resolved_images(candidates: Column, url: Column) -> Column:
    return F.transform(candidates, lambda c: F.named_struct(F.lit("url"), _full_image(c["raw"], url), F.lit("method"), c["method"], F.lit("raw"), c["raw"]))


def _image_candidates(html: Column, sources: str = "") -> Column:
    """All that may be images, in order, as (raw, method). The methods of the sources of a
    picture are those of its kind, or with ``sources`` names of their own."""

    def found(urls_: Column, method: str) -> Column:
        return F.transform(F.filter(urls_, lambda u: u != ""), lambda u: F.struct(u.alias("raw"), F.lit(method).alias("method")))

    def first(value: Column) -> Column:
        return F.array_compact(F.array(value))

    def real(t: Column, name: str) -> Column:
        return bound(attribute(t, name), lambda v: F.when(~is_placeholder(v), v))

    def lazy(t: Column) -> Column:
        # An image without any such attribute is told by one look.
        found_ = F.coalesce(*(real(t, a) for a in LAZY), *(best_of_srcset(attribute(t, a)) for a in LAZY_SRCSET))
        return F.when(t.rlike(r"(?i)\sdata-"), found_)

    shown = F.regexp_replace(html, r"(?is)<noscript[^>]*>.*?</noscript>", "")
    hidden = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<noscript[^>]*>(.*?)</noscript>"), F.lit(1)), " ")
    seen = bound(shown, lambda s: F.struct(s.alias("html"), tags(s, "img").alias("imgs"), F.array_join(F.regexp_extract_all(s, F.lit(r"(?is)<picture[^>]*>(.*?)</picture>"), F.lit(1)), " ").alias("pictures")))
    parts = F.struct(seen.alias("seen"), hidden.alias("hidden"), tags(html, "meta").alias("metas"))
    return bound(parts, lambda p: _found_in(html, p["seen"]["html"], p["seen"]["imgs"], p["seen"]["pictures"], p["hidden"], p["metas"], found, first, real, lazy, sources))


def _found_in(html, shown, imgs, pictures, hidden, metas, found, first, real, lazy, sources) -> Column:
    own = F.transform(imgs, lambda t: real(t, "src"))
    return F.concat(
        found(first(F.coalesce(content_of(metas, "og:image", "property"), content_of(metas, "og:image:secure_url", "property"))), "og_meta"),
        found(first(F.coalesce(*(content_of(metas, n, k) for n in ("twitter:image", "twitter:image:src") for k in ("name", "property")))), "twitter_meta"),
        found(F.transform(_with(html, "link", rel="preload", as_="image"), lambda t: attribute(t, "href")), "link_preload"),
        found(values(hidden, "img", "src"), "noscript_src"),
        found(F.transform(values(hidden, "img", "srcset"), best_of_srcset), "noscript_srcset_best"),
        found(F.transform(values(pictures, "source", "srcset"), best_of_srcset), "picture_srcset" if sources else "srcset_best"),
        found(values(pictures, "source", "src"), "picture_src" if sources else "src"),
        found(values(shown, "video", "poster"), "video_poster"),
        found(F.array_compact(F.transform(imgs, lazy)), "lazy"),
        found(F.array_compact(own), "src"),
        found(F.array_compact(F.transform(imgs, lambda t: best_of_srcset(attribute(t, "srcset")))), "srcset_best"),
        found(F.flatten(F.transform(F.regexp_extract_all(shown, F.lit(r"""(?i)\sstyle\s*=\s*"([^"]*)\""""), F.lit(1)), css_backgrounds)), "css_background_inline"),
    )


def _first_of(rows: Column, key: str) -> Column:
    """The first struct of each ``key``, in order."""
    return bound(F.transform(rows, lambda r: r[key]), lambda keys: F.filter(rows, lambda r, i: F.array_position(keys, r[key]) == i + 1))


def embed_provider(host: Column) -> Column:
    """(provider, media) of an embed's host; the first rule that fits, else an unknown frame."""
    out = F.struct(F.lit("unknown_iframe").alias("provider"), F.lit("embed").alias("media"))
    for name, media, pattern in reversed(PROVIDERS):
        out = F.when(host.rlike(pattern), F.struct(F.lit(name).alias("provider"), F.lit(media).alias("media"))).otherwise(out)
    return out


def embed_canonical(url: Column) -> Column:
    """The page that an embed shows; null where its URL does not tell."""
    parts = F.struct(url.alias("url"), urls.host(url).alias("host"), urls.route(url).alias("path"), embed_provider(urls.host(url))["provider"].alias("kind"))
    return bound(parts, lambda p: _canonical(p["url"], p["host"], p["path"], p["kind"]))


def _canonical(url: Column, host: Column, path: Column, kind: Column) -> Column:

    def part(pattern: str, before: str) -> Column:
        found = F.regexp_extract(path, pattern, 1)
        return F.when(found != "", F.concat(F.lit(before), found))

    watch = "https://www.youtube.com/watch?v="
    short = F.when(host == "youtu.be", part("^/([^/]{11})(?:/|$)", watch))
    keyed = F.regexp_extract(url, "[?&]v=([^&#]+)", 1)
    youtube = F.coalesce(part(r"/embed/([a-zA-Z0-9_-]{11})", watch), short, F.when(keyed != "", F.concat(F.lit(watch), keyed)))
    track = F.regexp_extract(url, "[?&]url=([^&#]+)", 1)
    return (
        F.when(kind == "youtube", youtube)
        .when(kind == "vimeo", F.coalesce(part("/video/([0-9]+)", "https://vimeo.com/"), part("^/([0-9]+)", "https://vimeo.com/")))
        .when(kind == "tiktok", part("/embed(?:/v2)?/([0-9]+)", "https://www.tiktok.com/video/"))
        .when(kind == "dailymotion", part("/embed/video/([a-zA-Z0-9]+)", "https://www.dailymotion.com/video/"))
        .when(kind == "wistia", F.coalesce(part("/embed/iframe/([a-zA-Z0-9]+)", "https://fast.wistia.com/embed/iframe/"), url))
        .when(kind == "loom", part("/embed/([a-f0-9]+)", "https://www.loom.com/share/"))
        .when(kind == "soundcloud", F.when(track != "", F.try_url_decode(track)).otherwise(url))
        .when(kind == "spotify", part("/embed/((?:track|album|playlist|episode|show)/[a-zA-Z0-9]+)", "https://open.spotify.com/"))
    )


def is_audio(url: Column) -> Column:
    ending = F.regexp_extract(F.lower(urls.route(url)), r"(\.[^.]*)$", 1)
    return F.coalesce(ending.isin(*AUDIO), F.lit(False))


def embeds(html: Column, url: Column) -> Column:
    """Embeds of a page: array of (url, provider, media, canonical), each URL once: video and
    audio tags with their sources, frames, and links to audio files."""
    return bound(_embed_rows(html, url), _embeds_once)


def _embeds_once(rows: Column) -> Column:
    keyed = F.transform(rows, lambda r: F.named_struct(F.lit("key"), F.regexp_replace(F.lower(F.trim(r["url"])), "#.*$", ""), F.lit("r"), r))
    return bound(F.filter(keyed, lambda k: k["key"].isNotNull()), lambda rows_: F.transform(_first_of(rows_, "key"), lambda k: k["r"]))


def embed_report(html: Column, url: Column) -> Column:
    """How the embeds of a page came about, as a struct: total, how many there are; no_canonical,
    those of them without a page to link to; by_provider, a map of counts; and of all that
    was found, repeats too: videos and audios of the page's own, frames, sounds (frames and
    links), unsupported frames, duplicates, and errors, sources that are no URL."""

    def told(rows: Column) -> Column:
        valid = F.filter(rows, lambda r: r["url"].isNotNull())
        n = lambda rows_, test: F.size(F.filter(rows_, test))
        sounds = lambda r: (r["provider"] == "unknown_audio") | (~r["provider"].startswith("native_") & (r["media"] == "audio"))

        def counts(valid: Column, once: Column) -> Column:
            providers = F.transform(once, lambda r: r["provider"])
            each = F.transform(F.array_sort(F.array_distinct(providers)), lambda p: F.struct(p.alias("key"), F.size(F.filter(providers, lambda x: x == p)).alias("value")))
            return F.struct(
                F.size(once).alias("total"), n(once, lambda r: r["canonical"].isNull()).alias("no_canonical"), F.map_from_entries(each).alias("by_provider"),
                n(valid, lambda r: r["provider"] == "native_video").alias("videos"), n(valid, lambda r: r["provider"] == "native_audio").alias("audios"),
                n(valid, lambda r: ~r["provider"].startswith("native_") & ~sounds(r)).alias("frames"), n(valid, sounds).alias("sounds"),
                n(valid, lambda r: r["provider"] == "unknown_iframe").alias("unsupported"), (F.size(valid) - F.size(once)).alias("duplicates"), (F.size(rows) - F.size(valid)).alias("errors"),
            )

        return bound(valid, lambda v: bound(_embeds_once(v), lambda once: counts(v, once)))

    return bound(_embed_rows(html, url), told)


def _embed_rows(html: Column, url: Column) -> Column:

    def native(name: str) -> Column:
        inside = F.array_join(F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"), F.lit(1)), " ")
        both = F.concat(values(html, name, "src"), values(inside, "source", "src"))
        links = F.transform(F.filter(both, lambda s: ~s.startswith("data:")), lambda s: urls.resolve(url, s))
        return F.transform(links, lambda link: made(link, F.lit(f"native_{name}"), F.lit(name), link))

    def made(link: Column, provider: Column, media: Column, canonical: Column) -> Column:
        return F.named_struct(F.lit("url"), link, F.lit("provider"), provider, F.lit("media"), media, F.lit("canonical"), canonical)

    def framed(src: Column) -> Column:
        kind = lambda link: bound(embed_provider(urls.host(link)), lambda k: made(link, k["provider"], k["media"], embed_canonical(link)))
        return bound(urls.resolve(url, src), kind)

    frames = F.array_compact(F.transform(tags(html, "iframe"), lambda t: F.coalesce(F.nullif(attribute(t, "src"), F.lit("")), attribute(t, "data-src"))))
    frames = F.filter(frames, lambda s: (s != "") & ~s.rlike("^(about:|javascript:|data:)"))
    heard = F.filter(F.transform(hrefs(html), lambda h: urls.resolve(url, h)), is_audio)
    heard = F.transform(heard, lambda link: made(link, F.lit("unknown_audio"), F.lit("audio"), link))
    return F.concat(native("video"), native("audio"), F.transform(frames, framed), heard)


#: Labels of what pages of a framework hold, with the patterns.
SIGNS = (
    ("next-data-script", "__NEXT_DATA__"), ("next-static-path", r"(?i)_next/static/"), ("astro-island-element", "(?i)<astro-island"), ("astro-static-path", "(?i)_astro/"),
    ("react-root-attr", "data-reactroot"), ("react-data-attr", "(?i)data-react-"), ("wp-content-path", "(?i)wp-content/"), ("wp-includes-path", "(?i)wp-includes/"),
    ("wp-version-param", r"(?i)\?ver=[0-9]"), ("laravel-session", "(?i)laravel_session"), ("csrf-meta-token", "(?i)<meta[^>]+csrf-token"), ("next-window-global", r"(?i)window\.__next"),
    ("astro-data-attr", "(?i)data-astro-"), ("webpack-runtime", "(?i)__webpack_require__"), ("react-dom-ref", "(?i)react-dom"), ("next-image-path", "(?i)/_next/image"),
    ("next-router-ref", "(?i)next-router"), ("xsrf-token", "(?i)XSRF-TOKEN"),
)


def signs(html: Column) -> Column:
    """Labels of the signs that a page holds, in order."""
    return F.array_compact(F.array(*(F.when(html.rlike(p), n) for n, p in SIGNS)))



def structured_data(html: Column) -> Column:
    """JSON-LD entries of a page: array of (type, valid). An entry without @type is Unknown and,
    as one without @context, not valid; what does not parse is one ParseError."""
    texts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    texts = F.filter(F.transform(texts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")

    def entry(m: Column) -> Column:
        kind, context = F.try_element_at(m, F.lit("@type")), F.try_element_at(m, F.lit("@context"))
        full = (F.coalesce(kind, F.lit("")) != "") & (F.coalesce(context, F.lit("")) != "")
        return F.struct(F.coalesce(kind, F.lit("Unknown")).alias("type"), full.alias("valid"))

    broken = F.array(F.struct(F.lit("ParseError").alias("type"), F.lit(False).alias("valid")))

    def parsed(t: Column) -> Column:
        one, many = F.from_json(t, "map<string,string>"), F.from_json(t, "array<map<string,string>>")
        return F.when(t.startswith("["), F.coalesce(F.transform(many, entry), broken)).otherwise(F.when(one.isNull(), broken).otherwise(F.array(entry(one))))

    return F.flatten(F.transform(texts, parsed))


def headings(html: Column) -> Column:
    """Levels of the headings, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])[\s>]"), F.lit(1)), lambda x: x.cast("int"))


def next_page(html: Column, url: Column) -> Column:
    """The next page of a list: rel="next", else a link that says so, else a link of the same
    host that names the page number after this one's; null where there is none."""
    linked = F.concat(_with(html, "a", rel="next"), _with(html, "link", rel="next"))
    by_rel = F.get(F.filter(F.transform(linked, lambda t: urls.resolve(url, attribute(t, "href"))), lambda u: u.isNotNull()), 0)
    return F.coalesce(by_rel, bound(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0)), lambda anchors: _next_of(anchors, url)))


def _next_of(anchors: Column, url: Column) -> Column:
    says = r"(?i)^(next|next\s*page|›|»|→|>|&gt;)$"

    def says_next(a: Column) -> Column:
        label = F.coalesce(attribute(F.regexp_extract(a, "(?s)^<[^>]*>", 0), "aria-label"), F.lit(""))
        return F.trim(F.regexp_replace(a, "(?s)<[^>]+>", "")).rlike(says) | label.rlike(says)

    def target(a: Column) -> Column:
        return urls.resolve(url, attribute(F.regexp_extract(a, "(?s)^<[^>]*>", 0), "href"))

    same = lambda u: u.isNotNull() & (urls.authority(u) == urls.authority(url))
    by_text = F.get(F.filter(F.transform(F.filter(anchors, says_next), target), same), 0)
    by_number = F.get(F.filter(F.transform(anchors, target), lambda u: same(u) & urls.is_page_of_list(u, urls.page_number(url) + 1)), 0)
    return F.coalesce(by_text, by_number)


def resources(html: Column, url: Column) -> Column:
    """Resources that a page loads: array of (url, kind), resolved, each once: style sheets,
    preloads, scripts, images, srcsets, sources, CSS references, imports, icons, media."""

    def group(pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda u: F.struct(u.alias("raw"), F.lit(kind).alias("kind")))

    entries = F.regexp_extract_all(html, F.lit(r"""(?i)srcset=["']([^"']+)["']"""), F.lit(1))
    parts = F.flatten(F.transform(entries, lambda s: F.transform(srcset(s), lambda e: e["url"])))
    rows = F.concat(
        group(r"""(?i)<link[^>]+rel=["']stylesheet["'][^>]*href=["']([^"']+)["']""", "style"),
        group(r"""(?i)<link[^>]+rel=["']preload["'][^>]*href=["']([^"']+)["'][^>]*as=["'][^"']+["']""", "preload"),
        group(r"""(?i)<script[^>]+src=["']([^"']+)["']""", "script"),
        group(r"""(?i)<img[^>]+src=["']([^"']+)["']""", "image"),
        F.transform(parts, lambda u: F.struct(u.alias("raw"), F.lit("srcset").alias("kind"))),
        group(r"""(?i)<source[^>]+src=["']([^"']+)["']""", "source"),
        group(r"""(?i)url\(["']?([^"')]+)["']?\)""", "css"),
        group(r"""(?i)@import\s+(?:url\()?["']?([^"');]+)["']?\)?""", "style"),
        group(r"""(?i)<link[^>]+rel=["'][^"']*icon[^"']*["'][^>]*href=["']([^"']+)["']""", "icon"),
        group(r"""(?i)<(?:video|audio)[^>]+src=["']([^"']+)["']""", "media"),
    )
    rows = F.filter(rows, lambda r: ~r["raw"].startswith("#") & ~((r["kind"] == "css") & r["raw"].startswith("data:")))
    made = F.transform(rows, lambda r: F.named_struct(F.lit("url"), urls.resolve(url, r["raw"]), F.lit("kind"), r["kind"]))
    return bound(F.filter(made, lambda r: r["url"].isNotNull()), lambda found: _first_of(found, "url"))
