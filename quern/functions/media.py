"""MIME types, media classes, column types and event kinds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The MIME type of each file extension.
MIME = {
    "css": "text/css",
    "js": "application/javascript", "mjs": "application/javascript",
    "ts": "application/typescript",
    "wasm": "application/wasm",
    "json": "application/json",
    "xml": "application/xml",
    "pdf": "application/pdf",
    "svg": "image/svg+xml",
    "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "avif": "image/avif",
    "bmp": "image/bmp", "tiff": "image/tiff",
    "ico": "image/x-icon",
    "mp4": "video/mp4", "webm": "video/webm",
    "ogg": "video/ogg", "mov": "video/quicktime",
    "avi": "video/x-msvideo",
    "mp3": "audio/mpeg", "wav": "audio/wav",
    "flac": "audio/flac", "aac": "audio/aac",
    "woff": "font/woff", "woff2": "font/woff2",
    "ttf": "font/ttf", "otf": "font/otf", "eot": "application/vnd.ms-fontobject",
    "html": "text/html", "htm": "text/html",
    "txt": "text/plain",
    "csv": "text/csv",
    "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "zip": "application/zip", "gz": "application/gzip",
}
#: MIME types of documents.
DOCUMENTS = (
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/epub+zip", "text/plain", "text/csv", "text/markdown",
)
#: Column types that merge without loss, and changes that lose data.
COMPATIBLE = (
    ("int", "bigint", "smallint", "serial", "bigserial"), ("text", "varchar", "char"), ("float", "double", "decimal", "numeric"),
    ("boolean", "bool"), ("timestamp", "timestamptz", "datetime"), ("json", "jsonb"),
)
LOSSY = (
    ("bigint", "int"), ("bigint", "smallint"), ("int", "smallint"), ("text", "varchar"), ("text", "char"), ("varchar", "char"),
    ("float", "int"), ("double", "int"), ("decimal", "int"), ("jsonb", "json"), ("timestamptz", "timestamp"),
)


def mime_of(url: Column) -> Column:
    """By the extension of a URL's path; null for unknown ones."""
    path = F.regexp_replace(url, "[?#].*$", "")
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), extension)


def sniff(content: Column, content_type: Column) -> Column:
    """MIME type of bytes: the header's, else by the first bytes."""
    header = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    start = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.trim(F.make_valid_utf8(F.substring(content, 1, 64).cast("string"))))
    svg = text.startswith("<svg") | (text.startswith("<?xml") & F.contains(text, F.lit("svg")))
    return (
        F.when(header != "", header)
        .when(start.startswith("89504E47"), "image/png")
        .when(start.startswith("FFD8FF"), "image/jpeg")
        .when(start.startswith("474946"), "image/gif")
        .when(start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250"), "image/webp")
        .when(start.startswith("25504446"), "application/pdf")
        .when(F.substring(start, 9, 8) == "66747970", "video/mp4")
        .when(start.startswith("494433") | start.startswith("FFFB"), "audio/mpeg")
        .when(svg, "image/svg+xml")
        .otherwise("application/octet-stream")
    )


def media_class(mime: Column) -> Column:
    m = F.lower(mime)
    out = F.when(m.isin(*DOCUMENTS), "document").otherwise("unknown")
    for kind in ("audio", "video", "image"):
        out = F.when(m.startswith(f"{kind}/"), kind).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def storage_category(node: Column, media: Column) -> Column:
    """Where content of a node belongs; the media class decides where there is one."""
    by_media = F.when(media == "unknown", "dom").when(media == "audio", "audio").when(media.isNotNull(), F.concat(media, F.lit("s")))
    by_node = F.when(node.isin("root", "index"), "metadata").when(node == "asset", "dom").otherwise("content")
    return F.coalesce(by_media, by_node)


def types_compatible(a: Column, b: Column) -> Column:
    out = a == b
    for group in COMPATIBLE:
        out = out | (a.isin(*group) & b.isin(*group))
    return out


def loses_data(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for x, y in LOSSY:
        out = out | ((a == x) & (b == y))
    return out


def event_subsystem(kind: Column) -> Column:
    return (
        F.when(kind == "diff-computed", "differential").when(kind == "rollback-complete", "recovery")
        .when(kind.isin("manifest-generated", "crawl-complete"), "coverage").otherwise("pipeline")
    )


def event_severity(kind: Column) -> Column:
    warned = kind.isin("stage-retrying", "approval-rejected", "pipeline-paused", "job-cancelled")
    return F.when(kind == "job-failed", "error").when(warned, "warn").otherwise("info")


def resource_priority(score: Column, security: Column, crawl: Column) -> Column:
    return (
        F.when((security >= 85) | (crawl >= 90), "SKIP").when(score >= 80, "CRITICAL").when(score >= 60, "HIGH")
        .when(score >= 40, "MEDIUM").when(score >= 20, "LOW").otherwise("SKIP")
    )


def download_advice(kind: Column, origin: Column, priority: Column, tags: Column) -> Column:
    own = origin.isin("same-domain", "subdomain")
    unwanted = (priority == "SKIP") | F.array_contains(tags, "analytics") | F.array_contains(tags, "advertising") | (kind == "api-endpoint")
    urgent = priority.isin("CRITICAL", "HIGH")
    return (
        F.when(unwanted, "SKIP").when(origin == "data-uri", "DOWNLOAD")
        .when(urgent & (own | ((origin == "cdn") & kind.isin("css", "font"))), "DOWNLOAD")
        .when(urgent, "REFERENCE")
        .when(priority == "MEDIUM", F.when(own, "DOWNLOAD").otherwise("REFERENCE"))
        .otherwise("DEFER")
    )
