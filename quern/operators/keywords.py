"""Pages bound to the endpoints and models whose words they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of one kind of resource.
RESOURCE_WORDS = {
    "user": ("user", "users", "account", "accounts", "profile", "me", "auth"),
    "post": ("post", "posts", "article", "articles", "blog", "entry"),
    "comment": ("comment", "comments", "reply", "replies", "feedback"),
    "product": ("product", "products", "item", "items", "catalog", "sku"),
    "order": ("order", "orders", "purchase", "purchases", "cart", "checkout"),
    "payment": ("payment", "payments", "invoice", "invoices", "billing"),
    "file": ("file", "files", "upload", "uploads", "attachment", "media"),
    "message": ("message", "messages", "chat", "notification", "notifications"),
    "tag": ("tag", "tags", "category", "categories", "label"),
    "search": ("search", "query", "filter", "find"),
}
#: Points for a shared word, and for a word whose family the other side knows.
WORD_POINTS, FAMILY_POINTS = 10, 5
#: Tasks that share the pages of one key.
SALTS = 16


def best_overlap(asking: DataFrame, offering: DataFrame, common: int = 100) -> DataFrame:
    """(page, endpoint, score): for each page of ``asking`` (page, key, points) the endpoint of
    ``offering`` (endpoint, key) with the most points in shared keys, the least of equals.

    A key that more than ``common`` endpoints have would meet every page that asks for it with
    all of them. Such keys are at most 1 / ``common`` of the rows of ``offering``; endpoints
    that agree in them are alike but for their rarer keys, and so are pages. So two cases are
    scored and the better taken: sets of common keys against sets of common keys, each with its
    least endpoint, and pages with the endpoints they share a rarer key with, at most ``common``
    a key. The first never says more than is true and says all of it for endpoints without a
    shared rare key; the second is exact. The result is the same for every ``common``.

    Pages that share nothing have no row; null pages, endpoints and keys take no part; repeated
    keys of an endpoint count once, those of a page add up.
    """
    l = asking.filter("page is not null and key is not null").groupBy("page", "key").agg(F.sum("points").alias("points"))
    r = offering.select("endpoint", "key").filter("endpoint is not null and key is not null").distinct()
    wide = r.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > common).select("key", F.lit(True).alias("wide"))

    l, r = _spread(l, wide, "key", "left"), r.join(wide, "key", "left")
    asks = l.groupBy("page").agg(F.array_sort(F.collect_list(F.when(F.col("wide"), F.struct("key", "points")))).alias("asks"))
    has = r.groupBy("endpoint").agg(F.array_sort(F.collect_list(F.when(F.col("wide"), F.col("key")))).alias("has"))

    best = lambda df, *by: df.groupBy(*by).agg(F.min_by(F.struct("endpoint", "score"), F.struct(-F.col("score"), "endpoint")).alias("b")).select(*by, "b.endpoint", "b.score")
    sets = has.groupBy("has").agg(F.min("endpoint").alias("endpoint")).select("endpoint", F.explode("has").alias("key"))
    asked = asks.select("asks").distinct().select("asks", F.explode("asks").alias("a")).select("asks", "a.key", "a.points")
    met = asked.join(sets, "key").groupBy("asks", "endpoint").agg(F.sum("points").alias("score"))
    alike = _spread(asks.filter(F.size("asks") > 0), best(met, "asks"), "asks", "inner").select("page", "endpoint", "score")

    rare = lambda df: df.filter("wide is null").drop("wide")
    near = _spread(rare(l).join(asks, "page"), rare(r).join(has, "endpoint"), "key", "inner")
    near = near.groupBy("page", "endpoint").agg(F.sum("points").alias("own"), F.first("asks").alias("asks"), F.first("has").alias("has"))
    also = F.aggregate(F.filter("asks", lambda a: F.array_contains("has", a["key"])), F.lit(0).cast("long"), lambda t, a: t + a["points"])
    exact = near.select("page", "endpoint", (F.col("own") + also).alias("score"))
    return best(alike.unionByName(exact), "page")


def _spread(pages: DataFrame, other: DataFrame, key: str, how: str) -> DataFrame:
    """Join on ``key``, where a key that very many pages share is dealt to :data:`SALTS` tasks by
    page; ``other``, which follows from endpoints, goes along once for each."""
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    each = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, [key, "salt"], how).drop("salt")


def keyword_overlap(pages: DataFrame, endpoints: DataFrame, families: bool = True, common: int = 100) -> DataFrame:
    """(page, endpoint, score) for pages (page, words) and endpoints (endpoint, words) that share
    anything: 10 a shared word and, with ``families``, 5 for each word of a page whose family
    has a word at the endpoint. The best of each page, the first of equals, by :func:`best_overlap`.
    """
    key = lambda word: F.concat(F.lit("word "), word)
    p = pages.select("page", F.explode(F.array_distinct("words")).alias("word"))
    e = endpoints.select("endpoint", F.explode(F.array_distinct("words")).alias("word"))
    asking = p.select("page", key(F.col("word")).alias("key"), F.lit(WORD_POINTS).alias("points"))
    offering = e.select("endpoint", key(F.col("word")).alias("key"))
    if families:
        of = F.create_map(*(F.lit(x) for f, ws in RESOURCE_WORDS.items() for w in ws for x in (w, f"family {f}")))
        family = F.try_element_at(of, F.col("word")).alias("key")
        asking = asking.unionByName(p.select("page", family, F.lit(FAMILY_POINTS).alias("points")))
        offering = offering.unionByName(e.select("endpoint", family))
    return best_overlap(asking, offering, common)


def _writes(methods: Column, *which: str) -> Column:
    return F.coalesce(F.arrays_overlap(methods, F.array(*map(F.lit, which))), F.lit(False))


def binding_type(mode: str = "csr") -> Column:
    """How a page with its endpoint gets its data, the first that holds: columns endpoint, auth,
    form, search, paged of the page, methods and tags of the endpoint. Null flags are false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    tagged = lambda *t: _writes(F.col("tags"), *t)
    methods = F.col("methods")
    return (
        F.when(F.col("endpoint").isNull(), "static")
        .when(flag("auth"), "auth-gated")
        .when(flag("form") & _writes(methods, "POST", "PUT", "PATCH"), "form-submit")
        .when(flag("search"), "search")
        .when(flag("paged"), "paginated")
        .when(~flag("form") & _writes(methods, "POST", "PUT", "PATCH", "DELETE"), "mutation")
        .when(tagged("realtime", "ws", "sse"), "real-time")
        .when(tagged("upload"), "file-upload")
        .when(~_writes(methods, "GET", "HEAD"), "mutation")
        .otherwise("server-fetch" if mode in ("ssr", "isr") else "client-fetch")
    )


def bind_pages(pages: DataFrame, endpoints: DataFrame, models: DataFrame, mode: str = "csr", common: int = 100) -> DataFrame:
    """(page, endpoint, model, binding, status, confidence, wants_auth), one row for each page.

    pages: (page, words, auth, form, search, paged), endpoints: (endpoint, words, methods, tags,
    deprecated, secured), models: (model, words); ids are one of a row. The best endpoint counts
    words and families, the best model words only. A page without an endpoint is static and
    bound; one whose endpoint is deprecated is blocked, one without a model partial.
    ``wants_auth`` says that the endpoint asks for a login and the page does not say so.
    Pages with null or empty words share nothing; other columns are ignored.
    """
    p = pages.select("page", "words", "auth", "form", "search", "paged")
    e = endpoints.select("endpoint", "words", "methods", "tags", "deprecated", "secured")
    to = keyword_overlap(p, e, True, common).select("page", "endpoint")
    by = keyword_overlap(p, models.select(F.col("model").alias("endpoint"), "words"), False, common).select("page", F.col("endpoint").alias("model"))
    out = p.drop("words").join(to, "page", "left").join(e.drop("words"), "endpoint", "left").join(by, "page", "left")
    old, none = F.coalesce(F.col("deprecated"), F.lit(False)), F.col("endpoint").isNull()
    status = F.when(none, "BOUND").when(old, "BLOCKED").when(F.col("model").isNotNull(), "BOUND").otherwise("PARTIAL")
    sure = F.when(none, 1.0).when(old, 0.9).when(F.col("model").isNotNull(), 0.85).otherwise(0.65)
    wants = F.coalesce(F.col("secured"), F.lit(False)) & ~F.coalesce(F.col("auth"), F.lit(False))
    return out.select("page", "endpoint", "model", binding_type(mode).alias("binding"), status.alias("status"), sure.alias("confidence"), wants.alias("wants_auth"))
