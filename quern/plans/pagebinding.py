"""Queries that bind pages to endpoints and models; parts stand in for endpoints, suppliers for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import urls
from quern.operators import keywords
from quern.plans.web import sql_route
from quern.registry import query
from quern.sources.tables import table

#: A fixture, the same text in Spark and DuckDB: what a page is about, what an endpoint returns
#: and a model is called.
_ABOUT = "CASE page_id % 9 WHEN 0 THEN 'users profile' WHEN 1 THEN 'article' WHEN 2 THEN 'orders cart' WHEN 3 THEN 'invoice' WHEN 4 THEN 'upload media' WHEN 5 THEN 'chat' WHEN 6 THEN 'find' ELSE '' END"
_PATH = "'/v1/' || CASE p_partkey % 8 WHEN 0 THEN 'account' WHEN 1 THEN 'posts' WHEN 2 THEN 'purchases' WHEN 3 THEN 'payments' WHEN 4 THEN 'files' WHEN 5 THEN 'messages' WHEN 6 THEN 'en' ELSE 'de' END || '/' || p_partkey || ' ' || p_name"
_MODEL = "CASE s_suppkey % 5 WHEN 0 THEN 'users' WHEN 1 THEN 'article author' WHEN 2 THEN 'orders' WHEN 3 THEN 'fr' ELSE '' END || ' ' || s_suppkey"
#: The same for facts: flags of pages, methods and tags of endpoints.
_FLAGS = {"auth": "page_id % 17 = 0", "form": "page_id % 5 = 0", "search": "page_id % 7 = 0", "paged": "contains(url, 'page=')"}
_METHODS = "CASE p_size % 5 WHEN 0 THEN 'POST' WHEN 1 THEN 'GET,POST' WHEN 2 THEN 'HEAD' WHEN 3 THEN 'OPTIONS' ELSE 'GET' END"
_TAGS = "CASE p_size % 11 WHEN 0 THEN 'realtime' WHEN 1 THEN 'upload' WHEN 2 THEN 'sse,v1' ELSE 'v1' END"

_WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''))"
_FAMILIES_SQL = ", ".join(f"('{w}', '{f}')" for f, ws in keywords.RESOURCE_WORDS.items() for w in ws)
_SQL = f"""
WITH p AS (SELECT page_id AS page, {', '.join(f'coalesce({e}, false) AS {c}' for c, e in _FLAGS.items())}, {_WORDS_SQL.format(f"coalesce({sql_route('url')}, '') || ' ' || {_ABOUT}")} AS words FROM pages),
e AS (SELECT p_partkey AS endpoint, string_split({_METHODS}, ',') AS methods, string_split({_TAGS}, ',') AS tags, p_size % 25 = 0 AS deprecated, p_size % 3 = 0 AS secured, {_WORDS_SQL.format(_PATH)} AS words FROM part),
m AS (SELECT s_suppkey AS model, {_WORDS_SQL.format(_MODEL)} AS words FROM supplier), f(word, family) AS (VALUES {_FAMILIES_SQL}),
pw AS (SELECT page, unnest(words) AS word FROM p), ew AS (SELECT endpoint, unnest(words) AS word FROM e), mw AS (SELECT model, unnest(words) AS word FROM m),
s AS (SELECT page, endpoint, count(*) * 10 AS score FROM pw JOIN ew USING (word) GROUP BY ALL
  UNION ALL SELECT page, endpoint, CAST(sum(k) * 5 AS BIGINT) FROM (SELECT page, family, count(*) AS k FROM pw JOIN f USING (word) GROUP BY ALL) JOIN (SELECT DISTINCT endpoint, family FROM ew JOIN f USING (word)) USING (family) GROUP BY ALL),
t AS (SELECT page, endpoint, sum(score) AS score FROM s GROUP BY ALL), te AS (SELECT page, arg_max(endpoint, (score, -endpoint)) AS endpoint FROM t GROUP BY page),
tm AS (SELECT page, arg_max(model, (score, -model)) AS model FROM (SELECT page, model, count(*) AS score FROM pw JOIN mw USING (word) GROUP BY ALL) GROUP BY page),
b AS (SELECT page, endpoint, model, CASE WHEN endpoint IS NULL THEN 'static' WHEN auth THEN 'auth-gated' WHEN form AND list_has_any(methods, ['POST', 'PUT', 'PATCH']) THEN 'form-submit' WHEN search THEN 'search' WHEN paged THEN 'paginated'
    WHEN NOT form AND list_has_any(methods, ['POST', 'PUT', 'PATCH', 'DELETE']) THEN 'mutation' WHEN list_has_any(tags, ['realtime', 'ws', 'sse']) THEN 'real-time' WHEN list_has_any(tags, ['upload']) THEN 'file-upload' WHEN NOT list_has_any(methods, ['GET', 'HEAD']) THEN 'mutation' ELSE 'server-fetch' END AS binding,
  CASE WHEN endpoint IS NULL THEN 'BOUND' WHEN deprecated THEN 'BLOCKED' WHEN model IS NULL THEN 'PARTIAL' ELSE 'BOUND' END AS status, CASE WHEN endpoint IS NULL THEN 1.0 WHEN deprecated THEN 0.9 WHEN model IS NULL THEN 0.65 ELSE 0.85 END::DOUBLE AS confidence, coalesce(secured AND NOT auth, false) AS wants_auth
  FROM p LEFT JOIN te USING (page) LEFT JOIN e USING (endpoint) LEFT JOIN tm USING (page))
"""


def _words(of):
    return F.array_distinct(F.filter(F.split(F.lower(of), "[^a-z0-9]+"), lambda w: w != ""))


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = F.concat(F.coalesce(urls.route(F.col("url")), F.lit("")), F.lit(" "), F.expr(_ABOUT))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), _words(about).alias("words"), *(F.expr(e).alias(c) for c, e in _FLAGS.items()))
    endpoints = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("endpoint"), _words(F.expr(_PATH)).alias("words"), F.split(F.expr(_METHODS), ",").alias("methods"), F.split(F.expr(_TAGS), ",").alias("tags"),
        F.expr("p_size % 25 = 0").alias("deprecated"), F.expr("p_size % 3 = 0").alias("secured"),
    )
    models = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model"), _words(F.expr(_MODEL)).alias("words"))
    return keywords.bind_pages(pages, endpoints, models, mode="ssr")


@query(_SQL + "SELECT page, endpoint, model, binding, status, confidence, wants_auth FROM b")
def page_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's endpoint and model, how it gets its data, and whether the binding is whole."""
    return _bound(spark, sf_dir)


@query(_SQL + """SELECT 'endpoint' AS kind, endpoint AS id, count(*) AS pages, min(page) AS first_page FROM b WHERE endpoint IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'model', model, count(*), min(page) FROM b WHERE model IS NOT NULL GROUP BY ALL""")
def binding_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each endpoint and each model serves, and the first of them."""
    used = _bound(spark, sf_dir).select("page", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in ("endpoint", "model")))).alias("u"))
    return used.filter("u.id is not null").groupBy("u.kind", "u.id").agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page"))


@query(_SQL + """SELECT binding, status, count(*) AS pages, count(*) FILTER (WHERE wants_auth) AS unguarded, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY binding, status""")
def binding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by kind and state of their binding, with their share of all."""
    b = _bound(spark, sf_dir).groupBy("binding", "status").agg(F.count(F.lit(1)).alias("pages"), F.count_if("wants_auth").alias("unguarded"))
    every = b.agg(F.sum("pages").alias("every"))  # one row
    return b.crossJoin(F.broadcast(every)).select("binding", "status", "pages", "unguarded", F.round(F.col("pages") * 100.0 / F.col("every"), 6).alias("share"))
