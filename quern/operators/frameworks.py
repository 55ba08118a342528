"""What web pages were made with: weighted signs of six frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import markup

#: The least score that names a framework, and the highest score of each.
LEAST = 30
HIGHEST = {"wordpress": 395, "nextjs": 335, "astro": 335, "react": 165, "express": 90, "laravel": 255}


def signals(
    html: Column,
    *,
    powered_by: Column | None = None,
    vary: Column | None = None,
    cookies: Column | None = None,
    header_names: Column | None = None,
    login_status: Column | None = None,
    api_status: Column | None = None,
    generator: Column | None = None,
    scripts: Column | None = None,
    links: Column | None = None,
) -> dict[str, Column]:
    """Whether each sign is there; null HTML and headers that are not given hold none. What the
    tags of the page say (generator, sources of scripts, targets of links) may be given."""

    def given(c: Column | None, kind: str) -> Column:
        return F.lit(None).cast(kind) if c is None else c

    def some(values: Column, pattern: str) -> Column:
        return F.coalesce(F.exists(values, lambda v: v.rlike(pattern)), F.lit(False))

    def text(c: Column | None, pattern: str) -> Column:
        return F.coalesce(given(c, "string").rlike(pattern), F.lit(False))

    held = {name: F.coalesce(html.rlike(p), F.lit(False)) for name, p in markup.SIGNS}
    own = tag_values(html)
    generator, scripts, links = (own[k] if c is None else c for k, c in (("generator", generator), ("scripts", scripts), ("links", links)))
    jar = given(cookies, "array<string>")
    return held | {
        "gen-wordpress": text(generator, "(?i)wordpress"), "gen-next": text(generator, r"(?i)next\.js"), "gen-astro": text(generator, "(?i)astro"),
        "src-wp": some(scripts, "(?i)/wp-content/"), "src-next": some(scripts, "/_next/"), "src-astro": some(scripts, "/_astro/"), "href-astro": some(links, "/_astro/"),
        "src-cra": some(scripts, r"/static/js/main\.\w+\.js"), "src-vite": some(scripts, r"/assets/index-\w+\.js"),
        "cookie-wp": some(jar, "(?i)wordpress_|wp-settings"), "cookie-laravel-session": some(jar, "(?i)laravel.*session"),
        "cookie-xsrf": some(jar, "(?i)^XSRF-TOKEN") & some(jar, "(?i)laravel"),
        "login": F.coalesce(given(login_status, "int").isin(200, 302), F.lit(False)), "api": F.coalesce(given(api_status, "int") == 200, F.lit(False)),
        "by-wordpress": text(powered_by, "(?i)x-powered-by") & text(powered_by, "(?i)wordpress"), "by-express": text(powered_by, "(?i)express"), "by-php": text(powered_by, "(?i)php"),
        "header-next": some(given(header_names, "array<string>"), "^x-next"), "vary-inertia": text(vary, "(?i)x-inertia"),
    }


def tag_values(html: Column) -> dict[str, Column]:
    return {"generator": F.try_element_at(markup.meta_tags(html), F.lit("generator")), "scripts": markup.values(html, "script", "src"), "links": markup.values(html, "link", "href")}


def fingerprint(pages: DataFrame, html: Column, **given: Column) -> DataFrame:
    """``pages`` plus ``found`` (framework, score, confidence, others). Tags are taken out of a page
    once and each sign is looked for once: columns that several others use stay columns."""
    names = {f"_{k}": v for k, v in tag_values(html).items()}
    tagged = pages.withColumns(names)
    held = signals(html, generator=F.col("_generator"), scripts=F.col("_scripts"), links=F.col("_links"), **given)
    marked = tagged.select(*pages.columns, F.struct(*(v.alias(k) for k, v in held.items())).alias("_held"))
    scored = marked.withColumn("_scores", F.struct(*(v.alias(k) for k, v in scores({k: F.col("_held")[k] for k in held}).items())))
    return scored.select(*pages.columns, detect({k: F.col("_scores")[k] for k in POINTS}).alias("found"))


#: Points of each sign.
POINTS = {
    "wordpress": {
        "gen-wordpress": 90, "wp-content-path": 65, "wp-includes-path": 40, "wp-version-param": 20, "src-wp": 30, "cookie-wp": 40, "login": 50, "api": 60, "by-wordpress": 50,
    },
    "nextjs": {
        "next-data-script": 85, "next-static-path": 65, "next-image-path": 30, "next-window-global": 40, "next-router-ref": 25, "src-next": 60, "header-next": 35, "gen-next": 50,
    },
    "astro": {"astro-island-element": 90, "astro-static-path": 65, "astro-data-attr": 30, "src-astro": 60, "gen-astro": 90, "href-astro": 40},
    "react": {"react-root-attr": 55, "react-data-attr": 30, "react-dom-ref": 20, "webpack-runtime": 15, "src-cra": 35, "src-vite": 30},
    "express": {"by-express": 90},
    "laravel": {"cookie-laravel-session": 85, "laravel-session": 50, "csrf-meta-token": 30, "cookie-xsrf": 30, "vary-inertia": 45},
}


def scores(held: dict[str, Column]) -> dict[str, Column]:
    """Points of each framework. What Next.js or Astro explain counts for React three tenths;
    PHP speaks for Laravel only where something else does."""
    out = {}
    for name, points in POINTS.items():
        total = F.lit(0)
        for sign, n in points.items():
            total = total + F.when(held[sign], n).otherwise(0)
        out[name] = total
    for stronger in ("nextjs", "astro"):
        out["react"] = F.when(out[stronger] >= 60, F.floor(out["react"] * 0.3).cast("int")).otherwise(out["react"])
    out["laravel"] = out["laravel"] + F.when(held["by-php"] & (out["laravel"] > 0), 15).otherwise(0)
    return out


def detect(scored: dict[str, Column]) -> Column:
    """(framework, score, confidence, others): the highest score, the first of equals, from
    LEAST points on; others that reach them too."""
    entries = F.array(*(F.struct(s.cast("int").alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name"), F.lit(HIGHEST[n]).alias("most")) for i, (n, s) in enumerate(scored.items())))
    ranked = F.sort_array(entries, asc=False)
    return F.get(F.transform(F.array(ranked), _named), 0)


def _named(ranked: Column) -> Column:
    top = ranked[0]
    known = top["score"] >= LEAST
    confidence = F.when(known, F.round(F.least(F.lit(1.0), top["score"] / top["most"]), 3)).otherwise(0.0)
    others = F.transform(F.filter(F.slice(ranked, 2, len(HIGHEST)), lambda e: e["score"] >= LEAST), lambda e: e["name"])
    return F.struct(F.when(known, top["name"]).otherwise("unknown").alias("framework"), top["score"].alias("score"), confidence.alias("confidence"), others.alias("others"))


#: Points of what a code base holds, and the highest score of each framework.
CODE_LEAST = 20
CODE_HIGHEST = {"nextjs": 115, "react": 80, "astro": 100, "express": 80, "laravel": 125, "wordpress": 160}
_APP_PAGE = r"/page\.(tsx?|jsx?)$"


def _code_signs() -> dict[str, list[tuple[int, Column]]]:
    """For each framework (points, whether a file (path, content) shows the sign)."""
    path, content = F.col("path"), F.coalesce(F.col("content"), F.lit(""))
    named = lambda *names: path.isin(*names)
    under = lambda *dirs: path.rlike("^(" + "|".join(dirs) + ")/")
    package, composer = path == "package.json", path == "composer.json"
    needs = lambda *deps: package & content.rlike('"(' + "|".join(deps) + r')"\s*:')
    return {
        "nextjs": [
            (60, needs("next")), (20, named("next.config.js", "next.config.ts", "next.config.mjs", "next.config.cjs")),
            (15, under("app") & path.rlike(_APP_PAGE)), (10, under("pages")), (10, named("pages/_app.tsx", "pages/_app.js", "pages/_app.ts")),
        ],
        "react": [
            (30, needs("react") & needs("react-dom")), (20, needs("@vitejs/plugin-react", "@vitejs/plugin-react-swc")), (10, named("vite.config.ts", "vite.config.js", "vite.config.mts")),
            (10, path.rlike(r"\.(tsx|jsx)$")), (10, named("src/App.tsx", "src/App.jsx", "src/main.tsx", "src/main.jsx")),
        ],
        "astro": [(60, needs("astro")), (20, named("astro.config.mjs", "astro.config.ts", "astro.config.js")), (15, path.rlike(r"\.astro$")), (5, under("src/pages"))],
        "express": [(50, needs("express")), (20, content.rlike(r"""express\(\)|require\(['"]express['"]\)""")), (10, under("routes", "src/routes"))],
        "laravel": [
            (70, composer & content.rlike(r'"laravel/framework"\s*:')), (20, named("artisan")), (15, named("routes/web.php")), (10, under("app/Http/Controllers")), (10, under("resources/views")),
        ],
        "wordpress": [
            (60, named("wp-config.php", "wp-config-sample.php")), (30, named("wp-login.php")), (20, named("functions.php") & content.rlike("add_action|add_filter|wp_enqueue")),
            (20, named("style.css") & F.contains(content, F.lit("Theme Name:"))), (30, under("wp-content", "wp-admin")),
        ],
    }


def detect_codebase(files: DataFrame) -> DataFrame:
    """(base, framework, score, confidence, others) for code bases of files (base, path, content):
    each sign counts once, whichever file shows it, in one grouping. Null contents are empty."""
    flags = {f"{name}_{i}": sign for name, signs_ in _code_signs().items() for i, (_, sign) in enumerate(signs_)}
    held = files.groupBy("base").agg(*(F.bool_or(F.coalesce(sign, F.lit(False))).alias(k) for k, sign in flags.items()))
    entries = []
    for order, (name, signs_) in enumerate(_code_signs().items()):
        points = F.lit(0)
        for i, (n, _) in enumerate(signs_):
            points = points + F.when(F.col(f"{name}_{i}"), n).otherwise(0)
        entries.append(F.struct(points.alias("score"), F.lit(-order).alias("order"), F.lit(name).alias("name"), F.lit(CODE_HIGHEST[name]).alias("most")))
    ranked = held.select("base", F.sort_array(F.array(*entries), asc=False).alias("l"))
    top, known = F.col("l")[0], F.col("l")[0]["score"] >= CODE_LEAST
    others = F.transform(F.filter(F.slice("l", 2, len(CODE_HIGHEST)), lambda e: e["score"] >= CODE_LEAST), lambda e: e["name"])
    return ranked.select(
        "base", F.when(known, top["name"]).otherwise("unknown").alias("framework"), top["score"].alias("score"),
        F.when(known, F.round(F.least(F.lit(1.0), top["score"] / top["most"]), 3)).otherwise(0.0).alias("confidence"), others.alias("others"),
    )


#: How hard a framework is to deploy, and a kind of database to move.
COMPLEXITY = {"react": "low", "astro": "low", "nextjs": "medium", "express": "medium", "laravel": "high", "wordpress": "high", "unknown": "medium"}
DATABASE_RISK = {"none": "low", "sqlite": "low", "postgres": "medium", "mysql": "medium", "mongodb": "medium"}


def deployment_risk(framework: Column, database: Column, storage: Column, target: Column, hosting: Column, missing: Column, confidence: Column) -> Column:
    """(score, risk) of deploying to ``target``: database and storage (null: none), missing required
    variables (a number), the framework's complexity, confidence in the target (high, medium,
    low) and whether it is where the site runs now."""

    def of(table: dict[str, str], key: Column) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit("medium"))

    data, hard = of(DATABASE_RISK, database), of(COMPLEXITY, framework)
    native = (storage == "r2") & (target == "cloudflare")
    score = (
        F.lit(80) + F.when(database.isNull(), 10).when(data == "low", 5).when(data == "medium", -5).otherwise(-15)
        + F.when(storage.isNull(), 5).when(native, 10).otherwise(0) + F.when(missing > 0, missing * -8).otherwise(5)
        + F.when(hard == "low", 5).when(hard == "medium", 0).otherwise(-10) + F.when(confidence == "high", 10).when(confidence == "medium", 5).otherwise(0)
        + F.when((hosting != "unknown") & (hosting == target), 5).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
    high = F.when(database.isNotNull() & (data == "high"), 1).otherwise(0) + missing
    medium = F.when(database.isNotNull() & (data == "medium"), 1).otherwise(0) + F.when(hard == "high", 1).otherwise(0)
    risk = F.when((high >= 2) | ((high >= 1) & (missing > 0)), "HIGH").when((high >= 1) | (medium >= 2) | (score < 60), "MEDIUM").otherwise("LOW")
    return F.struct(score.alias("score"), risk.alias("risk"))
