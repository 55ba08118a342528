"""Edges of a code base: layouts and routes, imports, data sources, links and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.grams import meetings
from quern.scratch import materialize

#: What is an import, a link and a redirect in a file.
IMPORT = r"""import\s+.*?from\s+['"]([^'"]+)['"]"""
LINK = r"""href=['"`](/[^'"`?#]+)"""
REDIRECT = r"""(?:redirect|useRouter|router\.push)\s*\(\s*['"`](/[^'"`?#]+)"""
#: Confidence in each kind of edge; a data source's own is multiplied by its.
CONFIDENCE = {
    "layout-wraps-route": 0.95, "route-uses-layout": 0.95, "route-uses-component": 0.9, "component-imports-component": 0.85,
    "route-uses-datasource": 0.8, "api-uses-datasource": 0.85, "route-links-route": 0.7, "route-redirects-route": 0.75,
}


def _starts(s: Column) -> Column:
    return F.transform(F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")), lambda n: F.substring(s, F.lit(1), n))


def _ends(s: Column) -> Column:
    return F.transform(F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")), lambda n: F.substring(s, n, F.length(s)))


def _keyed(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(f"{kind} "), k))


#: Ids of either side that meet in one block, about; what a task holds of a join.
BLOCK = 2_000
#: Pairs of a task, about, and the most tasks.
PAIRS, TASKS = 4_000_000, 4_000


def _classes(rows: DataFrame, id_: str, name: str) -> DataFrame:
    """(id, class, keys): ids of rows (id, key) with one set of keys are of one class."""
    per = rows.groupBy(id_).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return per.select(id_, F.unhex(F.sha2(F.to_json("keys"), 256)).alias(name), "keys")


def _parts(n: Column) -> Column:
    return F.ceil(n / BLOCK)


def _part(id_: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(id_), n)


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def shared(asked: DataFrame, known: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id), once each, for rows of asked (from_id, key) and known (to_id, key) with
    a key in common; ``more`` adds its columns to each to_id.

    Ids with the same keys of those that both sides have are a class. Classes meet by key and
    are made one of a pair; only then their members are joined. So what is shuffled follows
    from members and pairs of classes, not from the pairs of members, which are never
    exchanged, however many they are.

    The members of a class and of all that it meets are dealt to blocks of BLOCK by BLOCK ids,
    whatever their number, and blocks to tasks by the number of pairs. The last join is one by
    sorting: a broadcast one holds all pairs of a row of its other side, of two such joins all
    pairs of two classes.
    """
    known = materialize(known.join(asked.select("key").distinct(), "key", "left_semi").select("to_id", "key"), "known")
    a, b = _classes(asked.join(known.select("key").distinct(), "key", "left_semi"), "from_id", "_from"), _classes(known, "to_id", "_to")
    of = lambda df, name, n: df.groupBy(name).agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias(n)).select(name, n, F.explode("keys").alias("key"))
    pairs = materialize(of(a, "_from", "_asking").join(of(b, "_to", "_held"), "key").drop("key").distinct(), "classes")
    blocks = pairs.groupBy("_from").agg(_parts(F.max("_asking")).alias("_rows"), _parts(F.sum("_held")).alias("_cols"))
    tasks, at = 1 + int((pairs.agg(F.sum(F.col("_asking").cast("double") * F.col("_held"))).first()[0] or 0) / PAIRS), ["_from", "_row", "_col"]

    left = a.drop("keys").join(blocks, "_from").select("from_id", "_from", _part("from_id", F.col("_rows")).alias("_row"), _each(F.col("_cols")).alias("_col"))
    parts = pairs.groupBy("_to").agg(_parts(F.max("_held")).alias("_parts"))
    held = b.drop("keys").join(parts, "_to").withColumn("_part", _part("to_id", F.col("_parts"))).drop("_parts")
    held = held if more is None else held.join(more, "to_id")
    cells = pairs.join(blocks, "_from").select("_from", "_to", "_cols", "_held", _each(F.col("_rows")).alias("_row")).withColumn("_part", _each(_parts(F.col("_held"))))
    right = cells.drop("_held").join(held.hint("merge"), ["_to", "_part"]).withColumn("_col", _part("to_id", F.col("_cols"))).drop("_to", "_part", "_cols")
    left, right = materialize(left, "left"), materialize(right, "right")  # short plans: the driver plans the edges of all kinds together
    if tasks > 1:  # Spark itself would choose their number by the bytes that are shuffled
        tasks = min(TASKS, max(tasks, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        left, right = left.repartition(tasks, *at), right.repartition(tasks, *at)
    return left.join(right.hint("merge"), at).drop(*at)


def import_edges(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(from_id, to_id), once each: files (id, content) that import one of ``targets`` (id, path).

    ``@/`` and ``~/`` stand for ``src/``, and a path counts without its suffix (.ts, .tsx, .js,
    .jsx). An import names a path that ends with it, or with it and ``/index``, or that has a
    segment after a slash which starts with the import's last one. For an import with a slash
    the last case holds the others; so paths are known by the starts of their segments and, for
    imports without a slash, by the ends of the last segment, or of that before ``index``, and
    both sides meet by equality. An import that ends with a slash names nothing.
    """
    name = F.translate(F.regexp_replace("raw", "^[@~]/", "src/"), "\\", "/")
    raw = files.select("id", F.explode(F.array_distinct(text.extract_all(F.col("content"), IMPORT))).alias("raw")).select("id", name.alias("name"))
    last, bare = F.element_at(F.split("name", "/"), -1), ~F.contains("name", F.lit("/"))
    ways = F.when(bare, F.array(*map(F.lit, ("start", "end", "index")))).otherwise(F.array(F.lit("start")))
    asked = raw.filter(last != "").select(F.col("id").alias("from_id"), F.explode(ways).alias("way"), last.alias("key"))
    asked = materialize(asked.select("from_id", F.concat("way", F.lit(" "), "key").alias("key")).distinct(), "imports")

    file = F.regexp_replace(F.translate("path", "\\", "/"), r"\.[tj]sx?$", "")
    held = targets.filter("path is not null").select(F.col("id").alias("to_id"), F.split(file, "/").alias("s"))
    none = F.array().cast("array<string>")
    starts = F.flatten(F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), _starts))
    index = F.when(F.element_at("s", -1) == "index", _ends(F.coalesce(F.try_element_at("s", F.lit(-2)), F.lit("")))).otherwise(none)
    keys = F.array_distinct(F.concat(_keyed("start", starts), _keyed("end", _ends(F.element_at("s", -1))), _keyed("index", index)))
    return shared(asked, held.select("to_id", F.explode(keys).alias("key"))).select("from_id", "to_id")


def source_edges(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence), once each: files (id, path, content) that a source (id,
    confidence, files, vars) lists, or whose content holds one of its variables.

    A variable is a name of letters, digits and ``_``, so it is looked for in the words of
    such a file, by grams. Names of other characters are not found.
    """
    listed = sources.select(F.col("id").alias("to_id"), F.explode("files").alias("path")).join(files.select(F.col("id").alias("from_id"), "path"), "path").select("from_id", "to_id")
    word = files.select(F.col("id").alias("from_id"), F.explode(F.array_distinct(text.extract_all(F.col("content"), r"([A-Za-z0-9_]+)"))).alias("hay"))
    vars_ = sources.select(F.col("id").alias("to_id"), F.explode("vars").alias("needle")).filter(r"needle rlike '^[A-Za-z0-9_]+$'").distinct()
    met = meetings(word, vars_).distinct()
    named = materialize(word.join(met, "hay").select("from_id", F.col("needle").alias("key")).distinct(), "variables")
    vars_ = vars_.withColumnRenamed("needle", "key")
    sure = sources.groupBy(F.col("id").alias("to_id")).agg(F.max("confidence").alias("confidence"))
    twice = listed.join(named, "from_id").join(vars_, ["to_id", "key"]).select("from_id", "to_id")
    rest = materialize(listed.distinct().join(twice, ["from_id", "to_id"], "left_anti").join(sure, "to_id"), "listed")
    return shared(named, vars_, sure).unionByName(rest).select("from_id", "to_id", "confidence")


def _targets(routes: DataFrame, pattern: str) -> DataFrame:
    held = routes.filter("route is not null").groupBy("route").agg(F.max_by("id", "ord").alias("to_id"))
    said = routes.select(F.col("id").alias("from_id"), F.explode(text.extract_all(F.col("content"), pattern)).alias("route"))
    said = said.groupBy("from_id", "route").agg(F.count(F.lit(1)).alias("n"))
    return said.join(held, "route").filter("from_id != to_id").groupBy("from_id", "to_id").agg(F.sum("n").alias("n"))


def relationships(nodes: DataFrame, wraps: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, from_id, from_type, to_id, to_type, confidence, n): the edges of a code base; n is how
    often a link or redirect is said, else 1.

    nodes: (ord, id, type, path, route, content), types route, layout, component and api; wraps:
    (layout, routes); sources: (id, confidence, files, vars). A link goes to the last (by ord)
    of the routes with its path, and not to its own. Null contents hold nothing. Ids are one of
    a type; edges of unknown ids are left out.
    """
    of = lambda t: nodes.filter(F.col("type") == t)
    routes, components = of("route"), of("component")
    wrapped = wraps.select(F.col("layout").alias("from_id"), F.explode("routes").alias("to_id")).distinct()
    wrapped = wrapped.join(routes.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")
    wrapped = wrapped.join(of("layout").select(F.col("id").alias("from_id")), "from_id", "left_semi")

    def edges(kind: str, df: DataFrame, to_type: str) -> DataFrame:
        n = F.col("n").cast("long") if "n" in df.columns else F.lit(1).cast("long")
        sure = F.col("confidence") * CONFIDENCE[kind] if "confidence" in df.columns else F.lit(CONFIDENCE[kind])
        return df.select(F.lit(kind).alias("kind"), "from_id", F.lit(kind.split("-")[0]).alias("from_type"), "to_id", F.lit(to_type).alias("to_type"), F.round(sure, 6).alias("confidence"), n.alias("n"))

    every = [
        edges("layout-wraps-route", wrapped, "route"), edges("route-uses-layout", wrapped.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), "layout"),
        edges("route-uses-component", import_edges(routes, components), "component"), edges("component-imports-component", import_edges(components, components).filter("from_id != to_id"), "component"),
        edges("route-uses-datasource", source_edges(routes, sources), "datasource"), edges("api-uses-datasource", source_edges(of("api"), sources), "datasource"),
        edges("route-links-route", _targets(routes, LINK), "route"), edges("route-redirects-route", _targets(routes, REDIRECT), "route"),
    ]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out
