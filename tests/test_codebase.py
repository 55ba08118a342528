import random
import re

from pyspark.sql import functions as F

from quern.operators import bindings, imports

NODES = "ord int, id long, type string, path string, route string, content string"
SOURCES = "id long, confidence double, files array<string>, vars array<string>"


def named(raw, path):
    raw = re.sub(r"^[@~]/", "src/", raw).replace("\\", "/")
    fp = re.sub(r"\.[tj]sx?$", "", path.replace("\\", "/"))
    return bool(raw.split("/")[-1]) and (fp.endswith(raw) or fp.endswith(raw + "/index") or "/" + raw.split("/")[-1] in fp)


def test_imports_equal_the_nested_loop(spark):
    rng = random.Random(2)
    pieces = ["a", "ab", "abc", "index", "src", "b", ".", "..", "ba", "Ü", ""]
    path = lambda: "/".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))
    raws = {i: ["@/" + path() if rng.random() < 0.2 else path().replace("/", rng.choice(["/", "/", "\\"])) for _ in range(3)] for i in range(60)}
    targets = [(i, path() + rng.choice([".ts", ".tsx", "", ".js", ".css"])) for i in range(150)]
    files = [(i, "x\n".join(f"import  {{ A }} from '{r}';" for r in rs)) for i, rs in raws.items()] + [(99, None), (98, "import 'x'")]
    got = {tuple(r) for r in imports.import_edges(spark.createDataFrame(files, "id long, content string"), spark.createDataFrame([*targets, (999, None)], "id long, path string")).collect()}
    want = {(i, t) for i, rs in raws.items() for r in rs if r for t, p in targets if named(r, p)}
    assert len(want) > 500 and got == want


def test_relationships_of_a_code_base(spark):
    nodes = [
        (1, 1, "route", "src/app/home.tsx", "/", "import C from '@/components/Card'; <a href=\"/blog\"> <a href='/blog?x'> <a href=\"/\"> redirect('/shop') process.env.MY_DB_URL_2"),
        (2, 2, "route", "src/app/blog.tsx", "/blog", None), (3, 3, "route", "src/app/blog2.tsx", "/blog", "href='/gone'"), (4, 4, "route", "src/app/shop.tsx", "/shop", ""),
        (5, 10, "component", "src/components/Card.tsx", None, "import C from './Card'; import D from './CardGrid'"), (6, 11, "component", "src/components/CardGrid/index.tsx", None, ""),
        (7, 20, "api", "src/api/a.ts", None, "DB_URL"), (8, 21, "api", "src/api/b.ts", None, "db_url"), (9, 30, "layout", "src/l.tsx", None, ""),
    ]
    wraps = spark.createDataFrame([(30, [1, 1, 77]), (31, [2])], "layout long, routes array<long>")
    sources = spark.createDataFrame([(40, 0.5, ["src/api/b.ts", "src/gone.ts"], ["DB_URL", "", "a-b"]), (41, 1.0, None, ["NOPE"])], SOURCES)
    got = {(r.kind, r.from_id, r.to_id): (r.from_type, r.to_type, r.confidence, r.n) for r in imports.relationships(spark.createDataFrame(nodes, NODES), wraps, sources).collect()}
    assert got == {
        ("layout-wraps-route", 30, 1): ("layout", "route", 0.95, 1), ("route-uses-layout", 1, 30): ("route", "layout", 0.95, 1),
        ("route-uses-component", 1, 10): ("route", "component", 0.9, 1), ("route-uses-component", 1, 11): ("route", "component", 0.9, 1),
        ("component-imports-component", 10, 11): ("component", "component", 0.85, 1),
        ("route-uses-datasource", 1, 40): ("route", "datasource", 0.4, 1), ("api-uses-datasource", 20, 40): ("api", "datasource", 0.425, 1), ("api-uses-datasource", 21, 40): ("api", "datasource", 0.425, 1),
        ("route-links-route", 1, 3): ("route", "route", 0.7, 2), ("route-redirects-route", 1, 4): ("route", "route", 0.75, 1),
    }
    assert imports.relationships(spark.createDataFrame([], NODES), wraps, sources).count() == 0


A, B, C = "0123456789abcdef", "fedcba9876543210", "00000000ffffffff"


def test_objects_are_claimed_in_turns(spark):
    node = "job string, id string, cloud string, local string, images array<string>, videos array<string>"
    own = f"jobs/j/images/{A}/1.jpg"
    nodes = spark.createDataFrame(
        [
            ("j", A, f" {own} ", "x", [own, "", None], [f"jobs/j/videos/{A}/v"]), ("j", B, " ", "p/b.html", None, None), ("j", C, None, None, [], [f"jobs/j/embeds/{C}/e"]),
            ("j", "n4", "jobs/other/x", None, None, None), ("j", "n5", None, "", None, None), ("k", A, None, None, None, None), ("j", "n6", own, None, None, None), (None, None, None, None, None, None),
        ],
        node,
    )
    keys = [
        own, f"jobs/j/images/{A}/0.jpg", f"jobs/j/videos/{A}/v", f"jobs/j/embeds/{C}/e", f"jobs/j/content/z/{C}/index.html", f"jobs/j/content/a/{C}/index.html", "jobs/j/_manifest.json", "jobs/j/index.html",
        "jobs/j/content/late.html", f"jobs/j/images/{'1' * 16}/q", f"jobs/j/videos/{'1' * 16}/q", "jobs/j/dom/1", "jobs/j/x", "jobs/none/x", "loose", None, "jobs/j/p/a.html",
    ]
    objects = spark.createDataFrame(list(enumerate(keys)), "ord int, key string")
    bound = bindings.bindings(nodes, objects)
    html = {(r.job, r.node): (r.key, r.source, r.confidence, r.present) for r in bound.filter("kind = 'html'").collect()}
    assert html == {
        ("j", A): (own, "manifest-ref", 1.0, True), ("j", "n6"): (own, "manifest-ref", 1.0, True), ("j", B): ("jobs/j/p/b.html", "url-pattern", 0.9, False), ("j", C): (keys[4], "fallback", 0.5, True),
        ("j", "n4"): ("jobs/other/x", "manifest-ref", 1.0, False), ("j", "n5"): ("jobs/j/content/n5/index.html", "fallback", 0.3, False), ("k", A): (f"jobs/k/content/{A}/index.html", "fallback", 0.3, False),
    }
    files = {(r.node, r.kind, r.key): (r.source, r.confidence) for r in bound.filter("kind != 'html'").collect()}
    assert files == {
        (A, "image", keys[0]): ("manifest-ref", 1.0), (A, "image", keys[1]): ("url-pattern", 0.9), (A, "video", keys[2]): ("url-pattern", 0.9), (C, "embed", keys[3]): ("manifest-ref", 1.0),
    }
    left = {r.key: (r.category, r.reason) for r in bindings.orphans(nodes, objects, bound).collect()}
    page, other = bindings.REASONS["page"], bindings.REASONS["other"]
    assert left == {
        keys[5]: ("html", page), keys[8]: ("html", page), keys[9]: ("image", bindings.REASONS["image unknown"].replace("{node}", "1" * 16)), keys[10]: ("video", bindings.REASONS["video unknown"].replace("{node}", "1" * 16)),
        keys[11]: ("dom", other), keys[12]: ("unknown", other), keys[16]: ("unknown", other),
    }
    assert {tuple(r) for r in bindings.summary(nodes.filter("job is not null"), objects, bound).collect()} == {("j", 6, 14, 7, 7), ("k", 1, 0, 0, 0)}


def test_pairs_of_many_files_are_not_exchanged(spark):
    """Nothing gathers or counts the pairs once members are joined; each is there once."""
    files = spark.createDataFrame([(i, f'import a from "Card{i % 3}"; import b from "@/x/Card"') for i in range(300)], "id long, content string")
    targets = spark.createDataFrame([(1000 + i, f"src/x/Card{i % 4}.ts") for i in range(200)] + [(7, "src/y/Menu.ts")], "id long, path string")
    sources = spark.createDataFrame([(i, 0.5, ["p1"], [f"V{i % 2}"]) for i in range(50)], "id long, confidence double, files array<string>, vars array<string>")
    named = spark.createDataFrame([(i, f"p{i}", f"x V{i % 4} y") for i in range(100)], "id long, path string, content string")
    found = imports.import_edges(files, targets), imports.source_edges(named, sources)
    assert sorted(map(tuple, found[0].collect())) == sorted((i, 1000 + j) for i in range(300) for j in range(200))
    want = {(i, j, 0.5) for i in range(100) for j in range(50) if i % 4 == j % 2 or i == 1}
    got = [tuple(r) for r in found[1].collect()]
    assert len(got) == len(want) and set(got) == want
    for df in found:
        above = df._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
        assert "Aggregate" not in above and "Repartition" not in above


def test_pairs_of_a_class_are_dealt_in_blocks(spark, monkeypatch):
    """However large a class is, a task holds a block of it, and none has most of the pairs."""
    monkeypatch.setattr(imports, "BLOCK", 40, raising=False)
    monkeypatch.setattr(imports, "PAIRS", 5_000, raising=False)
    files = spark.createDataFrame([(i, 'import a from "@/x/Card"; import b from "Menu"') for i in range(700)] + [(None, 'import a from "Menu"')], "id long, content string")
    targets = spark.createDataFrame([(1000 + i, f"src/x/Card{i}.ts") for i in range(300)] + [(7, "src/y/Menu.ts")], "id long, path string")
    sources = spark.createDataFrame([(i, i / 8, ["p1"], ["V"]) for i in range(300)], "id long, confidence double, files array<string>, vars array<string>")
    named = spark.createDataFrame([(i, f"p{i}", "x V y" if i else "W") for i in range(700)], "id long, path string, content string")
    found = imports.import_edges(files, targets), imports.source_edges(named, sources)
    assert sorted(map(tuple, found[0].na.fill(-1).collect())) == sorted([(i, j) for i in range(700) for j in (7, *range(1000, 1300))] + [(-1, 7)])
    assert sorted(map(tuple, found[1].collect())) == [(i, j, j / 8) for i in range(1, 700) for j in range(300)]
    for df in found:
        counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(counts) > 20 and max(counts) < sum(counts) / 4
        assert "SortMergeJoin" in df._jdf.queryExecution().sparkPlan().toString().split("Join", 1)[0] + "Join"
