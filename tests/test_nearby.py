"""Nearness by equality, views of web pages, Java and PHP names by what files declare: fixed cases and brute force."""

import random

from pyspark.sql import functions as F

from plinth.operators import nearby, razor, resolve


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def imports(spark, *rows):
    return frame(spark, [(f, i, s) for i, (f, s) in enumerate(rows)], "file string, ord int, specifier string")


def ends(df):
    rows = df.collect()
    assert len({r.ord for r in rows}) == len(rows)
    return {r.ord: r.target for r in rows}


def paths(spark, *rows):
    return frame(spark, [(p,) for p in rows], "path string")


VIEWS = ["Shop/Views/Home/Index.cshtml", "Shop/Views/Home/_Card.cshtml", "Shop/Views/Shared/_Layout.cshtml", "Shop/Views/Shared/Error.cshtml", "Theme/Views/Shared/_Layout.cshtml", "Shop/Pages/Cart/Index.cshtml", "Shop/Pages/Cart/Index.cshtml.cs",
         "Shop/Pages/Shared/_Box.cshtml", "A/x/Views/Twin/T.cshtml", "A/y/Views/Twin/T.cshtml", "A/Views/Shared/T.cshtml", "Top.cshtml"]


def test_views_by_name_and_path(spark):
    home, cart = "Shop/Views/Home/Index.cshtml", "Shop/Pages/Cart/Index.cshtml"
    im = imports(
        spark, (home, "view:_Card"), (home, "view:Error"), (home, "view:_None"), (cart, "view:/Views/Shared/_Layout.cshtml"), ("Theme/z.cshtml", "view:~/Views/Shared/_Layout"), ("Else/z.cshtml", "view:~/Views/Shared/_Layout"), (cart, "view:_Box"),
        ("Shop/C/HomeController.cs", "action:Home/Index"), ("Shop/C/HomeController.cs", "action:Home/Error"), ("Shop/C/HomeController.cs", "action:Home/"), ("A/C.cs", "action:Twin/T"), ("Shop/C.cs", "action:X/~/Views/Home/_Card.cshtml"),
        (cart, "page:"), (home, "page:"), (cart, "using:Shop"), (cart, "tag:x"), (home, "view:Top"), ("Top.cshtml", "view:/Top.cshtml"), (cart, "view:_Card"),
    )
    none = frame(spark, [], "path string, name string"), frame(spark, [], "path string, namespace string")
    want = {0: VIEWS[1], 1: VIEWS[3], 3: VIEWS[2], 4: VIEWS[4], 6: VIEWS[7], 7: VIEWS[0], 8: VIEWS[3], 10: "A/Views/Shared/T.cshtml", 11: VIEWS[1], 12: VIEWS[6], 16: "Top.cshtml", 17: "Top.cshtml"}
    assert ends(razor.razor(im, paths(spark, *VIEWS), *none)) == want
    assert razor.razor(im.limit(0), paths(spark, *VIEWS), *none).count() == 0
    assert razor.razor(im, paths(spark, *VIEWS).limit(0), *none).count() == 0


def test_types_that_a_view_sees(spark):
    told = frame(spark, [("M/Error.cs", "ErrorModel"), ("M/Many.cs", "Line"), ("M/Many.cs", "Order"), ("N/Order.cs", "Order"), ("P/Cart/Index.cshtml.cs", "IndexModel"), ("M/Other.cs", "IndexModel"), ("G.cs", "Loose"), ("C/Badge.cs", "BadgeViewComponent"), ("P/Cart/Own.cs", "Own"), ("P/Up.cs", "Up"), ("M/a.ts", "Line")], "path string, name string")
    spaces = frame(spark, [("M/Error.cs", "Shop.M"), ("M/Many.cs", "Shop.M"), ("N/Order.cs", "Shop.N"), ("M/Other.cs", "Shop.M"), ("P/Cart/Own.cs", "Shop.P.Cart"), ("P/Up.cs", "Shop")], "path string, namespace string")
    cart = "P/Cart/Index.cshtml"
    facts = [("_ViewImports.cshtml", "using:Shop.M"), ("P/_ViewImports.cshtml", "namespace:Wrong"), ("P/_ViewImports.cshtml", "namespace:Shop.P"), ("Q/v.cshtml", "using:Shop.N")]
    asks = [(cart, "type:ErrorModel"), (cart, "type:IndexModel"), (cart, "type:Order"), ("Q/v.cshtml", "type:Order"), (cart, "type:Shop.N.Order"), (cart, "type:N.Order"), (cart, "type:Loose"), (cart, "type:Own"), (cart, "type:Up"), ("Q/v.cshtml", "type:Own"), (cart, "component:Badge"), (cart, "component:Cart"), (cart, "type:Line")]
    found = ends(razor.types(imports(spark, *facts, *asks), told, spaces))
    assert {k - len(facts): v for k, v in found.items()} == {0: "M/Error.cs", 1: "P/Cart/Index.cshtml.cs", 2: "M/Many.cs", 4: "N/Order.cs", 6: "G.cs", 7: "P/Cart/Own.cs", 8: "P/Up.cs", 10: "C/Badge.cs", 12: "M/Many.cs"}
    seen = razor.scopes(imports(spark, *facts), paths(spark, cart).withColumnRenamed("path", "file"))
    assert {r.namespace for r in seen.collect()} == {"", "Shop.M", "Shop", "Shop.P", "Shop.P.Cart"}


def test_named_templates(spark):
    im = imports(spark, ("a/b/c.ts", "./c.html"), ("a/b/c.ts", "../x.HTML"), ("c.ts", "../out.html"), ("c.ts", "lib/x.html"), ("c.ts", "./c.css"), ("a/d.ts", "./b/c.html"))
    assert {r.path for r in razor.named_templates(im).collect()} == {"a/b/c.html", "a/x.HTML"}


def test_java_by_declared_package(spark):
    files = paths(spark, "main/p/q/R.java", "test/p/q/R.java", "odd/R.java", "main/p/Outer.java", "x.y/Z.java", "T.java")
    declared = frame(spark, [("odd/R.java", "p.q"), ("main/p/Outer.java", "p")], "path string, package string")
    im = imports(spark, ("odd/A.java", "p.q.R"), ("test/B.java", "p.q.R"), ("m/C.java", "p.Outer.Inner"), ("m/C.java", "main.p.Outer"), ("m/C.java", "no.T|p.q.R.method"), ("m/C.java", "x.y.Z"), ("m/C.java", "T"), ("test/p/q/R.java", "p.q.R"), ("m/C.java", None))
    assert ends(resolve.java(im, files, declared)) == {0: "odd/R.java", 1: "test/p/q/R.java", 2: "main/p/Outer.java", 4: "main/p/q/R.java", 7: "test/p/q/R.java"}


def test_php_by_declared_namespace(spark):
    files = paths(spark, "src/A/Str.php", "lib/Str.php", "lib/Exception.php", "lib/helpers.php", "lib/more.php", "raw/B/Thing.php", "Top.php", "map/U.php")
    told = frame(spark, [("lib/Str.php", "Str"), ("src/A/Str.php", "Str"), ("lib/Exception.php", "Other"), ("lib/helpers.php", "tap"), ("lib/more.php", "tap"), ("lib/more.php", "glob")], "path string, name string")
    spaces = frame(spark, [("src/A/Str.php", "A"), ("lib/helpers.php", "A"), ("lib/more.php", "A")], "path string, namespace string")
    prefixes = frame(spark, [("M\\", "map"), ("", "nowhere")], "prefix string, dir string")
    names = ["A\\Str", "Str", "Exception", "A\\tap", "B\\Thing", "C\\Thing", "Any\\Top", "none|A\\glob", "\\M\\U", "A\\Str|M\\U", "zzz|M\\U|A\\Str"]
    im = imports(spark, *[("lib/x.php", n) for n in names], ("lib/more.php", "A\\tap"))
    want = {0: "src/A/Str.php", 1: "lib/Str.php", 3: "lib/helpers.php", 4: "raw/B/Thing.php", 6: "Top.php", 7: "lib/more.php", 8: "map/U.php", 9: "src/A/Str.php", 10: "map/U.php", 11: "lib/more.php"}
    assert ends(resolve.php(im, files, prefixes, told, spaces)) == want


def test_nearness_against_brute_force(spark):
    pick = random.Random(5)
    some = sorted({"/".join([*(pick.choice("ab") for _ in range(pick.randrange(4))), pick.choice("xyz")]) for _ in range(120)})
    index = [(pick.choice("kl"), p) for p in some for _ in range(2)]
    asks = [(file, i, r, k) for i, file in enumerate(pick.choices(some, k=60)) for r, k in enumerate(pick.sample(["k", "l", "none"], 2))]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    def brute(whole, unique):
        out = {}
        for file, i, _rank, key in sorted(asks, key=lambda a: a[1:3]):
            if i in out:
                continue
            steps = (lambda p: p.split("/")) if whole else (lambda p: p.split("/")[:-1] or ["."])
            found = sorted({p for k, p in index if k == key}, key=lambda p: (-shared(steps(p), steps(file)), p))
            best = [p for p in found if shared(steps(p), steps(file)) == shared(steps(found[0]), steps(file))]
            if best and (len(best) == 1 or not unique):
                out[i] = best[0]
        return out

    wanted, known = frame(spark, asks, "file string, ord int, rank int, key string"), frame(spark, index, "key string, path string")
    assert ends(nearby.nearest_first(wanted, known)) == brute(True, False)
    assert ends(nearby.nearest_only(wanted, known)) == brute(False, True) != {}
    assert known.limit(1).select(nearby.tails(F.lit("a/b/c")).alias("t")).first().t == ["a/b/c", "b/c", "c"]
