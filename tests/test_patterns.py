"""Patterns and identifiers against plain Python: globs by a small matcher of their rules, the rest by hand."""

import itertools
import posixpath
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from edgeloom.errors import UserError
from edgeloom.functions import identifiers as ids
from edgeloom.functions.patterns import Filter, Pattern, group_names, in_folder, in_path, pattern, with_name

SEGMENTS = ["", "k", "kit", "kit7", "K", "oven"]
PATHS = sorted({"/".join(x for x in t if x) for n in (1, 2, 3) for t in itertools.product(SEGMENTS, repeat=n)} - {""})
GLOBS = ["kit", "k*", "*", "**", "kit/**", "**/kit", "oven/**/kit", "k?t", "[ko]*", "[!k]*", "*/kit[0-9]", "**/k*/**", "kit/*/oven", "?/**"]


@lru_cache(maxsize=None)
def matches(glob: str, path: str) -> bool:
    """By the rules of the glob language, by trying every way to spend the next token."""
    if glob == "/**":
        return path == "" or path.startswith("/")
    if glob.startswith("/**/"):
        return path.startswith("/") and any(matches(glob[4:], path[k:]) for k in range(1, len(path) + 1) if path[k - 1] == "/")
    if glob.startswith("**/"):
        return any(matches(glob[3:], path[k:]) for k in range(len(path) + 1) if k == 0 or path[k - 1] == "/")
    if glob.startswith("**"):
        return any(matches(glob[2:], path[k:]) for k in range(len(path) + 1))
    if not glob or not path:
        return glob == path or (glob[:1] == "*" and matches(glob[1:], path))
    if glob[0] == "*":
        return matches(glob[1:], path) or (path[0] != "/" and matches(glob, path[1:]))
    if glob[0] == "[":
        body, rest = glob[1:].split("]", 1)
        negated, body = body.startswith("!"), body.removeprefix("!")
        members = {chr(c) for c in range(ord(body[0]), ord(body[2]) + 1)} if body[1:2] == "-" else set(body)
        return (path[0] in members) != negated and matches(rest, path[1:])
    return (path[0] == glob[0] or glob[0] == "?" and path[0] != "/") and matches(glob[1:], path[1:])


def test_globs_equal_brute_force(spark):
    frame = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = frame.select("p", *(Filter(Pattern.glob(g)).column("p").alias(str(k)) for k, g in enumerate(GLOBS))).collect()
    for row in got:
        for k, g in enumerate(GLOBS):
            assert row[str(k)] == matches(g, row.p), (g, row.p)


@pytest.mark.parametrize(
    ("make", "yes", "no"),
    [
        (lambda: Pattern.literal(r"menu\tea (hot)*.txt"), "menu/tea (hot)*.txt", "menu/tea hot.txt"),
        (lambda: Pattern.glob("menu/a^b&c~d.txt"), "menu/a^b&c~d.txt", "menu/abcd.txt"),
        (lambda: Pattern.glob("menu/[&^~]x"), "menu/^x", "menu/ax"),
        (lambda: Pattern.regex(r"(tea|milk)/\d{2}"), "milk/42", "cream/milk/42"),
        (lambda: Pattern.regex(r"\p{L}+\z"), "Crème", "Crème1"),
        (lambda: Pattern.regex(r"[+*]+x"), "+*+x", "x"),
        (lambda: Pattern.regex(r"(?P<first_part>a+)b"), "aab", "b"),
        (lambda: Pattern.glob("MENU/**", case_insensitive=True), "menu/ÄÖ", "card"),
    ],
)
def test_syntaxes(spark, make, yes, no):
    row = spark.range(1).select(Filter(make()).column(F.lit(yes)), Filter(make()).column(F.lit(no))).first()
    assert list(row) == [True, False]


@pytest.mark.parametrize(
    "make",
    [lambda: Pattern.glob("\t"), lambda: Pattern.glob("tea[bag"), lambda: Pattern.glob("tea[]"), lambda: Pattern.glob("tea[!]"), lambda: Pattern.regex("tea)"), lambda: Pattern.regex("(?<!t)ea")]
    + [lambda: Pattern.regex(r"(t)e\1"), lambda: Pattern.regex("te{1,2}+"), lambda: Pattern.regex("(?>te)a"), lambda: Pattern.regex(" "), lambda: Pattern.literal(" ")],
)
def test_bad_patterns_are_user_errors(spark, make):
    with pytest.raises(UserError):
        make()


def test_replacements(spark):
    p = Pattern.regex(r"(?<top>\w+)/([a-z]+)_?(?P<n_o>\d*)")
    assert group_names(r"\(a\)(?<top>\w+)[(](?:b)([a-z]+)(?P<n_o>\d*)") == ["top", None, "n_o"]
    assert p.names == ("top", None, "n_o")
    made = spark.range(1).select(*(p.replaced(F.lit("shop/till_12"), r) for r in ("$2-${1}", "${n_o}$$${top}", "x${gone}${9}y$3y", "$3"))).first()
    assert list(made) == ["till-shop", "12$shop", "xy", "12"]


def test_identifiers_equal_posix_rules(spark):
    parts = ["tea", "..", ".", "", "leaf.txt"]
    cases = ["/".join(t) for n in (1, 2, 3, 4) for t in itertools.product(parts, repeat=n)]
    want = lambda p: "" if posixpath.normpath(p) == "." else posixpath.normpath(p).replace("//", "/") if p else ""
    frame = spark.createDataFrame([(c, want(c)) for c in cases] + [(r" tea\.\leaf.txt ", "tea/leaf.txt")], "path string, want string")
    root = F.when(F.col("want") == "/", F.lit("/")).otherwise(F.col("want"))
    assert frame.filter(ids.normalize_identifier("path") != root).collect() == []


def test_targets(spark):
    row = spark.range(1).select(
        ids.folder(F.lit("recipe.md")), ids.folder(F.lit("book/cakes/recipe.md")), ids.type_name(F.lit("book::cakes::Recipe::")), ids.type_name(F.lit("book/cakes.Recipe")),
        ids.stem(F.lit("book/cake.v2.md")), ids.extension(F.lit("book/cake.v2.md")), ids.extension(F.lit("book/.hidden")), ids.non_blank_lines(F.lit("x\n\t\ny\r\n\r\n")), ids.crate_name(F.lit("cake-book")),
    ).first()
    assert list(row) == [".", "book/cakes", "Recipe", "Recipe", "cake.v2", ".md", "", 2, "cake_book"]


def test_filters_exclusions_and_inversion(spark):
    df = spark.createDataFrame([("shop/till/scan.py",), ("shop/shelf/scan.py",), ("shop/till/init.py",), ("",), ("readme.md",)], "p string")
    pick = lambda f: sorted(r.p for r in df.filter(f.column("p")).collect())
    assert pick(in_path(pattern("shop/**").except_in_folder("shop/shelf").except_with_name("init.py"))) == ["shop/till/scan.py"]
    assert pick(in_path("shop/**").not_matching()) == ["readme.md"]
    assert pick(with_name("init.py")) == ["shop/till/init.py"]
    assert pick(in_folder(pattern("shop/*").except_("shop/till"))) == ["shop/shelf/scan.py"]
