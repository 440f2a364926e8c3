"""Column functions on paths, patterns, durations and languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories and base names that mean tests.
TEST_DIRS = ["test", "tests", "__tests__", "testdata", "fixtures"]
TEST_NAMES = r"(\.(test|spec)\.[^.]+$)|(^test_[^/]*\.py$)|(_test\.(go|py)$)|((Test|Tests)\.(java|kt|cs|php)$)|(^conftest\.py$)"

#: Languages by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "java": "java", "go": "go", "cs": "csharp", "rs": "rust", "py": "python", "kt": "kotlin", "php": "php",
    "c": "cpp", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "vue": "vue", "svelte": "svelte", "razor": "razor", "cshtml": "razor",
}
#: Directories that a walk skips, besides those with a leading dot.
IGNORED_DIRS = ["node_modules", "dist", "build", "out", "target", "vendor", "coverage", "bin", "obj", "__pycache__", "venv", "env"]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def extension(path: Column) -> Column:
    """The last suffix in lower case, '' without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path; declaration files are TypeScript; null if none reads it."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def is_test(path: Column) -> Column:
    dirs = F.split(dir_name(path), "/")
    return F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS))) | base_name(path).rlike(TEST_NAMES)


def in_ignored_dir(path: Column) -> Column:
    return F.exists(F.split(dir_name(path), "/"), lambda d: d.isin(IGNORED_DIRS) | (F.length(d) > 1) & d.startswith("."))


def matches(path: Column, pattern: str) -> Column:
    """'' never matches; without a star a substring; else a glob over the whole path."""
    if not pattern:
        return F.lit(False)
    if "*" not in pattern:
        return path.contains(pattern)
    return path.rlike("^" + ".*".join(re.escape(x) for x in pattern.split("*")) + "$")


def ancestors(path: Column) -> Column:
    """All directories above a path, from the top."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def shared_depth(a: Column, b: Column) -> Column:
    """Leading directories that two paths share."""
    x, y = F.split(dir_name(a), "/"), F.split(dir_name(b), "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])


def normalised(path: Column) -> Column:
    """A path without '.', '..' and empty parts; '..' at the top stays."""
    step = lambda done, p: F.when(p.isin("", "."), done).when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    safe = lambda done, p: F.when(F.size(done) > 0, step(done, p)).otherwise(F.when(p.isin("", "."), done).otherwise(F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), safe), "/")


def duration_ms(text: Column) -> Column:
    """'90s', '5m', '2h', '1d' in milliseconds, else 0."""
    unit = F.regexp_extract(text, r"^\d+\s*([smhd])$", 1)
    factor = F.when(unit == "s", 1_000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)
    return F.coalesce(F.regexp_extract(text, r"^(\d+)\s*[smhd]$", 1).try_cast("long") * factor, F.lit(0)).cast("long")


def line_count(text: Column) -> Column:
    """Lines as wc counts them, and one more for a last line without an end."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return (ends + ((F.length(text) > 0) & ~text.endswith("\n")).cast("int")).cast("long")


def named(name: Column) -> Column:
    """A name as a reader's list orders it: by the Unicode collation (letters before case and accents, signs before digits), not by code unit. For sorting only."""
    return F.collate(name, "UNICODE")


def in_names_order(names: Column) -> Column:
    """An array of names in that order; names that it doesn't tell apart by code unit."""
    return F.transform(F.array_sort(F.transform(F.array_sort(names), named)), lambda x: F.collate(x, "UTF8_BINARY"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-|-$", "")
