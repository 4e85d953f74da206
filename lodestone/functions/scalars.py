"""Scalar functions on names, paths, hashes and numbers, all as Catalyst expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(name: Column) -> Column:
    return F.regexp_extract(name, r"[^.#/]*$", 0)


def fact_id(repo: Column, kind: Column, name: Column, file: Column, sep: str = "\0") -> Column:
    """128 bits of SHA-256 over the identity fields; positions don't enter it."""
    return F.substring(F.sha2(F.concat_ws(sep, repo, kind, name, file), 256), 1, 32)


def body_hash(text: Column) -> Column:
    """A hash of a body's lines, each trimmed, blank ones left out: layout doesn't change it."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.substring(F.sha2(F.array_join(kept, "\n"), 256), 1, 32)


def camel_words(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), r"[ _\-]+"), lambda x: x != "")


def singular(word: Column) -> Column:
    return F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^su]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|spec|specs|__tests__|testdata)/|(_test|_spec|\.test|\.spec)\.[a-z]+$|(^|/)test_[^/]*\.py$")


def glob_regex(glob: str) -> str:
    """** crosses directories, * and ? don't, {a,b} are alternatives."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : j].split(","))) + ")", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)
