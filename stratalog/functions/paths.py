"""Path and glob functions as column expressions; both separators are accepted, paths compare by upper case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_key(path: Column) -> Column:
    return F.upper(path)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def display_name(path: Column) -> Column:
    trimmed = F.regexp_replace(path, r"[/\\]+$", "")
    name = file_name(trimmed)
    return F.when((name == "") | trimmed.rlike(r"^[A-Za-z]:$"), F.concat(trimmed, F.lit("\\"))).otherwise(name)


def under_prefix(path: Column, prefix: Column, strict: bool = False) -> Column:
    """Ignoring case; without ``strict`` as a plain prefix (so `C:/foo` holds `C:/foobar`), with it only below the directory."""
    p, d = path_key(path), path_key(prefix)
    if not strict:
        return p.startswith(d)
    d = F.regexp_replace(d, r"[/\\]+$", "")
    return (p == d) | F.regexp_replace(p, r"\\", "/").startswith(F.concat(F.regexp_replace(d, r"\\", "/"), F.lit("/")))


def relative_path(path: Column, base: Column) -> Column:
    """What follows the base (no separator check), the file name if nothing does or the base differs."""
    b = F.regexp_replace(base, r"[/\\]+$", "")
    rest = F.regexp_replace(F.substring(path, F.length(b) + 1, F.length(path)), r"^[/\\]+", "")
    return F.when(path_key(path).startswith(path_key(b)) & (rest != ""), rest).otherwise(file_name(path))


def ancestors(path: Column) -> Column:
    """Every folder above a path, from the root on."""
    parts = F.split(path, r"[/\\]")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def common_root(paths: Column) -> Column:
    """Longest common directory of an array of paths, shrunk directory by directory with a plain prefix test that ignores case."""
    dirs = F.filter(F.transform(paths, directory_name), lambda d: d != "")

    def shrink(root: Column, d: Column) -> Column:
        ups = F.concat(F.reverse(ancestors(F.concat(root, F.lit("/x")))), F.array(F.lit("")))
        return F.filter(ups, lambda u: (u == "") | path_key(d).startswith(path_key(u)))[0]

    return F.when(F.size(dirs) == 0, "").otherwise(F.aggregate(dirs, F.get(dirs, F.lit(0)), shrink))


def glob_regex(pattern: str) -> str:
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob_match(name: Column, pattern: str | None) -> Column:
    """`*` and `?` over the whole name, ignoring case; null or empty input or pattern never matches."""
    if not pattern:
        return F.lit(False)
    return F.coalesce(name.rlike(glob_regex(pattern)) & (name != ""), F.lit(False))


def glob_match_column(name: Column, pattern: Column) -> Column:
    """The same for patterns in a column."""
    quoted = F.concat(F.lit("(?is)^\\Q"), F.replace(F.replace(F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("?"), F.lit("\\E.\\Q")), F.lit("\\E$"))
    return F.coalesce(F.when((pattern != "") & (name != ""), F.rlike(name, quoted)), F.lit(False))


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Blank patterns are skipped."""
    out = F.lit(False)
    for p in patterns:
        if p and p.strip():
            out = out | glob_match(name, p)
    return out


#: Fixed value: names that no folder backs up.
SYSTEM_GLOBS = ["*.tmp", "*.temp", "~*", "*.lock", "thumbs.db", "desktop.ini", ".DS_Store", "*.swp", "*.bak"]


def excluded(path: Column, folder: Column, global_globs: list[str], folder_globs: list[str] = (), subfolders: list[str] = ()) -> Column:
    """Globs on name or relative path, subfolders as plain prefixes of the relative path, system globs on the name."""
    name, relative = file_name(path), relative_path(path, folder)
    out = matches_any(name, SYSTEM_GLOBS)
    for g in [*global_globs, *folder_globs]:
        out = out | glob_match(name, g) | glob_match(relative, g)
    for s in subfolders:
        out = out | path_key(relative).startswith(s.rstrip("/\\").upper())
    return out


def unsafe_target(path: Column, sensitive: list[str]) -> Column:
    """Restore targets that climb, lie in a sensitive directory or hold forbidden characters."""
    out = F.array_contains(F.split(path, r"[/\\]"), "..") | path.rlike(r'[\x00-\x1F<>"|?*]') | (F.trim(path) == "")
    for d in sensitive:
        out = out | under_prefix(path, F.lit(d), strict=True)
    return out


def valid_hash(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))
