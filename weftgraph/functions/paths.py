"""Paths and command-line quoting, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that need no quotes in a shell.
SHELL_SAFE = r"^[A-Za-z0-9_+\-./]*$"
WIN32_UNSAFE = r"[ \"]"


def canonical_path(path: Column) -> Column:
    """One spelling of a path: no empty or ``.`` parts, ``x/..`` folded, leading ``..`` kept, no slash at the end."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")

    def fold(stack: Column, part: Column) -> Column:
        last = F.get(stack, F.size(stack) - 1)
        pops = (part == "..") & (F.size(stack) > 0) & (last != "..")
        return F.when(pops, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.array_append(stack, part))

    joined = F.array_join(F.aggregate(parts, none, fold), "/")
    relative = F.when(joined == "", ".").otherwise(joined)
    return F.when(path == "", "").when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(relative)


def decanonicalize(path: Column, backslashes: Column, windows: bool = False) -> Column:
    """The path with backslashes where bit k of `backslashes` (long) says so of slash k; slashes from the 65th on stay. Elsewhere than on Windows the path itself."""
    if not windows:
        return path
    bit = lambda k: (k < 64) & (F.call_function("shiftrightunsigned", backslashes, k.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    slash = lambda k: F.when(bit(k), "\\").otherwise("/")
    return F.array_join(F.transform(F.split(path, "/"), lambda part, i: F.when(i == 0, part).otherwise(F.concat(slash(i - 1), part))), "")


def dir_name(path: Column) -> Column:
    """What stands before the last run of slashes, or nothing."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*?)/+[^/]*$", 1)).otherwise("")


def shell_escape(path: Column) -> Column:
    """Quoted for a POSIX shell where that is needed."""
    return F.when(path.rlike(SHELL_SAFE), path).otherwise(F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def win32_escape(path: Column) -> Column:
    """Quoted as the C runtime of Windows takes arguments apart: backslashes are doubled before a quote and at the end."""
    inner = F.regexp_replace(path, r'(\\*)"', r'$1$1\\"')
    inner = F.regexp_replace(inner, r"(\\+)$", r"$1$1")
    return F.when(path.rlike(WIN32_UNSAFE), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(path)
