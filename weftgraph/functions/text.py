"""Output text, numbers and versions. Native but for `elide_middle_ansi`, which is batched through Arrow."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version of the file formats and manifest language that is spoken here.
FORMAT_VERSION = "1.13.2"
DEFAULT_DEPS_PREFIX = "Note: including file: "


def atoi(text: Column) -> Column:
    """Leading integer as C reads it, 0 if there is none, held within 32 bits."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    wide = F.when(digits == "", F.lit(0)).otherwise(F.regexp_replace(digits, r"^\+", "").cast("decimal(38,0)"))
    return F.least(F.greatest(F.coalesce(wide, F.lit(0)), F.lit(-(2**31))), F.lit(2**31 - 1)).cast("int")


def version_pair(version: Column) -> Column:
    """struct(major, minor)."""
    parts = F.split(version, r"\.")
    return F.struct(atoi(F.get(parts, F.lit(0))).alias("major"), F.coalesce(atoi(F.get(parts, F.lit(1))), F.lit(0)).alias("minor"))


def version_check(version: Column, spoken: str = FORMAT_VERSION) -> Column:
    """ok, older (a warning) or newer (an error), for what a manifest requires."""
    major, minor = (int(x) for x in spoken.split(".")[:2])
    v = version_pair(version)
    return F.when(v["major"] < major, "older").when((v["major"] > major) | (v["minor"] > minor), "newer").otherwise("ok")


def strip_ansi(text: Column) -> Column:
    """Without terminal control sequences; one that never ends takes the rest with it."""
    return F.regexp_replace(text, "\x1b\\[[^A-Za-z]*(?:[A-Za-z]|\\z)|\x1b(?!\\[)", "")


def elide_middle(text: Column, width: int) -> Column:
    """At most `width` characters, the middle replaced by dots; for text without control sequences."""
    if width <= 3:
        short = F.lit("..."[:width])
    else:
        left = (width - 3) // 2
        right = width - 3 - left
        short = F.concat(F.substr(text, F.lit(1), F.lit(left)), F.lit("..."), F.substr(text, F.length(text) - right + 1, F.lit(right)))
    return F.when(F.length(text) <= width, text).otherwise(short)


_COLOUR = re.compile("\x1b\\[[0-9;]*m")


def _elide(text: str | None, width: int) -> str | None:
    if text is None or len(text) <= width:
        return text
    pieces, at = [], 0  # (text, takes room)
    for m in _COLOUR.finditer(text):
        pieces += [(c, True) for c in text[at : m.start()]] + [(m.group(), False)]
        at = m.end()
    pieces += [(c, True) for c in text[at:]]
    shown = sum(room for _, room in pieces)
    if shown <= width:
        return text
    dots = min(3, width)
    first = (width - dots) // 2
    last = shown - (width - dots - first)
    out, seen, dotted = [], 0, False
    for c, room in pieces:
        if not dotted and seen == first:
            out.append("." * dots)
            dotted = True
        if not room:
            out.append(c)
            continue
        if seen < first or seen >= last:
            out.append(c)
        seen += 1
    return "".join(out)


def elide_middle_ansi(text: Column, width: int) -> Column:
    """The same for text with colours, which are kept and take no room."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _elide(x, width))

    return run(text)


def json_escape(text: Column) -> Column:
    """What stands between the quotes of a JSON string."""
    # The short escapes.
    short = [("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
    for plain, escaped in short:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    hexed = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[\\x00-\\x1f]"), F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c)), "")
    return F.when(text.rlike("[\\x00-\\x1f]"), hexed).otherwise(text)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, `most` + 1 where it is more (over characters; for ASCII paths also bytes)."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def suggestion(text: Column, words: Column, most: int = 3) -> Column:
    """The first of the nearest words of an array within `most` edits, else null."""
    near = F.transform(words, lambda w, i: F.struct(edit_distance(text, w, most).alias("d"), i.alias("i"), w.alias("w")))
    return F.array_min(F.filter(near, lambda x: x["d"] <= most))["w"]


def show_includes(output: Column, prefix: str = DEFAULT_DEPS_PREFIX) -> Column:
    """struct(includes, output): files that a compiler says it read, sorted, system files left out; and the rest of its output."""
    lines = F.split(F.regexp_replace(output, "\r\n", "\n"), "\n")
    # What follows the last line feed is a line only if it is not empty.
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    note = lambda x: x.startswith(prefix) & (F.length(x) > len(prefix))
    from .paths import canonical_path

    found = F.transform(F.filter(lines, note), lambda x: canonical_path(F.regexp_replace(F.substr(x, F.lit(len(prefix) + 1)), "^ +", "")))
    own = F.filter(found, lambda x: ~F.lower(x).contains("program files") & ~F.lower(x).contains("microsoft visual studio"))
    first_note = F.array_position(F.transform(lines, note), F.lit(True))
    # Before any note the compiler echoes the name of its input.
    kept = F.filter(lines, lambda x, i: ~note(x) & ~(F.lower(x).rlike(r"\.(c|cc|cxx|cpp|c\+\+)$") & ((first_note == 0) | (i < first_note))))
    text = F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("\n"))), "")
    return F.struct(F.array_sort(F.array_distinct(own)).alias("includes"), text.alias("output"))


def inline_response_file(command: Column, rspfile: Column, content: Column) -> Column:
    """A command with its reference to a response file replaced by what the file holds."""
    at = F.instr(command, rspfile)
    before = F.substr(command, F.lit(1), at - 1)
    after = F.substr(command, at + F.length(rspfile))
    flat = F.replace(content, F.lit("\n"), F.lit(" "))
    out = command
    for lead in ("--option-file=", "-f ", "@"):
        out = F.when(before.endswith(lead), F.concat(F.substr(before, F.lit(1), F.length(before) - len(lead)), flat, after)).otherwise(out)
    return F.when((F.coalesce(rspfile, F.lit("")) == "") | (at <= 1), command).otherwise(out)


def exit_status(code: Column, signal: Column) -> Column:
    """Exit code as a shell gives it: interrupted 130, other signals 128 and the signal."""
    return F.when(signal.isin(2, 15, 1), 130).when(signal > 0, 128 + signal).otherwise(code)
