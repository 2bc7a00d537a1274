"""Makefile-style depfiles, one per row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<outs:array<string>,ins:array<string>,error:string>"

# The grammar: a text is lines of names, and a name is pieces up to a gap. A backslash escapes a space or a mark only if it
# is the last of its run; what it doesn't escape it stands for. Values are of bytes, as file names are.
_PIECES = rb"""
    (?P<quoted_space> (?:\\\\)* \\\x20 )
  | (?P<odd_end>      \\+ (?=\x20) )
  | (?P<hash>         \\+ \# )
  | (?P<target_end>   \\+ : (?=[\x00\x20\r\n\t]) [\x00\x20\r\t]? )
  | (?P<colon>        \\+ : )
  | (?P<joined>       \\ (?: \r?\n | (?=[\x00\r]) | \Z ) )
  | (?P<slashes>      \\\\+ (?=[\x00\r\n]|\Z) )
  | (?P<other>        \\+ [^\\\x20\#:\x00\r\n] )
  | (?P<dollar>       \$\$ )
  | (?P<plain>        [a-zA-Z0-9+?'"&,/_:.~()}{%=@\[\]!\x80-\xff\-]+ )
  | (?P<line_end>     \r?\n )
  | (?P<gap>          . )
"""
_TOKEN = re.compile(_PIECES, re.VERBOSE | re.DOTALL)
#: What a piece adds to a name; the others end it.
_VALUE = {
    "quoted_space": lambda x: x[: len(x) // 2 - 1] + b" ",
    "hash": lambda x: x[:-2] + b"#",
    "colon": lambda x: x[:-2] + b":",
    "slashes": bytes,
    "other": bytes,
    "dollar": lambda x: b"$",
    "plain": bytes,
}


def lines(content: bytes) -> list[list[bytes]]:
    """The names of each line; a backslash at its end joins a line to the next."""
    out: list[list[bytes]] = [[]]
    name = b""
    for m in _TOKEN.finditer(content):
        kind, text = m.lastgroup, m[0]
        if kind in _VALUE:
            name += _VALUE[kind](text)
            continue
        if kind in ("odd_end", "target_end"):
            name += text.rstrip(b"\0 \r\t")
        if name and kind != "odd_end":
            out[-1].append(name)
            name = b""
        if kind == "line_end":
            out.append([])
    if name:
        out[-1].append(name)
    return [x for x in out if x]


def parse(content: bytes) -> tuple[list[str], list[str]]:
    """(outs, ins) of a depfile, each name once and in order; ValueError for what isn't one.

    A line names targets up to the first name that ends with a colon, then
    their inputs. A line without a colon goes on with targets. An input may
    stand as a target too, with no inputs of its own but known ones.
    """
    outs: dict[bytes, None] = {}
    ins: dict[bytes, None] = {}
    rules = lines(content)
    for names in rules:
        cut = next((k for k, x in enumerate(names) if x.endswith(b":")), len(names) - 1)
        targets = [x.removesuffix(b":") for x in names[: cut + 1]]
        known = [x for x in targets if x and x in ins]
        outs |= dict.fromkeys(x for x in targets if x and x not in ins)
        fresh = [y for x in names[cut + 1 :] if (y := x.removesuffix(b":")) and y not in ins]
        if known and fresh:
            raise ValueError("inputs may not also have inputs")
        ins |= dict.fromkeys(fresh)
    if any(x.strip(b":") for names in rules for x in names) and not any(x.endswith(b":") for names in rules for x in names):
        raise ValueError("expected ':' in depfile")
    return [x.decode() for x in outs], [x.decode() for x in ins]


def parse_depfile(content: Column) -> Column:
    """struct(outs, ins, error) of depfile texts."""

    @F.pandas_udf(SCHEMA)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                outs, ins = parse(x.encode() if isinstance(x, str) else bytes(x or b""))
                rows.append((outs, ins, None))
            except ValueError as error:
                rows.append(([], [], str(error)))
        return pd.DataFrame(rows, columns=["outs", "ins", "error"])

    return run(content)
