"""Dyndep files: inputs and outputs that are only known once a build has begun."""

from __future__ import annotations

from .manifest import Manifest, ManifestError, Scanner, canonical, expand, leading_int

DYNDEPS = "edge_id long, restat boolean, implicit_outputs array<string>, implicit_inputs array<string>"


def parse(manifest: Manifest, filename: str, text: str | None) -> list[tuple[int, bool, list[str], list[str]]]:
    """Rows of DYNDEPS: what each mentioned build statement gets."""
    if text is None:
        raise ManifestError(f"loading '{filename}': No such file or directory")
    s = Scanner(filename, text)
    found: dict[int, tuple[int, bool, list[str], list[str]]] = {}
    version = False
    missing = "expected 'ninja_dyndep_version = ...'"
    nothing = lambda _: ""

    def paths() -> list[str]:
        out = []
        while template := s.template(True):
            path = expand(template, nothing)
            if not path:
                raise s.fail("empty path")
            out.append(canonical(path))
        return out

    def let() -> tuple[str, str]:
        key = s.ident()
        if key is None:
            raise s.fail("expected variable name")
        s.want("equals")
        return key, expand(s.template(False), nothing)

    while True:
        kind, word = s.token()
        if kind == "newline":
            continue
        if kind == "eof":
            if not version:
                raise s.fail(missing)
            return list(found.values())
        if kind == "ident" and not version:
            s.at = s.last
            key, value = let()
            if key != "ninja_dyndep_version":
                raise s.fail(missing)
            parts = [*value.split("."), "0"]
            if (leading_int(parts[0]), leading_int(parts[1])) != (1, 0):
                raise s.fail(f"unsupported 'ninja_dyndep_version = {value}'")
            version = True
            continue
        if kind != "build":
            raise s.unexpected(kind, word)
        if not version:
            raise s.fail(missing)
        outs = paths()
        if not outs:
            raise s.fail("expected path")
        if outs[0] not in manifest.producer:
            raise s.fail(f"no build statement exists for '{outs[0]}'")
        edge = manifest.producer[outs[0]].number
        if edge in found:
            raise s.fail(f"multiple statements for '{outs[0]}'")
        if len(outs) > 1:
            raise s.fail("explicit outputs not supported")
        more_outs = paths() if s.take("pipe") else []
        s.want("colon")
        if s.ident() != "dyndep":
            raise s.fail("expected build command name 'dyndep'")
        if paths():
            raise s.fail("explicit inputs not supported")
        more_ins = paths() if s.take("pipe") else []
        if s.take("pipe2"):
            raise s.fail("order-only inputs not supported")
        s.want("newline")
        restat = False
        if s.take("indent"):
            key, value = let()
            if key != "restat":
                raise s.fail("binding is not 'restat'")
            restat = bool(value)
        found[edge] = (edge, restat, more_outs, more_ins)
