"""Loading shapes from files, folders, text and graphs (SRC-1 to SRC-3, SRC-10)."""

from __future__ import annotations

import os

from .turtle import Graph, parse

SUFFIXES = (".ttl", ".trig", ".nt", ".nq", ".n3")


def load_shapes(source: str | os.PathLike | Graph | list) -> Graph:
    """One graph of all sources. A folder gives its RDF files in order, not those below; text that is no path is
    Turtle. There is no network: a URL is refused."""
    if isinstance(source, Graph):
        return source
    if isinstance(source, (list, tuple)):
        if not source:
            raise ValueError("no shapes to load")
        out = load_shapes(source[0])
        for other in source[1:]:
            out = out + load_shapes(other)
        return out
    text = os.fspath(source)
    if "\n" not in text and os.path.isdir(text):
        names = sorted(x for x in os.listdir(text) if x.endswith(SUFFIXES))
        if not names:
            raise ValueError(f"no RDF files in {text}")
        return load_shapes([os.path.join(text, x) for x in names])
    if "\n" not in text and os.path.isfile(text):
        with open(text, encoding="utf-8") as f:
            body = f.read()
        return parse(nquads_as_trig(body) if text.endswith(".nq") else body)
    if text.startswith(("http://", "https://")):
        raise ValueError("shapes are not loaded from the network")
    return parse(text)


def nquads_as_trig(text: str) -> str:
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        body = line.rstrip(".").rstrip()
        head, _, last = body.rpartition(" ")
        named = last.startswith(("<", "_:")) and len(parse_terms(head)) == 3
        out.append(f"{last} {{ {head} }}" if named else f"{body} .")
    return "\n".join(out)


def parse_terms(text: str) -> list[str]:
    import re

    return re.findall(r'<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[\w-]+)?', text)
