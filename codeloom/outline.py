"""Outlines of one file, as JSON or as text."""

from __future__ import annotations

import json

from .extract.run import extract_file


def _index(path, text):
    index = extract_file(path, text)
    if index is None:
        raise ValueError(f"no parser for {path}")
    return index


def outline_json(path, text):
    return json.dumps(_index(path, text), indent=2, ensure_ascii=False)


def summary(doc):
    """The first line of a doc comment that says something; / and * go on the left only."""
    for line in doc.split("\n"):
        line = line.strip().lstrip("/*").strip()
        if line and not line.startswith("@"):
            return line
    return ""


def outline_text(path, text):
    """Symbols with their hierarchy edges and the gist of their docs."""
    index = _index(path, text)
    relations: dict = {}
    for e in index["edges"]:
        if e["kind"] in ("extends", "implements", "uses_trait"):
            relations.setdefault(e["from_fqn"], []).append(f"{e['kind']} {e['to_fqn']}")
    out = [f"{index['path']} ({index['lang']})" + (" with errors" if index["has_errors"] else "")]
    for s in index["symbols"]:
        pad = "    " if s["container"] else "  "
        out.append(f"{pad}{s['kind']} {s['name']} {s['start_line']}-{s['end_line']}")
        out += [f"{pad}  {r}" for r in relations.get(s["fqn"], ())]
        if s["doc"] and (gist := summary(s["doc"])):
            out.append(f"{pad}  {gist}")
    return "\n".join(out)
