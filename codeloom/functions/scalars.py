"""Scalar functions of names, docs and paths: as columns, and for parameters as Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(name: Column) -> Column:
    """Identifier words: camelCase, digits, _ and - become spaces; A-Z lowered."""
    spaced = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^0-9])(?=[0-9])", " ")
    return F.translate(F.translate(spaced, "_-", "  "), UPPER, LOWER)


def doc_summary(doc: Column, both_ends: bool = True) -> Column:
    """The first line of a doc comment that says something: stripped of / and *, not a tag."""
    strip = (lambda x: F.btrim(F.btrim(F.btrim(x, F.lit(" \t\r")), F.lit("/*")), F.lit(" \t\r"))) if both_ends else (lambda x: F.btrim(F.regexp_replace(F.btrim(x, F.lit(" \t\r")), r"^[/*]+", ""), F.lit(" \t\r")))
    lines = F.filter(F.transform(F.split(doc, "\n"), strip), lambda x: (x != "") & ~x.startswith("@"))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def short_name(fqn: Column) -> Column:
    """The last name: no (), nothing up to the last of \\ . / : #, no leading $."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(fqn, r"\(\)$", ""), r"^.*[\\./:#]", ""), r"^\$", "")


def short_name_of(fqn: str) -> str:
    return re.sub(r"^\$", "", re.sub(r"(?s)^.*[\\./:#]", "", fqn.removesuffix("()")))


def method_split(fqn: Column) -> Column:
    """struct<class, member>: at the first ::, or for a name with () at the last dot; null if neither."""
    at_colons = F.instr(fqn, "::")
    dotted = fqn.endswith("()") & F.contains(fqn, F.lit("."))
    return F.when(at_colons > 0, F.struct(F.substring(fqn, F.lit(1), at_colons - 1).alias("class"), F.substring(fqn, at_colons + 2, F.length(fqn)).alias("member"))).when(
        dotted, F.struct(F.regexp_extract(fqn, r"(?s)^(.*)\.[^.]*$", 1).alias("class"), F.substring_index(fqn, ".", -1).alias("member"))
    )


def method_split_of(fqn: str):
    """(class, member) or None."""
    if "::" in fqn:
        return tuple(fqn.split("::", 1))
    return tuple(fqn.rsplit(".", 1)) if fqn.endswith("()") and "." in fqn else None


def member_separator(fqn: str) -> str:
    return "::" if "::" in fqn else "."


def snippet(line: Column, most: int = 200) -> Column:
    """A trimmed line, cut at so many characters."""
    text = F.btrim(line, F.lit(" \t\r\n\f\v"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def signature(text: Column) -> Column:
    """White space made single spaces, cut at 200 characters."""
    return snippet(F.regexp_replace(text, r"\s+", " "))


def identifier_candidates(prompt: Column, tokens: int = 60) -> Column:
    """Names in a prompt: of its first tokens those with an upper-case letter or _, each once, in order."""
    found = F.slice(F.regexp_extract_all(prompt, F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), 1), 1, tokens)
    return F.array_distinct(F.filter(found, lambda x: x.rlike("[A-Z_]")))


def module_path(path: Column) -> Column:
    """A script's module: no extension, no /index."""
    return F.regexp_replace(F.regexp_replace(path, r"(\.d\.ts|\.ts|\.tsx|\.js|\.jsx|\.mjs|\.cjs)$", ""), r"/index$", "")


def bool_int(flag: Column) -> Column:
    return flag.cast("int")


def source_window(content: Column, start_line: Column, end_line: Column, offset: int, most: int) -> Column:
    """Lines of a declaration from an offset, at most so many, with a note where to go on. Null if the offset lies past the end."""
    first = start_line + F.lit(offset)
    last = F.least(end_line, first + F.lit(most - 1))
    text = F.array_join(F.slice(F.split(content, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")
    note = F.concat(F.lit("\n// … truncated at line "), last, F.lit(" — call again with sourceOffset="), last - start_line + 1, F.lit(" …"))
    return F.when(first <= end_line, F.when(last < end_line, F.concat(text, note)).otherwise(text))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)
