"""Code search by trigrams: postings of every text's runs of three characters, and which of them a pattern can't match without."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser

#: Strings that a part of a pattern is spelt out into at most, and characters of a class.
SPELLINGS, CLASS = 64, 8
#: What holds of every text.
ALWAYS = ("and", ())


def grams(text):
    """The distinct runs of three ASCII characters of a text, in lower case; no pattern requires others."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?=([\\x00-\\x7f]{3}))"), 1))


def postings(contents, keep=("path",)):
    """keep, gram: one row for each text and trigram of contents(..., content)."""
    return contents.select(*keep, F.explode(grams(F.col("content"))).alias("gram"))


def _of_string(text):
    """What a text holds that holds this string: all trigrams of its runs of ASCII characters, whose lower case depends on nothing else."""
    found = {run[i : i + 3] for run in re.findall(r"[\x00-\x7f]+", text.lower()) for i in range(len(run) - 2)}
    return ("and", tuple(sorted(found)))


def both(parts):
    """All of the parts; those that always hold are left out."""
    parts = [p for p in parts if p != ALWAYS]
    return parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(parts):
    """One of the parts; if one always holds, so does this."""
    parts = list(dict.fromkeys(parts))
    if not parts or ALWAYS in parts:
        return ALWAYS
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _spelt(strings):
    return either([_of_string(s) for s in sorted(strings)])


def _class(items):
    """The characters of a small class, or None."""
    out = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(value)
        elif op is sre.RANGE and value[1] - value[0] < CLASS:
            out |= set(range(value[0], value[1] + 1))
        else:
            return None
    return {chr(c).lower() for c in out} if len(out) <= CLASS and all(c < 128 for c in out) else None


def _part(op, value):
    """(the strings that it matches exactly, or None for too many or unknown; what holds besides) of one part of a pattern."""
    if op is sre.LITERAL:
        return ({chr(value).lower()} if value < 128 else None), ALWAYS
    if op is sre.IN:
        return _class(value), ALWAYS
    if op is sre.AT:
        return {""}, ALWAYS
    if op is sre.SUBPATTERN:
        _, added, taken, inner = value
        if added or taken:
            raise ValueError("flags")
        return _sequence(inner)
    if op is sre.BRANCH:
        found = [_sequence(alternative) for alternative in value[1]]
        strings = set().union(*[s for s, _ in found if s is not None])
        if all(s is not None for s, _ in found) and len(strings) <= SPELLINGS:
            return strings, ALWAYS
        return None, either([rest if s is None else _spelt(s) for s, rest in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, rest = _sequence(inner)
        if most == 1 and strings is not None and rest == ALWAYS:
            return (strings if least else strings | {""}), ALWAYS
        if not least:
            return None, ALWAYS
        return None, rest if strings is None else _spelt(strings)
    if op is sre.ATOMIC_GROUP:
        strings, rest = _sequence(value)
        return None, rest if strings is None else _spelt(strings)
    return None, ALWAYS  # any character, negated classes, look-around, back references


def _sequence(items):
    """_part of a sequence: neighbours that are spelt out are put together, so that trigrams across them count."""
    run, parts, whole = {""}, [], True
    for op, value in items:
        strings, rest = _part(op, value)
        parts.append(rest)
        if strings is not None and len(run) * len(strings) <= SPELLINGS:
            run = {a + b for a in run for b in strings}
            continue
        parts.append(_spelt(run))
        whole = False
        run = strings if strings is not None else {""}
    if whole and both(parts) == ALWAYS:
        return run, ALWAYS
    return None, both([*parts, _spelt(run)])


def required(pattern, regex=False):
    """What a text must hold, in lower case, for a line of it to match: a trigram, or ("and" | "or", parts); ALWAYS if nothing is known.

    A literal matches in any case. A regular expression is read by Python's own parser; where that could read it otherwise than Java's
    does (flags, classes within classes, quoted stretches), nothing is required, so a search is never short of a match.
    """
    if not regex:
        return _of_string(pattern)
    if re.search(r"&&|\[[^\]]*\[|\(\?[^:>=!<]|\\[QEGpPXRhHvVNkxuc0-9]", pattern):
        return ALWAYS
    try:
        strings, rest = _sequence(parser.parse(pattern))
    except (re.error, ValueError, OverflowError, RecursionError):
        return ALWAYS
    return rest if strings is None else _spelt(strings)


def leaves(need):
    """The trigrams that are named anywhere in what is required."""
    return {need} if isinstance(need, str) else set().union(*map(leaves, need[1]))


def _holds(need, held):
    if isinstance(need, str):
        return F.array_contains(held, need)
    join = (lambda a, b: a & b) if need[0] == "and" else (lambda a, b: a | b)
    return reduce(join, [_holds(part, held) for part in need[1]])


def candidates(index, need, key="path"):
    """key of the texts that hold what is required, by postings index(key, gram); None if nothing is required.

    Only postings of the named trigrams are read, and a text has at most one row of each.
    """
    named = leaves(need)
    if not named:
        return None
    found = index.where(F.col("gram").isin(*sorted(named)))
    if isinstance(need, str) or (need[0] == "and" and all(isinstance(x, str) for x in need[1])):
        return found.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(named)).select(key)
    return found.groupBy(key).agg(F.collect_set("gram").alias("held")).where(_holds(need, F.col("held"))).select(key)
