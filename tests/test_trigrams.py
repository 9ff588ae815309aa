"""What patterns require, against the engine that matches them: no match may be lost, and known patterns require what they should."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import lookup, trigrams


@pytest.mark.parametrize(
    "pattern, regex, want",
    [
        ("ABcd", False, ("and", ("abc", "bcd"))),
        ("ab", False, trigrams.ALWAYS),
        ("aİbcd", False, ("and", ("bcd",))),
        ("hello", True, ("and", ("ell", "hel", "llo"))),
        ("x.*", True, trigrams.ALWAYS),
        ("abc|xyz", True, ("or", (("and", ("abc",)), ("and", ("xyz",))))),
        ("abc|x", True, trigrams.ALWAYS),
        ("Licen[sc]ed?", True, ("or", (("and", ("cen", "enc", "ice", "lic", "nce")), ("and", ("ced", "cen", "enc", "ice", "lic", "nce")), ("and", ("cen", "ens", "ice", "lic", "nse")), ("and", ("cen", "ens", "ice", "lic", "nse", "sed"))))),
        ("(abc)+d", True, ("and", ("abc",))),
        ("(?:abc)?def", True, ("or", (("and", ("abc", "bcd", "cde", "def")), ("and", ("def",))))),
        (r"foo\s+bar\b", True, ("and", (("and", ("foo",)), ("and", ("bar",))))),
        ("(?i)abc", True, trigrams.ALWAYS),
        (r"\Qabc\E", True, trigrams.ALWAYS),
        ("[a-c&&[b]]xyz", True, trigrams.ALWAYS),
        ("(abc", True, trigrams.ALWAYS),
        ("^abc$", True, ("and", ("abc",))),
        ("[^abc]def", True, ("and", ("def",))),
    ],
)
def test_required(pattern, regex, want):
    got = trigrams.required(pattern, regex)
    simple = lambda need: need if isinstance(need, str) else (need[0], tuple(sorted(map(simple, need[1]), key=str)))
    assert simple(got) == simple(want)


def random_pattern(r, depth=0):
    if depth > 2:
        return r.choice(["a", "b", "Cd", "abc", "é", r"\.", "[ab]", "[^a]", "."])
    part = lambda: random_pattern(r, depth + 1)
    return r.choice([
        lambda: part() + part(), lambda: part() + part() + part(), lambda: f"({part()}|{part()})", lambda: f"(?:{part()}){r.choice(['*', '+', '?', '{2}', '{0,2}', '+?', '{1,3}'])}",
        part, lambda: "^" + part(), lambda: part() + "$", lambda: r"\b" + part(), lambda: f"(?={part()})" + part(),
    ])()


def test_no_match_is_lost(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(["a", "b", "c", "C", "d", "é", ".", "\n", "K", "K"]) for _ in range(r.randint(0, 12))) for _ in range(150)] + ["", None, "abc" * 2000]
    texts += ["".join(t) for t in itertools.product("abC", repeat=3)]
    contents = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, content string").cache()
    files = contents.select("path", (F.col("path") == "f3").alias("vendor"))
    index = trigrams.postings(contents).cache()
    wanted = 0
    for pattern, regex in [*((random_pattern(r), True) for _ in range(30)), ("aBc", False), ("ca", False), (".é", False), ("k", False)]:
        plain = lookup.search_code(files, contents, pattern, regex, limit=10_000).collect()
        wanted += trigrams.required(pattern, regex) != trigrams.ALWAYS
        assert lookup.search_code(files, contents, pattern, regex, limit=10_000, index=index).collect() == plain, pattern
    assert wanted > 8


def test_grams(spark):
    texts = ["", "ab", "abc", "ABcaBc", "a\nb\nc", "\U0001f600éß!", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", trigrams.grams(F.col("t")).alias("g")).collect()
    for i, g in got:
        low = texts[i] and texts[i].lower()
        assert g == (None if low is None else list(dict.fromkeys(x for x in (low[k : k + 3] for k in range(len(low) - 2)) if x.isascii())))
