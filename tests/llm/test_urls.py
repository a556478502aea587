from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.tables import by_id
from tidemark.llm import urls


def as_pattern(glob: str) -> str:
    return "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "(?s:.)"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", glob, re.S))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/*?", min_size=1, max_size=6), min_size=1, max_size=30), st.lists(st.text("ab/", max_size=9), max_size=8))
def test_automaton_equals_regular_expressions(globs, texts):
    found = urls.GlobAutomaton(globs).match([t.encode() for t in texts])
    for i, text in enumerate(texts):
        for k, glob in enumerate(globs):
            assert found[i, k] == bool(re.fullmatch(as_pattern(glob), text))


def test_rules(spark):
    cases = {
        "http://example.net/en/x": ("example.net", "/en/x", "example.net/en/", "allow"),
        "HTTPS://WWW.Example.NET/fr?q": ("www.example.net", "/fr", "net/", "block"),
        "http://a.example.com/de/": ("a.example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://b.org/fr/x#y": ("b.org", "/fr/x", "org/fr/", "allow"),
        "http://net": ("net", "", None, "allow"),
        "http://net/": ("net", "/", "net/", "block"),
        "no scheme": ("", "", None, "allow"),
        "x://y://z.net/a": ("y:", "//z.net/a", None, "allow"),
        "http://a.casino-royal.com/p": ("a.casino-royal.com", "/p", None, "block"),
        "": ("", "", None, "allow"),
    }
    rows = [(k, u, "h") for k, u in enumerate(cases)] + [(99, None, None), (100, "http://e.net/" + "a" * 50_000, None)]
    got = by_id(urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")), "page_id")
    for k, want in enumerate(cases.values()):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == want
    assert got[99]["host"] == got[99]["path"] == "" and got[100]["rule"] == "net/"
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
