import fnmatch
import random
import re

from hazegrid.llm import urls

CASES = [
    ("https://Example.ORG/es/x?q#f", "example.org", "/es/x", "example.org/es/", "block"),
    ("http://sub.example.org/en/12", "sub.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
    ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
    ("http://a.com/x/b.org/es/", "a.com", "/x/b.org/es/", None, "allow"),
    ("http://a.com/fr", "a.com", "/fr", None, "allow"),
    ("http://example.org?x=/es/", "example.org", "", None, "allow"),
    ("http://www.casino-win.example.net/en/1", "www.casino-win.example.net", "/en/1", None, "block"),
    ("ftp://x.net/a/wp-login.php", "x.net", "/a/wp-login.php", None, "block"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("//no.scheme/x", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄB.org/ä\n?x", "Äb.org", "/ä\n", "org/", "allow"),
]


def test_rules_and_verdicts(spark):
    rows = [(i, c[0], "clash", "clash") for i, c in enumerate(CASES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]][1:]
    assert urls.judge(pages.limit(0)).collect() == []
    assert {r["verdict"] for r in urls.judge(pages, rules=(), spam=()).collect()} == {"allow"}


def _regex(glob):
    return re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|[^*?]", glob)), re.S)


def test_automaton_equals_regular_expressions():
    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "ab"]) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs] + ["*" + "ab" * 40 + "**"]  # longer than one word
    strings = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", "x" + "ab" * 40 + "/b"]
    got = urls.ShiftAnd(globs).run(strings)
    for i, s in enumerate(strings):
        assert [bool(_regex(g).fullmatch(s)) for g in globs] == got[i].tolist(), s
    assert fnmatch.fnmatch("abc", "a*c") and urls.ShiftAnd(["a*c"]).run(["abc"])[0, 0]
