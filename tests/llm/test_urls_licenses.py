import textwrap
from pathlib import Path

import pyarrow as pa
import pytest

from assayloom.llm import licenses
from assayloom.llm.licenses import FULL_TEXTS, KNOWN, full_texts, scan_licenses
from assayloom.llm.urls import judge_urls


@pytest.fixture(scope="module")
def make_pages(spark):
    def make(rows):
        return spark.createDataFrame(pa.table({
            "page_id": pa.array([r[0] for r in rows], pa.int64()),
            "url": pa.array([r[1] for r in rows], pa.string()),
            "host": pa.array(["clash"] * len(rows), pa.string()),
            "tokens": pa.array(["clash"] * len(rows), pa.string()),
        }))

    return make


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


CASES = [
    (1, "http://A.Example.ORG/en/5?x=/es/", "a.example.org", "/en/5", "org/", "allow"),
    (2, "https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    (3, "x://b.example.org/en/12#f", "b.example.org", "/en/12", "example.org/en/1", "block"),
    (4, "x://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    (5, "x://example.org", "example.org", "", None, "allow"),
    (6, "x://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"),
    (7, "x://com/de/", "com", "/de/", "com/de/", "block"),
    (8, "x://telecom/de/", "telecom", "/de/", None, "allow"),
    (9, None, "", "", None, "allow"), (10, "no host", "", "", None, "allow"),
    (11, "", "", "", None, "allow"), (None, "x://ÀB.org/Z://y", "Àb.org", "/Z://y", "org/", "allow"),
    (12, "x://a?b/c", "a", "", None, "allow"), (12, "x://" + "l" * 100_000, "l" * 100_000, "", None, "allow"),
]


def test_listed_rules(make_pages, no_labels):
    got = judge_urls(make_pages([c[:2] for c in CASES]), no_labels).collect()
    rows = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str)
    assert rows == sorted(((c[0], *c[2:]) for c in CASES), key=str)


def test_mined_rules(spark, make_pages):
    rows = [(i, f"http://spam{i % 3}.bets.net/win/{i}") for i in range(90)]
    rows += [(i, f"http://site{i % 5}.net/en/{i}") for i in range(100, 300)]
    labels = spark.createDataFrame(
        [(i, 0, 0) for i in range(60)] + [(i, 1, 0) for i in range(100, 250)]
        + [(1, None, 1), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = judge_urls(make_pages(rows), labels).collect()
    assert all((r.verdict == "block") == (r.page_id < 90) for r in got)
    assert all(r.mined for r in got if r.page_id < 90)


def test_no_pages(make_pages, no_labels):
    assert judge_urls(make_pages([]), no_labels).count() == 0


def test_url_plan_is_native(make_pages, no_labels):
    plan = judge_urls(make_pages([c[:2] for c in CASES]), no_labels)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def test_licenses(make_docs):
    mit = KNOWN["MIT"]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n© 2021 Other\n" + mit.upper().replace(",", " ,")),
        (3, "A story.\nReleased under the MIT Licence\nAll rights reserved."),
        (4, "Intro\n\n" + KNOWN["ISC"] + "\n\nend"), (5, None), (6, ""), (7, "Copyright 2020"),
        (8, "word " * 300_000 + "\nLicensed under CC BY-NC 4.0."), (8, "x"), (None, "x"),
        (9, "Released under the MIT License, or not"),
    ]
    got = {(r.doc_id, r.licenses, r.n_licenses, r.whole_text)
           for r in scan_licenses(make_docs(rows)).collect()}
    assert got == {
        (1, "MIT", 1, True), (2, "MIT", 1, True), (3, "MIT-notice", 1, False), (4, "ISC", 1, False),
        (5, "", 0, False), (6, "", 0, False), (7, "", 0, False),
        (8, "CC-BY-NC-4.0-notice", 1, False), (8, "", 0, False), (None, "", 0, False),
        (9, "", 0, False),
    }
    assert scan_licenses(make_docs([])).count() == 0


def test_known_texts_at_several_widths(make_docs):
    cases = [(n, w) for n in KNOWN for w in (20, 31, 47, 60, 72, 80, 99)]
    rows = [(i, "Copyright (c) 2020 The Holders\nCopyright Someone\n"
             + textwrap.fill(" ".join(KNOWN[n].split()), w)) for i, (n, w) in enumerate(cases)]
    isc = textwrap.fill(" ".join(KNOWN["ISC"].split()), 60).replace(
        "above copyright", "above\ncopyright")
    rows.append((len(cases), isc))
    got = {r.doc_id: r.licenses for r in scan_licenses(make_docs(rows)).collect()}
    assert got == {**{i: n for i, (n, _) in enumerate(cases)}, len(cases): "ISC"}


def _file(title, name):
    """A licence file as it is published: title, copyright lines, several paragraphs."""
    text = KNOWN[name].replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    text = text.replace("conditions: The", "conditions:\n\nThe").replace(" 2. Alt", "\n\n2. Alt")
    return f"{title}\n\nCopyright (c) 2015 A and the b contributors\n\n{text}\n"


def test_published_files(make_docs):
    folder = Path(licenses.__file__).parent / "license_texts"
    files = [(n, (folder / f"{n}.txt").read_text("utf-8")) for n in FULL_TEXTS]
    files += [("MIT", _file("The MIT License (MIT)", "MIT")), ("MIT", _file("MIT License", "MIT")),
              ("Zlib", _file("zlib License", "Zlib")), ("ISC", _file("ISC License", "ISC"))]
    bsd = dict(files)["BSD-3-Clause"]
    files.append(("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2008, X.\n"
                  "All rights reserved.\n\n" + bsd.replace("1. ", "* ").replace("2. ", "* ")
                  .replace("3. ", "* ")))
    rows = [(i, t) for i, (_, t) in enumerate(files)]
    rows += [(100 + i, "A document.\n\nIts licence:\n\n" + t + "\n\nThe end.")
             for i, (_, t) in enumerate(files)]
    rows += [(200 + i, "#!/bin/sh\n" + "".join(f"# {x}\n" for x in t.splitlines()) + "code()")
             for i, (_, t) in enumerate(files)]
    rows += [(300 + i, textwrap.fill(" ".join(b.split()), 45))
             for i, (_, _, b) in enumerate(full_texts())]
    rows.append((999, bsd.replace("endorse", "praise")))  # another text
    got = {r.doc_id: (r.licenses, r.whole_text) for r in scan_licenses(make_docs(rows)).collect()}
    for i, (name, _) in enumerate(files):
        assert got[i] == (name, True), i
        # A notice for the user at the end of a file is found beside it.
        assert name in got[100 + i][0].split(",") and not got[100 + i][1], i
        assert name in got[200 + i][0].split(",") and not got[200 + i][1], i
    for i, (name, _, _) in enumerate(full_texts()):
        assert got[300 + i] == (name, True), name
    assert got[999] == ("", False)


def plain_verdicts(pages, bad, min_rows=20, sure=0.8):
    """All token combinations of the labelled URLs, counted one by one."""
    from collections import Counter
    from itertools import chain, combinations

    def tokens(url):
        host, _, path = url.split("://")[1].partition("/")
        return {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in path.split("/") if x}

    def parts(found):
        return chain.from_iterable(combinations(sorted(found), n) for n in range(1, len(found) + 1))

    seen, of = Counter(), Counter()
    for i, url in pages:
        if i in bad:
            for part in parts(tokens(url)):
                seen[part] += 1
                of[part, "block" if bad[i] else "allow"] += 1
    out = {}
    for i, url in pages:
        best = [(of[p, v] / seen[p], of[p, v], v) for p in parts(tokens(url)) for v in ("allow", "block")
                if of[p, v] >= min_rows and of[p, v] / seen[p] >= sure]
        out[i] = max(best)[2] if best else "allow"
    return out


def test_mined_verdicts_equal_counting_all_combinations(spark, make_pages, no_labels):
    import random

    rng = random.Random(7)
    pages = [(i, f"x://{rng.choice('ab')}.{rng.choice('cd')}.net/{rng.choice('ef')}/{rng.choice('gh')}")
             for i in range(700)]
    bad = {i: int(("a.c" in u or "/f/h" in u) == (rng.random() < 0.9)) for i, u in pages if i % 2}
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], no_labels.schema)
    got = {r.page_id: r.verdict for r in judge_urls(make_pages(pages), labels, rules=()).collect()}
    assert got == plain_verdicts(pages, bad)


def test_tokens_that_always_meet_are_one(spark, make_pages, no_labels):
    names = "&".join(f"name{k}=1" for k in range(25))
    rows = [(i, f"x://shop{i % 40}.net/?{names}") for i in range(60)]
    rows += [(i, f"x://site{i % 40}.net/page") for i in range(100, 300)]
    rows += [(900, "x://other.net/?name7=5"), (901, "x://other.net/?name99=5")]
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i, _ in rows if i < 900], no_labels.schema)
    got = {r.page_id: r for r in judge_urls(make_pages(rows), labels, rules=()).collect()}
    assert {got[i].verdict for i in range(60)} == {"block"} == {got[900].verdict}
    assert got[901].verdict == got[150].verdict == "allow"
