import re

import pytest

from tomewright.llm import licenses


def _brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Released under the MIT License. mit  LICENSE, (MIT)license", None, "", "GNU Lesser General Public-License v3; Apache\nLicense", "submit license", "mit licenses",
    "x " * 60_000 + "mit license", "é mit license ü", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "mit license mit license",
]


def test_base_columns_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, labels string")
    out = {r.doc_id: r for r in licenses.scan_licenses(df.select("doc_id", "text"), ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert out[8].labels == "apache,gpl,mit"
    assert licenses.scan_licenses(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize(
    "line,postfix,whole",
    [
        ("MIT", ["MIT"], True),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"], True),
        ("(MIT or ISC) and GPL-2.0 with X", ["MIT", "ISC", "or", "GPL-2.0", "X", "with", "and"], True),
        ("MIT AND", ["MIT"], False),
        ("AND MIT", [], False),
        ("(MIT", ["MIT"], False),
        ("MIT)", ["MIT"], False),
        ("MIT and more prose", ["MIT", "more", "and"], True),
        ("", [], False),
    ],
)
def test_expressions(line, postfix, whole):
    assert licenses.parse_expression(line) == (postfix, whole)


def test_evaluation():
    ways = licenses.evaluate(licenses.parse_expression("(MIT OR ISC) AND GPL-2.0 WITH CE")[0])
    assert ways == [frozenset({"mit", "gpl-2.0 with ce"}), frozenset({"isc", "gpl-2.0 with ce"})]
    assert licenses.expression_labels("LGPL-2.1+ or zlib") == ["lgpl", "zlib"]


def test_no_licence_of_a_long_expression_is_lost(spark):
    choices = " AND ".join(f"(L{2 * i} OR L{2 * i + 1})" for i in range(60))
    want = sorted(f"l{i}" for i in range(120))
    assert licenses.expression_labels(choices) == want
    listed = f"({' OR '.join(f'L{i}' for i in range(120))}) AND MIT"
    assert licenses.expression_labels(listed) == [*want, "mit"]
    ways = licenses.evaluate(licenses.parse_expression(" AND ".join(["(A OR B)", *(f"(L{2 * i} OR L{2 * i + 1})" for i in range(7))]))[0])
    assert len(ways) == 256 and sum("b" in w for w in ways) == 128
    assert len(licenses.evaluate(licenses.parse_expression(listed)[0])) == 120
    df = spark.createDataFrame([(1, f"SPDX-License-Identifier: {choices}")], "doc_id long, text string")
    assert licenses.scan_licenses(df, ["doc_id"]).collect()[0].labels == ",".join(want)


def test_labels_are_those_of_the_alternatives():
    for line in ["(MIT OR Apache-2.0) AND GPL-2.0 WITH CE", "(MIT OR ISC) WITH X", "A OR (B AND (C OR D))", "MIT AND", "(MIT", ""]:
        postfix = licenses.parse_expression(line)[0]
        assert licenses.expression_labels(line) == sorted({licenses.family(name) for way in licenses.evaluate(postfix) for name in way})


def test_prose_names_no_licence(spark):
    for line, want in [("see below", []), ("see LICENSE file", []), ("Zlib */", ["zlib"]), ("MIT and more prose", ["mit"]), ("MIT for this file", ["mit"]), ("Zlib-acknowledgement see there", ["zlib-acknowledgement"]), ("NONE", []), ("NOASSERTION", []), ("mitigate this", [])]:
        assert licenses.expression_labels(line) == want, line
    df = spark.createDataFrame([(1, "SPDX-License-Identifier: see below")], "doc_id long, text string")
    assert [(r.labels, r.score) for r in licenses.scan_licenses(df, ["doc_id"]).collect()] == [("", 0.0)]


def test_many_places_in_linear_time():
    import time

    automaton = licenses.build_automaton()
    began = time.process_time()
    found = licenses.scan_text(automaton, "the mit license or " * 100_000)
    assert (found["n_base"], found["first_word"], found["last_word"]) == (100_000, 1, 399_997)
    assert time.process_time() - began < 8


def test_tags_are_read_to_the_end_of_their_line():
    scanner = licenses.build_automaton()
    text = "é SPDX-License-Identifier: MIT\r\nİ # spdx-LICENSE-identifier:Apache-2.0 OR\tZlib\nSPDX-License-Identifier:\nend SPDX License Identifier: ISC"
    found = licenses.scan_text(scanner, text)
    assert found["expressions"] == ["MIT", "Apache-2.0 OR\tZlib", ""]
    assert found["labels"] == "apache,mit,zlib"
