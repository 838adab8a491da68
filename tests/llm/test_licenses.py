import itertools
import random

import pytest

from ondula.llm import licenses


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_ascends_and_never_beats_the_longest():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest(a, b)
    assert len(licenses.align(list("xaybzc"), list("abc"))) == 3


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_every_template_is_found_within_prose(name):
    scan = licenses.Scanner()
    for notice in licenses.TEMPLATES[name]:
        text = "Die Worte of the day are long. " * 30 + notice + " And the under is version license text. " * 30
        found = scan(text)
        assert [f[2] for f in found] == [name]
        assert found[0][3] == 1.0 and licenses.words_of(text[found[0][0]:found[0][1]]) == licenses.words_of(notice)


def test_changed_repeated_and_foreign_notices():
    scan = licenses.Scanner()
    notice = licenses.TEMPLATES["MIT"][2]
    changed = notice.replace("free of charge", "without charge").replace("substantial ", "")
    assert [f[2] for f in scan("intro " + changed)] == ["MIT"]
    short = "Licensed under the Apache License, Version 2.0.\n"
    assert [f[2] for f in scan(short + "some words between them here and there and so on " + short)] == ["Apache-2.0"] * 2
    assert [f[2] for f in scan(short * 3)] == ["Apache-2.0"] * 3
    assert scan("Released under the old bridge, the license of the poet.") == []
    assert scan(None) == [] and scan("") == []


def test_scan(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x " * 100000 + "Released under the MIT License.", 0), (3, "Licensed under CC BY-NC 4.0.", 0), (None, "Licensed under CC BY 4.0.", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses int")
    got = [[x.license for x in r.licenses] for r in licenses.scan(docs).collect()]
    assert got == [[], [], ["MIT"], ["CC-BY-NC-4.0"], ["CC-BY-4.0"]]
    assert licenses.scan(docs.where("false")).count() == 0


def named(text):
    return [f[2] for f in licenses.Scanner()(text)]


def test_kindred_licenses_are_told_apart():
    gpl = licenses.TEMPLATES["GPL-3.0"][1]
    assert named(gpl.replace("GNU General", "GNU Affero General")) == ["AGPL-3.0"]
    assert named(gpl.replace("GNU General", "GNU Lesser General")) == ["LGPL-3.0"]
    assert named(licenses.TEMPLATES["LGPL-2.1"][1].replace("Lesser ", "")) == []  # a version that the General Public License never had
    assert named(gpl.replace("This program", "This library")) == ["GPL-3.0"]
    assert named(licenses.TEMPLATES["LGPL-3.0"][1] + "\n\n" + gpl) == ["LGPL-3.0", "GPL-3.0"]
    two, three = licenses.TEMPLATES["BSD-2-Clause"][0], licenses.TEMPLATES["BSD-3-Clause"][1]
    assert named(two) == ["BSD-2-Clause"] and named(three) == ["BSD-3-Clause"]
    for kin in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        assert named(f"Text. Licensed under CC {kin} 4.0. More text.") == [f"CC-{kin}-4.0"]
    assert named("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 License.") == []


def test_denied_notices():
    assert named("It is not licensed under the MIT License.") == []
    assert named("It isn't released under the MIT License.") == []
    assert named("It was never licensed\nunder the Apache License, Version 2.0.") == []
    assert named("It is not only licensed under the MIT License.") == ["MIT"]
    assert named("This is not public. Licensed under the MIT License.") == ["MIT"]
    assert named("Not licensed under the MIT License. Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]


def test_scan_against_alignment_of_every_window():
    rng = random.Random(5)
    scan = licenses.Scanner()
    short = [n for n in scan.notices if len(n.words) < licenses.SHORT]
    seen = 0
    for _ in range(300):
        notice = rng.choice(short)
        words = [w for w in notice.words if rng.random() > 0.08]
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["lesser", "nc", "sa", "old", "the", "general", "3", "4.0"]))
        words = [rng.choice(["stone", "under", "work", "by"]) for _ in range(3)] + words + ["river", "the", "license"]
        brute = set()
        for n in short:
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + len(n.words) * 3 // 2 + 2) + 1):
                    pairs = licenses.align(words[a:b], n.words)
                    if pairs and n.names(words, a, pairs):
                        brute.add(n.name)
        got = {f[2] for f in scan(" ".join(words))}
        assert got <= brute and bool(got) == bool(brute), (words, got, brute)
        seen += bool(got)
    assert seen > 100
