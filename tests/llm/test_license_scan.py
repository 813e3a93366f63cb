import re
from itertools import product
from re import _parser

import pytest

from millrace.llm import license_scan as L
from millrace.llm import license_rules as R
from millrace.llm.license_rules import LicenseRule, build_rules

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    words = WORD.findall((text or "").translate(UP))
    starts, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def brute_detections(text, rules):
    """All matches, then containment by comparing every pair."""
    normal = " " + " ".join(WORD.findall((text or "").translate(UP))) + " "
    if normal == "  ":
        return []
    found = []
    for i, r in enumerate(rules):
        for m in re.finditer(rf"(?<= )(?:{r.regex})(?= )", normal):
            start = normal[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, r.priority, i, r.label))
    keep = []
    for d in found:
        inside = any(
            e is not d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3])) for e in found
        )
        if not inside:
            keep.append(d)
    return sorted(keep)


TEXTS = [
    None,
    "",
    "   \n",
    "Released under the MIT License.",
    "UNDER THE MIT LICENSE under the mit license",
    "Licensed under the Apache License, Version 2.0. cc by nc cc-by-nc",
    "Licensed under CC BY-NC 4.0. All rights reserved. Copyright 2021 X",
    "under the mit licensee",
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-3.0-only",
    "Übung under the mit license é",
    "word " * 20000 + "under the MIT license",
    "licensed under the apache license version 2 0 and see the apache license version 2 for details " * 40,
]


def test_against_brute_force(spark):
    rules = build_rules()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r for r in L.scan(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t and t[:60]
        want = brute_detections(t, rules)
        assert sorted((d.start, d.stop, d.priority, d.rule, d.label) for d in r.detections) == want
        labels = {d[4] for d in want} | set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(labels)) and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_priority_and_containment(spark):
    rules = (LicenseRule("inner", "b", "b", 3, 0.5), LicenseRule("outer", "b", "a b c", 2, 0.5), LicenseRule("weak", "b", "b c", 1, 0.5), LicenseRule("twin", "b", "a b c", 2, 0.5))
    r = L.scan(spark.createDataFrame([("a b c",)], "text string"), rules=rules).first()
    assert {d.label for d in r.detections} == {"inner", "outer"}


def test_rules_are_many_and_gated():
    rules = build_rules()
    assert len(rules) > 600 and len(R._sentences()) + len(R._NAMES) > 250
    for r in rules:
        re.compile(r.regex)


def test_stems_are_found_by_a_trie():
    stems = sorted({r.stem for r in build_rules()})
    assert not [s for s in stems for t in stems if s != t and s.startswith(t)]
    found = re.compile(f" ({R.trie(stems)})")
    for s in stems:
        assert found.findall(f" x {s}xy {s} ") == [s, s] and not found.findall(f" x{s} ")


def test_every_sentence_is_detected(spark):
    """One text for each hand-written sentence: its label, or that of an earlier rule at the same place, is found."""
    rules = build_rules()
    texts = [(i, alternatives(_parser.parse(regex))[0]) for i, (_, _, regex) in enumerate(R._sentences())]
    got = {r.i: {(d.label) for d in r.detections} for r in L.scan(spark.createDataFrame(texts, "i int, text string")).collect()}
    for i, t in texts:
        assert got[i] == {d[4] for d in brute_detections(t, rules)} and got[i], t


def test_many_detections_in_one_text(spark):
    import time

    text = "copyright 2020 all rights reserved " * 20_000  # 700 KB, 40,000 detections
    df = spark.createDataFrame([(text,)], "text string")
    start = time.perf_counter()
    r = L.scan(df).first()
    assert len(r.detections) == 40_000 and r.detections[-1].stop == 100_000
    assert time.perf_counter() - start < 60


def test_random_spans_resolve_like_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = "a b c d e f".split()
    rules = tuple(LicenseRule(f"l{i}", p.split()[0], p, rng.randrange(1, 4), 0.5) for i, p in enumerate(sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(60)})))
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 900])))) for i in range(30)]
    for r in L.scan(spark.createDataFrame(texts, "i int, text string"), rules=rules).collect():
        assert sorted((d.start, d.stop, d.priority, d.rule, d.label) for d in r.detections) == brute_detections(r.text, rules)


def test_clashing_names(spark):
    df = spark.createDataFrame([("under the MIT license", 1, "x", 0.5)], "text string, normal int, SPANS string, score double")
    r = L.scan(df).first()
    assert r.normal == 1 and r.SPANS == "x" and r.score == 1.0 and r.labels == "mit"


def test_keeps_other_columns_and_runs_no_python(spark):
    df = spark.createDataFrame([("x", 7)], "text string, labels int")
    out = L.scan(df.withColumnRenamed("labels", "other"))
    assert out.columns[:2] == ["text", "other"] and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert L.scan(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["under the mit license", "license mit"])
def test_keyword_is_in_every_match(text):
    normal = f" {text} "
    hit = [r for r in build_rules() if re.search(rf"(?<= )(?:{r.regex})(?= )", normal)]
    assert hit and all(r.keyword in normal and f" {r.stem}" in normal for r in hit)


def alternatives(parsed):
    """Strings that an expression matches: every branch, every optional part with and without."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            here = [chr(arg)]
        elif kind == "BRANCH":
            here = [s for branch in arg[1] for s in alternatives(branch)]
        elif kind == "SUBPATTERN":
            here = alternatives(arg[-1])
        elif kind == "MAX_REPEAT":
            low, high, body = arg
            one = alternatives(body)
            here = ["".join(t) for n in range(low, min(int(high), max(low, 1)) + 1) for t in product(one if n == 1 else one[:1], repeat=n)]
        else:
            assert kind == "IN"
            here = [chr(a) for o, a in arg if str(o) == "LITERAL"] or ["1"]
        out = [a + b for a in out for b in here]
    return out


def test_keyword_and_stem_are_in_every_alternative():
    lost = set()
    for r in build_rules():
        for s in alternatives(_parser.parse(r.regex)):
            assert re.fullmatch(r.regex, s), (r.regex, s)
            if r.keyword not in f" {s} " or not r.stem or f" {r.stem}" not in f" {s} ":
                lost.add((r.label, r.keyword, s))
    assert not lost


def test_every_alternative_is_detected(spark):
    texts = {
        "Released under the Expat License": "mit",
        "CreativeML Open RAIL-M license": "openrail",
        "BigScience OpenRAIL-M": "openrail",
        "the Responsible AI License": "bigscience",
        "Unauthorised copying of this file": "proprietary",
        "Unauthorized copying of this work": "proprietary",
        "for academic use only": "research-only",
        "for research and academic purposes only": "research-only",
    }
    got = {r.text: (r.labels, r.score) for r in L.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert {t: labels for t, (labels, _) in got.items()} == texts and all(s > 0 for _, s in got.values())
