"""License scans: base phrases and resolution against plain versions, rules against texts written by hand."""

import random
import re

import pytest
from narravane.llm.license_rules import KINDS, rules
from narravane.llm.licenses import BASE, find, license_report, resolved, sureness, words_of
from narravane.llm.queries import QUERIES


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_base(text):
    words = plain_words(text)
    return [(label, i) for i in range(len(words)) for phrase, label in BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]


def plain_resolved(found, kinds):
    """Each match against each other."""
    beats = lambda a, b: (kinds[a[0]], a[1] - a[2], a[0]) < (kinds[b[0]], b[1] - b[2], b[0])
    kept = []
    for m in sorted(set(found), key=lambda m: (kinds[m[0]], m[1] - m[2], m[0])):
        if not any(k[1] <= m[1] and m[2] <= k[2] and beats(k, m) for k in kept):
            kept.append(m)
    return kept


def labels(text):
    _, base, found = find(text.encode())
    return sorted({b for b, _ in base} | {d.label for d in found})


def test_there_are_hundreds_of_rules_in_order():
    order = list(KINDS)
    places = [order.index(r.kind) for r in rules()]
    assert len(places) > 400 and places == sorted(places)


CASES = {
    "SPDX-License-Identifier: MIT": ["mit"],
    "// SPDX-License-Identifier: GPL-2.0-only": ["gpl-2.0"],
    "SPDX-License-Identifier: (LGPL-2.1-or-later)": ["lgpl-2.1-or-later"],
    "Released under the MIT License.": ["mit"],
    "The X11 code is under the MIT licence, see LICENCE": ["mit"],
    "Licensed under the Apache License, Version 2.0 (the License)": ["apache-2"],
    "see http://www.apache.org/licenses/LICENSE-2.0": ["apache-2"],
    "Licensed under CC BY-NC 4.0.": ["cc-by-nc", "cc-by-nc-4.0"],
    "https://creativecommons.org/licenses/by-sa/4.0/": ["cc-by-sa-4.0"],
    "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0"],
    "the GNU Lesser General Public License": ["lgpl"],
    "GNU Affero General Public License v3 or later": ["agpl-3.0-or-later"],
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": ["bsd"],
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": ["mit"],
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file": ["mpl-2.0"],
    "distributed under a 3-clause BSD license": ["bsd-3-clause"],
    "This is free and unencumbered software released into the public domain.": ["unlicense"],
    "It is not licensed under the GNU General Public License.": [],
    "It is compatible with the Apache License": [],
    "a driver's license and a fishing license": [],
    "This file is confidential and proprietary information": ["proprietary"],
    "the license of this house": [],
    "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_texts_written_by_hand(text):
    assert labels(text) == CASES[text]


def test_every_rule_opens_its_own_gate():
    """A match made from a rule's pattern has one of the rule's words."""
    def example(pattern):
        text = pattern.pattern.decode().removeprefix("(?<![^ ])").removesuffix("(?![^ ])")
        text = re.sub(r"\(\?!.*?\)", "", text).replace("licen[cs]es?", "license").replace("(?:[^ ]+ )", "")
        text = re.sub(r"\{\d+,\d+\}\??", "", text)
        text = re.sub(r"\[(.)[^]]*\]", r"\1", text)
        while "(?:" in text:  # the first choice of each group, optional ones left out
            text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m[2] else m[1], text)
        return re.sub(r".\?", "", text.split("|")[0]).strip()

    made = 0
    for rule in rules():
        text = example(rule.pattern)
        if rule.pattern.fullmatch(text.encode()):
            made += 1
            assert rule.keys & set(text.encode().split()), (rule.label, text)
    assert made > 0.9 * len(rules())


def test_resolution_equals_the_plain_one():
    rng = random.Random(5)
    for _ in range(300):
        kinds = sorted(rng.choices(range(4), k=6))
        found = list({(rng.randrange(6), s := rng.randrange(12), s + rng.randrange(1, 8)) for _ in range(rng.randrange(14))})
        assert sorted(resolved(found, kinds)) == sorted(plain_resolved(found, kinds))


def test_words_and_base_phrases_equal_the_plain_ones():
    rng = random.Random(6)
    parts = ["under", "the", "MIT", "License", "license", "cc", "by", "nc", "apache", "version", "2", "é", "İ", "\x7f", "-", ".", "\n", " "]
    for _ in range(400):
        text = rng.choice(["", " ", "-"]).join(rng.choices(parts, k=rng.randrange(30)))
        n, base, _ = find(text.encode())
        assert [w.decode() for w in words_of(text.encode())] == plain_words(text)
        assert (n, base) == (len(plain_words(text)), plain_base(text))


def test_report_of_odd_rows(spark, docs_of):
    texts = [None, "", "cc by nc, CC-BY-NC and under the MIT license", "x " * 200_000 + "under the mit license", "x " * 200_000 + "under the mit license", "plain prose"]
    rows = {r.doc_id: r for r in license_report(docs_of(texts).selectExpr("*", "1 AS n_words", "2 AS labels")).collect()}
    assert tuple(rows[0][1:8]) == tuple(rows[1][1:8]) == (0, 0, None, None, "", "", 0.0)
    assert tuple(rows[2][1:7]) == (11, 3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit")
    assert rows[3].first_word == 200_000 and rows[3][1:] == rows[4][1:]
    assert rows[5].labels == "" and rows[5].score == 0.0
    assert license_report(docs_of([])).collect() == []


def test_query_over_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op11_license_rules"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and any(r.n_base for r in rows)
    for r in rows:
        base, at = plain_base(docs[r.doc_id]), [i for _, i in plain_base(docs[r.doc_id])]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(plain_words(docs[r.doc_id])), len(base), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({label for label, _ in base})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        n, own, found = find((docs[r.doc_id] or "").encode())
        assert r.score == sureness(own, found) and 0 <= r.score <= 1
