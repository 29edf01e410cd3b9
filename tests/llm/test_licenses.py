import re

import pytest

from freshet.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    found = []
    for label, phrase in licenses.PHRASES:
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), found


@pytest.fixture
def files(spark):
    texts = [
        "CC-BY cc by", "GNU General Public License, version 3.\nAll rights reserved. all-rights*reserved", None, "", "!!! ...",
        "Été cc ÉBY cc by", "all rights all rights reserved", "Released under the MIT License.", "the mit licence",
        "x " * 30_000 + "Licensed under the Apache License, Version 2.0.", "licensed under the apache something license version 2 0",
    ]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, texts[6], None)]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string")


def test_base_equals_brute_force(files):
    texts = {r.doc_id: r.text for r in files.collect()}
    rows = licenses.license_report(files).collect()
    assert len(rows) == files.count()
    for r in rows:
        n, found = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(found))
        assert r.first_word == (min(found)[0] if found else None) and r.last_word == (max(found)[0] if found else None)
        assert r.base_labels == ",".join(sorted({x[1] for x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_templates_by_relative_position(files):
    rows = {r.doc_id: r for r in licenses.license_report(files).collect()}
    assert rows[1].labels == "gpl,reserved" or "gpl-3.0" not in rows[1].labels
    assert rows[7].labels == "mit" and rows[7].score == 1.0
    assert rows[8].labels == "" and rows[8].score == 0.0
    assert rows[9].labels == "apache-2.0"
    assert rows[10].labels == ""


def test_whole_template_with_a_changed_word(spark):
    notice = dict((t[0], t[1]) for t in licenses.TEMPLATES)["bsd"].replace("permitted", "allowed")
    row = licenses.license_report(spark.createDataFrame([(1, f"Intro. {notice}!")], "doc_id long, text string")).first()
    assert row.labels == "bsd" and 0.9 < row.score < 1


def test_key_phrase_must_stand_in_its_template():
    with pytest.raises(ValueError):
        licenses.templates([("x", "some words", "other words")])


def test_empty_table(files):
    assert licenses.license_report(files.limit(0)).count() == 0
