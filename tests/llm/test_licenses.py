"""License scan against Python's regular expressions, and on odd rows."""

import re

from procwatch.llm import licenses

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["", None, "Released under the MIT License.", "under the mit-license under the mit license", "cc by nc cc by nc cc-by-nc",
         "Apache License, Version 2.0", "apache license version 20", "é under the mit license é", "underthe mit license",
         "SPDX-License-Identifier: MPL-2.0\nmore", "Licensed under the Apache-2.0 license", "x " * 30000 + "cc by nc",
         "see https://www.gnu.org/licenses/gpl-3.0.html", "GNU General Public License, version 3", "the \u212a cc BY nc",
         "GNU Lesser General Public License version 2.1", "All rights reserved.", "mit license under the"]


def base_by_hand(text):
    words = [w for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    places, found = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                found.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)))


def detections_by_hand(text):
    """All matches, then those in no match of a better or equal tier that comes before in order."""
    low, found = (text or "").lower(), []
    for rule in licenses.RULES:
        if rule["keyword"] in low:
            flags = rule["pattern"].replace(r"(?i)", "")
            ignore = re.IGNORECASE | re.ASCII if "(?i)" in rule["pattern"] else 0
            found += [(m.start(), -m.end(), rule["tier"], rule["label"], rule["kind"], rule["confidence"])
                      for m in re.finditer(flags, text, ignore)]
    found.sort()
    return [(s, -e, label, kind) for i, (s, e, tier, label, kind, _) in enumerate(found)
            if not any(t <= tier and -o >= -e for _, o, t, *_ in found[:i])]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_phrases(spark):
    for r in licenses.digest(frame(spark)).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_by_hand(TEXTS[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_detections(spark):
    for r in licenses.scan(frame(spark)).collect():
        got = [(d["start"], d["end"], d["label"], d["kind"]) for d in r["detections"]]
        assert got == detections_by_hand(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_containment_is_suppressed(spark):
    text = "SPDX-License-Identifier: GPL-3.0-only; GNU General Public License, version 3"
    got = licenses.scan(frame(spark, [text])).collect()[0]["detections"]
    assert [(d["label"], d["kind"]) for d in got] == [("gpl-3", "tag"), ("gpl", "name"), ("gpl-3", "name")]


def test_rules_are_many_and_gated():
    assert len(licenses.RULES) > 200
    assert all(any(g in r["keyword"] for g in licenses.GATES) for r in licenses.RULES)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in licenses.digest(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_by_hand(texts[r["doc_id"]])


def test_odd_tables(spark):
    assert licenses.digest(frame(spark, [])).count() == 0
    clash = frame(spark, ["cc by nc"] * 2).selectExpr("null as doc_id", "text", "1 as labels", "2 as detections", "3 as _at0")
    assert [r["labels"] for r in licenses.digest(clash).collect()] == ["cc-by-nc"] * 2
    assert licenses.scan(clash).columns.count("detections") == 1
