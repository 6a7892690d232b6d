"""License scan by ordered signature rules (DataFrame functions only).

Rules are regular expressions in tiers of priority. A rule runs on a text only if its
keyword stands in the text in lower case, and no rule runs on a text that has none of a
few short gates. All detections of a text are then swept in order of start: one that
lies within a detection of a better or equal tier is suppressed.

Everything happens within the row, so nothing is shuffled and no key can be hot.
"""

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# Characters that end a word, and the phrases every scan looks for.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE_PHRASES = {"under the mit license": "mit",
                "apache license version 2": "apache-2",
                "cc by nc": "cc-by-nc"}

# Label, SPDX identifier, words of the full name, address.
# Words are alternatives where a bar stands; a word in brackets may be missing.
LICENSES = [
    ("0bsd", "0BSD", "zero clause bsd license", "opensource.org/license/0bsd"),
    ("afl-3", "AFL-3.0", "academic free license [version|v] 3", "opensource.org/licenses/afl-3.0"),
    ("agpl-3", "AGPL-3.0", "affero general public license [version|v] 3", "gnu.org/licenses/agpl-3.0"),
    ("apache-1.1", "Apache-1.1", "apache software license [version|v] 1 1", "apache.org/licenses/license-1.1"),
    ("apache-2", "Apache-2.0", "apache license [version|v] 2", "apache.org/licenses/license-2.0"),
    ("artistic-1", "Artistic-1.0", "artistic license [version|v] 1", "opensource.org/licenses/artistic-license-1.0"),
    ("artistic-2", "Artistic-2.0", "artistic license [version|v] 2", "opensource.org/licenses/artistic-2.0"),
    ("beerware", "Beerware", "beer ware license", "people.freebsd.org/~phk"),
    ("blueoak-1", "BlueOak-1.0.0", "blue oak model license", "blueoakcouncil.org/license/1.0.0"),
    ("bsd-1", "BSD-1-Clause", "bsd 1 clause license", "opensource.org/license/bsd-1-clause"),
    ("bsd-2", "BSD-2-Clause", "bsd 2 clause license", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3", "BSD-3-Clause", "bsd 3 clause license", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4", "BSD-4-Clause", "bsd 4 clause license", "spdx.org/licenses/bsd-4-clause"),
    ("bsl-1", "BSL-1.0", "boost software license [version|v] 1", "boost.org/license_1_0.txt"),
    ("busl-1.1", "BUSL-1.1", "business source license [version|v] 1", "mariadb.com/bsl11"),
    ("cc0-1", "CC0-1.0", "creative commons zero", "creativecommons.org/publicdomain/zero"),
    ("cc-by", "CC-BY-4.0", "creative commons attribution [4] [0] international|license", "creativecommons.org/licenses/by/"),
    ("cc-by-nc", "CC-BY-NC-4.0", "creative commons attribution noncommercial", "creativecommons.org/licenses/by-nc/"),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", "attribution noncommercial noderivatives", "creativecommons.org/licenses/by-nc-nd/"),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", "attribution noncommercial sharealike", "creativecommons.org/licenses/by-nc-sa/"),
    ("cc-by-nd", "CC-BY-ND-4.0", "creative commons attribution noderivatives", "creativecommons.org/licenses/by-nd/"),
    ("cc-by-sa", "CC-BY-SA-4.0", "creative commons attribution sharealike", "creativecommons.org/licenses/by-sa/"),
    ("cddl-1", "CDDL-1.0", "common development and distribution license", "opensource.org/licenses/cddl1"),
    ("cecill-2", "CECILL-2.1", "cecill free software license agreement", "cecill.info/licences"),
    ("cpl-1", "CPL-1.0", "common public license [version|v] 1", "opensource.org/licenses/cpl1.0"),
    ("ecl-2", "ECL-2.0", "educational community license [version|v] 2", "opensource.org/licenses/ecl-2.0"),
    ("elastic-2", "Elastic-2.0", "elastic license [version|v] 2", "elastic.co/licensing/elastic-license"),
    ("epl-1", "EPL-1.0", "eclipse public license [version|v] 1", "eclipse.org/legal/epl-v10"),
    ("epl-2", "EPL-2.0", "eclipse public license [version|v] 2", "eclipse.org/legal/epl-2.0"),
    ("eupl-1.2", "EUPL-1.2", "european union public licence|license", "eupl.eu/1.2"),
    ("fdl-1.3", "GFDL-1.3", "gnu free documentation license", "gnu.org/licenses/fdl"),
    ("gpl", "GPL", "gnu general public license", "gnu.org/licenses/gpl"),
    ("gpl-2", "GPL-2.0", "general public license [version|v] 2", "gnu.org/licenses/old-licenses/gpl-2.0"),
    ("gpl-3", "GPL-3.0", "general public license [version|v] 3", "gnu.org/licenses/gpl-3.0"),
    ("isc", "ISC", "isc license", "opensource.org/licenses/isc"),
    ("lgpl", "LGPL", "gnu lesser|library general public license", "gnu.org/licenses/lgpl"),
    ("lgpl-2.1", "LGPL-2.1", "lesser general public license [version|v] 2", "gnu.org/licenses/old-licenses/lgpl-2.1"),
    ("lgpl-3", "LGPL-3.0", "lesser general public license [version|v] 3", "gnu.org/licenses/lgpl-3.0"),
    ("lppl-1.3", "LPPL-1.3c", "latex project public license", "latex-project.org/lppl"),
    ("mit", "MIT", "the mit license", "opensource.org/licenses/mit"),
    ("mit-0", "MIT-0", "mit no attribution", "opensource.org/license/mit-0"),
    ("mpl-1.1", "MPL-1.1", "mozilla public license [version|v] 1", "mozilla.org/mpl/1.1"),
    ("mpl-2", "MPL-2.0", "mozilla public license [version|v] 2", "mozilla.org/mpl/2.0"),
    ("ms-pl", "MS-PL", "microsoft public license", "opensource.org/licenses/ms-pl"),
    ("ms-rl", "MS-RL", "microsoft reciprocal license", "opensource.org/licenses/ms-rl"),
    ("ncsa", "NCSA", "university of illinois ncsa open source license", "opensource.org/licenses/ncsa"),
    ("odbl", "ODbL-1.0", "open database license", "opendatacommons.org/licenses/odbl"),
    ("odc-by", "ODC-By-1.0", "open data commons attribution license", "opendatacommons.org/licenses/by"),
    ("ofl-1.1", "OFL-1.1", "sil open font license", "scripts.sil.org/ofl"),
    ("openssl", "OpenSSL", "openssl license", "openssl.org/source/license"),
    ("osl-3", "OSL-3.0", "open software license [version|v] 3", "opensource.org/licenses/osl-3.0"),
    ("pddl-1", "PDDL-1.0", "public domain dedication and license", "opendatacommons.org/licenses/pddl"),
    ("php-3", "PHP-3.01", "php license [version|v] 3", "php.net/license"),
    ("polyform-nc", "PolyForm-Noncommercial-1.0.0", "polyform noncommercial license", "polyformproject.org/licenses/noncommercial"),
    ("postgresql", "PostgreSQL", "postgresql license", "opensource.org/licenses/postgresql"),
    ("python-2", "PSF-2.0", "python software foundation license", "python.org/psf/license"),
    ("rail", "OpenRAIL", "responsible ai license", "licenses.ai"),
    ("ruby", "Ruby", "ruby license", "ruby-lang.org/en/about/license"),
    ("sspl-1", "SSPL-1.0", "server side public license", "mongodb.com/licensing/server-side-public-license"),
    ("unicode", "Unicode-DFS-2016", "unicode license agreement", "unicode.org/copyright"),
    ("unlicense", "Unlicense", "this is free and unencumbered software", "unlicense.org"),
    ("upl-1", "UPL-1.0", "universal permissive license", "opensource.org/licenses/upl"),
    ("vim", "Vim", "vim license", "vimhelp.org/uganda"),
    ("w3c", "W3C", "w3c software notice and license", "w3.org/consortium/legal"),
    ("wtfpl", "WTFPL", "do what the fuck you want to public license", "wtfpl.net"),
    ("x11", "X11", "x11 license", "x.org/licenses"),
    ("zlib", "Zlib", "zlib license", "zlib.net/zlib_license"),
    ("zpl-2", "ZPL-2.1", "zope public license", "opensource.org/licenses/zpl"),
]

# Passages of texts of licenses and notices. Label, keyword, words.
PASSAGES = [
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "noninfringement", "fitness for a particular purpose and noninfringement"),
    ("bsd-3", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-2", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-4", "acknowledgement", "advertising materials mentioning features or use of this software"),
    ("isc", "hereby", "use copy modify and or distribute this software for any purpose"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", "released into the public domain"),
    ("public-domain", "domain", "dedicated to the public domain"),
    ("public-domain", "domain", "in the public domain"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "confidential", "proprietary and confidential"),
]

# Tier and confidence of each kind of rule; a smaller tier is better.
KINDS = {"tag": (1, 1.0), "address": (1, 0.95), "name": (2, 0.9), "grant": (2, 0.9),
         "short": (3, 0.7), "passage": (3, 0.6)}
TIERS = sorted({tier for tier, _ in KINDS.values()})


def _words_pattern(words: str) -> str:
    """Words one after the other, with anything that is no word between."""
    parts = []
    for i, word in enumerate(words.split()):
        optional = word.startswith("[")
        options = "|".join(re.escape(w) for w in word.strip("[]").split("|"))
        gap = f"{NO_WORD}+" if i else ""
        parts.append(f"(?:{gap}(?:{options}))?" if optional else f"{gap}(?:{options})")
    return f"(?i)(?<!{WORD}){''.join(parts)}(?!{WORD})"


def _keyword(words: str) -> str:
    """The longest plain word that every match holds."""
    plain = [w for w in words.split() if w.isalnum()]
    return max(plain, key=len)


def rules() -> list[dict]:
    """All rules, in order of priority: label, kind, keyword, pattern, tier, confidence."""
    found = []

    def add(label: str, kind: str, keyword: str, pattern: str) -> None:
        tier, confidence = KINDS[kind]
        found.append({"label": label, "kind": kind, "keyword": keyword.lower(), "pattern": pattern,
                      "tier": tier, "confidence": confidence})

    for label, identifier, name, address in LICENSES:
        exact = re.escape(identifier)
        add(label, "tag", "spdx-license-identifier",
            rf"(?i)spdx-license-identifier:\s*\(?{exact}(?:-only|-or-later|\+)?(?![\w.+-])")
        add(label, "address", address, rf"(?i)(?<!{WORD}){re.escape(address)}")
        add(label, "name", _keyword(name), _words_pattern(name))
        add(label, "grant", "licen", rf"(?i)licen[cs]ed{NO_WORD}+under{NO_WORD}+(?:the{NO_WORD}+)?"
                                     rf"(?:terms{NO_WORD}+of{NO_WORD}+(?:the{NO_WORD}+)?)?{exact}(?![\w-])")
        if any(c.isdigit() or c == "-" for c in identifier):
            add(label, "short", identifier, rf"(?<![\w.-]){exact}(?![\w-])")
    for label, keyword, words in PASSAGES:
        add(label, "passage", keyword, _words_pattern(words))
    for phrase, label in BASE_PHRASES.items():
        add(label, "grant", _keyword(phrase), _words_pattern(phrase))
    return sorted(found, key=lambda r: r["tier"])


RULES = rules()


def _covering(keywords: set[str]) -> list[str]:
    """A few strings one of which stands in every keyword.

    Chosen greedily among whole keywords, common words of licenses, and short pieces that
    hold a digit or a sign, which are rare in prose.
    """
    pieces = {k[i:i + n] for k in keywords for n in (3, 4, 5) for i in range(len(k) - n + 1)}
    offered = keywords | {"licen", "public", "software", "commons"} | {
        p for p in pieces if not p.isalpha()}
    left, chosen = set(keywords), []
    while left:
        best = max(sorted(offered), key=lambda p: (sum(p in k for k in left), len(p)))
        chosen.append(best)
        left = {k for k in left if best not in k}
    return chosen


GATES = _covering({r["keyword"] for r in RULES})


def _spans(text: Column, pattern: Column) -> Column:
    """Array of (start, end) of all matches, in characters from 0."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.zip_with(F.slice(parts, 1, F.size(found)), found,
                         lambda before, match: F.struct(F.length(before).alias("skip"),
                                                        F.length(match).alias("n")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["skip"]
        end = start + x["n"]
        return F.struct(end.alias("at"), F.concat(
            state["out"], F.array(F.struct(start.alias("s"), end.alias("e")))).alias("out"))
    return F.aggregate(lengths, first, step, lambda state: state["out"])


def _rule_table() -> Column:
    fields = "keyword string, pattern string, label string, kind string, tier int, confidence double"
    return F.from_json(F.lit(json.dumps(RULES)), f"array<struct<{fields}>>")


def _detections(text: Column, lowered: Column) -> Column:
    """All matches of all rules whose keyword stands in the text, sorted by start, longest first."""
    running = F.filter(_rule_table(), lambda r: lowered.contains(r["keyword"]))
    found = F.flatten(F.transform(running, lambda r: F.transform(
        _spans(text, r["pattern"]), lambda x: F.struct(
            x["s"].alias("start"), (-x["e"]).alias("minus_end"), r["tier"].alias("tier"),
            r["label"].alias("label"), r["kind"].alias("kind"),
            r["confidence"].alias("confidence")))))
    return F.array_sort(found)


_KEPT = "array<struct<start:int,end:int,label:string,kind:string,tier:int,confidence:double>>"


def _suppressed(sorted_detections: Column) -> Column:
    """The detections that lie within no earlier one of a better or equal tier.

    In this order whatever contains a detection comes before it, so it is enough to know how
    far the detections of each tier have reached.
    """
    reach = F.array(*[F.lit(-1) for _ in TIERS])
    start = F.struct(reach.alias("reach"), F.array().cast(_KEPT).alias("kept"))

    def step(state: Column, d: Column) -> Column:
        end = -d["minus_end"]
        inside = F.exists(F.slice(state["reach"], 1, d["tier"]), lambda r: r >= end)
        reach = F.transform(state["reach"], lambda r, i: F.when(
            i + 1 == d["tier"], F.greatest(r, end)).otherwise(r))
        kept = F.concat(state["kept"], F.array(F.struct(
            d["start"].alias("start"), end.alias("end"), d["label"].alias("label"),
            d["kind"].alias("kind"), d["tier"].alias("tier"), d["confidence"].alias("confidence"))))
        return F.struct(reach.alias("reach"), F.when(inside, state["kept"]).otherwise(kept).alias("kept"))
    return F.aggregate(sorted_detections, start, step, lambda state: state["kept"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `detections`: array of (start, end, label, kind, tier, confidence) in characters.

    A null or empty text, or one without a gate word, has an empty array. Rows are scanned one
    by one, so repeated rows, null ids and empty tables need nothing special. A column of that
    name is replaced.
    """
    lowered = F.col("_lowered")  # a column of its own, so that it is made once
    gated = reduce(or_, [lowered.contains(g) for g in GATES])
    none = F.array().cast(_KEPT)
    return (docs.withColumn("_lowered", F.lower(F.col(text)))
            .withColumn("detections", F.when(
                gated, _suppressed(_detections(F.col(text), lowered))).otherwise(none))
            .drop("_lowered"))


def base_places(text: Column, phrase: str) -> Column:
    """Character starts (from 0) of all places where the phrase's words stand in a row."""
    pattern = F.lit(_words_pattern(phrase))
    lowered = F.lower(text)
    gate = reduce(lambda a, b: a & b, [lowered.contains(w) for w in phrase.split()])
    return F.when(gate, F.transform(_spans(text, pattern), lambda x: x["s"])).otherwise(
        F.array().cast("array<int>"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+")).cast("long")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, base phrases with their first and last word, labels, score.

    `score` is the confidence of the surest detection that was not suppressed, 0 without one.
    A null or empty text has no words and no labels (empty strings) and a score of 0.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = scan(whole).withColumns(
        {f"_at{i}": base_places(F.col("text"), p) for i, p in enumerate(BASE_PHRASES)})
    places = [F.col(f"_at{i}") for i in range(len(BASE_PHRASES))]
    every = F.concat(*places)
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label))
                                     for p, label in zip(places, BASE_PHRASES.values())]))

    def word_of(start: Column) -> Column:
        # a phrase starts with a word, so the words that end before it are those of the text before
        return F.when(start.isNotNull(), word_count(F.substring(F.col("text"), F.lit(1), start)))
    return scanned.select(
        "doc_id", word_count(F.col("text")).alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        word_of(F.array_min(every)).alias("first_word"), word_of(F.array_max(every)).alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
        .alias("score"), F.size("detections").cast("long").alias("n_detections"))
