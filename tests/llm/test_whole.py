"""The whole job where a shorter one would pass: long candidates, all documents, whole blocks, rare classes, repeated ids."""

import random
import string
import textwrap

import numpy as np

from gleanery.llm import licenses, mixing, ngram_join, secrets, toxicity
from tests.llm import data


def made(seed, n, chars=string.ascii_letters + string.digits):
    rng = random.Random(seed)
    return "".join(rng.choice(chars) for _ in range(n))


def test_long_candidates_are_whole():
    late = made(1, 60, string.ascii_letters) + made(2, 200)
    cases = [("AWS_SESSION_TOKEN=\"", made(3, 350), "\""), ("Authorization: Bearer ", made(4, 700), ""), ("see ", late, ""), ("", "xoxb-" + made(5, 150), ""), ("", "sk_live_" + made(6, 150), ""), ("postgres://u:", made(7, 350), "@db/main")]
    for lead, token, tail in cases:
        spans = [(c.start, c.end) for c in secrets.candidates(f"{data.prose(1, 3)} {lead}{token}{tail} {data.prose(2, 3)}")]
        assert [b - a for a, b in spans] == [len(token)], lead
    body = made(8, 1500)
    text = f"-----BEGIN RSA PRIVATE KEY-----{body}-----END RSA PRIVATE KEY-----"
    assert body not in secrets.redact(text, [(c.start, c.end) for c in secrets.candidates(text)])
    assert secrets.redact(text, [(c.start, c.end) for c in secrets.candidates(text)])== "[secret]"


def test_coverage_counts_the_whole_candidate():
    words = secrets.Words({"cedar": 5})
    assert words.covered("cedar" * 60 + "7" * 300) == 0.5


def test_dictionary_counts_all_documents(spark):
    rows = [(i, "everywhere " + "seldom " * (i % 1000 == 7) + "a" * 25, "en", "s", None) for i in range(7000)]
    assert secrets.dictionary(data.table(spark, [*rows, (None, None, None, None, None)])) == {"everywhere": 7000, "seldom": 7}


def test_dictionary_is_whole_when_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(secrets, "HELD", 2)
    rows = [(i, "Oak pine ELM oak, fir_yew", "en", "s", None) for i in range(9)]
    assert secrets.dictionary(data.table(spark, rows)) == {"oak": 18, "pine": 9, "elm": 9, "fir": 9, "yew": 9}


def test_filler_is_no_head_of_the_alphabet():
    words = [a + b + c for a in string.ascii_lowercase for b in string.ascii_lowercase for c in "aeiou"]
    drawn = secrets.filler(dict.fromkeys(words, 3), 500)
    assert len(set(drawn)) == 500 and len({w[0] for w in drawn}) == 26


def scanned(spark, texts, templates=None):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    return licenses.scan_licenses(data.table(spark, rows), templates).collect()


def test_licenses_confirm_only_exact_wordings(spark):
    near = ["This work is licensed under the GNU Private General Public License, version 3.", "This work is licensed under the GNU Small General Public License, version 3.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under the MIT License except for trade."]
    out = scanned(spark, near)
    assert {r.doc_id for r in out} == set(range(4)) and not any(r.confirmed for r in out)
    assert all(w in next(r.differing for r in out if r.doc_id == i) for i, w in enumerate(["private", "small", "attribution-noderivatives", "except"]))


def test_licenses_that_differ_by_a_word_are_told_apart(spark):
    kinds = {"GPL-3.0": "", "LGPL-3.0": "Lesser ", "AGPL-3.0": "Affero "}
    out = scanned(spark, [f"This work is licensed under the GNU {w}General Public License, version 3." for w in kinds.values()])
    assert sorted((r.doc_id, r.license, r.confirmed) for r in out) == [(i, n, True) for i, n in enumerate(kinds)]


def test_licenses_differ_in_slots_only(spark):
    one = {"X": "Neither the name of {{holder}} nor the names of its contributors may be used under this license."}
    out = scanned(spark, ["Neither the name of Foo Bar Inc nor the names of its contributors may be used under this license.", "Neither the name of Foo nor the names of its contributors may not be used under this license."], one)
    assert [(r.doc_id, r.confirmed, r.differing) for r in out if r.confirmed] == [(0, True, ["foo", "bar", "inc"])]
    assert {r.doc_id for r in out} == {0, 1}


BSD2 = """Copyright (c) 2019, Jane Roe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission.
"""


def test_whole_license_texts(spark):
    gpl = licenses.pkgutil.get_data("gleanery.llm", "license_texts/GPL-3.0.txt").decode()
    out = scanned(spark, [BSD2.format(""), BSD2.format(THIRD), BSD2.format("").split("THIS SOFTWARE")[0], gpl])
    sure = [r for r in out if r.confirmed]
    assert sorted((r.doc_id, r.license) for r in sure) == [(0, "BSD-2-Clause"), (1, "BSD-3-Clause"), (3, "GPL-3.0")]
    assert next(r.end - r.start for r in sure if r.doc_id == 3) > 30_000


def test_more_licenses(spark):
    text = lambda name: licenses.pkgutil.get_data("gleanery.llm", f"license_texts/{name}.txt").decode()
    notices = {n: licenses.TEMPLATES[n].split("\n")[-1] for n in ("Zlib", "BSL-1.0", "EPL-2.0", "AGPL-3.0")}
    texts = {"LGPL-2.1": text("LGPL-2.1"), "LGPL-3.0": text("LGPL-3.0"), **{n: textwrap.fill(t.replace("{{mark}}", "1."), 70, break_on_hyphens=False) for n, t in notices.items()}}
    out = scanned(spark, list(texts.values()))
    assert [(r.doc_id, r.license) for r in sorted(out, key=lambda r: r.doc_id) if r.confirmed] == list(enumerate(texts))


def test_changed_license_texts_of_any_length(spark):
    """Blocks far longer than a page are compared whole; what differs is named."""
    gpl = licenses.pkgutil.get_data("gleanery.llm", "license_texts/GPL-3.0.txt").decode()
    changed = gpl.replace("  4. Conveying Verbatim Copies.", "  No commercial zorgling is allowed.\n\n  4. Conveying Verbatim Copies.")
    out = sorted((r for r in scanned(spark, [changed])), key=lambda r: r.start - r.end)
    assert all(r.end - r.start < 2_000 for r in out if r.confirmed) and out[0].end - out[0].start > 10_000 and out[0].saved > 0.9
    assert {r.license for r in out if r.end - r.start > 1_000} == {"GPL-3.0"}
    said = {w for r in out for w in r.differing}
    assert {"zorgling", "commercial"} <= said and len(said) < 200
    long = "license copyright warranty and so on " * 60_000
    (r,) = scanned(spark, [long])
    assert r.end - r.start > 2_000_000 and not r.confirmed


def test_aligned():
    a = "a b c d e f g h i j k l".split()
    assert licenses.aligned(a, a) == (12, [])
    share, differ = licenses.aligned("x a b c d q e f g h i".split(), a)
    assert share == 9 and sorted(differ) == ["q", "x"]
    assert licenses.aligned("c d e f".split(), a) == (4, []) and licenses.aligned(["z"], a) == (0, ["z"])
    rng = random.Random(2)
    for _ in range(200):
        b = [w for w in a * 3 if rng.random() < 0.9]
        c = [w if rng.random() < 0.9 else "n" for w in b]
        share, differ = licenses.aligned(c, b)
        assert 0 <= share <= len(b)


def test_license_blocks_are_whole(spark):
    wrapped = textwrap.fill(licenses.TEMPLATES["MIT"].split("\n")[2], 78)
    good = wrapped.replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS", 1)
    evil = wrapped.replace("THE SOFTWARE IS", "\n\nThe Software shall be used for\nGood, not Evil.\n\nTHE SOFTWARE IS", 1)
    changed = wrapped.replace("to deal", "to look")
    out = scanned(spark, [good, wrapped.split("\n")[0], evil, changed, "Licensed under the Apache\nLicense, Version 2.0."])
    assert {(r.doc_id, r.license) for r in out if r.confirmed} == {(0, "MIT"), (4, "Apache-2.0")}
    for i, words in ((2, {"good", "evil"}), (3, {"look", "deal"})):
        (r,) = (r for r in out if r.doc_id == i)
        assert words <= set(r.differing) and r.license == "MIT" and r.equal > 0.9 and r.end - r.start > 1000
    (r,) = (r for r in out if r.doc_id == 1)
    assert r.equal < 0.2


def test_terms_of_a_rare_class_are_learned(spark):
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 50 == 0
        said = toxic and i % 100 == 0 or not toxic and i % 30 == 1
        rows.append((i, data.prose(i, 12) + " zorgle" * said, "en", "s", None))
        labels.append((i, int(toxic)))
    lexicon = toxicity.train(data.table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).lexicon
    assert sum(t for _, t in labels) == 60 and sum("zorgle" in r[1] for r in rows) > 100
    assert "zorgle" in lexicon.words and "alder" not in lexicon.words


def test_few_long_documents_are_fitted():
    for lengths, counts, budget in (([100_000, 90_000, 70_000], [1, 1, 1], 160_000), ([900_001, 700_000, 500_003], [3, 3, 3], 2_100_004), ([90_000_000, 70_000_000, 100_000_000], [1, 1, 1], 160_000_000)):
        take = mixing.fit(np.array(lengths), np.array(counts), budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == budget
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(200_000, 3_000_000, 60))
    counts = rng.integers(1, 4, len(lengths))
    budget = int((lengths * counts).sum()) // 3
    assert abs(int((mixing.fit(lengths, counts, budget) * lengths).sum()) - budget) < 100


def test_one_of_each_goes_by_row(spark):
    a, b, c = (data.prose(i, 40) for i in (1, 2, 3))
    rows = [(1, a, "en", "s", None), (2, a, "en", "s", None), (2, b, "en", "s", None), (None, c, "en", "s", None), (None, c, "fr", "s", None), (4, b.upper(), "en", "s", None), (7, "", "en", "s", None), (8, None, "en", "s", None)]
    kept = ngram_join.one_of_each(data.table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (2, b), (0, c), (7, ""), (8, "")])
