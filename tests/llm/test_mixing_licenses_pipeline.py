import math
import sys

import pytest

from keyloom.llm import licenses, mixing


def test_mixing_counts_follow_weights_and_are_stable(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else ("small" if i % 2 else None), 5) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").repartition(7)
    out = mixing.mix(docs, {"small": 0.5}, total=4000, seed=3)
    assert out.columns == ["doc_id", "text", "source", "copy"]
    one = sorted((r.doc_id, r.copy) for r in out.collect())
    two = sorted((r.doc_id, r.copy) for r in mixing.mix(docs.repartition(3), {"small": 0.5}, total=4000, seed=3).collect())
    assert one == two != sorted((r.doc_id, r.copy) for r in mixing.mix(docs, {"small": 0.5}, total=4000, seed=4).collect())
    share = sum(d % 3 == 0 and d % 2 for d, _ in one)
    assert abs(share - 2000) < 5 * math.sqrt(2000) and abs(len(one) - 4000) < 5 * math.sqrt(4000)
    copies = {}
    for d, c in one:
        copies.setdefault(d, []).append(c)
    assert all(c == list(range(len(c))) for c in copies.values())
    small = [len(copies.get(i, [])) for i in range(6000) if i % 3 == 0 and i % 2]
    assert abs(small.count(0) / 1000 - math.exp(-2)) < 0.05 and abs(small.count(2) / 1000 - 2 * math.exp(-2)) < 0.06


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None)] * 3 + [(1, "a", "s")] * 2, "doc_id long, text string, source string")
    counts = [r["count"] for r in mixing.mix(docs, {"absent": 0.2}, total=100).groupBy("doc_id").count().collect()]
    assert all(c % 3 == 0 or c % 2 == 0 for c in counts)
    assert mixing.mix(docs, {"s": 0.0, "x": 1.0}).count() == 0 and mixing.mix(docs.limit(0), {}).count() == 0


def test_mixing_with_large_rates(spark):
    docs = spark.createDataFrame([(i, "s") for i in range(20)], "doc_id long, source string")
    n = mixing.mix(docs, {}, total=40_000).count()
    assert abs(n - 40_000) < 5 * 200


def test_licenses_found_whole_and_changed(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    words = mit.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 9)
    texts = ["plain words only", None, "", "Some text.\nReleased under the MIT License.\nMore", "A. Licensed under CC BY-NC 4.0. B " + "x " * 50 + mit, "before " + changed + " after", "This work is licensed under the GNU General Public License, version 3." * 2, "license " * 50_000, "Licensed under the Apache License, Version 2.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = licenses.scan(docs).orderBy("doc_id", "first_char").collect()
    assert [(r.doc_id, r.license, r.template) for r in rows] == [(3, "MIT", 0), (4, "CC-BY-NC-4.0", 0), (4, "MIT", 2), (5, "MIT", 2), (6, "GPL-3.0", 0), (6, "GPL-3.0", 0), (8, "Apache-2.0", 0)]
    assert [r.coverage for r in rows if r.doc_id != 5] == [1.0] * 6
    assert texts[3][rows[0].first_char : rows[0].end_char] == "Released under the MIT License"
    part = rows[3]
    assert part.matched == len(licenses.words_of(changed)) and 0.8 < part.coverage < 0.95
    assert licenses.scan(docs.limit(0)).count() == 0


def test_alignment_equals_whole_table():
    import random

    rng = random.Random(0)
    for _ in range(40):
        template = rng.choices("abcdef", k=12)
        words = rng.choices("abcdef", k=3) + [w for w in template if rng.random() < 0.9] + rng.choices("abcdef", k=3)
        best = {}
        for i in range(len(template) + 1):
            for j in range(len(words) + 1):
                options = [0]
                if i and j:
                    options.append(best[i - 1, j - 1] + (1 if template[i - 1] == words[j - 1] else -1))
                if i:
                    options.append(best[i - 1, j] - 1)
                if j:
                    options.append(best[i, j - 1] - 1)
                best[i, j] = max(options)
        matched, first, end = licenses.align(template, words, 3)
        assert matched >= max(best.values()) and 0 <= first < end <= len(words)


def test_query_equals_alignment_of_every_template_everywhere(spark):
    """Brute force: each template against each document at all shifts, without index or pruning."""
    from keyloom.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    templates = licenses.index()[0]
    want = []
    for d, text in docs.items():
        words = licenses.words_of(text)
        spans = [m.span() for m in licenses._WORD.finditer(text)]
        found = []
        for name, number, template in templates:
            bag = set(template)
            starts = [i for i in range(len(words)) if sum(w in bag for w in words[i : i + len(template)]) >= licenses.MIN_COVERAGE * len(template)]
            for shift in starts:
                matched, a, b = licenses.align(template, words, shift)
                if matched >= licenses.MIN_COVERAGE * len(template) and licenses.distinguished(name, template, words[a:b]):
                    found.append((matched, name, number, matched / len(template), a, b))
        kept = []
        for m in sorted(set(found), key=lambda x: (-x[0], -x[3], x[1], x[2])):
            if not any(m[4] < o[5] and o[4] < m[5] for o in kept):
                kept.append(m)
        want += [(d, n, k, m, spans[a][0], spans[b - 1][1]) for m, n, k, c, a, b in kept]
    got = [(r.doc_id, r.license, r.template, r.matched, r.first_char, r.end_char) for r in queries.op10_license_spans(spark, "/root/testdata/sf0.001").collect()]
    assert want and sorted(got) == sorted(want)


def test_notices_of_other_licenses_are_not_taken_for_these(spark):
    texts = ["Licensed under the BSD License.", "Licensed under the Elastic License.", "This work is licensed under the GNU General Public License, version 1.", "Licensed under CC BY-ND 4.0.", "Licensed under the Apache License, Version 1.1.", "licensed under the new plan " * 3_600, "without warranty of any kind, express or implied " * 2_000]
    docs = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, license string").withColumnRenamed("license", "text").selectExpr("*", "1 AS coverage")
    assert licenses.scan(docs).count() == 0


def test_every_notice_line_of_the_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    want = {r.doc_id for r in docs.collect() if any(x in r.text for x in lines)}
    from keyloom.llm import queries

    got = {r.doc_id for r in queries.op10_license_spans(spark, "/root/testdata/sf0.01").collect()}
    assert want and want <= got


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > 0 and sizes[4] > 0
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert packed.agg({"length": "sum"}).first()[0] == p.run(spark, sf).agg({"length": "sum"}).first()[0] > 0
    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mixture", "packing"]
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_stages_over_odd_rows(spark):
    import random

    import corpus_pipeline as p

    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, long = text(60), text(50), text(60_000)
    rows = [(None, None, None, None, None), (10**9, "", "en", "src0", 0), (10**9 + 1, one, "en", "src0", len(one)), (10**9 + 1, one, "en", "src0", len(one)), (10**9 + 2, one, None, None, None), (None, two, "de", "src1", 3), (10**9 + 3, long, "en", "src9", len(long)), (10**9 + 4, "few words", "en", "src0", 9)]
    docs = spark.createDataFrame([(*r, "x", 7, 8) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, copy int, n_words int").repartition(3)
    want = [[(None, two)] + [(10**9 + 1, one)] * 2 + [(10**9 + 2, one), (10**9 + 3, long)], [(None, two), (10**9 + 1, one), (10**9 + 3, long)]]
    order = lambda x: (x[0] is not None, x[0] or 0)
    for i, (name, stage) in enumerate(p.STAGES[:-1]):
        docs = p.written(stage(spark, docs, "/root/testdata/sf0.001"), f"odd-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "copy", "n_words"]
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=order)
        assert got == want[min(i, 1)] if i < 3 else set(got) <= set(want[1])
    assert p.STAGES[-1][1](spark, docs, "").agg({"length": "sum"}).first()[0] != 0


@pytest.mark.parametrize("name", ["pipeline", "op1_token_files", "op10_license_spans"])
def test_entry_has_the_queries(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and sys.modules["corpus_pipeline"]


def test_repeated_passages_keep_texts_that_lose_nothing(spark):
    import corpus_pipeline as p

    passage = " ".join(f"w{i}" for i in range(30))
    texts = ["one  two\nthree\n\nfour", None, passage, "first line\n" + passage + "\tend  end", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.text, r.n_chars) for r in p.repeated_passages(spark, docs, "").orderBy("doc_id").collect()]
    assert got == [(t, None if t is None else len(t)) for t in texts[:3]] + [("first line end end", 18), ("", 0)]


def test_sibling_licenses_are_told_apart(spark):
    third = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    two = licenses.TEMPLATES["BSD-2-Clause"][1]
    texts = [two, two.replace(" THIS SOFTWARE IS", third + " THIS SOFTWARE IS", 1), "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Free Documentation License, version 3.", "# SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: (EPL-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0)", licenses.TEMPLATES["MIT"][3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan(docs).orderBy("doc_id", "license").collect()
    assert [(r.doc_id, r.license, r.coverage) for r in rows] == [(0, "BSD-2-Clause", 1.0), (1, "BSD-3-Clause", 1.0), (2, "LGPL-3.0", 1.0), (3, "AGPL-3.0", 1.0), (5, "MIT-0", 1.0), (6, "EPL-2.0", 1.0), (6, "GPL-2.0-only", 1.0), (7, "MIT", 1.0)]
    assert rows[0].end_char >= len(two) - 1 and rows[-1].end_char >= len(texts[-1]) - 1
