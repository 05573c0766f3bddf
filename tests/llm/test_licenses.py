"""License scan against counting every template in every block."""

import random

import pytest

from shelfwatch.llm import licenses
from tests.llm.odd import documents, empty

ROW = [licenses.ROW_FILE, licenses.ROW_INDEX]


def plain(text, templates, percent=80):
    words = licenses.words_of(text)
    found = set()
    for label, notice in templates:
        own = licenses.words_of(notice)
        if not own or not label:
            continue
        step = licenses.block_step(len(own))
        for block in range(max(1, -(-len(words) // step))):
            held = set(words[block * step:block * step + 2 * step])
            share = len(held & set(own))
            if 100 * share >= percent * len(set(own)):
                found.add((label, step, block, share / len(set(own))))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.encode().split()]
    base = {label for _, label in places}
    score = 1.0 if places else max((f[3] for f in found), default=0.0)
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    return (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | {f[0] for f in found})), score), found


def corpus():
    rng = random.Random(7)
    filler = "the of to in software and license with use any copy under public notice alpha beta".split()
    texts = [None, "", " \n ", "MIT", "mit license", "MIT-License; mit\nLICENSE", "General  Public License apache license", "permit license"]
    for label, notice in licenses.TEMPLATES:
        for drop in (0, 1, 2, 5):
            words = notice.split()
            for _ in range(min(drop, len(words) - 1)):
                words.pop(rng.randrange(len(words)))
            before = [rng.choice(filler) for _ in range(rng.randrange(60))]
            texts.append(" ".join([*before, *words, *[rng.choice(filler) for _ in range(rng.randrange(60))]]))
    texts += [" ".join(rng.choice(filler) for _ in range(300)) for _ in range(10)]
    texts.append(" ".join([*["long"] * 40000, *licenses.TEMPLATES[3][1].split(), *["tail"] * 7]))
    return texts


@pytest.mark.parametrize("max_words", [licenses.MAX_WORDS, 40])
def test_against_plain(spark, max_words):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, matches = licenses.find_licenses(docs, max_words=max_words)
    got = {r["doc_id"]: tuple(r[c] for c in licenses.RESULTS) for r in rows.collect()}
    want = {i: plain(t, licenses.TEMPLATES) for i, t in enumerate(texts)}
    assert got == {i: w[0] for i, w in want.items()}
    own = rows.select(*ROW, "doc_id")
    pairs = {(r["doc_id"], r["label"], r["step"], r["block"], r["score"]) for r in matches.join(own, ROW).collect()}
    assert pairs == {(i, *f) for i, w in want.items() for f in w[1]}
    assert "cc-by-nc" in got[len(texts) - 1][5]


def test_equal_documents_and_own_templates(spark):
    """A third of the rows is one text; every row gets its labels."""
    texts = ["grant of use for all alders and birches"] * 40 + ["nothing here"] * 80
    templates = spark.createDataFrame([("own", "grant of use for all alders"), (None, "nothing here"), ("x", None), ("x", " ")], "label string, text string")
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    rows, matches = licenses.find_licenses(docs, templates)
    assert sorted(r["labels"] for r in rows.collect()) == [""] * 80 + ["own"] * 40
    assert {r["score"] for r in rows.collect()} == {0.0, 1.0} and matches.count() == 40


def test_odd_rows(spark):
    docs = documents(spark).withColumnRenamed("lang", "step").withColumnRenamed("source", "Word")
    rows, _ = licenses.find_licenses(docs)
    kept = [c for c in docs.columns if c not in ("text", "n_words")]
    assert rows.columns == [*kept, *ROW, *licenses.RESULTS] and rows.count() == docs.count()
    assert licenses.find_licenses(empty(spark))[0].count() == 0
    none = spark.createDataFrame([], "label string, text string")
    rows, matches = licenses.find_licenses(docs, none)
    assert matches.count() == 0 and rows.count() == docs.count()
