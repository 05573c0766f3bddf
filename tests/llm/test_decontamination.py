import re

from odd import documents, empty, prose

from shelfwatch.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items:
        own = WORD.findall((item_text or "").translate(LOWER))
        size = min(13, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1) if size else ():
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def setting(spark):
    items = [(1, prose(40, 3)), (2, prose(80, 2).upper()), (3, "one two"), (4, None), (5, "..."), (None, prose(20, 9)), (2, prose(80, 2).upper()),
             (10, "漢字 naïve")]
    more = [(50, "start " + prose(40, 3) + " end"), (51, prose(300, 7) + " " + " ".join(prose(40, 3).split()[:13])),
            (52, " ".join(prose(40, 3).split()[:12])), (53, "ONE, two!"), (54, prose(20, 9))]
    docs = documents(spark, [(d, t, "en", "a") for d, t in more])
    return docs, spark.createDataFrame(items, "item_id long, text string"), items


def test_hits_equal_brute_force(spark):
    docs, bench, items = setting(spark)
    for blocks in (200_000, 60):  # one pass, and several blocks of items
        got = decontaminate.find_hits(docs, bench, max_windows=blocks).collect()
        assert len(got) == docs.count()
        for r in got:
            n, hit, found = brute(r["text"], items)
            assert (r["n_words"], r["n_hit"], sorted(r["item_ids"])) == (n, hit, found)
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_removal(spark):
    docs, bench, items = setting(spark)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 50 not in ids and 53 not in ids and 51 in ids and 0 in ids and 4 in ids
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, drop_documents=False).collect()}
    assert cut[50] == "start  end" and cut[52] == " ".join(prose(40, 3).split()[:12])
    assert all(brute(t, items)[1] == 0 for t in cut.values())


def test_empty_tables(spark):
    docs, bench, _ = setting(spark)
    assert decontaminate.find_hits(empty(spark), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_hits(docs, bench.limit(0)).collect()} == {0}
