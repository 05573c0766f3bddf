import re
from collections import Counter

from odd import documents, empty, prose

from shelfwatch.llm import rules

SPACE = re.compile("[\x20\x09-\x0d]+")


def counts(text):
    words = [w for w in SPACE.split(text or "") if w]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    cover = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_counts_and_base_rule(spark):
    docs = documents(spark)
    texts = sorted((t or "" for t, in docs.select("text").collect()))
    got = rules.adaptive_rules(docs).collect()
    assert len(got) == len(texts) and sorted(r["text"] or "" for r in got) == texts
    for r in got:
        n, chars, symbols, dup, repeat = counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])
        assert r["Kept" if False else "a.b"] == 1.5


def test_thresholds_follow_the_group(spark):
    clean = [(100 + i, prose(60, 100 + i), "en", "plain") for i in range(120)]
    marked = [(400 + i, prose(60, 400 + i).replace(" ", " | "), "en", "tables") for i in range(120)]
    odd_one = [(900, prose(60, 900).replace(" ", " | "), "en", "plain")]
    docs = spark.createDataFrame([(d, t, lang, s) for d, t, lang, s in clean + marked + odd_one], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.adaptive_rules(docs).collect()}
    assert all(kept[d] for d, *_ in clean) and all(kept[d] for d, *_ in marked) and not kept[900]


def test_small_groups_take_the_language(spark):
    clean = [(100 + i, prose(60, 100 + i), "en", "plain") for i in range(120)]
    few = [(900, prose(60, 900).replace(" ", " | "), "en", "few")]
    docs = spark.createDataFrame(clean + few, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.adaptive_rules(docs).collect()}
    assert not kept[900] and kept[100]


def test_filter_returns_the_columns_of_documents(spark):
    docs = documents(spark)
    out = rules.filter_documents(docs)
    assert out.columns == docs.columns and {r["Kept"] for r in out.collect()} <= {"x"}
    assert rules.filter_documents(empty(spark)).count() == 0


def test_sketches_merge(spark):
    docs = documents(spark, [(100 + i, prose(50 + i, i), "en", "a") for i in range(50)])
    measured = rules.measure(docs)
    whole = {tuple(r) for r in rules.sketch(measured).collect()}
    halves = Counter()
    for part in (measured.where("n_words % 2 = 0"), measured.where("n_words % 2 = 1")):
        for r in rules.sketch(part).collect():
            halves[tuple(r)[:-1]] += r["n"]
    assert whole == {(*k, n) for k, n in halves.items()}


def test_no_threshold_is_given_beforehand(spark):
    """Two sources whose ordinary documents have many symbols, or repeat many lines, get limits of their own for each rate."""
    rows = []
    for i in range(150):
        rows.append((i, prose(80, i), "en", "prose"))
        rows.append((1000 + i, " ".join(w + "|" * (k % 3) for k, w in enumerate(prose(60 + i % 40, i).split())), "en", "tables"))
        lines = [prose(6, 5000 + 20 * i + k) for k in range(12)]
        rows.append((2000 + i, "\n".join([*lines, *lines[:i % 5]]), "de", "lists"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {r["__source"]: r for r in rules.thresholds(rules.sketch(rules.measure(docs))).collect()}
    for rate in rules.FENCES:
        assert len({limits[s][f"__max_{rate}"] for s in limits}) > 1, rate
    assert limits["tables"]["__max_symbol_rate"] > 1000 > 300 > limits["prose"]["__max_symbol_rate"]
    assert limits["lists"]["__max_dup_line_rate"] > 2000 > limits["prose"]["__max_dup_line_rate"]


def test_weight_grows_with_the_group(spark):
    """No jump at any size: the limit of a growing group goes from that of its language to its own."""
    def sketch(n):
        rows = [("en", "own", "word_length", 1000, n), ("en", "rest", "word_length", 500, 10_000)]
        return spark.createDataFrame(rows, "lang string, source string, rate string, bucket long, n long")

    got = [rules.thresholds(sketch(n)).where("__source = 'own'").first()["__max_word_length"] for n in (1, 10, 29, 30, 31, 99, 100, 1000)]
    assert got == sorted(got) and got[0] == 516 and got[-1] >= 1030 and abs(got[6] - got[5]) <= 3 and abs(got[3] - got[2]) <= 10
