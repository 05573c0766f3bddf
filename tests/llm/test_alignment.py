"""Alignment of two tokenizers against a plain version that encodes whole texts."""

import hashlib
import re
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import pytest

from shelfwatch.llm import alignment
from tests.llm.odd import documents, empty

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

TEXTS = ["plain words here", " lead", "trail ", "two  spaces", "tab\tand\nnew\n\nline  ", "naïve café 漢字テスト 日本語の文章", "emoji 👩‍👩‍👧 end", "",
         None, " ", "   ", "<|endoftext|> inside <s> and </s>", "under▁score", "a" * 700, "don't stop 1234567 $$$", "x y z　w",
         "﻿bom word", "मिश्रित पाठ यहाँ", "plain words here", "\x00nul \x7f del", "é combining", "word " * 400]


def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(texts):
    a, b = tools()
    letters = alignment._byte_letters()
    per_text, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spans = []
        for ids, of in ((ids_a, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
                        (ids_b, lambda i: (bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode()))):
            at, out, joined = 0, [], b""
            for i in ids:
                data = of(i)
                out.append((at, at + len(data), i))
                at, joined = at + len(data), joined + data
            spans.append(out)
            if not text or joined != b" " + text.encode():
                spans = None
                break
        if not spans:
            per_text.append(None)
            continue
        sa, sb = spans
        owner = {p: y for y in sb for p in range(y[0], y[1])}  # the token of B at each byte
        links = [(x[2], y[2]) for x in sa for y in sorted({owner[p] for p in range(x[0], x[1])})]
        cuts = [0, *sorted({x[1] for x in sa} & {y[1] for y in sb})]
        groups = [([], []) for _ in cuts[1:]]
        for side, spans in enumerate((sa, sb)):
            for s, _, i in spans:
                groups[bisect_right(cuts, s) - 1][side].append(i)
        per_text.append((sa, sb, links, groups))
        counts.update(links)
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    rows = []
    for got in per_text:
        if got is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        sa, sb, links, groups = got
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(sa), len(sb), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links),
                     sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return rows


@pytest.mark.parametrize("batch_bytes", [1, 1 << 22])
def test_against_plain(spark, batch_bytes):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [(i, t) for i, t in enumerate(TEXTS)]
        got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B, batch_bytes).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    assert [tuple(r)[1:] for r in got] == plain(TEXTS)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_BYTES", 100)
    tool = alignment.Aligner(A, B)
    want = [tool.batch([t])["digests"][0] for t in TEXTS]
    assert want == [r[-1] for r in plain(TEXTS)]
    assert all(len(p) <= alignment.LONG_PART for p in tool.codes) and len(tool.shown) == len(tool.codes) == len(tool.valid)


def test_pointer_jumping_over_a_long_component():
    """One group of 200 + 201 tokens that never end together before the last byte."""
    tool = alignment.Aligner(A, B)
    tool.size_a, tool.size_b = tool.size_a.copy(), tool.size_b.copy()
    tool.size_a[7], tool.size_b[8], tool.size_b[9] = 2, 1, 2
    x = tool.aligned([[7] * 200], [[8] + [9] * 199 + [8]])
    assert set(x["group_a"]) == set(x["group_b"]) == {0}
    assert len(x["link_a"]) == 200 + 201 - 1


def test_groups_and_odd_rows(spark):
    docs = documents(spark)
    groups = alignment.token_groups(docs, A, B)
    assert groups.columns == [*docs.columns, "groups"]
    for row in groups.collect():
        data = b" " + (row["text"] or "").encode()
        assert [g["start"] for g in row["groups"]] == [0, *[g["stop"] for g in row["groups"]][:-1]] if row["groups"] else not row["text"]
        assert not row["groups"] or row["groups"][-1]["stop"] == len(data)
    out = alignment.align(docs, A, B)
    assert out.columns == [*[c for c in docs.columns if c != "text"], *alignment.RESULTS] and out.count() == docs.count()
    assert alignment.align(empty(spark), A, B).count() == 0
    texts = [r["text"] for r in docs.collect()]
    assert sorted(tuple(r) for r in out.select(*alignment.RESULTS).collect()) == sorted(plain(texts))
