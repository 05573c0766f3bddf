import public_tokenizers
from hypothesis import given, settings, strategies as st
from odd import documents, empty, prose
from tokenizers import Tokenizer

from shelfwatch.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def length(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark):
    more = [(60, "a  b \n c\t d   ", "en", "a"), (61, "x" * 5000, "en", "a"), (62, "it's <|endoftext|> we'll\n\n  go", "en", "a"),
            (63, " lead <|endoftext|>", "en", "a"), (64, "a  b　 c  d", "en", "a")]
    docs = documents(spark, more)
    texts = {}
    for r in docs.collect():
        texts.setdefault((r["doc_id"], len((r["text"] or "").encode())), r["text"])
    got = token_counts.token_counts(docs, PATH, batch_bytes=64).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["n_tokens"] == length(texts[r["doc_id"], r["n_bytes"]])
        assert r["over_limit"] == (r["n_tokens"] > 512)
    assert token_counts.token_counts(empty(spark), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t'é漢.  ​\x1c\x85s<|endoftext|>"), max_size=60))
def test_pieces_are_safe(text):
    parts = token_counts.pieces_of(text)
    assert "".join(parts) == text
    assert sum(map(length, parts)) == length(text)


def test_long_texts_are_split():
    assert max(map(len, token_counts.pieces_of(prose(5000, 1)))) < 20


def test_long_pieces_are_not_kept(monkeypatch):
    """Text without blanks, in letters of several bytes, leaves nothing behind; the rest stays under its bound."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 2000)
    counter, whole = token_counts.Counter(path, 300), Tokenizer.from_file(path)
    texts = ["漢字かな交じり文" * 40, "plain words here", "x" * 500, "", "naïve café " * 30] + [f"word{i} other{i}" for i in range(50)]
    for _ in range(3):
        assert counter.counts(texts) == [len(whole.encode(t, add_special_tokens=False)) for t in texts]
        assert all(token_counts.bytes_of(p) <= token_counts.LONG_PIECE for p in counter.lengths)
    assert token_counts.bytes_of("é漢a") == 6
