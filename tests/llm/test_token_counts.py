import random

import public_tokenizers
import pyarrow as pa
import pytest

from cohortspark.llm.token_counts import Counter, token_counts

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))

ODD = [
    "",
    "<|endoftext|>",
    "a<|endoftext|> <|endoftext|>b<|endo ftext|><|endoftext",
    "it's we'll I'd 'S's'' they're' 1's",
    "   lead  and trail   \n\n\t x \r\n ",
    "名前は、漢字。１２３ ２ ひらがなカタカナ 한국어!",
    "a b c　d᠎e​f\x1cg\x85h",
    "👩‍👩‍👧 é é ß ŉ",
    "no" * 300 + "1" * 300 + "-" * 300,
    "x" * 5000,
    " " * 700 + "y",
]


def one_by_one(texts, path):
    """The library's own lengths, a text at a time."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def fuzz(n, seed=1):
    draw = random.Random(seed)
    bits = ["a", "The", "'s", "'ll", "'", " ", "  ", "\n", "\t", "1", "42", ".", "!?", "<|endoftext|>", "<|", "|>", "é", "漢字", "。", " ", "　", "_", "😀", "᠎"]
    return ["".join(draw.choices(bits, k=draw.randint(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 7, 40])
def test_parts_have_the_tokens_of_the_whole(size):
    texts = ODD + fuzz(2000)
    count = Counter(BYTES)
    assert count(pa.array(texts), size, 300).tolist() == one_by_one(texts, BYTES)
    parts = [list(count.parts(t, size)) for t in texts]
    assert ["".join(p) for p in parts] == texts and sum(map(len, parts)) > 3 * len(texts) / size


def test_other_files_are_counted_whole():
    texts = ODD[:6] + fuzz(200)
    for path in (WORDS, PIECES):
        assert Counter(path)(pa.array(texts), 5, 300).tolist() == one_by_one(texts, path)
        assert all(len(list(Counter(path).parts(t, 5))) == 1 for t in texts)
    with pytest.raises(ValueError):
        Counter("vocabulary.txt")


def test_rows(make_docs, clashing, prose):
    rows = [(i, prose(i, 3 * i)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(200, prose(5, 60_000)), (201, None), (None, "a b"), (1, prose(1, 3)), (1, prose(1, 3))]
    found = token_counts(clashing(make_docs(rows)), BYTES).collect()
    tokens = one_by_one([t or "" for _, t in rows], BYTES)
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, tokens, strict=True)]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert {r["over_limit"] for r in found} == {True, False}


def test_limit_and_empty_table(make_docs):
    assert token_counts(make_docs([]), BYTES).collect() == []
    found = token_counts(make_docs([(1, "one two three")]), BYTES, limit=2).collect()
    assert found[0]["over_limit"] and found[0]["n_tokens"] == 3


def test_query(spark):
    from cohortspark.llm.queries import op11_token_counts

    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokens = dict(zip(rows, one_by_one(list(rows.values()), BYTES), strict=True))
    found = op11_token_counts(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == tokens and len(found) == len(rows)
