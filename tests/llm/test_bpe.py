import hashlib
import random

import pytest

from lectern.llm.bpe import ByteBPE, decode_documents, default_vocabulary, encode_documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_vocabulary())


def texts():
    random.seed(1)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "the isn't a  \n\t", "éèü中ß😀x", "a'sdt1 2!", " \n", "!!--=="]
    out = [None, "", " ", "\n", "<|endoftext|>", "a<|endoftext|>b", "x" * 5000, "0123456789" * 300, "é" * 900, "  " * 700 + "a"]
    for i in range(120):
        s = "".join(random.choice(alphabets[i % 7]) for _ in range(random.choice([5, 60, 400, 1500])))
        out.append(s[: len(s) // 2] + "<|endoftext|>" * (i % 5 == 0) + s[len(s) // 2 :])
    return out


@pytest.mark.parametrize("leaf", [8, 2048])
def test_ids_as_the_library(library, leaf):
    bpe = ByteBPE(default_vocabulary(), leaf)
    for t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert bpe.encode(t) == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, library):
    rows = [(i, t, "x", 3) for i, t in enumerate(texts())] + [(None, "again", "x", 3), (1, "again", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, n_tokens int")
    out = encode_documents(docs.drop("token_ids", "n_tokens"), leaf=64)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted((r.text for r in decode_documents(out).select("text").collect())) == sorted((t or "" for _, t, _, _ in rows))
    assert encode_documents(docs.limit(0)).count() == 0


def test_every_cut_of_mixed_texts(library):
    """Leaves of many sizes put cuts inside words, blanks, contractions, code points and long unsplit stretches."""
    random.seed(7)
    parts = ["it's we're  they'll", " \n\n  ", "x1y2", "ﬁé", "日本語の文章。", "====", "--'s", "12345", " a", "'", "\u00a0\u2003", "\x1c\x85", "e\u0301", "zzzzzzzz" * 9, "ab" * 40, " " * 30, "0" * 50, "#" * 70]
    for leaf in (2, 3, 7, 16, 50):
        bpe = ByteBPE(default_vocabulary(), leaf)
        for _ in range(150):
            t = "".join(random.choice(parts) for _ in range(random.randrange(1, 14)))
            assert bpe.encode(t) == library.encode(t, add_special_tokens=False).ids, (leaf, t)


def test_long_stretches_join_without_encoding_them_anew(library):
    bpe = ByteBPE(default_vocabulary(), 256)
    for t in ("ACGTTGCA" * 9000, "".join(random.Random(3).choices("abcde", k=60_000)), " " * 50_000, "=-" * 30_000, "7" * 40_000):
        assert bpe.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_kept_column_named_like_a_result(spark):
    docs = spark.createDataFrame([(1, "a b", 9)], "doc_id long, text string, n_tokens int")
    assert encode_documents(docs, keep=("doc_id", "n_tokens"), ids=False).collect()[0].n_tokens == 2
