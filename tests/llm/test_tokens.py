"""Token counts and byte-level BPE against plain versions."""

import base64
import random
import tracemalloc

import numpy as np
import pytest
from helpers import sha

from folio.llm import byte_bpe, queries, token_counts
from folio.llm.common import table


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    out = ["", " ", "a", "hello world", "  two  spaces ", "\n\n\t x", "é è ü 汉字 🙂🙂", "<|endoftext|>", "don't DON'T", "12345678901234", "a" * 3000, "ab" * 2000, "".join(rng.choice("abcde") for _ in range(5000)), "🙂" * 500, "\u200b\ufeff", "x" * 70]
    return out + ["".join(rng.choice("ab .é\n1'") for _ in range(rng.randint(1, 60))) for _ in range(200)]


def test_bpe_equals_the_library(reference):
    bpe = byte_bpe.loaded(*queries.bpe_files())
    for text in texts():
        ids = bpe.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text), text[:50]
        assert bpe.decode(ids) == text.encode()


def test_bpe_query(spark, sf, reference):
    want = {(r.doc_id, len(i := reference.encode_ordinary(r.text or "")), sha(np.array(i, "<u4").tobytes()), sha(r.text or "")) for r in table(spark, sf, "documents").collect()}
    assert {tuple(r) for r in queries.op8_byte_bpe(spark, sf).collect()} == want


def test_bpe_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a b", "z"), (2, "a b", None), (2, "a b", None)], "doc_id long, text string, ids string")
    got = byte_bpe.encode_documents(docs, *queries.bpe_files()).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.n_tokens) for r in got} == {(1, 0), (None, 2), (2, 2)}
    assert all(r.ids_sha256 == sha(b"") for r in got if r.doc_id == 1)
    assert byte_bpe.encode_documents(docs.limit(0), *queries.bpe_files()).count() == 0


def test_long_pretokens_are_merged_in_order(reference):
    bpe, rng = byte_bpe.loaded(*queries.bpe_files()), random.Random(3)
    for size in (1, 2, 3, 50, 700, 20000):
        for letters in ("ab", "the and", "aeiounrst"):
            word = "".join(rng.choice(letters.replace(" ", "")) for _ in range(size))
            assert bpe.merge(word.encode()) == reference.encode_ordinary(word)


def viterbi(word, scores, unknown):
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        s, n = best[-1]
        options = [(s + unknown, -(n + 1))]
        for a in range(d):
            if (x := scores.get(word[a:d])) is not None:
                options.append((best[a][0] + x, -(best[a][1] + 1)))
        total, n = max(options)
        best.append((total, -n))
    return best[-1][1]


@pytest.mark.parametrize("nodes", [5, 100_000])
def test_trie_counts_equal_plain_segmentation(nodes):
    rng = random.Random(1)
    pieces = list(dict.fromkeys("".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4))) for _ in range(60)))
    scores = token_counts.zipf_scores(pieces)
    trie = token_counts.TrieCounter(scores, nodes)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        assert trie.count("▁" + word) == viterbi("▁" + word, scores, trie.unknown)


def test_long_words_need_no_nodes():
    rng = random.Random(3)
    pieces = list(dict.fromkeys("".join(rng.choice("▁abc") for _ in range(rng.randint(1, 6))) for _ in range(90)))
    trie = token_counts.TrieCounter(token_counts.zipf_scores(pieces), 100_000)
    for size in (0, 1, 5, 6, 7, 8, 40, 300):
        word = "▁" + "".join(rng.choice("abcd") for _ in range(size))
        assert trie.count_long(word) == viterbi(word, trie.scores, trie.unknown) == trie.count(word)
    made = trie.size
    tracemalloc.start()
    assert trie.count("▁" + "ab" * 150_000) > 0
    assert trie.size == made and tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF6220FF') AS STRING) AS text")
    assert token_counts.count_tokens(docs, queries.piece_file()).first().n_pretokens == 2
    assert byte_bpe.encode_documents(docs, *queries.bpe_files()).first().decoded_sha256 == sha("a\ufffdb \ufffd")
    with pytest.raises(ValueError, match="without a rank"):
        byte_bpe.ByteBpe({b"a": 0}, ".")


def test_token_count_query(spark, sf):
    scores = token_counts.load_scores(queries.piece_file())
    unknown = min(scores.values()) - token_counts.UNKNOWN_PENALTY
    known = {}
    want = set()
    for r in table(spark, sf, "documents").collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        for w in words:
            if w not in known:
                known[w] = viterbi("▁" + w, scores, unknown)
        want.add((r.doc_id, len(words), sum(known[w] for w in words)))
    assert {tuple(r) for r in queries.op1_token_counts(spark, sf).collect()} == want


def test_token_count_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, " \n\t", 2), (1, "the the " + "z" * 9000, 3)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_pretokens) for r in token_counts.count_tokens(docs, queries.piece_file()).collect()}
    assert got == {(None, 0), (1, 0), (1, 3)}
    assert token_counts.count_tokens(docs.limit(0), queries.piece_file()).count() == 0
