import base64
import random

import pytest

from ledgerloom.llm import tokenizing as T

tiktoken = pytest.importorskip("tiktoken")
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{T.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=T.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_librarys(spark, exact):
    random.seed(5)
    texts = ["Hello  world, it's 2024!\n\n\tdon’t", "", None, "   ", "日本語 🙂 é Ωμ", "a" * 30_000, "=" * 999, "".join(random.choice("abcdef") for _ in range(3_000)), "<|endoftext|> x", "word " * 20_000, "Hello  world, it's 2024!\n\n\tdon’t"]
    texts += ["".join(random.choice("ab cé1,'\n") for _ in range(random.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "x", "clash")], SCHEMA)
    out = T.encode_corpus(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got.pop(None) == exact.encode_ordinary("x")
    assert got == {k: exact.encode_ordinary(t or "") for k, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in T.decode(out).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts))
    assert T.encode_corpus(df.limit(0)).count() == 0


def test_few_steps_per_query_give_the_same(exact, monkeypatch):
    m = T.WordMerger(*T.merge_table(f"{T.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"))
    words = {"".join(random.choice("abcdefgh") for _ in range(n)) for n in (5, T.SHORT, T.SHORT + 1, 80, 700)}
    monkeypatch.setattr(T, "CACHED_WORDS", 0)
    m.learn(words)
    assert all(m.known[w] == exact.encode_ordinary(w) for w in words)
