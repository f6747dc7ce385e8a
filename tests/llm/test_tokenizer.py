import random

import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Fast

from terrane.llm import tokenizer as K

PUBLIC = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = [
    "", None, " ", "\n\n", "Hello world", "it's  we'll\tI'd ", "naïve café – “quoted”", "弁筐体と環状の軸受とを備え、組立を簡単にする。", "🔧👩‍🔬 é", "a" * 700, "....." * 60, "x y z　 q​w",
    "0x120F7 3,5-mexeno-portine ¾ m² 12'345", "\u001c\u001d end \u0085 next", "<|endoftext|> plain", "ﬁlth ß ẞ Ǆ ١٢٣ Ⅷ", "word " * 3000, "THE \"OLD\" MILL\r\nLINE\r",
]


@pytest.fixture(scope="module")
def ranks():
    return K.load_ranks()


@pytest.fixture(scope="module")
def public(ranks):
    return tiktoken.Encoding("own", pat_str=PUBLIC, mergeable_ranks=ranks, special_tokens={})


def _encode(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("ids", F.lit("clash")).withColumn("word", F.lit(1))
    t = K.Tokenizer.load(spark)
    out = df.select("doc_id", t.fitted(df, "text", **kw).encode(F.col("text")).alias("ids"), t.length(F.col("text")).alias("n"))
    return {r["doc_id"]: (r["ids"], r["n"]) for r in out.collect()}


@pytest.mark.parametrize("hot", [0, 50, 1 << 15])
def test_equals_public_encoders(spark, public, hot):
    fast = Fast.from_file(f"{K.FOLDER}/byte_bpe_50k.json")
    fast.encode_special_tokens = True
    got = _encode(spark, TEXTS, hot_words=hot)
    for i, t in enumerate(TEXTS):
        ids, n = got[i]
        assert ids == public.encode_ordinary(t or "") == fast.encode(t or "", add_special_tokens=False).ids and n == len(ids)


def test_random_texts(spark, public):
    rnd = random.Random(6)
    alphabet = "abcdeEST  '\"-.,0123\n\té中の🔧ßж"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(150)]
    got = _encode(spark, texts)
    assert all(got[i][0] == public.encode_ordinary(t) for i, t in enumerate(texts))


def test_round_trip(spark, ranks):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    ids = K.encode_corpus(df)
    back = ids.select("doc_id", K.decode(F.col("ids"), K.literal_pieces(ranks)).alias("t"))
    assert {r["doc_id"]: r["t"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id int, text string")
    assert K.encode_corpus(df.limit(0)).count() == 0
    assert [r["ids"] for r in K.encode_corpus(df).collect()] == [[64, 275]] * 2
