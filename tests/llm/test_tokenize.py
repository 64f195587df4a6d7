import pytest
import regex
from pyspark.sql import functions as F

from lodeworks.llm import tokenize as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def own():
    return T.encoder("byte_bpe_50k")


@pytest.fixture(scope="module")
def public(own):
    return tiktoken.Encoding("public", pat_str=T.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


TEXTS = [
    None, "", " ", "a", "aaaaaaa aaaa", "I'm we'll THEY'VE don't", "  two  blanks\t\ttabs\n\nlines \n", "<|endoftext|> is text", "Größe 12,5 µm – «да» 你好 🙂🙂", "x" * 5000,
    "ab" * 3000, "0123456789" * 50, "\x00\x01   \xa0", "Ti6Al4V-Платина_7",
]


def test_ids_equal_those_of_the_public_encoder(own, public):
    assert own.encode_batch(TEXTS) == [public.encode_ordinary(t) if t else [] for t in TEXTS]


def test_round_trip(own):
    back = {v: k for k, v in own.ranks.items()}
    for t, ids in zip(TEXTS, own.encode_batch(TEXTS), strict=True):
        assert b"".join(back[i] for i in ids).decode() == (t or "")


def test_pair_index_merges_in_rank_order():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"aa": 258}
    # "ab" has the lowest rank, so it is merged before "aa" wherever both could be
    assert T.encode_pieces([b"ababab", b"aaab", b"", b"aaa"], ranks) == [[257, 256], [258, 256], [], [258, 97]]


def test_token_ids_over_a_table(spark, own, public):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in T.token_ids(df.repartition(3)).collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert T.token_ids(df.limit(0)).count() == 0


def test_counts_keep_other_columns(spark, public):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.source, r.n_tokens) for r in T.token_counts(df, ["doc_id", "source"]).collect()}
    assert got == {i: ("s", len(public.encode_ordinary(t)) if t else 0) for i, t in enumerate(TEXTS)}


def test_small_memory_of_pieces_gives_the_same_ids(monkeypatch, own):
    monkeypatch.setattr(T, "KEPT_PIECES", 2)
    monkeypatch.setattr(T, "ROUND_BYTES", 8)
    fresh = T.Encoder(f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for t in TEXTS[:10]:
        assert fresh.encode_batch([t]) == own.encode_batch([t])


def test_pattern_covers_every_text():
    find = regex.compile(T.PATTERN).findall
    assert all("".join(find(t)) == t for t in TEXTS if t)
