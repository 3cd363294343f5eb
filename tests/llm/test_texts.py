"""Problems 7 and 9: exact encodings, round trips, look-alikes."""
import pytest

from sparktraj.llm import lookalike, tokens

TEXTS = [None, "", " ", "Hello  world's  end\n\n\tand 123abc ...", "naïve ｆｕｌｌ 日本語 тест  \xa0 x\x85y z\x1c\x1d", "<|endoftext|> stays text", "a" * 70_000, "word " * 40_000, "\U000323b0 newer ꟱ letters", "  \n ", "can't 'll''s ʼn n't", "Hello  world's  end\n\n\tand 123abc ..."]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [50, 4_000_000])
def test_ids_and_round_trip(spark, library, block):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, extra string").repartition(3)
    coded = tokens.encode(docs, block_chars=block).cache()
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert got == {i: library(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in tokens.decode(coded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, block_chars=block).collect()} == {i: len(v) for i, v in got.items()}


def test_repeated_and_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in tokens.encode(docs).collect()) == [(0, 1), (1, 2), (1, 2), (2, 0)]
    assert tokens.encode(docs.limit(0)).count() == 0
    assert tokens.encode(docs.where("doc_id = 2")).first()["ids"] == []
    coded = spark.createDataFrame([(1, [64, 65]), (1, [64]), (None, [65]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert sorted((r["doc_id"] or 0, r["text"] or str(r["text"])) for r in tokens.decode(coded).collect()) == [(0, "b"), (1, "a"), (1, "ab"), (2, "None"), (3, "")]
    assert tokens.decode(coded.limit(0)).count() == 0
    with pytest.raises(Exception):
        tokens.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()


SAME = ["Résumé of a fine fish: 10 cm", "Résumé of a ﬁne ﬁsh: 10 cm", "Résumé of a　fine fish: 10 cm", "Rés­umé o​f a fi⁠ne fish﻿: 10 cm", "Ｒésumé of a fine fish: １０ cm", "Résumé оf а finе fіѕh: 10 сm", "Résumé οf a fine fish: 10 cm"]
OTHER = ["Resume of a fine fish: 10 cm", "résumé of a fine fish: 10 cm", "Résumé of a fine fish: 1⁰ cm", "Résumé  of a fine fish: 10 cm", "Résumé of a fine fish:\n10 cm", "Résumé of a fine fish:\n\n10 cm"]


def test_alike(spark):
    texts = SAME + OTHER + [None, "", " ​", " ", SAME[0], "Ёлка", "Ёлка", "2024-01-02", "2024\u201101\u201002", "2024\u201301\u201302"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, look int").repartition(2)
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in lookalike.alike_pairs(docs).collect()}
    group = [*range(len(SAME)), texts.index(SAME[0], 1)]
    want = {(a, b) for a in group for b in group if a < b and texts[a] != texts[b]} | {(len(texts) - 5, len(texts) - 4), (len(texts) - 3, len(texts) - 2)}
    assert got == want
    assert lookalike.alike_pairs(docs.limit(0)).count() == 0


def test_a_hot_look(spark):
    docs = spark.createDataFrame([(i, "same page") for i in range(3000)] + [(5000, "same page"), (5001, "other")], "doc_id long, text string")
    assert lookalike.alike_pairs(docs).count() == 3000


def test_links_stand_for_pairs(spark, tmp_path):
    texts = ["a b", "a\u00a0b", "a b", "c", "A b", None, "c"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in lookalike.p9_links(spark, str(tmp_path)).collect()} == {(0, 0, 1), (1, 0, 2), (2, 0, 1)}
    assert [tuple(r) for r in lookalike.p9_folded(spark, str(tmp_path)).select("doc_id", "looks", "documents").collect()] == [(0, 2, 4)]


def test_one_form(spark):
    docs = spark.createDataFrame([(1, "ＡＢ c\r\nd"), (2, None), (3, "Straße")], "doc_id long, text string")
    assert {r["doc_id"]: r["same"] for r in lookalike.normalized(docs).collect()} == {1: "AB c\nd", 2: None, 3: "Straße"}
    assert {r["doc_id"]: r["same"] for r in lookalike.normalized(docs, True).collect()}[3] == "strasse"
    table = lookalike.replacements()
    assert all(lookalike.same_form(lookalike.same_form(t, table), table) == lookalike.same_form(t, table) for t in SAME + OTHER)
