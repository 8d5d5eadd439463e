import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import bpe, mixing, queries, splitting

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCAB), reason="no tokenizer files")

TEXTS = [
    "hello world", "  a  b\n\nfoo  ", "aaaaaaaaaaa aaaa", "", None, "   ", "日本語のテキスト、です。", "don't we'll 's   \t x", "<|endoftext|>é😀 ٣",
    "a" * 3001, " " * 100 + "x", "ab" * 300, "x y z\r\n　w", "the the the",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_VOCAB)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library_and_decode(spark, library):
    rows = [(i % 9, t, i) for i, t in enumerate(TEXTS)] + [(None, "the the", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = bpe.encode(df.withColumnRenamed("ids", "n")).withColumn("back", bpe.decode(F.col("ids"))).orderBy("n").collect()
    assert [list(r.ids) for r in got] == library([r[1] for r in rows])
    assert [r.back for r in got] == [r[1] or "" for r in rows]
    assert bpe.encode(df.limit(0).drop("ids")).count() == 0


def test_split_rules(spark, library):
    sentence = "One two three four five six seven. "
    texts = {1: sentence * 60, 2: "word " * 900, 3: "short", 4: None, 5: "", 6: "漢" * 700, 7: "line\n" * 700}
    df = spark.createDataFrame(list(texts.items()) + [(1, texts[1])], "doc_id long, text string")
    got = splitting.with_text(splitting.split_oversized(df, limit=128, overlap=16)).toPandas().sort_values(["doc_id", "piece_no"])
    assert sorted(got.doc_id.unique()) == [1, 2, 6, 7]
    for doc, g in got.groupby("doc_id"):
        n = len(library([texts[doc]])[0])
        start, end = g.start_token.tolist(), (g.start_token + g.n_tokens).tolist()
        assert g.piece_no.tolist() == list(range(1, len(g) + 1)) and start[0] == 0 and end[-1] == n
        assert all(e - 16 == s for e, s in zip(end, start[1:])) and g.n_tokens.max() <= 128
        assert all(t in texts[doc] for t in g.text)
    assert set(got[got.doc_id == 1].cut) == {"sentence", "end"} and set(got[got.doc_id == 2].cut) == {"word", "end"}
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_split_reaches_the_end_at_three_cuts_a_step(spark, library):
    rng, lines = np.random.default_rng(1), []
    for i in range(24):
        line = f"{i},"
        while len(library([line + "\n"])[0]) < 55:
            line += "QXZJKVWB"[rng.integers(8)]
        lines.append(line + "\n")
    text = "".join(lines)
    got = splitting.split_oversized(spark.createDataFrame([(1, text)], "doc_id long, text string"), limit=64, overlap=16).toPandas()
    n = len(library([text])[0])
    assert len(got) > 64 and (got.start_token + got.n_tokens).max() == n
    assert sorted(got.piece_no) == list(range(1, len(got) + 1))


def test_mixture_shares_and_caps(spark):
    rows = [(i, "alpha beta gamma " * (i % 5), "a" if i % 3 else "b") for i in range(120)] + [(500, "x y z", None), (501, None, "a"), (502, "rest", "unlisted")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2), ("none", 0.5, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(df, targets, block=8, shard_blocks=16).cache()
    s = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert s["a"].share == pytest.approx(0.3, abs=0.02) and s["b"].share == pytest.approx(0.7, abs=0.02) and s["none"].tokens == 0
    used = mixed.groupBy("source", "block").agg(F.count("*").alias("n"), F.max("repeat").alias("r")).collect()
    assert all(u.n <= {"a": 1, "b": 2}[u.source] for u in used)
    assert mixed.where(F.size("ids") != F.col("n_tokens")).isEmpty()
    assert mixing.mixture(df.limit(0), targets).count() == 0


def test_scarce_source_does_not_shrink_the_registered_mixture(spark, library, tmp_path):
    texts = {"a": "alpha beta gamma " * 20, "b": "one two three " * 20, "c": "only this"}
    rows = [(i, texts[s], s) for i, s in enumerate(["a"] * 60 + ["b"] * 60 + ["c"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    targets = [("a", 0.35, 1), ("b", 0.35, 1), ("c", 0.3, 4), ("none", 0.1, 2)]
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    s = {r.source: r for r in queries.p7_shares(spark, str(tmp_path)).collect()}
    n = dict(zip(texts, (len(x) for x in library(texts.values()))))
    assert s["c"].repeats == 4 and s["c"].tokens == 4 * n["c"] and 0 < s["c"].share < 0.3
    assert sum(r.tokens for r in s.values()) == pytest.approx(60 * (n["a"] + n["b"]) + n["c"], abs=512)
    assert s["a"].repeats == s["b"].repeats == 1 and s["none"].tokens == 0


def test_plan_of_a_mixture():
    p = mixing.plan(np.array([100.0, 100.0]), np.array([0.9, 0.1]), np.array([1, 1]), total=150)
    assert p.tolist() == [100, 50]
    assert mixing.plan(np.array([0.0, 10.0]), np.array([0.5, 0.5]), np.array([9, 2])).tolist() == [0, 20]


def test_deal_of_slots(spark):
    rows = mixing.slots_of(spark, ["a", "b", "c"], np.array([7, 30, 0]), np.array([4, 10, 3]), 10, 1).collect()
    assert sorted(sum(r.shard == s for r in rows) for s in range(4)) == [7, 10, 10, 10] and len({(r.shard, r.slot) for r in rows}) == 37
    assert sorted((r.block, r.repeat) for r in rows if r.source == "a") == sorted({(r.block, r.repeat) for r in rows if r.source == "a"})
    assert sum(r.source == "a" for r in rows) == 7 and sorted(r.block for r in rows if r.source == "b") == sorted(list(range(10)) * 3)


def test_segments_fold_like_whole_words(spark, library):
    texts = ["漢字仮名交じり文の長い列" * 40, "эпистемологический", "אבגדהוזחט" * 30, "ภาษาไทยไม่มีช่องว่าง" * 20, "ACGT" * 900 + "TTGACA" * 300, "한국어문장입니다" * 9, "aé" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [list(r.ids) for r in bpe.encode(df).orderBy("doc_id").collect()] == library(texts)


def test_permutation(spark):
    for n in (1, 2, 5, 64, 82, 1000, 5000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3).cast("long")).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))
