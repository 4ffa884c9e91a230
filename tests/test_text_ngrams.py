"""Pre-tokens, count tables, chunks, against plain loops and the toolkit's own test inputs."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import ngrams

SEP = tx.SEPARATOR
SIGNS = set("()[]{};,:.=+-*/<>!&|^~%@#?\\\"'`")


def plain_pretokens(text):
    out, run = [], ""
    for c in text:
        if c in "\n\r\t" or c in SIGNS:
            if run:
                out.append(run)
            out.append(c)
            run = ""
        elif run and (run[0] == " ") == (c == " "):
            run += c
        else:
            if run:
                out.append(run)
            run = c
    return out + [run] if run else out


def test_pretokens(spark):
    cases = ["hello world", "def foo(x):", "    return", "", None, "a  b\t\n_x$é 'q'", " x", "🙂🙂 ok" * 50]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", tx.pretokens(F.col("t")).alias("w")).collect()}
    assert got[0] == ["hello", " ", "world"]
    assert got[2][0] == "    "
    assert got[4] is None
    for i, c in enumerate(cases):
        if c is not None:
            assert got[i] == plain_pretokens(c)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n_é(", max_size=30), min_size=1, max_size=20))
def test_pretokens_property(spark, texts):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(texts)], "i int, t string")
    for r in df.select("i", tx.pretokens(F.col("t")).alias("w")).collect():
        assert r["w"] == plain_pretokens(texts[r["i"]])


def plain_counts(sequences, orders=(2, 3, 4, 5)):
    return Counter((k, SEP.join(s[i : i + k - 1]), s[i + k - 1]) for s in sequences for k in orders for i in range(len(s) - k + 1))


def table(df):
    return {(r["ord"], r["ctx"], r["next"]): r["cnt"] for r in df.collect()}


def seqs(spark, sequences):
    return spark.createDataFrame([(s,) for s in sequences], "tokens array<string>")


def test_counts_against_loop(spark):
    data = [list("abcabcab"), ["x"], [], None, list("aaaaaa"), ["1", "2", "3", "4", "5"] * 2, ["", "a", ""]]
    df = seqs(spark, data)
    assert table(ngrams.counts(df)) == plain_counts([s for s in data if s])
    cycle = {(r["ord"], r["ctx"]): r["next"] for r in ngrams.best_next(ngrams.counts(seqs(spark, [list("1234512345")]))).collect()}
    assert cycle[5, SEP.join("1234")] == "5"
    with pytest.raises(ValueError):
        ngrams.counts(df, orders=(1, 2))


def test_mle_prune_and_stats(spark):
    obs = spark.createDataFrame([(2, "10", "20", 2), (2, "10", "30", 1)], "ord int, ctx string, next string, cnt long")
    top = ngrams.mle(obs).orderBy("rank").collect()
    assert [(r["next"], round(r["prob"], 6)) for r in top] == [("20", 0.666667), ("30", 0.333333)]
    assert ngrams.mle(obs.where("ctx = '999'")).count() == 0
    assert [r["next"] for r in ngrams.prune(obs, 2).collect()] == ["20"]
    s = ngrams.stats(obs).first()
    assert (s["contexts"], s["associations"], s["observations"]) == (1, 2, 3)


def test_evict_takes_the_least_threshold_that_fits(spark):
    rows = [(2, "c", str(i), n) for i, n in enumerate([1, 1, 1, 2, 2, 3, 5, 200])]
    df = spark.createDataFrame(rows, "ord int, ctx string, next string, cnt long")
    for budget in range(0, 10):
        counts = [r[3] for r in rows]
        want = counts if len(counts) <= budget else [c for c in counts if c >= next((t for t in range(2, 100) if sum(c >= t for c in counts) <= budget), 99)]
        assert sorted(r["cnt"] for r in ngrams.evict(df, budget).collect()) == sorted(want), budget


def test_merge_diff_scale(spark):
    a, b = ngrams.counts(seqs(spark, [list("abab")])), ngrams.counts(seqs(spark, [list("abc")]))
    both = plain_counts([list("abab")]) + plain_counts([list("abc")])
    assert table(ngrams.merged(a, b)) == both
    assert table(ngrams.scaled(a, 3)) == {k: 3 * v for k, v in plain_counts([list("abab")]).items()}
    diff = {(r["ord"], r["ctx"], r["next"]): (r["old_cnt"], r["new_cnt"]) for r in ngrams.difference(a, b).collect()}
    assert diff[2, "a", "b"] == (2, 1)
    empty = ngrams.counts(seqs(spark, []).limit(0))
    assert ngrams.merged(empty).count() == 0 and ngrams.mle(empty).count() == 0


def test_chunks_against_loop(spark):
    texts = ["\n".join(["word " * 100] * 12), "one two", "a b c", "", None, "x\n\n  \ny z w v u t", "w " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string")
    want = set()
    for i, t in enumerate(texts):
        held, k = [], 0
        for line in (t or "").split("\n"):
            if line.strip():
                held += plain_pretokens(line.strip())
                if len(held) >= 512:
                    want.add((i, k, len(held)))
                    held, k = [], k + 1
        if len(held) >= 5:
            want.add((i, k, len(held)))
    assert {(r["doc"], r["chunk"], len(r["tokens"])) for r in ngrams.chunks(df, "doc").collect()} == want


def test_packed_keys_differ(spark):
    row = spark.range(1).select(ngrams.packed(F.lit(1), F.lit(2)).alias("a"), ngrams.packed(F.lit(40000), F.lit(0), F.lit(0), F.lit(1)).alias("b")).first()
    assert row["a"] == (1 << 16) + 2 and row["b"] < 0


def test_display(spark):
    row = spark.range(1).select(
        tx.human_size(F.lit(0)).alias("zero"),
        tx.human_size(F.lit(1536)).alias("kb"),
        tx.human_size(F.lit(3 * 1024.0**5)).alias("pb"),
        tx.human_duration(F.lit(90.0)).alias("d"),
        tx.bar(F.lit(5), F.lit(0)).alias("empty"),
        tx.bar(F.lit(50), F.lit(10), 4).alias("full"),
        tx.sparkline(F.array(*[F.lit(float(x)) for x in (1, 2, 3)]), 4).alias("s"),
        tx.sparkline(F.array().cast("array<double>"), 3).alias("none"),
        tx.trend(F.array(F.lit(2.0), F.lit(1.0))).alias("t"),
        tx.trend(F.array(F.lit(2.0))).alias("one"),
    ).first()
    assert (row["zero"], row["kb"], row["pb"], row["d"]) == ("0.0 B", "1.5 KB", "3.0 PB", "1.5m")
    assert row["empty"] == "░" * 28 and row["full"] == "████"
    assert row["s"] == "  ▄█" and row["none"] == "───" and row["t"] == "↓" and row["one"] == "→"


def test_sql_table_function(spark):
    tx.register(spark)
    assert [r["word"] for r in spark.sql("SELECT word FROM pretokenize('a b.') ORDER BY pos").collect()] == ["a", " ", "b", "."]
