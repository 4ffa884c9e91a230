"""Formatting duplicates, token counts and ids, mixing, leaked passages: against brute force, also on nulls, empty tables and repeated rows."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import encode, formatting_duplicates as dup, leakage, mixture, token_budget
from textloom.llm.tokenizers import DEFAULT_FOLDER, backtrack_encoder, batch_encoder

RANKS = f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"


# ---- formatting duplicates


def squash(v):
    return "".join(c for c in v if c.isalnum()).casefold()


def plain_record(values):
    out = set()
    for v in values:
        if v and squash(v):
            m = list(re.finditer(r"(?i)(^|[;|,\n{])[\W_]*(emotion|text|speaker|intensity)[^\w:=;|\n]*[:=]", v))
            out.add(tuple(sorted((squash(a[2]), squash(v[a.end() : b.start() if b else None])) for a, b in zip(m, m[1:] + [None]))) if m and m[0].start() == 0 else squash(v))
    return frozenset(out)


ROWS = [
    (1, "Ɔbaa no kɔ fie.", None, "x"), (2, None, "ɔBAA  no, kɔ fie!", "x"), (3, "Ɔbaa no kɔ fie", "ƆBAA NO KƆ FIE", "x"), (4, "Ɔbaa kɔ no fie", None, "x"),
    (5, '{"emotion": "joy", "text": "Good day.", "intensity": "8"}', None, "x"), (6, None, "text=good day; intensity=8; emotion=Joy", "x"), (7, None, "intensity: 8 | emotion: joy | text: Good day", "x"),
    (8, None, "intensity: 7 | emotion: joy | text: Good day", "x"), (9, "emotion joy text Good day", None, "x"), (10, None, None, "x"), (11, "...", " ", "x"), (12, "", "!", "x"),
    (13, "a b", "c", "x"), (14, "C.", "AB", "x"), (15, "ab", None, "x"), (2, None, "ɔBAA  no, kɔ fie!", "x"), (16, "z" * 100_000, None, "x"), (17, "Z " * 100_000, None, "x"), (None, "ab", None, "x"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, sentence string, text string, id string").withColumn("key", F.lit(1)).withColumn("hash", F.lit(2))


def brute(rows):
    groups = defaultdict(set)
    for i, *values, _ in rows:
        if i is not None and plain_record(values):
            groups[plain_record(values)].add(i)
    return groups


def test_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = ["kɔ", "fie", "no", "ɔbaa", "x1"]
    rows = ROWS + [(100 + i, " ".join(rng.choices(words, k=2)).title() if i % 2 else "-".join(rng.choices(words, k=2)), rng.choice([None, "", "fie!"]), "") for i in range(400)]
    groups = brute(rows)
    df = frame(spark, rows)
    pairs = {(r["first_id"], r["copy_id"]) for r in dup.copies(df, "row_id", "sentence", "text").collect()}
    assert pairs == {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    once = {(r["first_id"], r["copies"]) for r in dup.collapsed(df, "row_id", "sentence", "text").collect()}
    assert once == {(min(g), len(g)) for g in groups.values()}


def test_duplicates_when_one_record_holds_most_rows(spark, monkeypatch):
    df = frame(spark, [(i, "Same!" if i % 3 else f"other {i}", None, "") for i in range(300)])
    want = {(1, i) for i in range(2, 300) if i % 3}
    for share in (1e-3, 2.0):  # by broadcast, and by the even join alone
        monkeypatch.setattr(dup, "HOT_SHARE", share)
        got = dup.copies(df, "row_id", "sentence", "text")
        assert {(r["first_id"], r["copy_id"]) for r in got.collect()} == want


def test_duplicates_with_many_filters(spark):
    """More rows than one filter serves: parted by hash, with the same result."""
    df = frame(spark, ROWS * 3)
    want = {(min(g), i) for g in brute(ROWS).values() for i in g if i != min(g)}
    for most_keys in (30, 10**6):
        assert {(r["first_id"], r["copy_id"]) for r in dup.copies(df, "row_id", "sentence", "text", most_keys=most_keys).collect()} == want
    assert {(r["first_id"], r["copies"]) for r in dup.collapsed(df, "row_id", "sentence", "text", most_keys=30).collect()} == {(min(g), len(g)) for g in brute(ROWS).values()}


def test_names_of_parts_are_a_parameter(spark):
    df = frame(spark, [(1, "mood=joy; line=Go", None, "x"), (2, "line: go | mood: Joy", None, "x")])
    assert dup.copies(df, "row_id", "sentence", "text").count() == 0
    assert dup.copies(df, "row_id", "sentence", "text", part_names=("mood", "line")).count() == 1


def test_duplicates_of_an_empty_table(spark):
    df = frame(spark, [])
    assert dup.copies(df, "row_id", "sentence", "text").count() == 0
    assert dup.collapsed(df, "row_id", "sentence", "text").count() == 0


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    rows = [int(k) for k in keys] + [int(k) for k in keys[:700]] * 2
    df = spark.createDataFrame([(k,) for k in rows], "hash long").repartition(7)
    for blocks in (1, 8):
        again = dup.repeat_filter(df, blocks)
        block, bits = dup._positions(keys, blocks)
        hit = ((again[block, bits >> 3] >> (7 - (bits & 7))) & 1).all(axis=0)
        assert hit[:700].all()
        if blocks == 8:
            assert hit[700:].mean() < 0.2


# ---- token ids and counts


def test_encoder_equals_the_library():
    encoder, library = backtrack_encoder(RANKS), batch_encoder(RANKS)
    rng = random.Random(5)
    alphabets = ["abcdefghij ", "the and ing 's\n\t", "ɔɛŋ wɔ", "日本語のテキスト。", "0123456789.,", "🙂👩‍👧é́", "ab"]
    texts = ["".join(rng.choices(a, k=rng.randint(1, 300))) for a in alphabets for _ in range(150)]
    texts += ["", "<|endoftext|>", "a" * 20_000, "ab" * 20_000, "  \n\n  x", "\x00�", "don't DON'T"]
    for t, ids in zip(texts, library(texts)):
        assert encoder.encode(t) == ids
    assert encoder.encode(None) == []


def test_ids_of_documents(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "x" * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in docs.select("doc_id", encode.token_ids(F.col("text"), RANKS).alias("ids")).collect()}
    want = batch_encoder(RANKS)(["Hello world", "<|endoftext|>", "x" * 50_000])
    assert got == {1: want[0], 2: [], 3: [], 4: want[1], 5: want[2]}
    assert docs.limit(0).select(encode.token_ids(F.col("text"), RANKS)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_by_every_library(spark, name):
    path = f"{DEFAULT_FOLDER}/{name}"
    texts = ["Hello world", "", "Ɔbaa no kɔ fie."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = [r["n"] for r in df.select("i", encode.token_count(F.col("t"), path).alias("n")).orderBy("i").collect()]
    assert got == [len(x) for x in batch_encoder(path)(texts)] + [0]


def test_token_budget(spark):
    rows = [("a", "one two", "./X/part.txt", "TW", " Ashanti Twi 🇬🇭", 1), ("a", "one two", "./X/part.txt", "TW", " Ashanti Twi 🇬🇭", 1), ("b", None, None, None, None, None), ("c", "three", "x\\other.txt", "twi", "ASHANTI TWI", 2), (None, "four", "y", "?", "english", 3), (None, "five", "y", "", "english", 3)]
    snippets = spark.createDataFrame(rows, "id string, content string, source string, language string, phase_name string, stored_at long")
    aliases = spark.createDataFrame([("tw", "twi"), ("twi", "twi")], "alias string, lang string")
    path = f"{DEFAULT_FOLDER}/byte_bpe_50k.json"
    counted = token_budget.snippet_tokens(snippets, aliases, path)
    assert {(r["id"], r["source"], r["language"], r["phase"], r["n_tokens"]) for r in counted.collect()} == {
        ("a", "x/part.txt", "twi", "ashanti twi", 2), ("b", "(none)", "(none)", "(none)", 0), ("c", "x/other.txt", "twi", "ashanti twi", 1), (None, "y", "(none)", "english", 1)
    }
    reports = spark.createDataFrame([("r1", "Ashanti Twi", 5), ("r1", "ashanti twi 🇬🇭", 9), ("r1", "Ashanti Twi", 0), ("r2", "Ashanti Twi", 4), ("r2", None, None)], "run_id string, name string, tokens_trained long")
    trained = {r["phase"]: r["tokens_trained"] for r in token_budget.tokens_trained(reports).collect()}
    assert trained == {"ashanti twi": 13, "(none)": 0}
    cube = token_budget.token_cube(counted, token_budget.tokens_trained(reports))
    by = {(r["source"], r["language"], r["phase"]): (r["n_snippets"], r["n_tokens"], r["tokens_trained"]) for r in cube.collect()}
    assert by["(all)", "(all)", "(all)"] == (5, 5, None) and by["(all)", "(all)", "ashanti twi"] == (2, 3, 13) and by["x/*", "twi", "(all)"] == (2, 3, None) and by["x/part.txt", "(all)", "ashanti twi"] == (1, 2, None)
    assert ("(none)/*", "(all)", "(all)") not in by and by["y", "(all)", "(all)"] == (2, 2, None)
    with pytest.raises(ValueError, match="no configuration"):
        token_budget.snippet_tokens(snippets, spark.range(100_001).selectExpr("CAST(id AS STRING) AS alias", "'x' AS lang"), path)
    assert token_budget.snippet_tokens(snippets.limit(0), aliases, path).count() == 0


def test_token_budget_keeps_phases_without_snippets(spark):
    counted = spark.createDataFrame([("a", "x", "twi", "english", 3)], "id string, source string, language string, phase string, n_tokens long")
    trained = spark.createDataFrame([("english", 7, 1), ("refinement (all data)", 9, 2)], "phase string, tokens_trained long, runs long")
    cube = token_budget.token_cube(counted, trained)
    assert cube.columns == ["source", "language", "phase", "n_snippets", "n_tokens", "tokens_trained"]
    rows = [tuple(r) for r in cube.where("tokens_trained IS NOT NULL").collect()]
    assert sorted(rows) == [("(all)", "(all)", "english", 1, 3, 7), ("(all)", "(all)", "refinement (all data)", 0, 0, 9)]
    assert cube.count() == 9
    none = token_budget.token_cube(counted.limit(0), trained)
    assert {tuple(r) for r in none.where("tokens_trained IS NOT NULL").collect()} == {("(all)", "(all)", "english", 0, 0, 7), ("(all)", "(all)", "refinement (all data)", 0, 0, 9)}


# ---- mixing


def test_mixing(spark):
    rng = random.Random(1)
    docs = [(i, s, " word" * rng.randint(1, 9)) for i, s in enumerate(["a"] * 600 + ["b"] * 200 + ["c"] * 5 + ["d"] * 50 + [None] * 10 + ["e"] * 20)]
    docs += [(9001, "a", None), (9002, "a", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    plan = spark.createDataFrame([("a", 2.0, 3), ("b", 1.0, None), ("c", 1.0, 2), ("d", 0.0, 5), ("e", None, 5), ("f", 3.0, 1), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    held = defaultdict(int)
    for _, s, t in docs:
        held[s] += len((t or "").split())
    caps = {"a": 3, "b": None, "c": 2}
    for how in ({}, {"exact_shares": True}, {"total_tokens": 1000}, {"total_tokens": 0}):
        chosen, shares = mixture.mix(df, plan, RANKS, **how)
        used = defaultdict(int)
        rows = chosen.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows)
        for r in rows:
            assert r["uses"] >= 1 and (caps[r["source"]] is None or r["uses"] <= caps[r["source"]])
            used[r["source"]] += r["uses"] * r["n_tokens"]
        report = {r["source"]: r for r in shares.collect()}
        assert set(report) == {"a", "b", "c", "d", "e", "f", None}
        for s in "abc":
            assert report[s]["used_tokens"] == used[s] and abs(report[s]["target_tokens"] - used[s]) <= 4.5
        total = how.get("total_tokens", held["a"] + held["b"] + held["c"])
        if how.get("exact_shares"):
            total = min(3 * held["a"] / 0.5, 2 * held["c"] / 0.25)
        share, most = {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 3 * held["a"], "b": float("inf"), "c": 2 * held["c"]}
        free, left, due = set(share), total, {}
        while over := {s for s in free if left * share[s] / sum(share[x] for x in free) > most[s] + 1e-9}:
            for s in over:
                due[s] = most[s]
            free -= over
            left = total - sum(due.values())
        due |= {s: left * share[s] / sum(share[x] for x in free) for s in free}
        assert {s: report[s]["target_tokens"] for s in "abc"} == {s: int(x + 1e-6) for s, x in due.items()}
        if how == {}:
            assert due["c"] == most["c"] < total * 0.25 and sum(due.values()) == pytest.approx(total)
        assert report["d"]["used_tokens"] == report["e"]["used_tokens"] == report["f"]["used_tokens"] == 0
    chosen, shares = mixture.mix(df.limit(0), plan, RANKS)
    assert chosen.count() == 0 and shares.count() == 7


# ---- leaked passages


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "fair", "brings", "boats", "of", "wool", "x1", "Ɔbaa", "kɔ"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(60)] + [(60, None), (61, ""), (62, "one two three four five six seven eight nine ten"), (63, "one two three four five six seven eight nine ten")]
    texts = []
    for i in range(150):
        body = " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
        item = items[rng.randrange(60)][1].split()
        at = rng.randint(0, max(0, len(item) - 9))
        texts.append((i, body + " // " + "_".join(item[at : at + rng.choice([9, 10, 11])]).upper() + "\\n" + body))
    texts += [(500, None), (501, ""), (502, "ONE_two-three\\nfour\\tfive # six\n seven eight nine ten"), (503, "one two three four five six seven eight nine\\rten"), (502, "ONE_two-three\\nfour\\tfive # six\n seven eight nine ten"), (504, "pad " * 100_000 + items[62][1])]

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").replace("\\n", " ").replace("\\t", " ").casefold())

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 9):
            windows[tuple(w[k : k + 10])].add(i)
    want = {(i, s) for i, t in texts for w in [words(t)] for k in range(len(w) - 9) for s in windows.get(tuple(w[k : k + 10]), ())}
    corpus = spark.createDataFrame(texts, "file_id long, content string").withColumn("sample_id", F.lit("clash"))
    held = spark.createDataFrame(items, "sample_id long, prompt string")
    for block in (leakage.ITEM_CHARS, 300):
        got = leakage.leaked(corpus, "file_id", "content", held, "sample_id", "prompt", block)
        rows = [(r["file_id"], r["sample_id"]) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want) and {(502, 62), (502, 63), (504, 62)} <= want
    assert leakage.leaked(corpus, "file_id", "content", held.limit(0), "sample_id", "prompt").count() == 0
    assert leakage.leaked(corpus.limit(0), "file_id", "content", held, "sample_id", "prompt").count() == 0
