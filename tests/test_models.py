"""Prediction, sampling, evaluation, byte-pair encoding, sketches."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom import queries
from textloom.functions import text as tx
from textloom.functions.text import SEPARATOR as SEP
from textloom.operators import bpe, evaluate, lookups, ngrams, predict, sketch
from textloom.operators.joins import evenly

WEIGHTS = {2: 0.05, 3: 0.15, 4: 0.30, 5: 0.50}


def seqs(spark, sequences, extra=None):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "id int, tokens array<string>")


def plain_model(sequences):
    model = defaultdict(Counter)
    for s in sequences:
        for k in range(2, 6):
            for i in range(len(s) - k + 1):
                model[k, tuple(s[i : i + k - 1])][s[i + k - 1]] += 1
    return model


def plain_predict(model, context):
    out = Counter()
    for k in range(2, 6):
        if len(context) >= k - 1 and (k, tuple(context[len(context) - k + 1 :])) in model:
            n = model[k, tuple(context[len(context) - k + 1 :])]
            for t, c in n.items():
                out[t] += WEIGHTS[k] * c / sum(n.values())
    return sorted(out.items(), key=lambda x: (-round(x[1], 12), x[0]))


TRAIN = [list("the cat sat on the mat the cat ran"), list("the dog sat on the log"), list("abcabcabcabd")]


def test_interpolation_and_greedy_generation(spark, monkeypatch):
    model = plain_model(TRAIN)
    table = ngrams.counts(seqs(spark, TRAIN))
    prompts = [list("the "), list("a"), list("zz"), list("abc"), [], list("sat on the ")]
    df = seqs(spark, prompts)
    got = defaultdict(list)
    for r in predict.interpolated(df, table, "id").orderBy("id", "rank").collect():
        got[r["id"]].append((r["token"], round(r["prob"], 9)))
    for i, p in enumerate(prompts):
        assert got[i] == [(t, round(q, 9)) for t, q in plain_predict(model, p)], p
    made = {r["id"]: r["generated"] for r in predict.greedy_chain(df, table, 12, "id").collect()}
    monkeypatch.setattr(predict, "LISTED_CONTEXTS", 0)
    monkeypatch.setattr(predict, "FEW_CONTEXTS", 0)
    assert made == {r["id"]: r["generated"] for r in predict.greedy_chain(df, table, 12, "id").collect()}
    for i, p in enumerate(prompts):
        out = []
        if len(p) >= 2:
            for _ in range(12):
                options = plain_predict(model, p + out)
                if not options:
                    break
                out.append(options[0][0])
                if len(out) >= 8 and out[-4:] == out[-8:-4]:
                    out = out[:-4]
                    break
        assert made[i] == out, p


def predictions(spark, rows):
    return spark.createDataFrame([(1, t, p, k + 1) for k, (t, p) in enumerate(rows)], "id int, token string, prob double, rank int")


def test_sampler(spark):
    two = predictions(spark, [("10", 0.5), ("20", 0.49)])
    strong = predict.Sampler(temperature=1.0, top_k=2, top_p=1.0, repetition_penalty=100.0)
    out = {r["token"]: r["prob"] for r in predict.adjusted(two, strong, "id", F.array(F.lit("10"))).collect()}
    assert out["20"] > 0.9
    three = predictions(spark, [("10", 0.7), ("20", 0.2), ("30", 0.1)])
    assert [r["token"] for r in predict.adjusted(three, predict.Sampler(temperature=0), "id").collect()] == ["10"]
    # The token that crosses top-p is kept; top-k cuts in the order before the penalty.
    assert {r["token"] for r in predict.adjusted(three, predict.Sampler(1.0, 0, 0.75, 1.0), "id").collect()} == {"10", "20"}
    cut = predict.adjusted(three, predict.Sampler(1.0, 1 + 1, 1.0, 100.0), "id", F.array(F.lit("10")))
    assert [r["token"] for r in cut.orderBy("rank").collect()] == ["20", "10"]
    plain = predict.adjusted(three, predict.Sampler(1.0, 0, 1.0, 1.0), "id")
    draws = [predict.drawn(plain, "id", F.lit(u)).first()["token"] for u in (0.0, 0.69, 0.71, 0.95, 1.0)]
    assert draws == ["10", "10", "20", "30", "30"]


def test_generation_is_repeatable_and_stops(spark, monkeypatch):
    table = ngrams.counts(seqs(spark, TRAIN))
    df = seqs(spark, [list("the "), list("zz")])
    run = lambda: {r["id"]: r["generated"] for r in predict.generate(df, table, 4, "id", seed=7).collect()}
    first = run()
    assert first == run() and len(first[0]) == 4 and first[1] == []
    monkeypatch.setattr(predict, "LISTED_CONTEXTS", 0)
    assert first == run()
    stopped = predict.generate(df, table, 4, "id", predict.Sampler(temperature=0), stop="c")
    assert all("c" not in r["generated"] for r in stopped.collect())


def test_perplexity_and_coverage(spark):
    model = plain_model(TRAIN)
    table = ngrams.counts(seqs(spark, TRAIN))
    tests = [list("the cat sat"), list("qqqqqqqq"), list("abca"), [], list("the qqq cat sat on")]
    got = {r["id"]: (r["perplexity"], r["coverage"]) for r in evaluate.scores(seqs(spark, tests), table, "id").collect()}
    for i, t in enumerate(tests):
        p = [dict(plain_predict(model, t[:k][-4:])).get(t[k], 0.0) for k in range(4, len(t))]
        if not p:
            assert got[i] == (None, 0.0)
            continue
        cover = sum(x > 0 for x in p) / len(p)
        assert abs(got[i][1] - cover) < 1e-12
        if cover < 0.5:
            assert got[i][0] is None
        else:
            assert abs(got[i][0] - math.exp(-sum(math.log(x or 1e-10) for x in p) / len(p))) < 1e-6


def test_sanity_and_convergence(spark):
    cases = [("a sane sentence", True), ("", False), ("ab", False), ("aaaaaaaaaa", False), ("12345 67890 !!!", False), (None, False), ("  \n", False)]
    df = spark.createDataFrame(cases, "t string, ok boolean")
    assert df.where(evaluate.is_sane(F.col("t")) != F.col("ok")).count() == 0
    rows = [("r", 1, 100.0), ("r", 2, 50.0), ("r", 3, 50.2), ("r", 4, None), ("s", 1, None), ("s", 2, 10.0), ("s", 3, 10.05)]
    out = evaluate.convergence(spark.createDataFrame(rows, "run string, epoch int, ppl double"), ["run"], "epoch", "ppl")
    assert [(r["run"], r["epoch"]) for r in out.where("converged").orderBy("run", "epoch").collect()] == [("r", 3), ("s", 3)]
    assert out.where("run = 's' AND epoch = 2").first()["delta"] == -1.0


def plain_bpe(freq, most):
    words = {w: list(w) for w in freq}
    rules = []
    while len(rules) < most:
        pairs = Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] += freq[w]
        if not pairs:
            break
        n = max(pairs.values())
        best = min(p for p, c in pairs.items() if c == n)
        rules.append((*best, n))
        for w, s in words.items():
            out, i = [], 0
            while i < len(s):
                if s[i : i + 2] == list(best):
                    out.append(best[0] + best[1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            words[w] = out
    return rules


def plain_fold(word, rules):
    s = list(word)
    for left, right in rules:
        out, i = [], 0
        while i < len(s):
            if s[i : i + 2] == [left, right]:
                out.append(left + right)
                i += 2
            else:
                out.append(s[i])
                i += 1
        s = out
    return s


TEXTS = ["the cat sat on the mat aaaaa aaa", "the dog sat", "the cat ran\nto the 🙂 é", "hello world hello", None, ""]


def test_bpe_against_loop(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc int, text string")
    freqs = bpe.word_freqs(docs)
    freq = {r["word"]: r["freq"] for r in freqs.collect()}
    want = plain_bpe(freq, 400)
    assert bpe.learn_in_order(freq, 400) == want
    assert bpe.learn_in_order(freq, 400, target_vocab=len({c for w in freq for c in w}) + 8) == []
    merges = bpe.learn_merges(freqs, 15)
    assert [(r["l"], r["r"], r["n"]) for r in merges.orderBy("rank").collect()] == want[:15]
    jobs = bpe._learn_by_jobs(freqs, 6, "rank int, l string, r string, merged string, n long")
    assert [(r["l"], r["r"], r["n"]) for r in jobs.orderBy("rank").collect()] == want[:6]
    rules = [(x[0], x[1]) for x in want]
    rank = {p: k for k, p in reversed(list(enumerate(rules)))}
    for w in freq:
        assert bpe.fold_word(w, rank) == plain_fold(w, rules)
    pieces = {r["word"]: r["pieces"] for r in bpe.encode_words(freqs.select("word"), merges).collect()}
    assert pieces == {w: plain_fold(w, rules[:15]) for w in freq}
    every = bpe.learn_merges(freqs, 400)
    batches = {r["word"]: r["pieces"] for r in bpe._encode_in_batches(freqs.select("word"), *bpe._rules(every)).collect()}
    assert batches == {w: plain_fold(w, rules) for w in freq}
    vocab = bpe.vocabulary(freqs, merges)
    assert [r["token"] for r in vocab.orderBy("token_id").limit(8).collect()] == list(bpe.SPECIALS)
    assert vocab.count() == vocab.select("token").distinct().count()
    back = {r["doc"]: r["text"] for r in bpe.decode(bpe.encode(docs, "doc", merges, vocab), "doc", vocab).collect()}
    assert back == {i: t for i, t in enumerate(TEXTS) if t}
    unknown = bpe.encode(spark.createDataFrame([(1, "ζ")], "doc int, text string"), "doc", merges, vocab).first()
    assert unknown["token_id"] == bpe.UNKNOWN
    number = {r["token"]: r["token_id"] for r in vocab.collect()}
    fold = lambda t: [p for w in re.findall(tx.PRETOKEN, t) for p in plain_fold(w, rules[:15])]
    made = docs.select("doc", bpe.encoder(merges, vocab)(tx.pretokens(F.col("text"))).alias("p")).collect()
    assert {r["doc"]: [(x["piece"], x["token_id"]) for x in r["p"]] for r in made} == {i: [(p, number[p]) for p in fold(t or "")] for i, t in enumerate(TEXTS)}
    ids = docs.select("doc", bpe.decoded(bpe.encoder(merges, vocab)(tx.pretokens(F.col("text")))["token_id"], vocab).alias("t"))
    assert {r["doc"]: r["t"] for r in ids.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(docs.limit(0), "doc", merges, vocab).count() == 0


def test_generation_query_goes_on_for_thirty_tokens(spark, tmp_path):
    words = [w for k in range(60) for w in (f"w{k}", " ")]
    spark.createDataFrame([(1, "".join(words), "x", "s"), (2, "p q p q p q p q p q p q p q", "x", "s")], "doc_id int, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w0 w1"), (2, "p q")], "sample_id int, prompt string").write.parquet(f"{tmp_path}/generation_sample.parquet")
    got = {r["sample_id"]: (r["generated"], r["n_tokens"]) for r in queries.queries()["greedy_generation"](spark, str(tmp_path)).collect()}
    assert got == {1: ("".join(words[3:33]), 30), 2: (" p q", 4)}


def test_bpe_queries_merge_until_no_pair_is_left(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x", "s") for i, t in enumerate(TEXTS)], "doc_id int, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    freq = {r["word"]: r["freq"] for r in bpe.word_freqs(docs).collect()}
    want = plain_bpe(freq, 10_000)
    made = queries.queries()
    assert [(r["l"], r["r"], r["n"]) for r in made["bpe_merges"](spark, str(tmp_path)).orderBy("rank").collect()] == want
    pieces = {w: plain_fold(w, [x[:2] for x in want]) for w in freq}
    assert {r["word"]: r["pieces"] for r in made["bpe_encode_words"](spark, str(tmp_path)).collect()} == {w: " + ".join(p) for w, p in pieces.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in made["bpe_doc_tokens"](spark, str(tmp_path)).collect()} == {i: sum(len(pieces[w]) for w in re.findall(tx.PRETOKEN, t)) for i, t in enumerate(TEXTS) if t}
    assert {r["same"] for r in made["bpe_decode_roundtrip"](spark, str(tmp_path)).collect()} == {True}


def test_bpe_stops_at_the_vocabulary_target_on_both_paths(spark):
    freqs = spark.createDataFrame([("abcab", 5), ("cab", 3), ("bd", 1)], "word string, freq long")
    want = plain_bpe({"abcab": 5, "cab": 3, "bd": 1}, 2)
    for most_words in (0, 100):
        merges = bpe.learn_merges(freqs, target_vocab=4 + len(bpe.SPECIALS) + 2, most_words=most_words)
        assert [(r["l"], r["r"], r["n"]) for r in merges.orderBy("rank").collect()] == want


def test_merges_learnt_in_batches_by_jobs(spark):
    """Many merges a job, in the order of one merge after the other; words that make ties and symbols that come back."""
    rng = random.Random(5)
    freq = {"".join(rng.choices("abcdefgh", k=rng.randint(1, 9))): rng.randint(1, 40) for _ in range(300)} | {"aaaa": 7, "aa": 3, "": 2}
    freq.pop("")
    df = spark.createDataFrame(list(freq.items()), "word string, freq long")
    want = plain_bpe(freq, 60)
    jobs = bpe._learn_by_jobs(df, 60, "rank int, l string, r string, merged string, n long")
    assert [(r["l"], r["r"], r["n"]) for r in jobs.orderBy("rank").collect()] == want
    assert bpe.independent([("a", "b", 9), ("c", "d", 8), ("b", "e", 7), ("f", "g", 6)], set(), True) == [("a", "b", 9), ("c", "d", 8)]
    assert bpe.independent([("a", "b", 9), ("c", "d", 7), ("b", "e", 7)], set(), True) == [("a", "b", 9)]
    assert bpe.independent([("a", "b", 9), ("c", "d", 8)], {"ab"}, True) == [("a", "b", 9)]
    assert bpe.independent([("a", "b", 9), ("c", "d", 8)], set(), False) == [("a", "b", 9)]


def test_token_ids_from_text_to_perplexity(spark, tmp_path):
    """Encoding, chunks, counts and scores over ids, against plain loops."""
    docs = spark.createDataFrame([(i, t, "x", "s") for i, t in enumerate(TEXTS)], "doc_id int, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the cat sat on the mat"), (2, "zz"), (3, "hello dog hello world")], "sample_id int, prompt string").write.parquet(f"{tmp_path}/generation_sample.parquet")
    freq = {r["word"]: r["freq"] for r in bpe.word_freqs(docs).collect()}
    rules = [x[:2] for x in plain_bpe(freq, 10_000)]
    made = queries.queries()
    number = {r["token"]: r["token_id"] for r in made["bpe_vocabulary"](spark, str(tmp_path)).collect()}
    ids = lambda t: [number.get(p, bpe.UNKNOWN) for w in re.findall(tx.PRETOKEN, t) for p in plain_fold(w, rules)]
    assert {r["doc_id"]: r["ids"] for r in made["bpe_doc_ids"](spark, str(tmp_path)).collect()} == {i: ids(t) for i, t in enumerate(TEXTS) if t}
    lines = [[i for x in t.split("\n") if x.strip() for i in ids(x.strip())] for t in TEXTS if t]
    sequences = [x for x in lines if len(x) >= ngrams.LEAST_TAIL]
    model = plain_model(sequences)
    assert {(r["ord"], r["ctx"], r["next"]): r["cnt"] for r in made["id_ngram_counts"](spark, str(tmp_path)).collect()} == {(k, " ".join(map(str, c)), t): n for (k, c), x in model.items() for t, n in x.items()}
    assert sorted(r["n_tokens"] for r in made["id_chunk_sizes"](spark, str(tmp_path)).collect()) == sorted(map(len, sequences))
    got = {r["sample_id"]: (r["perplexity"], r["coverage"]) for r in made["id_perplexity"](spark, str(tmp_path)).collect()}
    for k, t in ((1, "the cat sat on the mat"), (2, "zz"), (3, "hello dog hello world")):
        x = ids(t)
        p = [dict(plain_predict(model, x[:i][-4:])).get(x[i], 0.0) for i in range(4, len(x))]
        cover = sum(q > 0 for q in p) / len(p) if p else 0.0
        assert got[k][1] == pytest.approx(cover, abs=1e-6)
        if p and cover >= 0.5:
            assert got[k][0] == pytest.approx(math.exp(-sum(math.log(q or 1e-10) for q in p) / len(p)), abs=1e-3)
        else:
            assert got[k][0] is None


def test_even_joins(spark):
    rows = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(100)] + [(None, 7), (500, 8)], "k int, v int")
    groups = rows.where("k IS NOT NULL AND k <> 500").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = {(r["k"], r["v"], r["n"]) for r in rows.join(groups, ["k"]).collect()}
    kept = {(r["k"], r["v"], r["n"]) for r in rows.join(groups, ["k"], "left").collect()}
    for share in (1e-3, 0.2, 2.0):
        assert {(r["k"], r["v"], r["n"]) for r in evenly(rows, groups, ["k"], F.col("n"), share).collect()} == want
        assert {(r["k"], r["v"], r["n"]) for r in evenly(rows, groups, ["k"], F.col("n"), share, "left").collect()} == kept
    assert evenly(rows, groups.limit(0), ["k"], F.col("n")).count() == 0


def test_bpe_rule_learnt_twice():
    rules = [("b", "c"), ("a", "bc"), ("x", "abc"), ("a", "b"), ("ab", "c"), ("x", "abc")]
    rank = {p: k for k, p in reversed(list(enumerate(rules)))}
    late = [("a", "b"), ("x", "abc"), ("ab", "c"), ("x", "abc")]
    first = {p: k for k, p in reversed(list(enumerate(late)))}
    assert bpe.fold_word("xabc", first, {("x", "abc"): [3]}) == plain_fold("xabc", late) == ["xabc"]
    assert bpe.fold_word("xabc", rank, {("x", "abc"): [5]}) == plain_fold("xabc", rules)


def test_model_queries_count_all_orders(spark, tmp_path):
    rows = [(1, "a b c d e f", "x", "code_a"), (2, "a b c d e", "x", "code_a"), (3, "a b c d x y", "x", "web"), (4, "b c d e f g", "x", None)]
    spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda of: Counter((k, SEP.join(w[i - k + 1 : i]), w[i]) for t in of for w in [re.findall(tx.PRETOKEN, t)] for k in (2, 3, 4, 5) for i in range(k - 1, len(w)))
    code, other, every = plain([rows[0][1], rows[1][1]]), plain([rows[2][1]]), plain([r[1] for r in rows])
    run = lambda name, *cols: {(r["ord"], r["ctx"], r["next"]): tuple(r[c] for c in cols) for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    one = lambda counter: {k: (n,) for k, n in counter.items()}
    assert run("merge_models", "cnt") == one(code + other)
    assert run("model_diff", "old_cnt", "new_cnt") == {k: (code[k], other[k]) for k in code.keys() | other.keys() if code[k] != other[k]}
    assert run("epoch_scaled_counts", "cnt") == {k: (n * 3,) for k, n in code.items()}
    assert run("decayed_counts", "cnt") == {k: (n // 2,) for k, n in code.items() if n // 2}
    assert run("stream_counts", "cnt") == one(every)


def test_sketch(spark):
    keys = spark.createDataFrame([("hello",)] * 3 + [("world",), (None,)], "k string")
    cms = sketch.build(keys, F.col("k"), width=1024)
    asked = spark.createDataFrame([("hello",), ("world",), ("nothing",)], "k string")
    got = {r["key"]: r["estimate"] for r in sketch.estimate(cms, asked, F.col("k"), width=1024).collect()}
    assert got["hello"] >= 3 and got["world"] >= 1 and got["nothing"] == 0
    assert cms.groupBy("row").agg(F.sum("cnt").alias("n")).where("n <> 4").count() == 0
    weighted = sketch.build(spark.createDataFrame([(42, 100)], "k long, n int"), F.col("k"), F.col("n"), 256, 3)
    half = sketch.estimate(sketch.decayed(weighted, 0.5), spark.createDataFrame([(42,)], "k long"), F.col("k"), 256, 3).first()["estimate"]
    assert half == 50 and sketch.cleared(cms).count() == 0
    assert sketch.memory_bytes() == 16 * 1024 * 1024
    assert sketch.merged(cms, cms).agg(F.sum("cnt")).first()[0] == 32


def test_greedy_generation_counts_only_after_the_contexts_it_meets(spark, monkeypatch):
    """The same tokens as from the whole count table, which the query doesn't make."""
    draw = random.Random(3)
    texts = [[draw.choice("a b c d e é ß z".split()) for _ in range(draw.randint(0, 60))] for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(3)
    prompts = [(i, [draw.choice("a b c d e é ß z never".split()) for _ in range(draw.randint(0, 7))]) for i in range(40)]
    df = spark.createDataFrame([*prompts, (None, ["a", "b"])], "id int, tokens array<string>")
    want = {r["id"]: r["generated"] for r in predict.greedy_chain(df, ngrams.counts(docs), 12, "id").collect()}
    monkeypatch.setattr(lookups, "BLOCK", 150)
    assert {r["id"]: r["generated"] for r in predict.greedy_chain_over(df, docs, 12, "id").collect()} == want
    assert any(len(x) > 4 for x in want.values())
    monkeypatch.setattr(predict, "LISTED_CONTEXTS", 3)
    assert {r["id"]: r["generated"] for r in predict.greedy_chain_over(df, docs, 12, "id").collect()} == want


def test_greedy_generation_makes_no_count_table(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "ngrams", lambda *a, **k: pytest.fail("n-grams of the whole corpus are made"))
    assert queries.queries()["greedy_generation"](spark, "/root/testdata/sf0.001").count() == 314


def test_id_perplexity_counts_only_what_prompts_look_up(spark, monkeypatch):
    """The same rows as by the whole table of id n-grams; the merges are learnt once."""
    folder, learnt = "/root/testdata/sf0.001", []
    learn = bpe.learn_merges
    monkeypatch.setattr(bpe, "learn_merges", lambda *a, **k: learnt.append(1) or learn(*a, **{**k, "target_vocab": 600}))
    merged = queries._merges(spark, folder)
    monkeypatch.setattr(queries, "_merges", lambda *a: learnt.append(2) or merged)
    few = queries.queries()["id_perplexity"](spark, folder).collect()
    assert learnt == [1, 2]
    monkeypatch.setattr(lookups, "MOST_ASKED", 0)
    assert sorted(map(str, queries.queries()["id_perplexity"](spark, folder).collect())) == sorted(map(str, few))
