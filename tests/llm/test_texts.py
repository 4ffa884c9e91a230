"""Sentence units, languages, files nobody wrote: marked cases, held-out accuracy, brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import language_id, sentences, source_files

ENGLISH = [
    "Dr. Taleno met Mrs. Wemeso at 3 p.m. in the big hall.", "The meeting ended at 2 p.m.", "My sister sold the kite.", "See fig. 7 for details.", "We walked home, e.g. by the river.",
    "The bread, the salt, etc.", "Nobody knew why!", "Where is the doctor today?", "It cost 7.25 cedis at home.", "K. B. Taleno signed first.", "The old farmer waited.", "A small child smiled.",
    "He met Dr. Bareta on the farm.", "Mrs. Kofeka came at 5 p.m. on Sunday.", "The doctor left at 6 p.m.", "Nobody saw the old farmer.", "A doctor saw the child.", "Dr. Fihemo sang.",
]


def corpus(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(ENGLISH, k=12)), "english", "stories") for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def segmenter(spark):
    docs = corpus(spark).withColumn("code", F.lit(False))
    return sentences.Segmenter(sentences.statistics(docs.select("text", "lang", "code")))


def cut(segmenter, text, lang="english", code=False):
    return [text[a:b] for a, b in segmenter.units(text, lang, code)]


def test_statistics_find_abbreviations(segmenter):
    known = segmenter.languages["english"]
    assert {"dr", "mrs", "p.m", "fig", "e.g"} <= set(known.abbreviations)
    assert {"my", "nobody", "the"} <= known.starters and "taleno" not in known.starters


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Rezato met Mrs. Hohoso at 3 p.m. in the hall.", "It cost 8.50 cedis."],
        ["The meeting ended at 2 p.m.", "My sister came."],
        ["“Where is the kite?” asked Petiya.", "The old farmer waited."],
        ["Kadena wrote: “We will meet. It is late.”", "The doctor left."],
        ['"Nobody knew," Malizi said, "and nothing can be done."', "A child smiled!"],
        ["The chief said it was “almost done.”", "Nobody saw the kite."],
        ["Peloki waited... and then replied.", "The kite fell…", "A child smiled."],
        ["Version v6.3.72 is kept at https://a.example/b/index.html for now.", "The end?!", "My kite."],
        ["K. B. Wikifo signed the list (see p. 19) first.", "A child sang."],
    ],
)
def test_english(segmenter, units):
    assert cut(segmenter, " ".join(units)) == units
    assert cut(segmenter, "\r\n".join(units)) == units
    assert cut(segmenter, units[0].replace(" ", "\n", 1) + "  " + "\n".join(units[1:])) == [units[0].replace(" ", "\n", 1), *units[1:]]


def test_without_capitals(segmenter):
    assert cut(segmenter, "dr. miboye met mrs. wemeso at 3 p.m. in the hall. nobody knew. the meeting ended at 2 p.m. my sister came.") == [
        "dr. miboye met mrs. wemeso at 3 p.m. in the hall.", "nobody knew.", "the meeting ended at 2 p.m.", "my sister came."
    ]


@pytest.mark.parametrize(
    ("units", "between"),
    [
        (["値段は77.1円でした！", "商人は「椅子を見ました！」と答えました。", "「この村には14人が住んでいます。」とYaneweさんが言いました。", "姉は見ました？！"], ""),
        (["孩子们说：“这个村子有37个人。”", "“我的姐姐买了！”老师说！", "《书》是老师写的。"], ""),
        (["«በቤት 41 ሰዎች ነበሩ!» ነጋዴው አለ።", "ዋጋው 4.7 ብር ነው።"], " "),
        (["من كان في الحقل؟", "«بلغ السعر 64.5 دينارا!» قال الفلاح."], " "),
        (["दाम 48.6 रुपये था।", "“घर पर 4 लोग थे!” वैद्य ने कहा।"], " "),
        (["มีคน 78 คนที่ตลาด", "ราคา 11.3 บาทแพงเกินไป", "หมอบอกว่าชอบงานใหม่"], " "),
        (["« Je voudrais voir une chaise ! » dit Zayiza.", "Où est-il ?", "Il part."], " "),
    ],
)
def test_other_scripts(segmenter, units, between):
    assert cut(segmenter, between.join(units), "(none)") == units


def test_number_after_a_period_is_a_scored_collocation(spark):
    """Of two types without other signs of an abbreviation: the one tied to numbers though they follow only half the time, and the one that numbers follow as they follow any type."""
    rows = ["we read the appendix. 4 in town. "] * 40 + ["we saw the appendix. The old farmer waited. "] * 40 + ["a child saw the river. 7 children sang. "] * 2 + ["we sat by the river. The old farmer waited. "] * 100
    docs = spark.createDataFrame([(" ".join(rows), "english", False)], "text string, lang string, code boolean")
    assert sentences.statistics(docs)["english"].numbered == {"appendix"}
    a, b, c, d = 40.0, 80.0, 42.0, 1000.0
    row = spark.createDataFrame([(a, b, c, d), (1.0, 80.0, 100.0, 1000.0), (0.0, 0.0, 5.0, 10.0)], "a double, b double, c double, d double")
    for r in row.select("*", sentences.likelihood(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect():
        assert r["x"] == pytest.approx(sentences._log_likelihood(r["a"], r["b"], r["c"], r["d"]))


def test_rare_abbreviation_in_a_large_corpus(spark):
    """Three occurrences count the same among four million tokens, where a share of the tokens asked for more."""
    text = "the old farmer walked home slowly today. " * 40_000
    docs = spark.createDataFrame([("The old farmer saw the qz. behind the river. " * 3 + "\n\n" + "The " + text, "english", False)] + [("The " + text, "english", False)] * 14, "text string, lang string, code boolean")
    assert "qz" in sentences.statistics(docs)["english"].abbreviations


def test_scores_as_expressions(spark):
    rows = [("dr", 40, 2, 500, 9000), ("p.m", 7, 0, 500, 9000), ("ɔd", 5, 1, 500, 9000), ("12", 9, 0, 500, 9000), ("home", 3, 90, 500, 9000)]
    df = spark.createDataFrame(rows, "word string, period long, plain long, periods long, total long")
    for r in df.select("*", sentences.score(*[F.col(c) for c in df.columns]).alias("x")).collect():
        assert r["x"] == pytest.approx(sentences.abbreviation_score(*r[:5]))


def test_language_wholly_without_capitals(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(" ".join(rng.choices(ENGLISH, k=12)).lower(), "english", False) for _ in range(150)], "text string, lang string, code boolean")
    learnt = sentences.Segmenter(sentences.statistics(docs))
    assert {"dr", "mrs", "fig"} <= set(learnt.languages["english"].abbreviations)
    assert cut(learnt, "nobody knew dr. miboye at home. mrs. wemeso sang.") == ["nobody knew dr. miboye at home.", "mrs. wemeso sang."]
    events, pairs = sentences.counted("Dr. Kofeka Met Mrs. Wemeso See Fig. 7 The End.", False)
    assert events["fig", "before_number"] == events["dr", "period"] == events["kofeka", "plain"] == events["end", "before_end"] == 1
    assert not pairs and not {"lower", "starts", "before_lower"} & {e for _, e in events}


def test_blocks(segmenter):
    text = "# Title\n\nThe kite (26)\n\nA child smiled. It was\nlate.\n \n- one item. Two\n- other item\n1) third\nThe end.\n```py\ndef f():\n\n    return 1.\n```\nNobody knew."
    assert cut(segmenter, text) == ["# Title", "The kite (26)", "A child smiled.", "It was\nlate.", "- one item. Two", "- other item", "1) third", "The end.", "```py", "def f():", "return 1.", "```", "Nobody knew."]
    assert cut(segmenter, "a = 1. b\n\n  c", code=True) == ["a = 1. b", "c"]
    assert segmenter.units(None) == segmenter.units("") == segmenter.units(" \n\t") == []


def test_words_of_any_length(segmenter):
    long = "x" * 3000
    assert segmenter._word_before(f"a {long}", 0, 3002) == long and segmenter._word_before("ab cd ", 0, 6) == "" and segmenter._word_before("ab", 1, 2) == "b"
    events, pairs = sentences.counted(f"the {long} fell. {long}. Then it rose.", False)
    assert events[long, "plain"] == events[long, "period"] == pairs[long, "then"] == 1


def test_segmented_table(spark):
    docs = corpus(spark).limit(20).union(spark.createDataFrame([(1000, None, None, None), (1001, "  ", "x", ""), (1002, "A. " * 20_000, None, "s"), (1003, "x\ny", "python", "code_python")], "doc_id long, text string, lang string, source string"))
    rows = sentences.segmented(docs.withColumn("code", F.lit("clash")))
    assert [f.dataType.typeName() for f in rows.schema] == ["long", "long", "long"]
    found = {(r["doc_id"], r["start_char"], r["end_char"]) for r in rows.collect()}
    assert (1003, 0, 1) in found and (1003, 2, 3) in found and not {1000, 1001} & {i for i, _, _ in found}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[i][a:b] == texts[i][a:b].strip() != "" for i, a, b in found)
    assert sentences.segmented(docs.limit(0)).count() == 0


# ---- languages

WORDS = {
    "english": "the old farmer wants a new book at home and nobody knows where my sister went today".split(),
    "french": "le vieux fermier voudrait un nouveau livre à la maison et personne ne sait où est ma sœur".split(),
    "twi": "ɔhene no kɔ fie na ɔbaa no pɛ sɛ ɔhunu nhoma foforɔ wɔ sukuu mu nnɛ".split(),
}


def sentence(rng, lang):
    return " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 12))).capitalize() + rng.choice(".!?")


def language_rows(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        value = " ".join(sentence(rng, lang) for _ in range(rng.randint(1, 3)))
        truth = {lang}
        label = {"english": "EN ", "french": "Français", "twi": "tw"}[lang]
        if i % 10 == 0:
            other = rng.choice([x for x in WORDS if x != lang])
            value += rng.choice([" ", " / ", ": "]) + sentence(rng, other)
            truth.add(other)
        elif i % 10 == 1:
            label = rng.choice([None, "", "?", "other"])
        elif i % 10 == 2:
            label = "english" if lang != "english" else "twi"
        rows.append((i, value, None, label, truth, lang if i % 10 > 2 else None))
    return rows


def test_language_cases(spark):
    rows = language_rows(random.Random(9), 900)
    data = [(i, a, q, label) for i, a, q, label, _, _ in rows]
    data += [(data[0]), (5000, "12 + 3", "!?", "twi"), (5001, None, "", None), (5002, "ɔhene no kɔ fie (Internet) `x = 1`\n```py\nthe old farmer wants\n```", None, "twi"), (5003, "the old farmer " * 5000, None, "en")]
    df = spark.createDataFrame(data, "row_id long, answer string, question string, lang string").withColumn("id", F.lit(0)).withColumn("text", F.lit("clash"))
    aliases = spark.createDataFrame([("en", "english"), ("english", "english"), ("français", "french"), ("tw", "twi"), ("twi", "twi")], "alias string, lang string")
    found = language_id.identified(df, "row_id", ["answer", "question"], "lang", aliases)
    got = {(r["id"], r["field_name"], r["lang"]) for r in language_id.cases(found).collect()}
    want = {(i, "answer", lang) for i, _, _, _, truth, right in rows for lang in truth if right is None}
    assert len(got & want) / len(got) > 0.97 and len(got & want) / len(want) > 0.97
    assert not {x for x in got if x[0] >= 5000}
    assert all(0 <= r["start_char"] < r["end_char"] and 0 < r["confidence"] <= 1 for r in found.limit(50).collect())
    assert language_id.identified(df.limit(0), "row_id", ["answer"], "lang", aliases).count() == 0


def test_network_is_stored_and_scores_alike_in_any_batch(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(sentence(rng, lang), lang) for lang in WORDS for _ in range(60)]
    network = language_id.trained([t for t, _ in texts], [x for _, x in texts])
    again = language_id.ByteConvolution.from_bytes(network.to_bytes())
    rows = [w for t, _ in texts for w in language_id.windows(t)]
    x = language_id.matrix(rows)
    want = network.log_probabilities(x)
    assert again.languages == network.languages and np.array_equal(again.log_probabilities(x), want)
    assert np.allclose(np.concatenate([network.log_probabilities(x[i : i + 1]) for i in range(40)]), want[:40], atol=1e-4)
    for total, parts in language_id.judged(network, [texts[0][0], "12 + 3", texts[-1][0] + " " + texts[0][0]]):
        assert all(p.sum() == pytest.approx(1) and 0 <= k < len(WORDS) for _, _, k, p in parts)
    assert language_id.judged(network, ["!?"])[0][1] == []
    made = language_id.fitted(spark, ["a b"], ["x"])
    monkeypatch.setattr(language_id, "trained", None)  # the second time nothing is trained
    assert np.array_equal(language_id.fitted(spark, ["a b"], ["x"]).weights["out"], made.weights["out"])


# ---- source files


def code(rng, n=8):
    names = lambda: "".join(rng.choices("abcdefgh", k=6))
    return "\n\n".join(f"def {names()}({names()}, limit={rng.randint(1, 99)}):\n    {names()} = {names()}({names()})\n    return {names()}[:limit] + {rng.randint(1, 99)}" for _ in range(n)) + "\n"


def test_kinds():
    rng = random.Random(1)
    kinds = lambda t: source_files.profile(t)[:3]
    hand = code(rng)
    none = (False, False, False)
    assert kinds(hand) == none and kinds(None) == none and kinds("") == none and kinds("x") == none
    assert kinds("# Code generated by mytool v1. DO NOT EDIT.\n" + hand)[0] and kinds(hand + "\n# @generated by mytool\n")[0]
    assert kinds(("// Autogenerated from a.schema, do not modify by hand\n" + hand).replace("\n", "\\n"))[0]
    assert not kinds('def header(f):\n    f.write("Code generated by mytool. DO NOT EDIT.")\n' + hand)[0]
    assert not kinds(hand + "# ids are generated by the server, see the store module\n" + hand)[0]
    assert not kinds("# Copyright the authors. Use is free under the Open Terms.\n" + hand)[0]
    assert kinds("".join(f"  getField{i}() {{\n    return this.row[{i}];\n  }}\n\n" for i in range(40)))[0]
    assert not kinds("w = [\n" + "".join(f"  [{i}, {i * 7}],\n" for i in range(9)) + "]\n" + hand * 2)[0]
    small = ";".join(f"{a}={b}({c},{rng.randint(1, 9)})" for a, b, c in (rng.choices("abcdefgh", k=3) for _ in range(120)))
    assert kinds(small) == (False, True, False)
    assert kinds("module.exports = [" + ",".join(f'{{"id": {i}, "name": "x{i}"}}' for i in range(60)) + "]")[2]
    assert kinds('BLOB = "' + "kJ8sd0" * 300 + '"')[2] and kinds('CSV = """id,a\n' + "".join(f"{i},word{i}\n" for i in range(99)) + '"""')[2]
    assert kinds('FIXTURE = "' + "kJ8sd0" * 40 + '"\n' + hand * 3) == none


def test_copies_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = [code(rng, 20) for _ in range(12)]
    rows, k = [], 0
    for b in base:
        lines = b.split("\n")
        for edits in (0, 0, 1, 3, 12, 30):
            own = list(lines)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"    q{rng.randint(0, 10**6)} = {rng.randint(0, 99)}"
            text = "\n".join(own)
            rows.append((k, rng.choice(["r1", "r2", "r3", None]), rng.choice(["", "# licence 1.2\n", "\n\n"]) + text.replace("    ", rng.choice(["    ", "\t"]))))
            k += 1
    rows += [(k, "r1", "x = 1\n"), (k + 1, "r2", "x = 1\n"), (k + 2, "r1", None), (k + 3, "r2", ""), rows[0]]
    rows += [(1000 + i, f"h{i % 40}", "# note\n" * (i % 3) + base[0]) for i in range(60)]
    shingles = {i: set(source_files.file_shingles(t)) if source_files.profile(t)[4] is not None else set() for i, _, t in rows}
    repos = {i: r for i, r, _ in rows}

    def alike(a, b):
        return shingles[a] and shingles[b] and repos[a] and repos[b] and repos[a] != repos[b] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])

    want = {a for a in shingles if any(a != b and alike(a, b) for b in shingles)}
    df = spark.createDataFrame(rows, "file_id long, repo string, content string").withColumn("id", F.lit("clash"))
    for share, block in ((1e-3, source_files.BLOCK_FORMS), (2.0, 2)):  # hot groups by broadcast and whole buckets, and neither
        monkeypatch.setattr(source_files, "HOT_SHARE", share)
        monkeypatch.setattr(source_files, "BLOCK_FORMS", block)
        got = source_files.classified(df, "file_id", "content", "repo")
        assert {r["id"] for r in got.where("vendored").collect()} == want
        assert got.count() == len(shingles)
    assert source_files.classified(df.limit(0), "file_id", "content", "repo").count() == 0


def test_families_of_masked_statements():
    families = lambda t: source_files.masked_families(source_files.masked_statements(t, source_files.tokens(t)))
    assert families("") == families("x = 1\n" * 7) == 0.0 and families("x = 1\n" * 8) == 1.0
    assert families("".join(f"field_{i}: Optional[int] = {i}\n" for i in range(9)) + code(random.Random(2), 1)) > 0.5
    # Nearly equal statements share a band and pass the comparison of their shingles, others don't.
    long = "return x + {} * y - z / w % v & u | t ^ s < r > q and p or not n is m in k if j else i"
    mixed = "".join(long.format(i) + (" for h\n" if i % 2 else "\n") for i in range(8))
    assert families(mixed) == 1.0
    assert families("".join(f"{'(' * i}x + {i}{')' * i}\n" for i in range(1, 12))) < 0.5


def test_near_forms_meet_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 4)
    rows = []
    for form in range(40):
        sketch = base.copy() if form % 2 else rng.integers(-(1 << 62), 1 << 62, 4)
        sketch[form % 4] ^= form
        rows += [(bucket, 40, form, form % 5, form % 3 != 0, *map(int, sketch)) for bucket in (1, 2)]
    members = spark.createDataFrame(rows, "bucket long, n long, form long, where long, open boolean, s0 long, s1 long, s2 long, s3 long")
    near = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a[5:], b[5:])) <= 51
    own = [r for r in rows if r[0] == 1]
    want = {(a[2], b[2]) for a in own if a[4] for b in own if a[2] != b[2] and (a[3] != b[3] or a[3] == 0) and near(a, b)}
    assert want
    for block in (4096, 7):
        monkeypatch.setattr(source_files, "BLOCK_FORMS", block)
        assert {(r["form"], r["other"]) for r in source_files.near_in_buckets(members).collect()} == want
    assert source_files.near_in_buckets(members.limit(0)).count() == 0
