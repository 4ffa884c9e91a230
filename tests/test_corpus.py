"""Sources, sinks, preparation, retrieval, model files, curriculum, streaming."""

import os
import json

import pytest
from pyspark.sql import functions as F

from textloom import session
from textloom.operators import ngrams, prepare, retrieval
from textloom.plans import curriculum, service
from textloom.sources import binary, corpus, model
from textloom.streaming import counts as streaming


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.txt": "one\n  two \n\nthree\r\n", "b.MD": "x y", "c.bin": "no", ".hidden/d.txt": "no", "node_modules/e.js": "no", "sub/f.py": "print(1)\n",
        "sub/deep/g.rs": "fn main() {}", "big.txt": "z" * 1_000_001, "p/package-lock.json": "{}", "p/dist/h.ts": "no", "p/i.ts": "let x;", "p/j.json": "[" + "1," * 6000 + "1]",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "bad.txt").write_bytes(b"ok line\n\xff\xfe broken\nvalid \xef\xbf\xbd mark\n")
    return tmp_path


def test_scans(spark, folder):
    root = str(folder)
    assert sorted(r["path"] for r in corpus.text_files(spark, root).collect()) == sorted(
        ["a.txt", "b.MD", "sub/f.py", "sub/deep/g.rs", "big.txt", "bad.txt", "p/package-lock.json", "p/dist/h.ts", "p/i.ts", "p/j.json"]
    )
    got = corpus.lines(spark, root)
    assert [r["line"] for r in got.where("path = 'a.txt'").collect()] == ["one", "two", "three"]
    assert [r["line"] for r in got.where("path = 'bad.txt'").collect()] == ["ok line", "valid \ufffd mark"]
    assert {r["path"] for r in corpus.plain_text_files(spark, root).collect()} == {"a.txt", "big.txt", "bad.txt"}
    whole = {r["path"] for r in corpus.whole_files(spark, root).collect()}
    assert "a.txt" in whole and "big.txt" not in whole and "bad.txt" not in whole
    assert {r["path"] for r in corpus.project_files(spark, root).collect()} == {"sub/f.py", "sub/deep/g.rs", "p/i.ts"}
    (folder / "odd [1]{x}*.txt").write_text("brackets")
    assert [r["line"] for r in corpus.lines(spark, root).where("path LIKE 'odd%'").collect()] == ["brackets"]
    empty = folder / "node_modules"
    assert corpus.lines(spark, str(empty), endings=("md",)).count() == corpus.project_files(spark, str(folder / ".hidden")).count() == 0
    code = spark.createDataFrame([(2, "python", "b"), (1, "python", "a"), (3, "rust", "ɔ"), (4, None, "x"), (5, "rust", None)], "id int, language string, content string")
    written = corpus.write_numbered(code, "language", "content", ["id"], {"python": ".py", "rust": ".rs"}, str(folder / "numbered"))
    assert {(r["language"], r["file_name"], r["bytes"]) for r in written.collect()} == {("python", "000000.py", 1), ("python", "000001.py", 1), ("rust", "000000.rs", 2)}
    assert (folder / "numbered/python/000001.py").read_text() == "b" and (folder / "numbered/rust/000000.rs").read_text() == "ɔ" and len(list((folder / "numbered/python").iterdir())) == 2
    out = str(folder / "out")
    corpus.write_lines(spark.createDataFrame([("a\nb",), ("c",)], "l string").coalesce(1), "l", out)
    assert corpus.manifest(spark, out).agg(F.sum("lines")).first()[0] == 2


def test_wiki(spark, tmp_path):
    import bz2

    page = "<mediawiki>" + "".join(f"<page><title>T{i}</title><revision><text>{t}</text></revision></page>" for i, t in enumerate(["'''Bold''' [[a|link]] {{x}}", "#REDIRECT [[y]]"])) + "</mediawiki>"
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(page.encode()))
    rows = corpus.wiki_articles(spark, str(tmp_path / "dump.xml.bz2"))
    assert rows.count() == 2
    clean = {r["title"]: r["a"] for r in rows.select("title", prepare.markup_stripped(F.col("text")).alias("a")).collect()}
    assert clean["T0"].split() == ["Bold", "link"]


def test_preparation_edges(spark):
    rows = spark.createDataFrame([(1, "ghana_qa", "a ", "b"), (2, "ghana_qa", "a", None), (3, "other", "x", "y"), (1, "ghana_qa", "a ", "b")], "row_id long, dataset string, answer string, question string")
    for c in ("sentence", "twi", "text", "output", "instruction", "copies"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    texts = prepare.dataset_texts(rows, "row_id", "dataset")
    found = {r["value"]: (r["row_id"], r["copies"]) for r in prepare.exact_dedup(texts, "dataset", value="value", order=["row_id", "k"]).collect()}
    assert found == {"a": (1, 3), "b": (1, 2)}
    assert prepare.exact_dedup(texts.limit(0), "dataset", value="value", order=["row_id", "k"]).count() == 0
    assert prepare.text_column(rows) == "text" and prepare.text_column(rows.select("row_id", "dataset")) == "dataset"
    chat = spark.createDataFrame([(1, [("a long one", None), (None, "content here"), ("abc", "x")])], "id int, c array<struct<value:string,content:string>>")
    assert [r["text"] for r in prepare.flatten_conversations(chat, "id", "c").orderBy("pos").collect()] == ["a long one", "content here"]
    nulls = spark.createDataFrame([(1, None, "long enough")], "id int, a string, b string")
    assert prepare.unpivot_text(nulls, "id", ["a", "b"], 3, literal_null=True).count() == 2
    code = spark.createDataFrame([("Python", "x = 1\\n" * 20), ("python", "# DO NOT EDIT\n" + "y = 2\n" * 20), ("python", "a\n" * 30 + "b" * 10), (None, "z\n" * 60), ("rust", None)], "language string, content string")
    assert sorted(r["n_lines"] for r in prepare.code_filtered(code, "language", "content").collect()) == [21, 31]
    docs = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(300))), (2, ""), (3, None), (4, "one")], "doc int, text string")
    tail = {r["doc"]: r["n_lines"] for r in prepare.tail_lines(docs, "doc", "text").collect()}
    assert tail == {1: 15, 4: 1}
    assert prepare.without_tail(docs, "doc", "text").where("doc = 1").first()["text"].endswith("line 284")


def test_retrieval(spark):
    docs = [("1", "def add(a, b): return a + b"), ("2", "fn main() { println!(\"fibonacci\"); }"), ("3", "class Foo: pass"), ("4", None)]
    store = spark.createDataFrame(docs, "id string, content string")
    asked = spark.createDataFrame([(1, "fibonacci"), (2, "main  println"), (3, "nothing such"), (4, "  "), (5, None)], "q int, t string")
    top = {(r["q"], r["rank"]): (r["id"], r["score"]) for r in retrieval.search(store, asked, "q", "t", "id", "content", 2).collect()}
    assert top == {(1, 1): ("2", 1.0), (2, 1): ("2", 1.0)}
    assert retrieval.bm25(store, asked, "q", "t", "id", "content", 1).where("q = 1").first()["id"] == "2"
    versions = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", None, "only"), ("a", 2, "new")], "id string, at int, content string")
    kept = retrieval.latest(versions, "id", F.col("at").isNotNull(), F.col("at"))
    assert {(r["id"], r["content"]) for r in kept.collect()} == {("a", "new"), ("b", "only")}
    gone = retrieval.removed(store, store.where("id = '2'"), "id")
    assert retrieval.search(gone, asked, "q", "t", "id", "content", 2).count() == 0
    assert retrieval.get_many(store, spark.createDataFrame([("1",), ("9",)], "id string"), "id").count() == 1


def test_binary_round_trip(spark, tmp_path):
    m = binary.Model("test-modèl", ["<PAD>", "a", "é"], [("a", "é", "aé")], tables={2: {(1,): {2: 3, 1: 1}}, 3: {(1, 2): {1: 2}}}, tokens_trained=10, created_at=5)
    data = binary.encode(m)
    assert binary.decode(data) == m
    assert binary.header(data)["header_size"] == 67 + len("test-modèl".encode())
    with pytest.raises(binary.FormatError):
        binary.decode(b"NOPE" + data[4:])
    with pytest.raises(binary.FormatError):
        binary.decode(data[:4] + b"\x09\x00" + data[6:])
    for cut in (3, 20, len(data) - 1):
        with pytest.raises(binary.FormatError):
            binary.decode(data[:cut])
    assert not binary.decode(data[:-1] + bytes([data[-1] ^ 1])).checksum_holds
    path = tmp_path / "m.bin"
    path.write_bytes(data)
    spark.dataSource.register(binary.BinaryModelSource)
    rows = spark.read.format("binary_model").load(str(path)).collect()
    assert {(r["ord"], tuple(r["ctx"]), r["next"], r["cnt"]) for r in rows} == {(2, (1,), 2, 3), (2, (1,), 1, 1), (3, (1, 2), 1, 2)}
    assert spark.read.format("binary_model").option("part", "vocab").load(str(path)).count() == 3
    assert [tuple(r) for r in spark.read.format("binary_model").option("part", "merges").load(str(path)).collect()] == [(1, "a", "é", "aé")]
    with open(path, "rb") as f:
        assert [(o, tuple(c), n, k) for at, _ in binary.sections(f) for o, c, n, k in binary.entries(f, at)] == [(2, (1,), 2, 3), (2, (1,), 1, 1), (3, (1, 2), 1, 2)]
    table = spark.createDataFrame([(2, [1], 2, 3), (2, [1], 1, 1), (3, [1, 2], 1, 2), (2, [70], 5, 1 << 40)], "ord int, ctx array<int>, next int, cnt long").repartition(3)
    made = str(tmp_path / "made.bin")
    for _ in range(2):  # a file that is there is replaced
        binary.write_binary(table, made, m.vocab, m.merges, m.name, 10, 5)
    back = binary.decode((tmp_path / "made.bin").read_bytes())
    assert back.checksum_holds and back.tables == {2: {(1,): {2: 3, 1: 1}, (70,): {5: 0xFFFFFFFF}}, 3: {(1, 2): {1: 2}}} and (back.vocab, back.merges, back.name, back.associations) == (m.vocab, m.merges, m.name, 4)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.bin", "made.bin"]
    binary.write_binary(table.limit(0), made, m.vocab, m.merges)
    assert binary.decode((tmp_path / "made.bin").read_bytes()).tables == {} and spark.read.format("binary_model").load(made).count() == 0


def test_model_folder_merge_and_service(spark, tmp_path):
    seq = lambda s: ngrams.counts(spark.createDataFrame([(list(s),)], "tokens array<string>"))
    a, b, c = (str(tmp_path / x) for x in "abc")
    model.write(a, seq("hello hello"), name="first")
    model.write(a, seq("hello hello "), name="again")
    model.write(b, seq("yellow"), name="second")
    service.merge(spark, [a, b], c)
    assert model.meta(spark, a)["name"] == "again"
    assert {r["name"] for r in model.models(spark, str(tmp_path)).collect()} == {"again", "second", "merged"}
    assert {r["ord"]: r["observations"] for r in service.info(spark, c).collect()}[2] == 11 + 5
    assert model.counts(spark, a, 3).select("ord").distinct().count() == 1
    asked = spark.createDataFrame([("1", "hel"), ("2", None)], "id string, prompt string")
    from textloom.operators.predict import Sampler

    made = {r["id"]: r["text"] for r in service.generate_batch(asked, model.counts(spark, a), 3, Sampler(temperature=0)).collect()}
    assert made["2"] == ""


def test_phases_and_prompts():
    assert [p.name for p in curriculum.phases({"twi", "english"})][0].startswith("Ashanti Twi") and len(curriculum.phases({"twi", "english"})) == 3
    assert curriculum.prompts_of("Ashanti Twi 🇬🇭") == curriculum.PROMPTS["twi"] and curriculum.prompts_of("Personal Code") == curriculum.PROMPTS["code"]
    assert curriculum.prompts_of("Refinement (all data)") == curriculum.PROMPTS["english"]
    assert curriculum.converged(100.0, 99.5, True) and not curriculum.converged(100.0, 99.5, False) and not curriculum.converged(None, 9.0, True) and not curriculum.converged(100.0, 90.0, True)


def training_docs(spark):
    lines = "Once upon a time the cat sat on the mat and the dog ran home\nThe quick brown fox saw the cat sit on the mat in the house\nIn the beginning the dog sat on the log\n"
    rows = [(1, "twi", "Me din de Kofi na me wo Ghana\nƐnnɛ yɛ da pa na me ho yɛ\n" * 4), (2, "english", lines * 3), (3, "english", lines * 2), (4, "other", "unlisted part\n"), (5, None, None), (6, "english", "")]
    return spark.createDataFrame(rows, "doc int, part string, text string")


def test_curriculum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(curriculum, "JUDGED_TOKENS", 4)
    docs, out, path = training_docs(spark), str(tmp_path / "m"), str(tmp_path / "progress.json")
    state = curriculum.train(docs, "doc", "text", "part", out, path, vocabulary=120)
    assert [p.name for p in state.phases] == ["Ashanti Twi 🇬🇭", "English", "Refinement (all data)"]
    assert state.status == "converged" and curriculum.read_progress(path) == state and json.loads((tmp_path / "progress.json").read_text())["updated_at"]
    english = state.phases[1]
    assert english.total_files == english.files_processed == 3 and english.lines_processed == 15 and len(english.perplexity_history) == english.epoch and english.status in ("converged", "completed")
    assert english.coverage_history[0] > 0.9 and any(p.sample_generation and p.sample_generation.startswith(curriculum.prompts_of(p.name)) for p in state.phases)
    assert state.rate(0.0) == (0.0, 0.0)
    # The counts: every phase's own, times its epochs, and all of them in the last phase, pruned.
    tokenizer = curriculum.Tokenizer.read(spark, out)
    assert tokenizer.vocab.count() == state.vocabulary <= 120
    one = lambda own: ngrams.id_counts(ngrams.chunked(tokenizer.lines(own, "doc", text="text"), "doc", "lines"), "tokens")
    parts = [(docs.where("part = 'twi'"), state.phases[0].epoch), (docs.where("part = 'english'"), english.epoch), (docs.where("text IS NOT NULL"), state.phases[2].epoch)]
    want = ngrams.prune(ngrams.merged(*[ngrams.scaled(one(own), epochs) for own, epochs in parts]), 2)
    assert ngrams.difference(want, model.counts(spark, out)).count() == 0 and want.count() == state.associations
    assert model.meta(spark, out)["tokens_trained"] == sum(p.tokens_trained for p in state.phases)

    loaded = service.load(spark, out)
    asked = spark.createDataFrame([("a", "the cat "), ("b", None), ("c", "the cat ")], "id string, prompt string")
    ids = loaded.tokenize(asked, "id", text="prompt")
    assert {r["id"]: r["text"] for r in loaded.detokenize(ids, "id").collect()} == {"a": "the cat ", "b": "", "c": "the cat "}
    from textloom.operators.predict import Sampler

    made = {r["id"]: r for r in loaded.generate(asked, 6, Sampler(temperature=0)).collect()}
    assert made["a"]["text"] == made["c"]["text"] != "" and made["b"]["text"] == "" and made["b"]["finish"] == "stop"
    first = made["a"]["text"][1:3]
    cut = {r["id"]: r for r in loaded.generate(asked, 6, Sampler(temperature=0), stop=["~~", first]).collect()}
    assert first not in cut["a"]["text"] and made["a"]["text"].startswith(cut["a"]["text"]) and cut["a"]["finish"] == "stop"
    talk = service.Chat(loaded, 3, Sampler(temperature=0))
    assert talk.say("  ") == "" and talk.say("the cat") == talk.turns[0][1] and talk.said.startswith("the cat\n") and service.health(loaded)["model"] == "model"


def test_training_stops_and_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(curriculum, "JUDGED_TOKENS", 1)
    docs, path = training_docs(spark), str(tmp_path / "progress.json")
    out = str(tmp_path / "m")
    for calls in (2, 1):  # stopped within the second phase, and before its next part
        asked = iter(range(100))
        state = curriculum.train(docs, "doc", "text", "part", out, path, resume=calls < 2, vocabulary=60, files_a_part=1, stop=lambda asked=asked, calls=calls: next(asked) >= calls + 3)
        assert state.status == "stopped"
    state = curriculum.train(docs, "doc", "text", "part", out, path, resume=True, files_a_part=1)
    assert state.status == "converged" and state.phases[1].files_processed == 3 and curriculum.read_progress(path) == state
    tokenizer = curriculum.Tokenizer.read(spark, out)
    one = lambda own: ngrams.id_counts(ngrams.chunked(tokenizer.lines(own, "doc", text="text"), "doc", "lines"), "tokens")
    parts = [docs.where("part = 'twi'"), docs.where("part = 'english'"), docs.where("text IS NOT NULL")]
    want = ngrams.prune(ngrams.merged(*[ngrams.scaled(one(own), p.epoch) for own, p in zip(parts, state.phases)]), 2)
    assert ngrams.difference(want, model.counts(spark, out)).count() == 0
    assert model.meta(spark, out)["tokens_trained"] == sum(p.tokens_trained for p in state.phases)


def test_small_helpers(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a", "b", 1 << 40), (2, "a", "c", 3)], "ord int, ctx string, next string, cnt long")
    assert ngrams.clamped(rows).agg(F.max("cnt")).first()[0] == ngrams.MOST_COUNT
    assert [r["next"] for r in curriculum.split_by(rows, spark.createDataFrame([("c",), ("c",)], "next string")).collect()] == ["c"]
    model.write(str(tmp_path / "m"), rows)
    service.export_json(spark, str(tmp_path / "m"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    rows.withColumn("batch", F.lit(0)).write.partitionBy("batch").parquet(str(tmp_path / "counts"))
    streaming.compact(spark, str(tmp_path / "counts"), str(tmp_path / "base"))
    assert spark.read.parquet(str(tmp_path / "base")).count() == 2
    ids = spark.createDataFrame([([1, 65535, 3, 40000],), ([7],)], "ids array<int>")
    packed = ids.select("ids", ngrams.packed_array(F.col("ids")).alias("ctx"), (F.size("ids") + 1).alias("ord"))
    assert packed.where(ngrams.unpacked(F.col("ctx"), F.col("ord")) != F.col("ids")).count() == 0 and packed.select("ctx").distinct().count() == 2
    tables = session.written(rows, "ord")
    assert tables.where("ord = 2").count() == 2 and session.stored_bytes(spark, session.shared_path(spark, "none")) is None
    path = session.shared_path(spark, "some-bytes")
    session.store_bytes(spark, path, b"abcde" * 3, part=4)
    session.store_bytes(spark, path, b"later")
    assert session.stored_bytes(spark, path) == b"abcde" * 3
    session.remove_written(spark)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"doc number {i % 3} and more") for i in range(20)], "doc int, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for _ in range(2):  # the second run finds nothing new
        stream = streaming.stream_files(spark, str(tmp_path / "in"), "doc int, text string", 2)
        streaming.count_stream(stream, out, log).start().awaitTermination()
    batch = ngrams.counts(ngrams.sequences_of(docs))
    assert ngrams.difference(batch, streaming.counted(spark, out)).count() == 0
    docs.write.mode("append").parquet(str(tmp_path / "in"))
    streaming.count_stream(streaming.stream_files(spark, str(tmp_path / "in"), "doc int, text string"), out, log).start().awaitTermination()
    assert ngrams.difference(ngrams.scaled(batch, 2), streaming.counted(spark, out)).count() == 0


def test_mounted_folders_are_read_by_the_tasks(spark, folder, monkeypatch):
    """The same files and texts as by Spark's source, without a list of files on the driver; what is left out isn't opened."""
    root = str(folder)
    for name in ("odd [1]{x}.py", "a b+c.py", "_left/out.py", "_out.py", "k=v/in.py", "sub/ü.py"):
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(name)
    os.symlink(folder / "missing", folder / "node_modules/gone.py")
    rows = lambda: [sorted(tuple(r) for r in f(spark, root).collect()) for f in (corpus.whole_files, corpus.project_files)]
    with monkeypatch.context() as m:
        m.setattr(corpus, "_read", lambda *a, **k: pytest.fail("the files are listed on the driver"))
        m.setattr(corpus, "READ_BYTES", 10)
        got = rows()
    os.remove(folder / "node_modules/gone.py")
    monkeypatch.setattr(corpus, "_mounted", lambda *a: False)
    assert got == rows() and len(got[1]) == 7
