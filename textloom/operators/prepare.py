"""Corpus preparation: flattening, cleaning, filters, deduplication, limits, hold-outs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kept_lines, text_lines, trimmed

#: The columns that may hold a row's text, in order of preference.
TEXT_COLUMNS = ("text", "sentence", "twi", "Twi", "content", "output", "answer")
#: The main and further text columns of each data set of the Twi corpus.
DATASET_COLUMNS = {
    "sentences_320k": ("sentence",),
    "parallel_4m": ("twi",),
    "sentiments_400k": ("text",),
    "emotions_400k": ("text",),
    "bible_asante": ("text",),
    "gooaq_twi_2m": ("answer", "question"),
    "code_170k_twi": ("answer", "question"),
    "reasoning_1k": ("output", "instruction"),
    "ghana_qa": ("answer", "question"),
}
#: What says in the first five lines of a file that it was generated.
GENERATED_MARKERS = ("auto-generated", "do not edit", "generated by", "automatically generated", "machine generated")
#: Endings of the files of each programming language.
ENDINGS = {"python": ".py", "typescript": ".ts", "javascript": ".js", "rust": ".rs"}
#: Steps that strip wiki markup, in order.
MARKUP_STEPS = (
    (r"\{\{[^}]*\}\}", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"'''?", ""),
    (r"&amp;", "&"),
    (r"&lt;[^&]*&gt;", ""),
    (r"&[a-z]+;", ""),
    (r"<[^>]+>", ""),
    (r"==+\s*[^=]+\s*==+", "\n"),
    (r"\n\s*\n+", "\n"),
)


def text_column(df: DataFrame, preferred: str | None = None) -> str:
    """The preferred column, or else the first of TEXT_COLUMNS, or else the first string column."""
    if preferred in df.columns:
        return preferred
    for name in TEXT_COLUMNS:
        if name in df.columns:
            return name
    for name, kind in df.dtypes:
        if kind == "string":
            return name
    raise ValueError("no column holds text")


def dataset_texts(rows: DataFrame, row_id: str, dataset: str) -> DataFrame:
    """dataset, row_id, k, value: the texts of each row in the columns that its data set fills, main one first."""
    names = sorted({c for cs in DATASET_COLUMNS.values() for c in cs})
    fits = [
        F.when(F.col(dataset) == d, F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("value")) for i, c in enumerate(columns)]))
        for d, columns in DATASET_COLUMNS.items()
    ]
    return rows.select(dataset, row_id, *names).select(dataset, row_id, F.explode(F.coalesce(*fits)).alias("x")).select(dataset, row_id, "x.k", "x.value")


def exact_dedup(texts: DataFrame, *group: str, value: str, order: list[str]) -> DataFrame:
    """group, value and the ORDER columns of its first occurrence, for each different trimmed value that isn't empty: a partial aggregate, so a value of a third of all rows is one row a task."""
    clean = texts.withColumn(value, trimmed(F.col(value))).where((F.col(value).isNotNull()) & (F.col(value) != ""))
    return clean.groupBy(*group, value).agg(F.min(F.struct(*order)).alias("o"), F.count(F.lit(1)).alias("copies")).select(*group, value, "o.*", "copies")


def clean_lines(texts: DataFrame, *keep: str, value: str, longer_than: int = 2) -> DataFrame:
    """keep, pos, line: the trimmed lines of more than so many characters."""
    return texts.select(*keep, F.posexplode(kept_lines(F.col(value), longer_than)).alias("pos", "line"))


def flatten_conversations(rows: DataFrame, conv_id: str, messages: str, longer_than: int = 5) -> DataFrame:
    """conv_id, pos, text of an array of messages: the value, or the content where a message has no value, of more than so many characters."""
    kinds = dict(rows.dtypes)[messages]
    names = [n for n in ("value", "content") if f"{n}:" in kinds]
    one = rows.select(conv_id, F.posexplode(messages).alias("pos", "m"))
    text = F.col("m") if not names else F.coalesce(*[F.col(f"m.{n}") for n in names])
    return one.select(conv_id, "pos", trimmed(text).alias("text")).where(F.char_length("text") > longer_than)


def unpivot_text(rows: DataFrame, row_id: str, columns: list[str], longer_than: int = 5, literal_null: bool = False) -> DataFrame:
    """row_id, field, text of several columns. With LITERAL_NULL a null counts as the four letters it is written with, as some sources have it."""
    long = rows.unpivot([row_id], columns, "field", "text")
    text = F.coalesce(trimmed(F.col("text")), F.lit("None")) if literal_null else trimmed(F.col("text"))
    return long.select(row_id, "field", text.alias("text")).where(F.char_length("text") > longer_than)


def stories(rows: DataFrame, text: str, longer_than: int = 10) -> DataFrame:
    return rows.withColumn(text, trimmed(F.col(text))).where(F.char_length(text) > longer_than)


def markup_stripped(article: Column) -> Column:
    """An article without wiki markup."""
    for pattern, by in MARKUP_STEPS:
        article = F.regexp_replace(article, pattern, by)
    return article


def article_lines(rows: DataFrame, article_id: str, text: str) -> DataFrame:
    """article_id, pos, line: no redirects or articles under 100 characters; lines over 20 characters that don't begin with a list, table or template mark."""
    clean = rows.select(article_id, markup_stripped(F.col(text)).alias("a")).where(~F.col("a").startswith("#REDIRECT") & (F.char_length("a") >= 100))
    lines = clean.select(article_id, F.posexplode(F.split("a", "\n")).alias("pos", "line")).withColumn("line", trimmed(F.col("line")))
    return lines.where((F.char_length("line") > 20) & ~F.substring("line", 1, 1).isin("*", "|", "!", "{"))


def code_filtered(rows: DataFrame, language: str, content: str, languages: tuple[str, ...] = tuple(ENDINGS)) -> DataFrame:
    """Files of the languages with 50 trimmed characters, 3 to 5000 lines and no marker in the first five; line ends and tabs stored as two characters are made real."""
    out = rows.withColumn(language, F.lower(language)).where(F.col(language).isin(*languages) & (F.char_length(trimmed(F.col(content))) >= 50))
    out = out.withColumn(content, F.replace(F.replace(F.col(content), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))).withColumn("n_lines", F.size(F.split(content, "\n")))
    head = F.lower(F.array_join(F.slice(F.split(content, "\n"), 1, 5), "\n"))
    marked = F.lit(False)
    for m in GENERATED_MARKERS:
        marked = marked | F.contains(head, F.lit(m))
    return out.where(F.col("n_lines").between(3, 5000) & ~marked)


def top_n(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The first N rows of each key in ORDER; Spark cuts each task to N a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def ending_counts(paths: Column, rows: DataFrame) -> DataFrame:
    """ext, files by file ending."""
    return rows.select(F.lower(F.regexp_extract(paths, r"\.([A-Za-z0-9]+)$", 1)).alias("ext")).where("ext <> ''").groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


def corpus_status(docs: DataFrame, phase: str, doc_id: str, text: str, most: int = 3) -> DataFrame:
    """phase, files, lines, bytes, largest: of each phase the sums, and its files with most lines."""
    n_lines = F.when(F.col(text) == "", 0).otherwise(F.size(F.split(F.col(text), "\n")))
    sized = docs.where(F.col(text).isNotNull()).select(phase, doc_id, n_lines.cast("long").alias("lines"), F.octet_length(text).cast("long").alias("bytes"))
    sums = sized.groupBy(phase).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    first = sized.withColumn("rn", F.row_number().over(Window.partitionBy(phase).orderBy(F.desc("lines"), doc_id))).where(F.col("rn") <= most)
    names = first.groupBy(phase).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", doc_id))), lambda x: x[doc_id].cast("string")), ",").alias("largest"))
    return sums.join(names, sums[phase].eqNullSafe(names[phase])).select(sums[phase], "files", "lines", "bytes", "largest")


def tail_lines(docs: DataFrame, doc_id: str, text: str, least: int = 10, most: int = 500, share: float = 0.05) -> DataFrame:
    """doc_id, tail: the last twentieth of each file's lines, 10 to 500 of them, without blank ones, as one text. These lines stay in the training text too unless without_tail() takes them out."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    lines = F.when(F.endswith(F.col(text), F.lit("\n")), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.size("l") * share))).cast("int")
    rows = docs.where(F.col(text) != "").select(doc_id, lines.alias("l"))
    tail = F.slice("l", F.greatest(F.lit(1), F.size("l") - n + 1), n)
    kept = F.filter(tail, lambda x: trimmed(x) != "")
    return rows.select(doc_id, F.array_join(kept, "\n").alias("tail"), F.size(kept).alias("n_lines")).where("n_lines > 0")


def without_tail(docs: DataFrame, doc_id: str, text: str, least: int = 10, most: int = 500, share: float = 0.05) -> DataFrame:
    """doc_id, text without those last lines: an honest split."""
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.size("l") * share))).cast("int")
    rows = docs.where(F.col(text).isNotNull()).select(doc_id, F.split(text, "\n").alias("l"))
    return rows.select(doc_id, F.array_join(F.slice("l", 1, F.greatest(F.lit(0), F.size("l") - n)), "\n").alias(text))


def tokenizer_sample(docs: DataFrame, phase: str, doc_id: str, text: str, most: int) -> DataFrame:
    """phase, doc_id, pos, line: the first lines of each phase in order of file and line, trimmed, of more than three bytes."""
    lines = docs.select(phase, doc_id, F.posexplode(text_lines(F.col(text))).alias("pos", "line")).withColumn("line", trimmed(F.col("line"))).where(F.octet_length("line") > 3)
    return top_n(lines, phase, most, doc_id, "pos").drop("rn")


def combined(files: DataFrame, group: str, order: list[str], content: str, name: Column | None = None) -> DataFrame:
    """group, pos, text: each file between a begin and an end mark, one row a file in the order it has in the combined text; a group is never gathered in one row."""
    head = F.concat(F.lit("<|file|>"), F.concat(F.lit(" "), name) if name is not None else F.lit(""), F.lit("\n"))
    w = Window.partitionBy(group).orderBy(*order)
    return files.select(group, F.row_number().over(w).alias("pos"), F.concat(head, F.col(content), F.lit("\n<|endfile|>\n")).alias("text"))
