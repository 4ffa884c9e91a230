"""Problem 5: files of a code collection that nobody wrote by hand in that project."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import evenly
from ..session import persisted, table
from .common import spread

#: Words of a shingle, and the similarity from which two files are copies of each other.
SHINGLE, SIMILAR = 5, 0.8
#: Bands, and the MinHash values in each over plain and over masked shingles. Two files of similarity 0.8 (0.9 when masked) share a band with a probability of 0.999, two of 0.4 with one of 0.08.
BANDS, ROWS, MASKED_ROWS = 32, 6, 2
#: Bits of a sketch of one-bit MinHash values, and the similarity by it under which a pair isn't compared: five standard deviations under SIMILAR.
SKETCH_BITS, SKETCHED = 256, 0.6
#: Tokens below which equal or similar files tell nothing of each other (part of what a copy is, whatever the size of the table): of 30 tokens there are hardly more shingles than a licence line has.
LEAST_TOKENS = 30
#: Tokens of the shortest statement that counts, and the bands of a statement and MinHash values in each: statements of similarity 0.8 share a band with a probability of 0.98.
STATEMENT, STATEMENT_BANDS, STATEMENT_ROWS = 3, 4, 2
#: A family of statements has at least so many members in a file, and families make a file generated if they hold this share of its statements.
FAMILY, FAMILY_SHARE = 8, 0.5
#: Forms of a bucket that are compared in one go; larger buckets are cut into blocks, and each block is compared with each in a task's memory of two blocks.
BLOCK_FORMS = 4096
#: Share of a file's text in literals and punctuation from which it is data, and least length of such a file.
LITERAL_SHARE, LEAST_DATA = 0.75, 200
#: A file is minified with less white space than this among tokens other than literals, and lines or names as of no hand-written file.
SPACE_SHARE, LONG_LINE = 0.10, 120
#: A cluster with at least this share of all rows is joined by broadcast: there can't be more than its inverse of them.
HOT_SHARE = 1e-3

#: What generators write about a file in a comment at its head or foot.
_STATEMENT = re.compile(
    r"""@generated\b
    | <auto-?generated | -\*-\s*generated | auto-?\s?generated\s+(?:file|code|from|by|with|using)\b
    | \b(?:file|code|module|source)\s+(?:is|was|has\s+been)\s+(?:\w+[\s-])?generated\b
    | \bcode\s+generated\s+(?:by|from|with)\b
    | ^\W*(?:machine|automatically|auto)[\s-]?generated\b | ^\W*generated\s+(?:code|file|by|from|with|on|using)\b
    | \b(?:do\s+not|don't)\s+(?:edit|modify|change)\s+(?:this\s+file|by\s+hand|manually|directly)
    | \b(?:edits|changes)\s+(?:will\s+be|are)\s+(?:lost|overwritten)\b""",
    re.I | re.X,
)
_LEXER = re.compile(
    r'''(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|(?:(?<=\n)|(?<=[ \t;])|\A)\#(?![\[!])[^\n]*|<!--.*?(?:-->|\Z))
    | (?P<doc>(?<![=(,\[]\ )(?<![=(,\[])(?:"""(?:.*?)(?:"""|\Z)|\'\'\'(?:.*?)(?:\'\'\'|\Z)))
    | (?P<string>r\#+".*?(?:"\#+|\Z)|"""(?:.*?)(?:"""|\Z)|\'\'\'(?:.*?)(?:\'\'\'|\Z)|(?<==\ )"(?:[^"\\]|\\.)*"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)
    | (?P<number>\b(?:0[xXbBoO][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)\w*)
    | (?P<name>[^\W\d]\w*(?:\$\w*)*|\$\w*)
    | (?P<sign>[^\s\w])''',
    re.S | re.X,
)
#: Names that stand for values, in common languages.
_VALUES = frozenset(("null", "true", "false", "None"))
#: Kinds of tokens that are no code.
REMARKS = ("comment", "doc")
#: Words that masking keeps, the reserved ones of common languages.
_RESERVED = frozenset(
    """as assert async await break case catch class const continue crate def default del delete do elif else enum except export extends false finally fn for from function global if impl import in
    instanceof interface is lambda let loop match mod module mut new nil none not null or and pass pub raise return self static struct super switch this throw trait true try type typeof undefined
    use var void where while with yield""".split()
)


def unescaped(text: str) -> str:
    """Content whose line ends and tabs are stored as two characters, with real ones; line ends become single line feeds."""
    if "\\n" in text and text.count("\n") <= 1:
        text = text.replace("\\r\\n", "\n").replace("\\n", "\n").replace("\\t", "\t")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, token, position) of a file in any language."""
    return [(m.lastgroup, m[0], m.start()) for m in _LEXER.finditer(text)]


def states_generation(text: str, lexed: list[tuple[str, str, int]]) -> bool:
    """Whether a comment before the first or after the last code says that the file was generated. What code writes or mentions between is no such statement."""
    code = [i for i, (kind, _, _) in enumerate(lexed) if kind not in REMARKS]
    outer = lexed[: code[0]] + lexed[code[-1] + 1 :] if code else lexed
    return any(_STATEMENT.search(line) for _, comment, _ in outer for line in comment.split("\n"))


def _masked(kind: str, token: str) -> str:
    if kind == "string":
        return '"'
    if kind == "number":
        return "0"
    return "a" if kind == "name" and token.lower() not in _RESERVED else token


def statement_families(text: str) -> float:
    """The share of a file's statements in families: statements that differ only in numbers, and in the order of those numbers run on or stand in a table."""
    lines = [re.sub(r"\d+(?:\.\d+)?", "0", x.strip()) for x in text.split("\n")]
    lines = [x for x in lines if len(x) > 3 and not x.startswith(("//", "#", "*", "/*"))]
    if len(lines) < FAMILY:
        return 0.0
    # Types and values that alternate within a family are masked like its numbers.
    plain = [re.sub(r"[:=]\s*[\w<>]+(?=[,;]?$)", ":a", x) for x in lines]
    count = Counter(x for x in plain if "0" in x)
    return sum(n for n in count.values() if n >= FAMILY) / len(lines)


def masked_statements(text: str, lexed: list[tuple[str, str, int]]) -> list[str]:
    """The identifier-masked lines of a file that have STATEMENT tokens."""
    code = [x for x in lexed if x[0] not in REMARKS]
    return _statements(text, [at for _, _, at in code], [_masked(kind, token) for kind, token, _ in code])


def _statements(text: str, places: list[int], masked: list[str]) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    end = -1
    for at, token in zip(places, masked):
        if at > end:
            if len(held) >= STATEMENT:
                out.append(" ".join(held))
            held = []
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
        held.append(token)
    if len(held) >= STATEMENT:
        out.append(" ".join(held))
    return out


def _shingles_of(forms: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all forms, one after the other, and where those of each begin; a form under SHINGLE words has one of the whole."""
    h = np.fromiter((_hash_of(w) for form in forms for w in form), np.uint64)
    sizes = np.fromiter(map(len, forms), np.int64, len(forms))
    of = np.repeat(np.arange(len(forms)), sizes)
    begins = np.cumsum(sizes) - sizes
    value = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        value = (value * np.uint64(0x9E3779B97F4A7C15) + np.append(h[k:], np.zeros(min(k, len(h)), np.uint64)) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        value ^= value >> np.uint64(29)
    kept = np.zeros(len(h), bool)
    if len(h) >= SHINGLE:
        kept[: len(h) - SHINGLE + 1] = of[: len(h) - SHINGLE + 1] == of[SHINGLE - 1 :]
    for k in np.flatnonzero(sizes < SHINGLE):
        kept[begins[k]] = True
        value[begins[k]] = zlib.crc32(" ".join(forms[k]).encode()) << 16
    return value[kept] >> np.uint64(16), np.searchsorted(of[kept], np.arange(len(forms)))


@functools.lru_cache(maxsize=200_000)
def _hash_of(word: str) -> int:
    return zlib.crc32(word.encode())


def masked_families(statements: list[str]) -> float:
    """The share of a file's statements in families of FAMILY members, clustered by MinHash bands over their masked shingles; a member's shingles are SIMILAR to those of the family's first."""
    if len(statements) < FAMILY:
        return 0.0
    # Equal statements are one form; forms are taken by size, so a family begins with its commonest.
    forms = Counter(statements).most_common()
    if len(forms) == 1:
        return 1.0
    shingles, starts = _shingles_of([form.split(" ") for form, _ in forms])
    ends = np.append(starts[1:], len(shingles))
    n = STATEMENT_BANDS * STATEMENT_ROWS
    mixed = shingles[:, None] * _A[:n] + _B[:n]
    mixed ^= mixed >> np.uint64(31)
    lowest = np.minimum.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts, axis=0).reshape(len(forms), STATEMENT_BANDS, STATEMENT_ROWS)
    bands = (lowest[:, :, 0] * np.uint64(0x94D049BB133111EB) ^ lowest[:, :, 1]).tolist()
    shingles_of = lambda k: set(shingles[starts[k] : ends[k]].tolist())
    firsts: dict[tuple[int, int], list[int]] = {}
    size: Counter[int] = Counter()
    for k, (_, count) in enumerate(forms):
        near = {f for b in enumerate(bands[k]) for f in firsts.get(b, ())}
        own = shingles_of(k) if near else set()
        family = next((f for f in sorted(near) if len(own & (other := shingles_of(f))) >= SIMILAR * len(own | other)), k)
        if family == k:
            for b in enumerate(bands[k]):
                firsts.setdefault(b, []).append(k)
        size[family] += count
    return sum(c for c in size.values() if c >= FAMILY) / len(statements)


def kinds(text: str, lexed: list[tuple[str, str, int]], statements: list[str]) -> tuple[bool, bool, bool]:
    """Whether a file is generated, minified, or data, by its own tokens and masked statements."""
    # Families of masked statements tell a generator's output; what hand-written tables look alike is left out by the exact check, that numbers run on or values alternate in them.
    generated = states_generation(text, lexed) or masked_families(statements) >= FAMILY_SHARE and statement_families(text) >= FAMILY_SHARE
    body = [(kind, token) for kind, token, _ in lexed if kind not in REMARKS]
    size = Counter({"word": 0, "string": 0, "number": 0, "sign": 0, "name": 0})
    for kind, token in body:
        size["word" if kind == "name" and token not in _VALUES else kind] += len(token)
    total = sum(size.values())
    # Punctuation belongs to the literals around it: rows of data hold as much of it as of numbers.
    literal = (size["string"] + size["number"]) / max(1, total - size["sign"])
    data = total >= LEAST_DATA and literal >= LITERAL_SHARE
    code = total - size["string"]
    kept, at = [], 0
    for kind, token, start in lexed:
        if kind == "comment":
            kept.append(text[at:start])
            at = start + len(token)
    stripped = "".join([*kept, text[at:]])
    space = (len(stripped) - len("".join(stripped.split()))) / max(1, len(stripped) - size["string"])
    longest = max((len(x) for x in stripped.split("\n")), default=0)
    names = [token for kind, token in body if kind == "name" and token.lower() not in _RESERVED]
    short = sum(len(x) <= 2 or x.startswith("_0x") for x in names) / max(1, len(names))
    minified = not data and code >= LEAST_DATA / 2 and space < SPACE_SHARE and (longest > LONG_LINE or short > 0.5)
    return generated, minified, data


_A = np.random.default_rng(11).integers(1, 1 << 63, SKETCH_BITS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(12).integers(0, 1 << 63, SKETCH_BITS, dtype=np.uint64)


def shingle_hashes(words: list[str]) -> np.ndarray:
    """The different 32-bit hashes of all runs of SHINGLE words; one of the whole where there are fewer."""
    h = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return np.array([zlib.crc32("\n".join(words).encode())], dtype=np.uint64)
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = (out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)] + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        out ^= out >> np.uint64(29)
    return np.unique(out >> np.uint64(32))


def lowest_hashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """N MinHash values of a set of shingles."""
    lowest = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None] * _A[:n] + _B[:n]
        part ^= part >> np.uint64(31)
        lowest = np.minimum(lowest, (part * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    return lowest


def band_hashes(lowest: np.ndarray, rows: int) -> np.ndarray:
    """Of each band, a hash of its number and MinHash values."""
    bands = lowest[: BANDS * rows].reshape(BANDS, rows)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(rows):
        out = (out ^ bands[:, k]) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


PROFILE = "generated boolean, minified boolean, data boolean, n_tokens int, form long, bands array<long>, sketch array<long>"


def profile(text: str | None) -> tuple:
    """What one file tells: its kinds, and for the search of copies a hash of its tokens, the bands and a sketch.

    A band joins the hashes of the same band over identifier-masked and over plain shingles: files share it only if both their form and their wording are alike.
    """
    text = unescaped(text or "")
    lexed = tokens(text)
    body = [x for x in lexed if x[0] not in REMARKS]
    form_tokens = [_masked(kind, token) for kind, token, _ in body]
    generated, minified, data = kinds(text, lexed, _statements(text, [at for _, _, at in body], form_tokens))
    if len(body) < LEAST_TOKENS:
        return generated, minified, data, len(body), None, [], []
    words = [token for _, token, _ in body]
    plain = shingle_hashes(words)
    lowest = lowest_hashes(plain, SKETCH_BITS)
    masked = lowest_hashes(shingle_hashes(form_tokens), BANDS * MASKED_ROWS)
    bands = (band_hashes(masked, MASKED_ROWS) * np.uint64(0x9E3779B97F4A7C15)) ^ band_hashes(lowest, ROWS)
    sketch = np.packbits(((lowest >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    form = xxhash.xxh3_64_intdigest("\n".join(words)) - (1 << 63)
    return generated, minified, data, len(body), form, bands.view(np.int64).tolist(), sketch.tolist()


def file_shingles(text: str | None) -> list[int]:
    """The shingles of a file's tokens."""
    return shingle_hashes([token for kind, token, _ in tokens(unescaped(text or "")) if kind not in REMARKS]).astype(np.uint32).view(np.int32).tolist()


def profiles(files: DataFrame, id_column: str, text_column: str, keep: list[str]) -> DataFrame:
    """The profile of every file, in one pass over whole contents."""
    schema = files.select(F.col(id_column).alias("id"), *keep).schema
    for field in T.StructType.fromDDL(PROFILE).fields:
        schema = schema.add(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([profile(t) for t in batch["text"]], columns=schema.names[1 + len(keep) :])
            yield pd.concat([batch[["id", *keep]].reset_index(drop=True), out], axis=1)

    return spread(files.select(F.col(id_column).alias("id"), *keep, F.col(text_column).alias("text"))).mapInPandas(run, schema)


def joined_evenly(rows: DataFrame, groups: DataFrame, key: str, size: Column) -> DataFrame:
    """ROWS with the columns of GROUPS (one row for each key, which counts SIZE rows): rows of groups that hold a large share are joined where they are, so no task gathers one."""
    return evenly(rows, groups, [key], size, HOT_SHARE)


def _similarity(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _sketched(a: str, b: str) -> Column:
    """The similarity of two forms by their sketches: bits agree by chance in half of the cases."""
    differ = sum((F.bit_count(F.element_at(a, k).bitwiseXOR(F.element_at(b, k))) for k in range(1, SKETCH_BITS // 64 + 1)), F.lit(0))
    return 1 - 2 * differ / SKETCH_BITS


#: Forms up to this number (8 MB of numbers) are broadcast to find their files again; more of them are joined by a shuffle.
FEW_FORMS = 1_000_000


def _shingled(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """form, shingles of the files whose id WANTED (id, form) holds: their contents are read again, so that shingles of all files needn't be kept or moved."""
    chosen = files.join(F.broadcast(wanted) if wanted.count() <= FEW_FORMS else wanted, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"form": batch["form"], "shingles": [file_shingles(t) for t in batch["text"]]})

    # A file delivered twice under its id gives its form twice.
    return chosen.select("form", "text").mapInPandas(run, "form long, shingles array<int>").groupBy("form").agg(F.first("shingles").alias("shingles"))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of batches in which equal keys follow each other."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        if held and (held[-1][keys].iloc[-1].to_numpy() != values[0]).any():
            yield pd.concat(held)
            held = []
        for a, b in zip(edges, edges[1:]):
            if b < len(batch):
                yield pd.concat([*held, batch.iloc[a:b]]) if held else batch.iloc[a:b]
                held = []
            else:
                held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held)


WORDS_OF_SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]


def near_in_buckets(members: DataFrame) -> DataFrame:
    """form, other: pairs of a bucket's forms of different repositories whose sketches are near, of which the first is open.

    MEMBERS: bucket, n (its forms), form, where, open, and the sketch in columns. A bucket of more than BLOCK_FORMS is cut into blocks by a hash, and each two blocks meet in a place of their own, so no task
    holds more than two blocks and only near pairs are ever made into rows. Nothing is left out at any size.
    """
    blocks = F.ceil(F.col("n") / BLOCK_FORMS).cast("int")
    placed = members.withColumn("b", F.pmod(F.xxhash64("form", F.lit(5)), blocks).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), blocks - 1)))
    columns = ["form", "where", *WORDS_OF_SKETCH]
    asked = placed.where("open").select("bucket", F.col("b").alias("i"), F.col("k").alias("j"), F.lit(True).alias("asks"), *columns)
    among = placed.select("bucket", F.col("k").alias("i"), F.col("b").alias("j"), F.lit(False).alias("asks"), *columns)
    met = asked.unionByName(among).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    far = int((1 - SKETCHED) / 2 * SKETCH_BITS)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["bucket", "i", "j"]):
            asks = group["asks"].to_numpy(dtype=bool)
            if not asks.any():
                continue
            bits = group[WORDS_OF_SKETCH].to_numpy(dtype=np.int64).view(np.uint64)
            form, where = group["form"].to_numpy(dtype=np.int64), group["where"].to_numpy(dtype=np.int64)
            left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
            out = []
            for at in range(0, len(left), 256):
                own = left[at : at + 256]
                differ = sum(np.bitwise_count(bits[own, None, k] ^ bits[None, right, k]).astype(np.int16) for k in range(bits.shape[1]))
                near = (differ <= far) & (form[own, None] != form[None, right]) & ((where[own, None] != where[None, right]) | (where[own, None] == 0))
                a, b = np.nonzero(near)
                out.append(pd.DataFrame({"form": form[own[a]], "other": form[right[b]]}))
            yield pd.concat(out)

    return met.mapInPandas(compare, "form long, other long").distinct()


def copied(known: DataFrame, files: DataFrame) -> DataFrame:
    """id of the files of which another repository holds a copy: the same tokens but for comments and white space, or SIMILAR shingles of tokens.

    Files of the same tokens become one form first. Forms that share a band are compared with the first of their bucket; those that aren't like it, with all others of the bucket, block by block.
    Pairs pass their sketches before their shingles are made. A null repository is no repository: it makes no copy another's.
    """
    rows = known.where("form IS NOT NULL AND repo IS NOT NULL")
    forms = persisted(
        rows.groupBy("form").agg(F.min("id").alias("id"), F.min("repo").alias("low"), F.max("repo").alias("high"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    sure = forms.where("low <> high").select("form")

    # A repository stands for a form as a hash, or 0 for forms of several: two forms of one repository are no copies of each other.
    where = F.when(F.col("low") == F.col("high"), F.xxhash64("low")).otherwise(F.lit(0).cast("long")).alias("where")
    members = forms.select("form", where, F.explode("bands").alias("bucket"))
    firsts = members.groupBy("bucket").agg(F.min("form").alias("other"), F.count(F.lit(1)).alias("n"), F.min("where").alias("least"), F.max("where").alias("most"))
    buckets = persisted(firsts.where("n > 1 AND (least <> most OR least = 0)").select("bucket", "n", "other"))
    inside = persisted(joined_evenly(members, buckets, "bucket", F.col("n")))
    sketches = forms.select("form", where, "sketch")
    others = sketches.select(F.col("form").alias("other"), F.col("where").alias("other_where"), F.col("sketch").alias("other_sketch"))

    def verified(near: DataFrame) -> DataFrame:
        """The pairs (form, other) whose shingles are similar."""
        near = persisted(near)
        wanted = near.select("form").union(near.select("other")).distinct().join(forms.select("form", "id"), "form")
        texts = persisted(_shingled(files, wanted))
        counts = near.groupBy("other").agg(F.count(F.lit(1)).alias("n"))
        seconds = persisted(texts.select(F.col("form").alias("other"), F.col("shingles").alias("s2")).join(counts, "other"))
        compared = joined_evenly(near.join(texts, "form"), seconds, "other", F.col("n"))
        return persisted(compared.where(_similarity("shingles", "s2") >= SIMILAR).select("form", "other"))

    pairs = persisted(inside.select("form", "other").where("form <> other").distinct())
    # One form may be the first of very many, so its pairs are joined evenly.
    counts = persisted(pairs.groupBy("other").agg(F.count(F.lit(1)).alias("n")))
    near = joined_evenly(pairs.join(sketches, "form"), others.join(counts, "other"), "other", F.col("n"))
    near = near.where(((F.col("where") != F.col("other_where")) | (F.col("where") == 0)) & (_sketched("sketch", "other_sketch") >= SKETCHED))
    first = verified(near.select("form", "other"))
    found = first.select("form").union(first.select("other")).distinct()

    left = persisted(inside.where("form <> other").join(found, "form", "left_anti").select("bucket", "form", F.lit(True).alias("open")))
    asked = left.groupBy("bucket").agg(F.first("open").alias("asked"))
    # Members of a bucket that is asked about, marked where they ask themselves; a bucket's rows are joined evenly by its size.
    sized = persisted(asked.join(buckets.select("bucket", "n"), "bucket").select("bucket", "n"))
    there = joined_evenly(inside.select("bucket", "form"), sized, "bucket", F.col("n"))
    marked = there.join(found.withColumn("known", F.lit(True)), "form", "left").join(sketches, "form")
    spelled = [F.element_at("sketch", k + 1).alias(name) for k, name in enumerate(WORDS_OF_SKETCH)]
    rest = verified(near_in_buckets(marked.select("bucket", "n", "form", "where", F.col("known").isNull().alias("open"), *spelled)))
    forms_found = sure.union(found).union(rest.select("form")).union(rest.select("other")).distinct()
    return rows.join(forms_found, "form", "left_semi").select("id")


def classified(files: DataFrame, id_column: str, text_column: str, repo_column: str) -> DataFrame:
    """id, generated, minified, data, vendored of each different id. Null, empty and tiny contents are none of them; rows delivered again count once."""
    known = persisted(profiles(files.where(F.col(id_column).isNotNull()).withColumn("repo", F.col(repo_column)), id_column, text_column, ["repo"]))
    texts = files.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    vendored = copied(known, texts).distinct().withColumn("vendored", F.lit(True))
    kinds_of = known.groupBy("id").agg(*[F.max(c).alias(c) for c in ("generated", "minified", "data")])
    return kinds_of.join(vendored, "id", "left").withColumn("vendored", F.coalesce("vendored", F.lit(False)))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with what it is."""
    return classified(table(spark, sf_dir, "download_code"), "file_id", "content", "repo").withColumnRenamed("id", "file_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_files(spark, sf_dir).where("generated OR minified OR data OR vendored").select("file_id")
