"""Problem 8: sentence units of texts in any language and script."""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persisted, table
from .common import label, spread

#: Sources whose texts are code, each line a unit.
CODE_SOURCES = ("code_python", "code_typescript", "code_javascript", "code_rust")
CODE_PREFIX = "personal_"

#: Marks that end a sentence, and what opens and closes quotations and brackets.
END_MARKS = ".!?…。！？．።፧؟।॥۔"
QUOTES = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "”", "‹": "›", "(": ")", "[": "]", "（": "）"}
CLOSERS = "”»」』’›)]）》\"'"

#: Log-likelihood ratio from which two events are held to belong together (chi square at p = 0.005), as usual for sentence starters and collocations.
LIKELY = 7.88
#: Score from which a type is an abbreviation.
ABBREVIATION_SCORE = 0.3
#: Occurrences that a type needs before it is scored as an abbreviation, starter or collocation, in a corpus of any size.
LEAST = 2
#: An abbreviation before an upper-case word that is no known starter ends the sentence if it ended one, for sure, this often against such words.
ENDS_SHARE = 0.2
#: The most words between a quotation that stands first and the end of the sentence that names its speaker.
SPEAKER_WORDS, SPEAKER_LETTERS = 8, 24

_THAI = re.compile(r"[฀-๿]")
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힣]")
_HAN_KANA = re.compile(r"[぀-ヿ㐀-鿿]")
_END = re.compile(rf"[{re.escape(END_MARKS)}]+")
_ITEM_ALWAYS = re.compile(r"[^\S\n]*[*•▪◦·‣]\s+\S")
_ITEM = re.compile(r"[^\S\n]*(?:[-–+]|\(?\d{1,3}[.)]|\(?[^\W\d_]\))\s+\S")
_HEAD = re.compile(r"#{1,6}\s+\S")
_TOKEN = re.compile(r"\S+")
_WORD_HERE = re.compile(r"\w*")
_MARK_HERE = re.compile(rf"\s*[{re.escape(END_MARKS)}]")
_SPACES = re.compile(r"\s+")
_INITIAL = re.compile(r"\b[^\W\d_]")
_QUOTE = re.compile(r"[" + re.escape("".join(QUOTES) + CLOSERS.replace("'", "").replace("’", "")) + "]")
_STOP = re.compile(rf"[{re.escape(END_MARKS)}]+|[{re.escape(''.join(QUOTES))}\"]")
_EDGE = "“”«»‹›„\"'‘’()[]{}<>,;:!?…*_`"


def is_code(source: str | None) -> bool:
    return bool(source) and (source in CODE_SOURCES or source.startswith(CODE_PREFIX))


def blocks(text: str, code: bool = False) -> Iterator[tuple[bool, int, int]]:
    """(prose, start, end) of the parts of a text between which every unit ends: paragraphs are prose; list items, headings and lines of code are whole units."""
    start = end = -1  # of the open part
    item = fence = False
    at = 0
    for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text):
        here, at = at, at + len(line)
        body = line.strip()
        if code or fence or body.startswith("```"):
            if start >= 0:
                yield not item, start, end
                start = -1
            if body:
                yield False, here, at
            if not code and body.startswith("```"):
                fence = not fence
            continue
        if not body:
            if start >= 0:
                yield not item, start, end
            start, item = -1, False
            continue
        free = start < 0 or item
        new_item = bool(_ITEM_ALWAYS.match(line)) or bool(_ITEM.match(line)) and (free or text[start:end].rstrip()[-1:] in f"{END_MARKS}:")
        if item and not new_item and line[0].isspace():
            end = at  # an item goes on in an indented line
            continue
        if new_item or item or _HEAD.match(line):
            if start >= 0:
                yield not item, start, end
            start = -1
            if _HEAD.match(line):
                yield False, here, at
                item = False
                continue
            item = new_item
        if start < 0:
            start = here
        end = at
    if start >= 0:
        yield not item, start, end


def initials(text: str) -> tuple[int, int, int]:
    """How many words begin with a letter in upper case, in lower case, and without case."""
    firsts = _INITIAL.findall(text)
    upper, lower = sum(map(str.isupper, firsts)), sum(map(str.islower, firsts))
    return upper, lower, len(firsts) - upper - lower


def cased(text: str) -> bool:
    """Whether capitals tell something: both cases begin words, and most words aren't capitalised."""
    upper, lower, _ = initials(text)
    return upper > 0 and lower > 0.5 * upper


def running_text(text: str, parts: list[tuple[bool, int, int]]) -> str:
    """The paragraphs that hold an end mark: headings may be capitalised where the sentences aren't. The whole text where there are none."""
    return "\n".join(text[a:b] for prose, a, b in parts if prose and _END.search(text, a, b)) or text


# ---- statistics


def _type(token: str) -> tuple[str, bool]:
    """The type of a token in lower case without its last period, and whether it had one."""
    word = token.strip(_EDGE).lower()
    if word.endswith("."):
        return word.rstrip(".").lstrip("."), not word.endswith("..")
    return word.lstrip("."), False


@functools.lru_cache(maxsize=200_000)
def _looked_at(token: str) -> tuple[str, bool, str, bool]:
    """The type of a token ("" where it is none to count), whether it had a period, how it begins (number, lower, upper, other), whether it surely ends a sentence. Remembered, since most tokens come again."""
    word, period = _type(token)
    first = token.strip(_EDGE)[:1]
    if _UNSPACED.search(word):
        word = ""
    begins = "number" if first.isdigit() else "lower" if first.islower() else "upper" if first.isupper() else "other"
    return word, period, begins, token.rstrip(CLOSERS)[-1:] in "!?" or period and len(word) > 5 and "." not in word


def counted(text: str, code: bool) -> tuple[dict[tuple[str, str], int], dict[tuple[str, str], int]]:
    """Counts of (type, event), and of (type with a period, type after it), in the prose of a text.

    Events: plain, period (how often with a final period), lower (written in lower case), starts (after a mark that surely ends a sentence, or first in a block), and of a type with a period before_lower, before_number, before_end.
    A text whose capitals tell nothing gives only plain, period, before_number and before_end.
    """
    events: dict[tuple[str, str], int] = defaultdict(int)
    pairs: dict[tuple[str, str], int] = defaultdict(int)
    parts = list(blocks(text, code))
    running = running_text(text, parts)
    upper, lower, other = initials(running)
    letterless = other > upper + lower  # most words have no case
    telling = letterless or upper > 0 and lower > 0.5 * upper
    for prose, start, end in parts:
        if not prose:
            continue
        tokens = _TOKEN.findall(text, start, end)
        sure = True
        last: str | None = None
        for token in tokens:
            word, period, begins, ends = _looked_at(token)
            if word:
                if last is not None:
                    if begins == "number" or begins == "lower" and telling:
                        events[last, f"before_{begins}"] += 1
                    elif telling:
                        pairs[last, word] += 1
                events[word, "period" if period else "plain"] += 1
                if not telling:
                    pass
                elif begins == "lower" or letterless and not sure:
                    events[word, "lower"] += 1
                elif sure and (letterless or begins == "upper"):
                    events[word, "starts"] += 1
                last = word if period else None
                sure = ends
            else:
                last, sure = None, False
        if last is not None:
            events[last, "before_end"] += 1
    return events, pairs


EVENTS = ("plain", "period", "lower", "starts", "before_lower", "before_number", "before_end")


def _log_likelihood(both: float, first: float, second: float, total: float) -> float:
    """Dunning's ratio for SECOND events of which BOTH fall together with one of FIRST, of TOTAL; negative where they meet less often than by chance."""
    p = second / total
    inside = both / first if first else 0.0
    outside = (second - both) / (total - first) if total > first else 0.0

    def part(k: float, n: float, q: float) -> float:
        return (k * math.log(max(q, 1e-12)) if k else 0.0) + ((n - k) * math.log(max(1 - q, 1e-12)) if n > k else 0.0)

    ratio = 2 * (part(both, first, inside) + part(second - both, total - first, outside) - part(both, first, p) - part(second - both, total - first, p))
    return ratio if inside >= outside else -ratio


def likelihood(both: Column, first: Column, second: Column, total: Column) -> Column:
    """_log_likelihood() as an expression."""
    both, first, second, total = (c.cast("double") for c in (both, first, second, total))
    none = F.lit(0.0)
    inside = F.when(first > 0, both / first).otherwise(none)
    outside = F.when(total > first, (second - both) / (total - first)).otherwise(none)

    def part(k: Column, n: Column, q: Column) -> Column:
        return F.when(k > 0, k * F.log(F.greatest(q, F.lit(1e-12)))).otherwise(none) + F.when(n > k, (n - k) * F.log(F.greatest(1 - q, F.lit(1e-12)))).otherwise(none)

    p = second / total
    ratio = 2 * (part(both, first, inside) + part(second - both, total - first, outside) - part(both, first, p) - part(second - both, total - first, p))
    return F.when(inside >= outside, ratio).otherwise(-ratio)


def abbreviation_score(word: str, period: int, plain: int, periods: int, total: int) -> float:
    """How much a type looks like an abbreviation: its tie to the period, less for long types and for those also written without it, more for inner periods."""
    letters = len(word.replace(".", ""))
    if not letters or not any(c.isalpha() for c in word):
        return 0.0
    tie = _log_likelihood(period, period + plain, periods, total)
    return tie * math.exp(-letters) * (word.count(".") + 1) * letters ** -float(plain) if tie > 0 else 0.0


def score(word: Column, period: Column, plain: Column, periods: Column, total: Column) -> Column:
    """abbreviation_score() as an expression."""
    letters = F.length(F.replace(word, F.lit("."), F.lit(""))).cast("double")
    dots = F.length(word) - letters
    tie = likelihood(period, period + plain, periods, total)
    return F.when(word.rlike(r"\p{L}") & (tie > 0), tie * F.exp(-letters) * (dots + 1) * F.pow(letters, -plain.cast("double"))).otherwise(0.0)


@dataclass
class Language:
    """What the segmenter knows of a language."""

    #: Abbreviation -> whether an upper-case word that is no starter begins a sentence after it, and whether any word does.
    abbreviations: dict[str, tuple[bool, bool]] = field(default_factory=dict)
    starters: set[str] = field(default_factory=set)
    #: Types with a period that a number follows as their collocation.
    numbered: set[str] = field(default_factory=set)
    #: Log probabilities of frequent types, to tell the language of unlabelled texts.
    frequent: dict[str, float] = field(default_factory=dict)


def statistics(docs: DataFrame) -> dict[str, Language]:
    """The knowledge of each language, from all DOCS (text, lang, code). Counting runs in the tasks and is summed by type; only types that pass the tests come to the driver."""
    schema = "lang string, word string, after string, event string, n long"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str, str | None, str], int] = defaultdict(int)

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n) for k, n in held.items()], columns=["lang", "word", "after", "event", "n"])
            held.clear()
            return out

        for batch in batches:
            for text, lang, code in zip(batch["text"], batch["lang"], batch["code"]):
                events, pairs = counted(text or "", bool(code))
                for (word, event), n in events.items():
                    held[lang, word, None, event] += n
                for (word, after), n in pairs.items():
                    held[lang, word, after, "pair"] += n
            if len(held) > 200_000:
                yield rows()
        yield rows()

    counts = docs.select("text", "lang", "code").mapInPandas(count, schema).groupBy("lang", "word", "after", "event").agg(F.sum("n").alias("n"))
    counts = persisted(counts)
    by = [F.coalesce(F.sum(F.when(F.col("event") == e, F.col("n"))), F.lit(0)).alias(e) for e in EVENTS]
    types = persisted(counts.where("event <> 'pair'").groupBy("lang", "word").agg(*by))
    totals = {r["lang"]: r for r in types.groupBy("lang").agg(F.sum(F.col("plain") + F.col("period")).alias("n"), F.sum("period").alias("periods"), F.sum("starts").alias("starts")).collect()}
    out = {lang: Language() for lang in totals}
    size = F.create_map(*[x for lang, r in totals.items() for x in (F.lit(lang), F.lit(float(r["n"])))]) if totals else None
    if size is None:
        return out
    of = lambda name: F.create_map(*[x for lang, r in totals.items() for x in (F.lit(lang), F.lit(float(r[name])))])[F.col("lang")]
    periods, begun = of("periods"), of("starts")
    every = F.col("plain") + F.col("period")

    # Types seldom written without their period are candidates; the score decides, before anything comes to the driver.
    scored = defaultdict(dict)
    candidates = types.where((F.col("period") >= LEAST) & (F.col("plain") <= F.col("period") / 2 + 2))
    for r in candidates.where(score(F.col("word"), F.col("period"), F.col("plain"), periods, size[F.col("lang")]) >= ABBREVIATION_SCORE).toLocalIterator():
        scored[r["lang"]][r["word"]] = r

    starts = types.where((F.col("starts") >= LEAST) & (F.col("starts") >= 0.2 * (every - F.col("lower"))))
    tie = likelihood(F.col("starts"), every, begun, size[F.col("lang")])
    for r in starts.where((F.col("lower") > 0) & (F.col("starts") > 0.05 * F.col("lower")) | (tie > LIKELY) & (F.col("starts") >= 3)).toLocalIterator():
        if r["word"] not in scored[r["lang"]]:
            out[r["lang"]].starters.add(r["word"])

    # Collocations of a period and a number, of all places after a period: against all tokens, whatever begins sentences would seem tied to whatever ends them.
    followed = F.col("before_lower") + F.col("before_number")
    pairs = counts.where("event = 'pair'").select("lang", "word", "after", "n")
    firsts = pairs.groupBy("lang", "word").agg(F.sum("n").alias("m")).join(types.where(followed > 0).select("lang", "word", followed.alias("f"), "before_number"), ["lang", "word"], "full")
    firsts = persisted(firsts.select("lang", "word", (F.coalesce("m", F.lit(0)) + F.coalesce("f", F.lit(0))).alias("first"), F.coalesce("before_number", F.lit(0)).alias("number")))
    places = F.broadcast(firsts.groupBy("lang").agg(F.sum("first").alias("places"), F.sum("number").alias("numbers")))
    numbers = firsts.where(F.col("number") >= LEAST).join(places, "lang").where(likelihood(F.col("number"), F.col("first"), F.col("numbers"), F.col("places")) > LIKELY)
    for r in numbers.toLocalIterator():
        out[r["lang"]].numbered.add(r["word"])

    # What follows each abbreviation: starters against other upper-case words.
    found = [(lang, word) for lang, words in scored.items() for word in words]
    after: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    if found:
        spark = docs.sparkSession
        known = spark.createDataFrame(found, "lang string, word string")
        first = spark.createDataFrame([(lang, w) for lang, x in out.items() for w in x.starters] or [("", "")], "lang string, after string").withColumn("starter", F.lit(True))
        pairs = counts.where("event = 'pair'").join(known, ["lang", "word"]).join(first, ["lang", "after"], "left")
        for r in pairs.groupBy("lang", "word").agg(F.sum(F.when(F.col("starter"), F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("starter"), 0).otherwise(F.col("n"))).alias("c")).collect():
            after[r["lang"], r["word"]] = [r["s"], r["c"]]
    for lang, word in found:
        r, (s, c) = scored[lang][word], after[lang, word]
        ends = s + r["before_end"]
        # Of one that was never seen to end anything, as where capitals tell nothing, no word is known to begin a sentence.
        out[lang].abbreviations[word] = (ends >= ENDS_SHARE * c, ends > 0 and ends >= 0.8 * (ends + r["before_lower"] + r["before_number"]) and ends >= ENDS_SHARE * c)

    ranked = types.withColumn("all", F.col("plain") + F.col("period")).where(F.col("all") >= size[F.col("lang")] * 1e-3)  # at most 1000 of a language
    for r in ranked.toLocalIterator():
        out[r["lang"]].frequent[r["word"]] = math.log(r["all"] / totals[r["lang"]]["n"])
    return out


# ---- segmentation


class Segmenter:
    """Cuts texts into units by what was learnt."""

    def __init__(self, languages: dict[str, Language]):
        self.languages = languages
        self.none = Language()

    def language(self, text: str, lang: str) -> Language:
        """The knowledge of the label, or for texts without one of the language whose frequent types fit best."""
        known = self.languages.get(lang)
        if known is not None and lang != "(none)":
            return known
        words = [_type(t)[0] for t in _TOKEN.findall(text)]
        options = [(sum(x.frequent.get(w, -10.0) for w in words), name) for name, x in self.languages.items() if name != "(none)"]
        return self.languages[max(options)[1]] if options and words else self.none

    def units(self, text: str | None, lang: str = "(none)", code: bool = False) -> list[tuple[int, int]]:
        """(start, end) of the units of TEXT in code points. None for null and blank texts."""
        if not text or not text.strip():
            return []
        out: list[tuple[int, int]] = []
        parts = list(blocks(text, code))
        capitals = not code and cased(running_text(text, parts))
        known = self.language(text, lang) if not code else self.none
        for prose, start, end in parts:
            if prose:
                cuts = [start, *self._cuts(text, start, end, known, capitals), end]
                spans = zip(cuts, cuts[1:])
            else:
                spans = [(start, end)]
            for a, b in spans:
                piece = text[a:b]
                a += len(piece) - len(piece.lstrip())
                b -= len(piece) - len(piece.rstrip())
                if a < b:
                    out.append((a, b))
        return out

    def _cuts(self, text: str, start: int, end: int, known: Language, capitals: bool) -> list[int]:
        if len(_THAI.findall(text, start, end)) * 2 > end - start:
            return self._thai_cuts(text, start, end)
        end -= len(text[start:end]) - len(text[start:end].rstrip())
        closing = self._closings(text, start, end)
        cuts: list[int] = []
        begun = start  # of the sentence
        at = start
        while m := self._next_stop(text, at, end, closing):
            kind, a, b = m
            at = b
            if kind == "quote":
                # A quotation from a to b whose last mark may end the sentence around it.
                inside = text[a + 1 : b - 1].rstrip()
                if text[a] in "([（":
                    continue
                if inside[-1:] not in END_MARKS:
                    continue
                b = self._after_closers(text, b, end)
                if _MARK_HERE.match(text, b, end):
                    continue  # the sentence has its own mark after the quotation
                if self._quote_ends(text, begun, a, b, end, known, capitals):
                    cuts.append(b)
                    begun = b
                at = b
                continue
            b = self._after_closers(text, b, end)
            at = b
            if b < end and self._mark_ends(text, a, m[2], b, begun, end, known, capitals):
                cuts.append(b)
                begun = b
        return cuts

    @staticmethod
    def _thai_cuts(text: str, start: int, end: int) -> list[int]:
        """Between two words parted by white space with no digit on either side."""
        return [m.end() for m in _SPACES.finditer(text, start, end) if start < m.start() and m.end() < end and not text[m.start() - 1].isdigit() and not text[m.end()].isdigit()]

    @staticmethod
    def _closings(text: str, start: int, end: int) -> dict[int, int]:
        """Of each quotation or bracket that is closed in the same block, the position of its closing mark by that of its opening one; inner ones are left out."""
        out: dict[int, int] = {}
        stack: list[int] = []
        straight: list[int] = []
        for m in _QUOTE.finditer(text, start, end):
            i, c = m.start(), m[0]
            if c in QUOTES:
                stack.append(i)
            elif c == '"':
                straight.append(i)
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if QUOTES[text[stack[k]]] == c:
                        out[stack[k]] = i
                        del stack[k:]
                        break
        if len(straight) % 2 == 0:
            out |= dict(zip(straight[::2], straight[1::2]))
        return out

    @staticmethod
    def _next_stop(text: str, at: int, end: int, closing: dict[int, int]) -> tuple[str, int, int] | None:
        """The next quotation or bracket, or run of end marks outside of any."""
        for m in _STOP.finditer(text, at, end):
            if m[0][0] in END_MARKS:
                return "mark", *m.span()
            if m.start() in closing:
                return "quote", m.start(), closing[m.start()] + 1
        return None

    @staticmethod
    def _after_closers(text: str, b: int, end: int) -> int:
        while b < end and (text[b] in CLOSERS and text[b] not in "\"'" or text[b] in "\"'" and (b + 1 == end or text[b + 1].isspace()) and text[b - 1] in END_MARKS):
            b += 1
        return b

    @staticmethod
    def _word_start(text: str, begun: int, a: int) -> int:
        """Where the word that ends at a begins: looked for in ever longer parts before it, so neither a long sentence nor a long word costs much."""
        size = 64
        while True:
            low = max(begun, a - size)
            last = text[low:a].rsplit(None, 1) if a > low and not text[a - 1].isspace() else []
            if low == begun or len(last) != 1:
                return a - len(last[-1]) if last else a
            size *= 4

    @classmethod
    def _word_before(cls, text: str, begun: int, a: int) -> str:
        return text[cls._word_start(text, begun, a) : a]

    @staticmethod
    def _next_word(text: str, b: int, end: int) -> str:
        m = _TOKEN.search(text, b, end)
        return m[0].strip(_EDGE) if m else ""

    def _starter(self, word: str, known: Language) -> bool:
        return word.lower().rstrip(".") in known.starters

    def _quote_ends(self, text: str, begun: int, a: int, b: int, end: int, known: Language, capitals: bool) -> bool:
        """Whether the sentence ends after a quotation with an end mark of its own."""
        m = _TOKEN.search(text, b, end)
        if not m:
            return False
        next_at = m.start()
        following = text[next_at]
        if following in ",;:،፣，、；：":
            return False
        k = a - 1
        while k >= begun and text[k].isspace():
            k -= 1
        unspaced = bool(_HAN_KANA.match(following))
        if k >= begun:
            if text[k] in ":,：，፦":
                return True
            if unspaced:
                return False
            if following.islower():
                return not capitals
            return True
        # The quotation stands first: the words up to the next mark name the speaker if they are few.
        if following in QUOTES or following == '"':
            return True
        m = _END.search(text, b, end)
        while m and m[0] == "." and m.end() < end and not text[m.end()].isspace() and text[m.end()] not in CLOSERS:
            m = _END.search(text, m.end(), end)
        speaker = text[b : m.start() if m else end]
        few = len(speaker) <= SPEAKER_LETTERS if unspaced else len(speaker.split()) <= SPEAKER_WORDS
        return not few and not (capitals and following.islower())

    def _mark_ends(self, text: str, a: int, marks_end: int, b: int, begun: int, end: int, known: Language, capitals: bool) -> bool:
        """Whether the sentence ends at b, after the marks from a to marks_end and what closes after them."""
        marks = text[a:marks_end]
        spaced = text[b].isspace()
        if not marks.strip("。！？．።፧؟।॥۔"):
            return True
        if not spaced:
            if text[b] in "/\\_@&=%-,;:" or text[b].isdigit():
                return False
            if marks in (".", "…", "..", "...") and not (text[b].isupper() or text[b] in QUOTES or text[b] == '"'):
                if not capitals and text[b].lower() != text[b].upper():
                    around = self._word_before(text, begun, b) + _TOKEN.match(text, b, end)[0]
                    return not set(around) & set("/\\@_") and text[a - 2 : a].isalpha() and self._starter(_WORD_HERE.match(text, b, end)[0], known)
                # In scripts without letter case the period alone decides; elsewhere a period inside a word, an address or an abbreviation.
                return text[b].isalpha() and text[b].lower() == text[b].upper() and text[a - 1].isalpha() and bool(text[begun : self._word_start(text, begun, a)].strip())
        word = self._next_word(text, b, end)
        first = word[:1]
        if marks == ".":
            kind = self._word_before(text, begun, a).lstrip(_EDGE).lower()
            if not spaced and len(kind) == 1 and kind.isalpha():
                return False
            return self._period_ends(kind, word, first, known, capitals)
        if marks.strip(".…"):
            # ! or ?, perhaps with others.
            return not (capitals and first.islower() and text[b - 1] in CLOSERS)
        # Dots that trail off.
        if first.isupper() and capitals:
            return True
        if first and first.lower() == first.upper():
            return not first.isdigit() or True
        return self._starter(word, known) if not capitals else False

    def _period_ends(self, kind: str, word: str, first: str, known: Language, capitals: bool) -> bool:
        initial = len(kind) == 1 and kind.isalpha()
        entry = known.abbreviations.get(kind)
        if entry is None and "-" in kind:
            entry = known.abbreviations.get(kind.rpartition("-")[2])
        lettered = first.lower() != first.upper()
        if first.isdigit():
            return entry is None and not initial and kind not in known.numbered
        if entry is None and not initial:
            return not (lettered and capitals and first.islower())
        if initial and entry is None:
            entry = (False, False)
        others, any_word = entry
        if not lettered:
            return any_word or bool(word) is False
        if capitals:
            return first.isupper() and (others or self._starter(word, known) and not initial)
        return any_word or others and self._starter(word, known)


def segmented(docs: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char of the units of all DOCS (doc_id, text, lang, source).

    Null and blank texts give none; a repeated row gives its units again as rows that are dropped as equal. A single text is cut in memory in one go, whatever its length.
    """
    rows = spread(docs.select("doc_id", "text", label(F.col("lang")).alias("lang"), F.coalesce(F.col("source").isin(*CODE_SOURCES) | F.col("source").startswith(CODE_PREFIX), F.lit(False)).alias("code")))
    rows = rows.where(F.col("text").isNotNull())
    learnt = docs.sparkSession.sparkContext.broadcast(statistics(rows.where("NOT code")))
    schema = docs.select("doc_id").schema.add("start_char", "long").add("end_char", "long")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(learnt.value)
        for batch in batches:
            found = [(i, a, b) for i, text, lang, code in zip(batch["doc_id"], batch["text"], batch["lang"], batch["code"]) for a, b in segmenter.units(text, lang, bool(code))]
            yield pd.DataFrame(found, columns=["doc_id", "start_char", "end_char"])

    return rows.mapInPandas(cut, schema)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(table(spark, sf_dir, "documents"))
