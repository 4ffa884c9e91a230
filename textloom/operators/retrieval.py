"""Snippet store, keyword search, BM25."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, that of the greatest order: an upsert. Ties go to the greatest row."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])).alias("row"))
    return best.select(key, "row.*")


def removed(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def get_many(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_semi")


def terms(text: Column) -> Column:
    """The terms of a query in lower case, repeated ones kept."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


class _Postings:
    """The terms of a stated set of queries as arrays: of each term the queries that hold it, with a weight."""

    def __init__(self, rows: list[tuple[int, int, float]], terms: int, queries: int):
        order = sorted(rows)
        self.query = np.array([q for _, q, _ in order], np.int64)
        self.weight = np.array([w for _, _, w in order], np.float64)
        self.starts = np.searchsorted(np.array([t for t, _, _ in order], np.int64), np.arange(terms + 1))
        self.queries = queries

    def scored(self, terms: list[int], values: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The queries that any of TERMS stands in, and the sums of their weights, times a value of each term."""
        spans = [(self.starts[t], self.starts[t + 1]) for t in terms]
        query = np.concatenate([self.query[a:b] for a, b in spans]) if spans else np.empty(0, np.int64)
        weight = np.concatenate([self.weight[a:b] * (1.0 if values is None else values[k]) for k, (a, b) in enumerate(spans)]) if spans else np.empty(0)
        found, at = np.unique(query, return_inverse=True)
        return found, np.bincount(at, weight, len(found))


def _best(query: np.ndarray, score: np.ndarray, keys: np.ndarray, k: int, digits: int) -> np.ndarray:
    """The places of the K best of each query: by score, of equal ones the first key."""
    order = np.lexsort((np.argsort(np.argsort(keys, kind="stable"), kind="stable"), -np.round(score, digits), query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def _top_k(rows: DataFrame, key: str, k: int, digits: int, score_rows: Callable[[], Callable[[pd.DataFrame], Iterator[tuple[object, np.ndarray, np.ndarray]]]]) -> DataFrame:
    """n (number of the query), key, score: each task keeps its own K best of every query as it reads, so what is shuffled is K rows a query and task, however many rows match."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField(key, rows.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores_of = score_rows()
        kept_q, kept_s, kept_k = np.empty(0, np.int64), np.empty(0), np.empty(0, object)
        for batch in batches:
            qs, ss, ks = [kept_q], [kept_s], [kept_k]
            for name, q, s in scores_of(batch):
                if len(q):
                    qs.append(q)
                    ss.append(s)
                    own = np.empty(len(q), object)
                    own[:] = name
                    ks.append(own)
            q, s, names = np.concatenate(qs), np.concatenate(ss), np.concatenate(ks)
            best = _best(q, s, names, k, digits)
            kept_q, kept_s, kept_k = q[best], s[best], names[best]
        yield pd.DataFrame({"n": kept_q, key: kept_k, "score": kept_s})

    return rows.mapInPandas(run, schema)


def _numbered(queries: DataFrame, query_id: str, held: Column) -> tuple[list, list[list[str]]]:
    """The stated queries, brought to the driver: their ids and terms. A query without terms finds nothing."""
    rows = queries.select(F.col(query_id).alias("q"), held.alias("t")).where(F.size("t") > 0).collect()
    return [r["q"] for r in rows], [list(r["t"]) for r in rows]


def _ranked(found: DataFrame, queries: DataFrame, query_id: str, ids: list, key: str, k: int, digits: int) -> DataFrame:
    names = queries.sparkSession.createDataFrame([(n, q) for n, q in enumerate(ids)], T.StructType([T.StructField("n", T.LongType()), queries.select(F.col(query_id)).schema[0]]))
    w = Window.partitionBy("n").orderBy(F.desc(F.round("score", digits)), key)
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "n").select(query_id, key, "score", "rank")


def search(store: DataFrame, queries: DataFrame, query_id: str, query: str, key: str, content: str, k: int) -> DataFrame:
    """query_id, key, score, rank of the K best snippets of each query: the share of its terms that the content holds, as part of a word too.

    The queries are a stated set, held as a whole by each task beside an automaton of their distinct terms, so the store is read once for all of them and each content is passed once for all terms.
    Ties are ranked by the key. Null contents, and queries that are null or blank, find nothing; a query id that comes twice is answered for each of its rows.
    """
    ids, asked = _numbered(queries, query_id, terms(F.col(query)))
    number: dict[str, int] = {}
    rows = [(number.setdefault(t, len(number)), q, c / len(ts)) for q, ts in enumerate(asked) for t, c in Counter(ts).items()]
    shared = store.sparkSession.sparkContext.broadcast((list(number), rows, len(asked)))

    def score_rows() -> Callable[[pd.DataFrame], Iterator[tuple[object, np.ndarray, np.ndarray]]]:
        import ahocorasick

        words, held, n = shared.value
        postings = _Postings(held, len(words), n)
        automaton = ahocorasick.Automaton()
        for t, w in enumerate(words):
            automaton.add_word(w, t)
        automaton.make_automaton()

        def scores_of(batch: pd.DataFrame) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
            for name, text in zip(batch[key], batch["lower"]):
                found = {t for _, t in automaton.iter(text)} if words else ()
                if found:
                    yield name, *postings.scored(sorted(found))

        return scores_of

    texts = spread(store.select(key, F.lower(content).alias("lower")).where("lower IS NOT NULL"))
    return _ranked(_top_k(texts, key, k, 12, score_rows), queries, query_id, ids, key, k, 12)


def retrieve(store: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """The snippets of the hits; the best are chosen before the join."""
    return hits.join(store, key)


def bm25(store: DataFrame, queries: DataFrame, query_id: str, query: str, key: str, content: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, key, score, rank by BM25 over words of letters and digits in lower case. Document frequencies of the queries' terms are counted first; then one pass scores, each task keeping its K best."""
    def split(c: str) -> Column:
        return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")

    docs = spread(store.select(key, split(content).alias("t")).where(F.size("t") > 0))
    ids, asked = _numbered(queries, query_id, F.array_distinct(split(query)))
    number: dict[str, int] = {}
    rows = [(number.setdefault(t, len(number)), q, 1.0) for q, ts in enumerate(asked) for t in ts]
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("mean")).first()
    wanted = store.sparkSession.createDataFrame([(t,) for t in number], "term string")
    df = docs.select(F.explode(F.array_distinct("t")).alias("term")).join(F.broadcast(wanted), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = {r["term"]: math.log(1 + (size["docs"] - r["df"] + 0.5) / (r["df"] + 0.5)) for r in df.toLocalIterator()}  # of the stated queries' terms alone
    shared = store.sparkSession.sparkContext.broadcast((number, rows, len(asked), idf, size["mean"]))

    def score_rows() -> Callable[[pd.DataFrame], Iterator[tuple[object, np.ndarray, np.ndarray]]]:
        number, held, n, idf, mean = shared.value
        postings = _Postings(held, len(number), n)

        def scores_of(batch: pd.DataFrame) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
            for name, words in zip(batch[key], batch["t"]):
                count = Counter(w for w in words if w in number)
                if count:
                    norm = k1 * (1 - b + b * len(words) / mean)
                    yield name, *postings.scored([number[w] for w in count], [idf[w] * c * (k1 + 1) / (c + norm) for w, c in count.items()])

        return scores_of

    return _ranked(_top_k(docs, key, k, 9, score_rows), queries, query_id, ids, key, k, 9)
