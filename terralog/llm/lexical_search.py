"""Ranked lexical search by dual trees (operator 11).

Documents become vectors over the items' terms, and are scored by whole numbers: a term's weight times a saturating share
of its occurrences, by the document's length. Items form a tree by the terms that they share, the documents of a batch
another one. A node holds the maximum of every coordinate below it, so the product of two nodes bounds the score of any
item and document below them. A pair of nodes whose bound is under the weakest k-th score of the node's items is left out
whole; what is left is scored, best bounds first, so that the k-th scores rise early. Nothing that could rank is skipped.

Each task keeps the best k of its documents for each item, and these few meet by item. Items are broadcast in groups of a
bounded number of characters; a larger set of items is searched group by group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .hashing import LETTERS, steps, words

K = 10
#: Characters of items that are sent to all tasks at a time.
GROUP_CHARS = 4_000_000
#: Items of a block (the root of a tree) and of a leaf; documents of a node of the upper level and of a leaf.
BLOCK_ITEMS, LEAF_ITEMS, NODE_DOCS, LEAF_DOCS = 256, 8, 128, 16
#: Documents of a batch, fewer where a block has so many terms that the matrix would exceed these bytes.
BATCH_DOCS, BATCH_BYTES = 1024, 64_000_000
#: Terms of the most documents, by which a batch's tree is split.
SPLIT_TERMS = 128
#: About so many documents are searched first, for lower bounds of the k-th scores. They are searched again with the rest.
SEED_DOCS = 20_000
VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"


def item_terms(rows: list[tuple[int, str]]) -> dict[int, np.ndarray]:
    """Sorted distinct term hashes of each item; rows of one id are one item."""
    out: dict[int, np.ndarray] = {}
    for a, b in steps([t for _, t in rows]):
        w = words([t for _, t in rows[a:b]], LETTERS)
        for j, (i, _) in enumerate(rows[a:b]):
            h = np.unique(w.hashes[w.starts[j] : w.starts[j + 1]])
            out[i] = np.union1d(out[i], h) if i in out else h
    return out


class Vocabulary:
    """Places of term hashes in the sorted vocabulary, by a table of their first bits before the search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are in the vocabulary, and where in it."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), max(0, len(self.hashes) - 1))
        ok = self.hashes[place] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[ok], place[ok]


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, counts``: all terms' number, and the vocabulary's terms with how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = Vocabulary(vocabulary), max(1, len(vocabulary))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in steps(texts):
                w = words(texts[a:b], LETTERS)
                at, term = known.find(w.hashes)
                doc = np.searchsorted(w.starts, at, side="right") - 1
                both, count = np.unique(doc * size + term, return_counts=True)
                first = pa.array(np.searchsorted(both // size, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(x, pa.int32())) for x in (both % size, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(w.starts), pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, VECTORS)


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many rows hold each of the ``size`` terms of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    if size:
        for r in rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def saturated(count: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share of the score: grows with its count, less in documents of more terms than the mean."""
    kind = np.int64 if 90 * int(n.max(initial=0)) * n_docs < 1 << 63 else object
    m = (10 + 90 * n.astype(kind) * n_docs // max(1, n_terms)).astype(np.int64)
    return 1_000_000_000 * count // (1000 * count + 8 * m)


def split(has: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts of at most ``most`` rows: each is cut by the column nearest to half of its rows, or in halves if none is near."""
    done, todo = [], [np.arange(len(has))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        share = has[rows].mean(0) if has.shape[1] else np.zeros(0)
        best = int(np.abs(share - 0.5).argmin()) if len(share) else 0
        if len(share) and 0.1 < share[best] < 0.9:
            yes = has[rows, best]
            todo += [rows[~yes], rows[yes]]
        else:
            todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return [r for r in done if len(r)]


class ItemTree:
    """A block of items: its terms, the maxima of its coordinates, and leaves of a few items each with their own."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray, leaf: int = LEAF_ITEMS):
        self.terms = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.int64)
        local = [np.searchsorted(self.terms, t) for t in terms]
        w = weight[self.terms]
        self.kind = np.float64 if len(self.terms) * int(w.max(initial=1)) * 10**6 < 1 << 53 else np.int64
        self.top = w.astype(self.kind)
        has = np.zeros((len(terms), len(self.terms)), bool)
        for i, t in enumerate(local):
            has[i, t] = True
        self.leaves = []
        for items in split(has, leaf):
            own = np.flatnonzero(has[items].any(0))
            self.leaves.append((items, own, (has[items][:, own] * w[own]).astype(self.kind)))


class Best:
    """The best ``k`` of each item so far, by score, then by id; ``least`` is the score that another must reach."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k, self.seed = k, np.ones(n, np.int64) if least is None else np.maximum(1, least)
        self.least = self.seed.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        s, d = (np.concatenate(x) for x in zip(self.found[item], (score.astype(np.int64), doc), strict=True))
        order = np.lexsort((d, -s))[: self.k]
        self.found[item] = s[order], d[order]
        if len(order) == self.k:
            self.least[item] = max(self.seed[item], s[order[-1]])


def search_batch(tree: ItemTree, first: int, u: np.ndarray, docs: np.ndarray, best: Best) -> int:
    """Searches a block of items, the first of which is item ``first`` of ``best``, over the documents of a batch.

    ``u``: a row a term of the block, a column a document, in the tree's order. Returns how many pairs were scored.
    """
    scored, n = 0, u.shape[1]
    leaf = np.maximum.reduceat(u, np.arange(0, n, LEAF_DOCS), axis=1)
    node = np.maximum.reduceat(leaf, np.arange(0, leaf.shape[1], NODE_DOCS // LEAF_DOCS), axis=1)
    root = tree.top @ node  # of the whole block with each upper node
    per = NODE_DOCS // LEAF_DOCS
    for items, own, w in tree.leaves:
        at = items + first
        upper = np.flatnonzero(root >= best.least[at].min())
        if not len(upper):
            continue
        top = w.max(0)
        upper = upper[top @ node[np.ix_(own, upper)] >= best.least[at].min()]
        lower = (upper[:, None] * per + np.arange(per)).ravel()
        lower = lower[lower < leaf.shape[1]]
        bound = top @ leaf[np.ix_(own, lower)]
        order = np.argsort(-bound, kind="stable")
        lower, bound, take, done = lower[order], bound[order], 2, 0
        while done < len(lower):
            end = min(done + take, int(np.searchsorted(-bound, -best.least[at].min(), side="right")))
            if end <= done:
                break
            columns = (lower[done:end, None] * LEAF_DOCS + np.arange(LEAF_DOCS)).ravel()
            columns = columns[columns < n]
            score = w @ u[np.ix_(own, columns)]
            scored += score.size
            for i, row in zip(at.tolist(), score, strict=True):
                hit = np.flatnonzero(row >= best.least[i])
                if len(hit):
                    best.add(i, row[hit], docs[columns[hit]])
            done, take = end, 2 * take
    return scored


def matrix(terms: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, kind) -> np.ndarray:
    """Dense rows of a block's terms, columns of a batch's documents."""
    at = np.searchsorted(terms, term)
    ok = at < len(terms)
    ok[ok] = terms[at[ok]] == term[ok]
    u = np.zeros((len(terms), n), kind)
    u[at[ok], doc[ok]] = value[ok]
    return u


def best_of(rows: DataFrame, model: dict, least: np.ndarray | None) -> DataFrame:
    """``item, doc_id, score``: of each task the best k documents of each item, as good as ``least`` (a score an item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = model["terms"], model["weight"]
        blocks = [(a, ItemTree(terms[a : a + BLOCK_ITEMS], weight)) for a in range(0, len(terms), BLOCK_ITEMS)]
        best = Best(len(terms), model["k"], least)
        common = np.sort(np.argsort(-model["df"], kind="stable")[:SPLIT_TERMS])
        size = max(LEAF_DOCS, min(BATCH_DOCS, BATCH_BYTES // (8 * max([1, *(len(t.terms) for _, t in blocks)]))))
        for batch in batches:
            for a in range(0, len(batch), size):
                part = batch.slice(a, size)
                ids, n = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                length = np.diff(part.column(2).offsets.to_numpy())
                term, count = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                doc = np.repeat(np.arange(len(part)), length)
                value = saturated(count, np.repeat(n, length), model["n_docs"], model["n_terms"])
                order = np.concatenate(split(matrix(common, doc, term, np.ones(len(doc), bool), len(part), bool).T, LEAF_DOCS))
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                for first, tree in blocks:
                    search_batch(tree, first, matrix(tree.terms, place[doc], term, value, len(part), tree.kind), ids[order], best)
        sizes = [len(s) for s, _ in best.found]
        if sum(sizes):
            columns = [np.repeat(np.arange(len(sizes)), sizes), np.concatenate([d for _, d in best.found]), np.concatenate([s for s, _ in best.found])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    found = rows.where("n > 0").mapInArrow(run, "item long, doc_id long, score long")
    by = Window.orderBy(F.desc("score"), "doc_id")
    parts = F.pmod(F.xxhash64("doc_id"), F.lit(32))  # first in parts, so that no task gets an item's rows of all tasks
    for keys in (["item", parts], ["item"]):
        found = found.withColumn("rank", F.row_number().over(by.partitionBy(*keys))).where(F.col("rank") <= model["k"])
    return found


def _group(docs: DataFrame, rows: list[tuple[int, str]], k: int) -> DataFrame:
    spark = docs.sparkSession
    found = {i: h for i, h in item_terms(rows).items() if len(h)}
    vocabulary = np.unique(np.concatenate([*found.values(), np.zeros(0, np.uint64)]))
    v = base.stored(vectors(docs, vocabulary))
    total = v.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    df = document_frequencies(v, len(vocabulary))
    ids, has = list(found), [np.searchsorted(vocabulary, h) for h in found.values()]
    tree = split(_incidence(has, df), BLOCK_ITEMS)  # items that share terms are in one block
    ids, has = ([x[i] for b in tree for i in b] for x in (ids, has))
    model = {"k": k, "n_docs": total["n_docs"], "n_terms": total["n_terms"], "terms": has, "weight": weights(df, total["n_docs"]), "df": df}
    few = v.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(1, total["n_docs"] // SEED_DOCS))) == 0)
    least = np.zeros(len(ids), np.int64)
    for r in best_of(few, model, None).where(F.col("rank") == k).collect():
        least[r["item"]] = r["score"]
    names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    return best_of(v, model, least).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _incidence(has: list[np.ndarray], df: np.ndarray) -> np.ndarray:
    """Which items have each of the terms of the most documents."""
    common = np.sort(np.argsort(-df, kind="stable")[:SPLIT_TERMS])
    return np.array([np.isin(common, t) for t in has]).reshape(len(has), len(common))


def search(docs: DataFrame, items: DataFrame, k: int = K, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each item, equal scores by id.

    Terms are runs of ASCII letters and digits and all other characters, A-Z in lower case, compared by 64-bit hashes.
    Null and empty texts have no terms; an item without terms, and any table that is empty, gives no rows. Rows of
    documents without an id are left out of ranks and counts, as are items without an id; repeated rows of documents are
    documents of their own, repeated rows of an item are one item with the terms of all. ``group_chars``: characters of
    items that are searched at a time.
    """
    docs = base.documents(docs).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null").distinct()
    chars = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = max(1, -(-chars // group_chars))
    of = F.pmod(F.xxhash64("item_id"), F.lit(n))
    groups = [sorted(tuple(r) for r in items.where(of == g).collect()) for g in range(n)]
    return reduce(DataFrame.unionByName, [_group(docs, g, k) for g in groups])
