"""Exact n-gram Jaccard self-join by universe partition (operator 2).

A document is its set of distinct five-word shingles, as 64-bit hashes. Sets of similar size form a band. A band cuts the
hash universe into segments; two sets of which at most H elements differ agree in all but H segments, so with more than
H segments they must share one whole (pigeonhole). A segment may also stand with its one-deletion neighbourhood: it
then withstands one difference and counts twice. How many segments a band has, and how many of them with neighbourhoods,
is allocated by cost: rows written against the chance of segments with hardly any element, which many sets share. Of what
its size leaves to spare a document omits its smallest segments; both sides order segments by content, so none that they share is lost.

Rows that meet by a segment are candidates and are verified exactly. Documents with one set are one node. Rounds compare
the nodes of a segment with one of them, its hub: the first in an order of the key's own, then the first of those outside the
component that has the least root. Links merge nodes to components, and a segment whose nodes are of one component is closed. Rounds go on
while each closes half of the rows; what is still open then is compared all with all, where components differ, in a join
whose condition holds parity sketches, so pairs that differ too much for a link never leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .components import components
from .hashing import mix, steps, words

SHINGLE = 5
#: Rows that a document may write rather than one key of a single element, or of none: the latter tells nothing, and a
#: fixed share of all documents of a band would meet at it.
SMALL_KEY_COST, EMPTY_KEY_COST = 4.0, 1000.0
#: Longs of the parity sketch.
SKETCH = 16
_ALL = (1 << 64) - 1


@lru_cache(maxsize=100_000)
def band(number: int) -> tuple[int, int, int, int]:
    """Least and largest size of a band, its segments, and how many of them (the first) have one-deletion neighbourhoods."""
    lo = 1
    for _ in range(number):
        lo = max(lo + 4, -(-8 * lo // 5)) if lo < 9 else -(-8 * lo // 5)
    hi = max(lo + 3, -(-8 * lo // 5) - 1) if lo < 9 else -(-8 * lo // 5) - 1
    need, best = 2 * hi // 9 + 1, None
    for m in sorted({*range((need + 1) // 2, need + 9)} | {need + need * k // 20 for k in range(21)}):
        d = max(0, need - m)
        cost = sum(_cost(n, hi, m, d) for n in (lo, (lo + hi) // 2, hi))
        if best is None or cost < best[0]:
            best = (cost, m, d)
    return lo, hi, *best[1:]


def _spare(n: int, hi: int, m: int, d: int) -> int:
    """Segments that a set of ``n`` may omit: as many as it must share with a partner of the band beyond one."""
    return max(0, m + d - 1 - (n + min(hi, 5 * n // 4)) // 9)


def _cost(n: int, hi: int, m: int, d: int) -> float:
    """Expected rows of a set of ``n`` in ``m`` segments, ``d`` with neighbourhoods, and the price of its smallest keys."""
    none = (1 - 1 / m) ** n
    chance = [none, n / m * none / (1 - 1 / m), n * (n - 1) / 2 / m**2 * none / (1 - 1 / m) ** 2] if m > 1 else [0.0, float(n == 1), float(n == 2)]
    spare, empty, small = _spare(n, hi, m, d), (m - d) * chance[0], (m - d) * (chance[0] + chance[1])
    rows = max(0, m - d - spare) + d * (1 + n / m)
    empty_keys = _beyond(empty, spare) + d * (chance[0] + chance[1])
    return rows + EMPTY_KEY_COST * empty_keys + SMALL_KEY_COST * (_beyond(small, spare) + d * chance[2])


def _beyond(mean: float, spare: int) -> float:
    """Expected excess over ``spare`` of a number with Poisson's law."""
    if mean > 60:
        return max(0.0, mean - spare)
    p, out = exp(-mean), mean - spare
    for k in range(spare):
        out += (spare - k) * p
        p *= mean / (k + 1)
    return max(0.0, out)


def bands_of(n: int) -> list[int]:
    """The band of sets of ``n``, and the next one if a partner may be there."""
    b = 0
    while band(b)[1] < n:
        b += 1
    return [b, b + 1] if 5 * n // 4 >= band(b + 1)[0] else [b]


def keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set (sorted hashes): two sets with a Jaccard similarity of 0.8 or more have at least one in common."""
    n = len(h)
    mixed = mix(h ^ np.uint64(0x94D049BB133111EB))
    sums = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
    out = []
    for b in bands_of(n):
        _, hi, m, d = band(b)
        segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        count = np.bincount(segment.astype(np.int64), minlength=m)
        end = np.cumsum(count)
        place = (np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64((b + 1) * 0xD6E8FEB86659FD93 & _ALL)
        key = mix(sums[end] - sums[end - count] + place)
        spare = _spare(n, hi, m, d)
        order = d + np.lexsort((key[d:], count[d:]))
        out.append(key[order[min(len(order), spare) :]])
        out.append(key[:d])
        for i in range(d):
            first, last = int(end[i] - count[i]), int(end[i])
            out.append(mix((sums[last : last + 1] - sums[first : first + 1]) + place[i : i + 1] - mixed[first:last]))
    return np.unique(np.concatenate(out))


def sketch(h: np.ndarray) -> list[int]:
    """Parity of the number of elements hashed to each of 64 * ``SKETCH`` bits. Sets that differ in d elements have
    sketches that differ in at most d bits."""
    odd = np.bincount((mix(h) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def near(a: str, b: str, n_a: str, n_b: str) -> Column:
    """False only for pairs that cannot link: linked sets differ in at most a ninth of their sizes' sum.

    The sizes are compared first, then a quarter of the sketch, which already rules out most pairs, then all of it.
    """
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH)]
    within = [9 * sum(x, F.lit(0)) <= F.col(n_a) + F.col(n_b) for x in (bits[: SKETCH // 4], bits)]
    return (5 * F.col(n_a) >= 4 * F.col(n_b)) & (5 * F.col(n_b) >= 4 * F.col(n_a)) & within[0] & within[1]


def sets_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than five words, of the whole sequence."""
    for a, b in steps(texts):
        h, first = words(texts[a:b]).ngrams(SHINGLE, whole_if_short=True)
        for i in range(b - a):
            yield np.unique(h[first[i] : first[i + 1]])


def _identity(h: np.ndarray) -> tuple[int, int]:
    return int(np.add.reduce(mix(h ^ np.uint64(0x1234567)), dtype=np.uint64).view(np.int64)), int(np.add.reduce(mix(h ^ np.uint64(0x7654321)), dtype=np.uint64).view(np.int64))


PRINTS = "doc_id long, digest long, n_shingles long, node long, twin long, sketch array<long>, keys array<long>"


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_shingles, node, twin, sketch, keys`` of each row: node and twin are two hashes of the set.

    ``digest`` is a hash of the text. A task gives the keys of a node once, with the first of its documents, so that copies
    add no keys; an empty set has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = sets_of(batch.column(2).to_pylist())
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = [next(sets) for _ in range(len(part))]
                both = [_identity(h) for h in found]
                fresh = [len(h) > 0 and node not in seen and not seen.add(node) for h, (node, _) in zip(found, both, strict=True)]
                k = [keys(h).view(np.int64) if new else np.zeros(0, np.int64) for h, new in zip(found, fresh, strict=True)]
                columns = [
                    part.column(0), part.column(1), pa.array([len(h) for h in found], pa.int64()), pa.array([n for n, _ in both], pa.int64()), pa.array([t for _, t in both], pa.int64()),
                    pa.array([sketch(h) for h in found], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, k)]), pa.int32()), pa.array(np.concatenate(k))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_shingles", "node", "twin", "sketch", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, PRINTS)


def _sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``pairs`` those whose sketches do not rule a link out."""
    of = {x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "uv"}
    return pairs.join(of["u"], "u").join(of["v"], "v").where(near("sketch_u", "sketch_v", "n_u", "n_v")).select("u", "v")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``pairs`` (``u, v``, a written table) those whose documents' sets have 100 * intersection >= 80 * union, as a written table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for h in sets_of(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([h.tobytes()], pa.binary())], ["node", "hashes"])
                at += 1

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]), kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= 80 * (len(a) + len(b) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    chosen = base.stored(nodes.join(wanted, "node").select("node", "doc_id"))
    s = docs.join(chosen, "doc_id").select("node", "text").mapInArrow(sets, "node long, hashes binary")
    both = pairs.join(s.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(s.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    return base.stored_in_small_batches(both.select("u", "v", "a", "b").mapInArrow(test, "u long, v long"))  # a row holds two whole sets


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (``node, root``) after further links between nodes."""
    if labels is None:
        return base.stored(components(links))
    lu, lv = labels.select(F.col("node").alias("u"), F.col("root").alias("ru")), labels.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    mapped = links.join(lu, "u", "left").join(lv, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    more = components(mapped)
    renamed = labels.join(more.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = more.join(labels.select("node"), "node", "left_anti")
    return base.stored(renamed.unionByName(fresh))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def linked(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``node, component_id`` of every node (set) of more than one document, as a written table.

    ``docs``: ``doc_id, text``; ``prints``: their written fingerprints.
    """
    known = prints.where("n_shingles > 0 and doc_id is not null")
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"), (F.min("twin") == F.max("twin")).alias("one_set"), F.count(F.lit(1)).alias("n_docs"))
    nodes = base.stored(nodes.withColumn("node", F.when(F.col("one_set"), F.col("node")).otherwise(F.raise_error(F.lit("two sets have one hash")))).drop("one_set"))
    rows = known.select("node", F.explode("keys").alias("key")).repartition("key")  # one shuffle for the count and the join
    by_key = F.col("node").bitwiseXOR(F.col("key"))  # nodes in an order of the key's own, so that hubs of a group differ
    shared = rows.groupBy("key").agg(F.min(by_key).alias("a"), F.max(by_key).alias("b")).where("a < b").select("key", F.col("key").bitwiseXOR(F.col("a")).alias("hub"))
    rows = base.stored(rows.join(shared, "key").distinct())  # of keys that two nodes have: key, node, hub

    pairs = base.stored(rows.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct())
    labels = _merge(None, verified(base.stored(_sketched(pairs, nodes)), docs, nodes))
    tested, rows, before = pairs, rows.drop("hub"), None
    while True:
        labelled = _labelled(rows, labels)
        least = labelled.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").drop("b")
        rows = base.stored(labelled.join(least, "key").select("key", "node", "root", "a"))  # of keys that are still open
        n = rows.count()
        if not n:
            break
        if before is not None and 2 * n > before:
            pairs = _open_pairs(rows, nodes, tested)
            labels = _merge(labels, verified(pairs, docs, nodes))
            break
        hubs = rows.where("root > a").groupBy("key").agg(F.min(F.struct(by_key, "node", "root")).alias("hub"))
        pairs = rows.join(hubs, "key").where(F.col("root") != F.col("hub.root")).select(F.col("node").alias("u"), F.col("hub.node").alias("v"))
        pairs = base.stored(pairs.distinct().join(tested, ["u", "v"], "left_anti"))
        labels = _merge(labels, verified(base.stored(_sketched(pairs, nodes)), docs, nodes))
        tested, rows, before = tested.unionByName(pairs), rows.select("key", "node"), n

    sizes = _labelled(nodes.select("node", "doc_id", "n_docs"), labels)
    roots = base.stored(sizes.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("n_docs").alias("n_docs")).where("n_docs > 1").drop("n_docs"))
    return base.stored(base.stored(sizes.select("node", "root")).join(roots, "root").select("node", "component_id"))


def _open_pairs(rows: DataFrame, nodes: DataFrame, tested: DataFrame) -> DataFrame:
    """All pairs of nodes of different components that share a key and that sketches do not rule out, but for those tested."""
    sized = base.stored(rows.join(nodes, "node").select("key", "node", "root", "n_shingles", "sketch"))
    x, y = (sized.select(F.col("key").alias(f"key_{s}"), F.col("node").alias(s), F.col("root").alias(f"root_{s}"), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "uv")
    pairs = x.join(y, (F.col("key_u") == F.col("key_v")) & (F.col("u") > F.col("v")) & (F.col("root_u") != F.col("root_v")) & near("sketch_u", "sketch_v", "n_u", "n_v"))
    either = tested.unionByName(tested.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return base.stored(pairs.select("u", "v").distinct().join(either, ["u", "v"], "left_anti"))


def rows_linked(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_shingles, component_id``, one row per row of ``docs``; ``digest`` is a hash of the text."""
    docs = base.documents(docs)
    prints = base.stored_in_small_batches(fingerprints(docs))
    rows = prints.select("doc_id", "digest", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    out = rows.join(linked(docs, prints), "node", "left")
    return out.select("doc_id", "digest", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``; of repeated ids each row by its own text.

    Two documents link when 100 * intersection >= 80 * union of their sets; the component is the least id reachable.
    Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows with a null id
    are returned with a null component.
    """
    return rows_linked(docs).drop("digest")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component; rows without an id stay.

    That is a row with the component's least id. Of several rows with that id in one component the text of least hash
    stays, and of rows with one id and one text one row. Rows with one id whose texts are not linked are judged apart.
    Texts without words are linked with nothing: of rows with one id and one such text one stays too.
    """
    of = base.stored(rows_linked(docs).where("doc_id is not null").groupBy("doc_id", "digest", "component_id").agg((F.max("n_shingles") > 0).alias("has_words"), F.count(F.lit(1)).alias("n_rows")))
    leader = of.where("component_id = doc_id and has_words").groupBy("doc_id").agg(F.min("digest").alias("first"))
    judged = base.stored(of.join(leader, "doc_id", "left").withColumn("stays", (F.col("component_id") == F.col("doc_id")) & (~F.col("has_words") | (F.col("digest") == F.col("first")))))
    names = {c: base.unused(c, docs) for c in ("copy_id", "copy_digest")}
    digest = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    key = lambda df: df.select(F.col("doc_id").alias(names["copy_id"]), F.col("digest").alias(names["copy_digest"]))
    on = (docs["doc_id"].cast("long") == F.col(names["copy_id"])) & (digest == F.col(names["copy_digest"]))
    repeated = judged.where("stays and n_rows > 1")
    if repeated.isEmpty():
        return docs.join(key(judged.where("not stays")), on, "left_anti")
    once = docs.join(key(repeated), on, "left_semi").groupBy(docs["doc_id"].alias(names["copy_id"]), digest.alias(names["copy_digest"])).agg(F.first(F.struct(*(docs[c] for c in docs.columns))).alias("row"))
    return docs.join(key(judged.where("not stays or n_rows > 1")), on, "left_anti").unionByName(once.select("row.*"))
