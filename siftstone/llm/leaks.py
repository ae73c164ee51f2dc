"""Evaluation texts inside training texts.

Winnowing keeps the least hash of k-word grams per sliding window. Items keep all their grams, so a run of
k + window - 1 equal words in a document always shares a fingerprint with the item. With k = 5 and window = 2 a run of
six equal words is never missed, and a passage of twenty or more words of which at most one in eight is altered
holds such a run.

Sentences that many items share don't count: their grams are taken out before the join, and their words add nothing to the
length of a passage. Documents are read once. Where the fingerprints of the items fit a checked broadcast, a document gives out only the
stretches of words around its hits; else its fingerprints are joined and the hit documents are read again.

Hits are extended by the furthest word reached for each number of edits (altered, added or dropped words), to both sides of a
run of equal words, so edits may stand side by side anywhere in a passage.

Null or blank texts have no fingerprints. Ids that repeat give their pairs once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.words import clean, gram_hashes, winnow, word_codes, words
from siftstone.session import spread, written

K, WINDOW = 5, 2
#: A passage has at least so many words, of which at most one in so many is altered.
LEAST_WORDS, ONE_IN = 20, 8
#: A sentence in at least so many items is shared wording, not content.
SHARED_BY = 5
#: Item fingerprints are broadcast up to so many rows of 8 bytes; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000

_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def item_sentences(items: DataFrame) -> DataFrame:
    """(item_id, text_id, place, sentence): levelled sentences of every distinct text of every item, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (i, t, k, s)
                for i, t, text in zip(pdf.item_id, pdf.text_id, pdf.item_text)
                for k, s in enumerate(" ".join(words(x)) for x in _SENTENCE.split(clean(text)))
                if s
            ]
            yield pd.DataFrame(rows, columns=["item_id", "text_id", "place", "sentence"])

    each = items.where("item_id is not null and item_text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.xxhash64("item_text").alias("text_id"), "item_text"
    )
    return each.distinct().mapInPandas(run, "item_id long, text_id long, place int, sentence string")


def weighted_items(items: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """(item_id, text_id, sentences): each item's sentences in order as (place, sentence, shared).

    A sentence in at least ``shared_by`` items is shared. A group holds the sentences of one item.
    """
    each = written(item_sentences(items), "item-sentences")
    shared = each.groupBy("sentence").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= shared_by).select("sentence", F.lit(True).alias("shared"))
    marked = each.join(shared, "sentence", "left").select("item_id", "text_id", F.struct("place", "sentence", F.coalesce("shared", F.lit(False)).alias("shared")).alias("s"))
    return marked.groupBy("item_id", "text_id").agg(F.array_sort(F.collect_list("s")).alias("sentences"))


def item_fingerprints(weighted: DataFrame, k: int = K) -> DataFrame:
    """(fingerprint, item_id, text_id, n): grams of every item that hold a word of a sentence that is not shared, and how often they stand in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for pdf in batches:
            out = []
            for i, t, sentences in zip(pdf.item_id, pdf.text_id, pdf.sentences):
                tokens, weight = _weighed(sentences)
                h = gram_hashes(word_codes(tokens, cache), k)
                counted = np.convolve(weight, np.ones(k, dtype=np.int64), "valid") > 0 if len(h) else np.empty(0, dtype=bool)
                kept, n = np.unique(h[counted], return_counts=True)
                out.append(pd.DataFrame({"fingerprint": kept.view(np.int64), "item_id": i, "text_id": t, "n": n}))
            if len(cache) > 500_000:
                cache.clear()
            yield pd.concat(out) if out else pd.DataFrame({"fingerprint": [], "item_id": [], "text_id": [], "n": []}).astype("int64")

    return weighted.mapInPandas(run, "fingerprint long, item_id long, text_id long, n long")


def _weighed(sentences) -> tuple[list[str], list[int]]:
    """Words of an item, and 1 for each that counts."""
    tokens: list[str] = []
    weight: list[int] = []
    for s in sentences:
        part = s["sentence"].split()
        tokens += part
        weight += [0 if s["shared"] else 1] * len(part)
    return tokens, weight


def stretches(documents: DataFrame, keys: np.ndarray, reach: int) -> DataFrame:
    """(doc_id, text, fingerprints): the words around the hits of every document, ``reach`` words to both sides.

    ``keys`` are the sorted fingerprints that count as hits. Winnowed grams find the hits, and hits nearer than that share a stretch; all
    grams of a stretch that are in ``keys`` come out with it.
    """
    held = documents.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        wanted = held.value
        for batch in batches:
            ids, texts, found = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words(text)
                h = gram_hashes(word_codes(tokens, cache), K)
                values = h.view(np.int64)
                hit = _isin(values, wanted)
                at = winnow(h, WINDOW)
                at = at[hit[at]]
                if not len(at):
                    continue
                cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
                for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
                    first, last = max(0, at[a] - reach), at[b - 1] + reach
                    ids.append(i)
                    texts.append(" ".join(tokens[first : last + K]))
                    found.append(np.unique(values[first : last + 1][hit[first : last + 1]]))
            if len(cache) > 500_000:
                cache.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text", "fingerprints"]
            )

    return _texts(documents).mapInArrow(run, "doc_id long, text string, fingerprints array<long>")


def _isin(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    place = np.searchsorted(wanted, values)
    return wanted[np.minimum(place, len(wanted) - 1)] == values


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): distinct winnowed fingerprints of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = gram_hashes(word_codes(words(text), cache), K)
                h = np.unique(h[winnow(h, WINDOW)]).view(np.int64)
                ids.append(np.full(len(h), i, dtype=np.int64))
                found.append(h)
            if len(cache) > 500_000:
                cache.clear()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], names=["doc_id", "fingerprint"])

    return _texts(documents).mapInArrow(run, "doc_id long, fingerprint long")


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def runs_of_equal_words(doc: list[int], doc_at: dict[tuple[int, ...], list[int]], item: list[int], k: int = K) -> Iterator[tuple[int, int, int]]:
    """(item place, document place, length) of every longest run of at least ``k`` equal words."""
    for i, gram in enumerate(zip(*(item[x:] for x in range(k)))):
        for j in doc_at.get(gram, ()):
            if i and j and item[i - 1] == doc[j - 1]:
                continue
            n = k
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            yield i, j, n


def gram_places(tokens: list, k: int = K) -> dict[tuple, list[int]]:
    at: dict[tuple, list[int]] = {}
    for i, gram in enumerate(zip(*(tokens[j:] for j in range(k)))):
        at.setdefault(gram, []).append(i)
    return at


def reached(item: list, doc: list, i: int, j: int, d: int, most: int) -> list[int]:
    """For each number of edits up to ``most``, how many item words an alignment from (i, j) in direction d takes at most.

    Every alignment counted ends with an equal word, or takes none. Edits are altered, added and dropped words. The furthest word is kept for
    each diagonal, so the work is ``most`` squared and the equal words.
    """
    n, m = (len(item) - i, len(doc) - j) if d > 0 else (i + 1, j + 1)
    best = [0]
    # Words of the item taken, by diagonal (words of the document taken less those of the item).
    front = {0: 0}
    for e in range(1, most + 1):
        after: dict[int, int] = {}
        furthest = best[-1]
        for g in range(-e, e + 1):
            # An altered word on the same diagonal, an added one from below, a dropped one from above.
            a = max(front.get(g, -2) + 1, front.get(g - 1, -1), front.get(g + 1, -2) + 1)
            if a < 0 or a > n or a + g > m or a + g < 0:
                continue
            start = a
            while a < n and a + g < m and item[i + d * a] == doc[j + d * (a + g)]:
                a += 1
            after[g] = a
            if a > start and a > furthest:
                furthest = a
        best.append(furthest)
        if not after or furthest >= n:
            best += [furthest] * (most - e)
            break
        front = after
    return best


#: A passage holds at least so many equal five-word grams: n words of which n // 8 are altered leave at least
#: n - n // 8 - 4 (n // 8 + 1) of them, which is least at 24 words.
LEAST_GRAMS = 5


def passage(doc: list, doc_at: dict[tuple, list[int]], item: list, weight: list[int], one_in: int = ONE_IN) -> int:
    """The most item words that count in a passage shared by both, 0 if there is none.

    A passage is a stretch of the item of which at most one word in ``one_in`` is altered, added or dropped in the document, and which
    holds a run of ``K`` equal words. ``weight`` is 0 for words of shared sentences.
    """
    counted = [0]
    for w in weight:
        counted.append(counted[-1] + w)
    best, most = 0, len(item) // one_in
    runs = list(runs_of_equal_words(doc, doc_at, item))
    if sum(n - K + 1 for _, _, n in runs) < LEAST_GRAMS:
        return 0
    for i, j, n in runs:
        if best == counted[-1]:
            break
        # More words than those left to a side can't be taken, so fewer edits than these need a look.
        right = reached(item, doc, i + n, j + n, 1, most)
        left = reached(item, doc, i - 1, j - 1, -1, most)
        for x, to_left in enumerate(left):
            for y, to_right in enumerate(right[: most + 1 - x]):
                if (x + y) * one_in <= to_left + n + to_right:
                    best = max(best, counted[i + n + to_right] - counted[i - to_left])
    return best


def leaked_pairs(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, shared_by: int = SHARED_BY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_words): each document that holds a passage of an item, and its length."""
    weighted = written(weighted_items(items, shared_by), "items")
    held = written(item_fingerprints(weighted), "item-fingerprints")
    # Stretches are words already; texts that are read again have to be cut.
    small = held.count() <= broadcast_rows
    if small:
        longest = weighted.select(F.aggregate("sentences", F.lit(0), lambda n, s: n + F.size(F.split(s["sentence"], " "))).alias("n")).agg(F.max("n")).first()[0] or 0
        keys = np.unique(np.array([r[0] for r in held.select("fingerprint").distinct().toLocalIterator()], dtype=np.int64))
        # An alignment takes as many words as the item has, and an added one for each edit at most.
        near = written(stretches(documents, keys, longest + longest // ONE_IN + K).withColumn("part", F.xxhash64("doc_id", "text")), "stretches")
        hits = near.select("doc_id", "part", F.explode("fingerprints").alias("fingerprint"))
        # Fewer equal grams than any passage has need no closer look; grams count as often as they stand in the item.
        shared = hits.join(F.broadcast(held), "fingerprint").groupBy("doc_id", "part", "item_id", "text_id").agg(F.sum("n").alias("n"))
        pairs = shared.where(F.col("n") >= LEAST_GRAMS).drop("n")
        joined = near.select("doc_id", "part", "text").join(pairs, ["doc_id", "part"]).join(F.broadcast(weighted), ["item_id", "text_id"])
    else:
        pairs = fingerprints(documents).join(held, "fingerprint").select("doc_id", "item_id", "text_id").distinct()
        joined = _texts(documents).join(pairs, "doc_id").join(weighted, ["item_id", "text_id"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], tuple[list[str], list[int]]] = {}
        last, tokens, at = None, [], {}
        for pdf in batches:
            out = []
            for doc_id, text, item_id, text_id, sentences in zip(pdf.doc_id, pdf.text, pdf.item_id, pdf.text_id, pdf.sentences):
                if (item_id, text_id) not in known:
                    known[item_id, text_id] = _weighed(sentences)
                if text != last:
                    last, tokens = text, text.split() if small else words(text)
                    at = gram_places(tokens)
                n = passage(tokens, at, *known[item_id, text_id])
                if n >= least_words:
                    out.append((doc_id, item_id, n))
            if len(known) > 20_000:
                known.clear()
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words"])

    found = joined.select("doc_id", "text", "item_id", "text_id", "sentences").mapInPandas(verify, "doc_id long, item_id long, n_words long")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
