"""Problem 7: evaluation texts leaking into training text.

Method: a BM25 inverted index of the test items with block maxima.  Every
training document is cut into overlapping passages, each passage queries the
index with block-max WAND, all items at or above their threshold are
retrieved, and a retrieved item is verified on the document's words.

The retrieval loses nothing: an item's contributions are divided by the least
score that any ``run`` consecutive words of it can have, so a passage holding
such a run scores at least 1, and passages overlap by run - 1 words, so every
run of a document lies whole in one passage.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.text import spread, words
from furrow.session import Scratch

#: Item words of one index shard, shards of one pass over the corpus, and words of one passage.
SHARD_WORDS = 250_000
PASS_SHARDS = 8
PASSAGE_WORDS = 48
NO_MORE = 1 << 62


class Index:
    """Postings of one shard: per term the items ascending, their contributions and block maxima."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int, block: int = 16, k1: float = 1.2, b: float = 0.75, slack: float = 1e-9):
        items = sorted(x for x in items if len(x[1]) >= run)
        self.run, self.block, self.ids = run, block, [i for i, _ in items]
        self.grams = [self._grams(w, run) for _, w in items]
        df = Counter(t for _, w in items for t in set(w))
        n, mean = len(items), (sum(len(w) for _, w in items) / len(items)) if items else 1.0
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        postings: dict[str, list[tuple[int, float]]] = {}
        for at, (_, w) in enumerate(items):
            own = {t: idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(w) / mean)) for t, f in Counter(w).items()}
            least = min(sum(own[t] for t in set(w[i : i + run])) for i in range(len(w) - run + 1))
            for t, s in own.items():
                postings.setdefault(t, []).append((at, s / least * (1 + slack)))
        self.docs = {t: [d for d, _ in p] for t, p in postings.items()}
        self.score = {t: [s for _, s in p] for t, p in postings.items()}
        self.top = {t: max(s) for t, s in self.score.items()}
        self.tops = {t: [max(s[i : i + block]) for i in range(0, len(s), block)] for t, s in self.score.items()}

    @staticmethod
    def _grams(w: list[str], run: int) -> frozenset[str]:
        return frozenset(" ".join(w[i : i + run]) for i in range(len(w) - run + 1))

    def retrieve(self, terms: list[str]) -> list[int]:
        """Places of all items that score 1 or more for distinct terms of the index."""
        lists = [(self.docs[t], self.score[t], self.tops[t], self.top[t]) for t in terms]
        at = [0] * len(lists)
        here = [d[0] for d, _, _, _ in lists]
        order, found, size = list(range(len(lists))), [], self.block
        while True:
            order.sort(key=here.__getitem__)
            bound, pivot = 0.0, -1
            for j, i in enumerate(order):
                if here[i] == NO_MORE:
                    break
                bound += lists[i][3]
                if bound >= 1.0:
                    pivot = j
                    break
            if pivot < 0:
                return found
            doc = here[order[pivot]]
            while pivot + 1 < len(order) and here[order[pivot + 1]] == doc:
                pivot += 1
            # Block maxima of the blocks that hold (or pass) the pivot.
            bound, until = 0.0, here[order[pivot + 1]] if pivot + 1 < len(order) else NO_MORE
            for j in range(pivot + 1):
                docs, _, tops, _ = lists[order[j]]
                p = bisect_left(docs, doc, at[order[j]])
                if p == len(docs):
                    continue
                blk = p // size
                bound += tops[blk]
                until = min(until, docs[min((blk + 1) * size, len(docs)) - 1] + 1)
            if bound >= 1.0:
                total = 0.0
                for j in range(pivot + 1):
                    i = order[j]
                    docs, score, _, _ = lists[i]
                    p = bisect_left(docs, doc, at[i])
                    if p < len(docs) and docs[p] == doc:
                        total += score[p]
                        p += 1
                    at[i] = p
                    here[i] = docs[p] if p < len(docs) else NO_MORE
                if total >= 1.0:
                    found.append(doc)
            else:
                target = max(until, doc + 1)
                for j in range(pivot + 1):
                    i = order[j]
                    docs = lists[i][0]
                    at[i] = bisect_left(docs, target, at[i])
                    here[i] = docs[at[i]] if at[i] < len(docs) else NO_MORE

    def passages(self, w: list[str], size: int) -> Iterator[tuple[int, int]]:
        """Overlapping (start, end) of the stretches of ``run`` or more terms of the index.

        A word of no item breaks any leak, so only such stretches can hold one.
        """
        start, step = 0, size - self.run + 1
        for end, t in enumerate([*w, None]):
            if t in self.top:
                continue
            if end - start >= self.run:
                for at in range(start, end - self.run + 1, step):
                    yield at, min(end, at + size)
            start = end + 1

    def search(self, w: list[str], passage: int) -> list[tuple[int, int]]:
        """(place, runs shared) of the items of which ``w`` holds a run."""
        top, verified = self.top, {}
        for start, end in self.passages(w, passage):
            terms = list(set(w[start:end]))
            if sum(top[t] for t in terms) < 1.0:
                continue
            runs = [" ".join(w[i : i + self.run]) for i in range(start, end - self.run + 1)]
            for place in self.retrieve(terms):
                grams = self.grams[place]
                shared = sum(r in grams for r in runs)
                if shared:
                    verified[place] = verified.get(place, 0) + shared
        return list(verified.items())


def _shards(items: DataFrame, run: int, shard_words: int) -> tuple[DataFrame, int]:
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 4 / shard_words))
    return items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")), n


def leaks(documents: DataFrame, items: DataFrame, run: int = 12, passage: int = PASSAGE_WORDS, shard_words: int = SHARD_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(item_id, doc_id, n_runs): documents holding ``run`` or more consecutive words of an item.

    ``n_runs`` counts the document's word positions (per passage) at which such
    a run starts.  Items with fewer words than ``run`` cannot leak; NULL texts
    hold nothing; an item id given twice counts as both texts.

    The index is built per shard of about ``shard_words`` item words;
    ``PASS_SHARDS`` of them are broadcast at a time and a task holds one, so
    both are bounded however many items there are.  A pass reads the corpus
    once and cuts each text into words once for all its shards; documents are
    searched whole and never shuffled.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    named = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    sharded, n = _shards(named, run, shard_words)
    corpus = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    corpus = spread(corpus)
    out = None
    for first in range(0, n, PASS_SHARDS):
        sent = []
        for k in range(first, min(n, first + PASS_SHARDS)):
            rows = sharded.where(F.col("shard") == k).select("item_id", "text").collect()
            sent.append(spark.sparkContext.broadcast(pickle.dumps(Index([(r.item_id, words(r.text)) for r in rows], run))))
        found = scratch.save(corpus.mapInArrow(_searcher(sent, passage), "item_id bigint, doc_id bigint, n_runs int"))
        for b in sent:
            b.destroy()
        out = found if out is None else out.union(found)
    return out.groupBy("item_id", "doc_id").agg(F.max("n_runs").alias("n_runs"))


def _searcher(sent: list, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(sent[0].value)
        for batch in batches:
            item, doc, runs = [], [], []
            texts = [words(t) for t in batch.column(1).to_pylist()]
            for shard in sent:
                if len(sent) > 1:
                    index = pickle.loads(shard.value)
                for d, w in zip(batch.column(0).to_pylist(), texts):
                    for place, n in index.search(w, passage):
                        item.append(index.ids[place])
                        doc.append(d)
                        runs.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(runs, pa.int32())], names=["item_id", "doc_id", "n_runs"])

    return run


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item set and split: items, items leaked, documents hit."""
    hits = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    return items.select("item_id", "item_set", "split").join(hits, "item_id", "left").groupBy("item_set", "split").agg(
        F.count("*").alias("n_items"), F.count("n_docs").alias("n_leaked"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_pairs")
    )
