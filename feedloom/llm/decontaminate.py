"""Benchmark items inside training texts: a BM25 inverted index of the items, queried by every passage.

The index holds the items, cut into blocks of bounded size; each block is broadcast and all passages of all
texts query it. Item scores are divided by the item's threshold (a part of the score it gives to itself), so
1 is the threshold of every item. A passage goes through two filters: upper bounds over the rare terms of
each item, in numpy for a whole batch, then block-max WAND over the posting lists. What it retrieves is
verified on the words: question and answer, each for itself, must occur in order in a narrow span.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_size

K1, B = 1.2, 0.75
#: Part of its own score an item must reach in a passage, and of that, what its common terms may give.
SCORE_PART, COMMON_PART = 0.5, 0.5
#: Least overlap of question words and of answer words, as sets and in order; span of the latter by their number.
OVERLAP, SPAN = 0.8, 1.25
#: UTF-8 bytes of item text in one broadcast block of the index.
BLOCK_BYTES = 8 << 20
#: Postings in one block of a posting list.
POSTING_BLOCK = 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (runs of letters and digits, lower case) of all texts, and where each text begins among them."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(clean, " "), " ")
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


@dataclass
class Index:
    """One block of items."""

    ids: list
    questions: list[list[str]]
    answers: list[list[str]]
    terms: pa.Array = None
    starts: np.ndarray = None  # posting list of each term
    items: np.ndarray = None
    weights: np.ndarray = None
    peaks: list[np.ndarray] = field(default_factory=list)  # highest weight of each posting block
    tops: np.ndarray = None
    rare: np.ndarray = None  # whether the term is a rare one of the posting's item
    rare_starts: np.ndarray = None  # the same lists with such postings only
    rare_items: np.ndarray = None
    rare_weights: np.ndarray = None
    need: np.ndarray = None  # what an item's rare terms must give
    half: int = 64

    def build(self, df: dict[str, int], count: int, mean: float) -> Index:
        own = [q + a for q, a in zip(self.questions, self.answers)]
        names = sorted({w for words in own for w in words})
        number = {w: i for i, w in enumerate(names)}
        lists: list[list[tuple[int, float, bool]]] = [[] for _ in names]
        self.need = np.ones(len(own))
        for item, words in enumerate(own):
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {w: math.log(1 + (count - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            threshold = SCORE_PART * sum(weight.values())
            common = 0.0
            for w in sorted(weight, key=lambda w: (-df[w], w)):
                part = weight[w] / threshold
                is_common = common + part <= COMMON_PART
                common += part if is_common else 0
                lists[number[w]].append((item, part, not is_common))
            self.need[item] = 1 - common - 1e-9
            self.half = max(self.half, math.ceil(1.25 * len(words)))
        self.terms = pa.array(names, pa.string())
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = [p for x in lists for p in x]
        self.items = np.array([p[0] for p in flat], dtype=np.int64)
        self.weights = np.array([p[1] for p in flat])
        self.rare = np.array([p[2] for p in flat], dtype=bool)
        for a, b in zip(self.starts, self.starts[1:]):
            self.peaks.append(np.maximum.reduceat(self.weights[a:b], np.arange(0, b - a, POSTING_BLOCK)))
        self.tops = np.array([p.max() for p in self.peaks])
        # rare postings only, for the bounds
        keep = np.flatnonzero(self.rare)
        term = np.searchsorted(self.starts, keep, side="right") - 1
        self.rare_starts = np.searchsorted(term, np.arange(len(names) + 1))
        self.rare_items, self.rare_weights = self.items[keep], self.weights[keep]
        return self

    def windows(self, words: pa.Array, starts: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """(text, first word, last word, terms) of the passages whose bounds leave some item possible.

        Passages are ``2 * half`` words long and begin every ``half`` words, so an item, and an item with a
        quarter more words put in, lies whole in one.
        """
        found = pc.index_in(words, value_set=self.terms).fill_null(-1).to_numpy()
        counts = self.rare_starts[1:] - self.rare_starts[:-1]
        at = np.flatnonzero(found >= 0)
        at = at[counts[found[at]] > 0]
        if not len(at):
            return []
        text = np.searchsorted(starts, at, side="right") - 1
        # windows numbered over the whole batch, with one spare before each text
        spans = np.maximum(1, -(-(starts[1:] - starts[:-1]) // self.half))
        base = np.concatenate([[0], np.cumsum(spans + 1)])
        window = base[text] + 1 + (at - starts[text]) // self.half
        fan = counts[found[at]]
        item_at = np.repeat(self.rare_starts[found[at]], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        item, weight = self.rare_items[item_at], self.rare_weights[item_at]
        window, term = np.repeat(window, fan), np.repeat(found[at], fan)
        window, item, term, weight = np.concatenate([window, window - 1]), np.tile(item, 2), np.tile(term, 2), np.tile(weight, 2)
        # a term counts once per window and item
        order = np.lexsort((term, item, window))
        window, item, term, weight = window[order], item[order], term[order], weight[order]
        fresh = np.ones(len(order), bool)
        group = np.ones(len(order), bool)
        group[1:] = (window[1:] != window[:-1]) | (item[1:] != item[:-1])
        fresh[1:] = group[1:] | (term[1:] != term[:-1])
        first = np.flatnonzero(group)
        total = np.add.reduceat(np.where(fresh, weight, 0), first)
        live = np.unique(window[first[total >= self.need[item[first]]]])
        out = []
        for w in live.tolist():
            t = int(np.searchsorted(base, w, side="right") - 1)
            k = w - base[t] - 1
            a = starts[t] + max(k, 0) * self.half
            b = min(starts[t] + (k + 2) * self.half, starts[t + 1])
            own = np.unique(found[a:b])
            out.append((t, int(a), int(b), own[own >= 0]))
        return out

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items whose score over these terms reaches 1, by block-max WAND."""
        ends = self.starts[terms + 1]
        at = self.starts[terms].copy()
        hits = []
        items, weights, done = self.items, self.weights, np.iinfo(np.int64).max
        here = np.where(at < ends, items[np.minimum(at, len(items) - 1)], done)
        while True:
            order = np.argsort(here, kind="stable")
            bound = np.cumsum(self.tops[terms[order]])
            pivot = int(np.searchsorted(bound, 1 - 1e-9))
            if pivot >= len(order) or here[order[pivot]] == done:
                return hits
            goal = here[order[pivot]]
            while pivot + 1 < len(order) and here[order[pivot + 1]] == goal:
                pivot += 1
            lead = order[: pivot + 1]
            # upper bound from the posting blocks that would hold the pivot item
            near, blocks_end = 0.0, done
            place = []
            for i in lead.tolist():
                start, end = self.starts[terms[i]], ends[i]
                p = at[i] + int(np.searchsorted(items[at[i] : end], goal))
                place.append(p)
                if p < end:
                    block = int(p - start) // POSTING_BLOCK
                    near += self.peaks[terms[i]][block]
                    last = min(start + (block + 1) * POSTING_BLOCK, end) - 1
                    blocks_end = min(blocks_end, int(items[last]))
            if near >= 1 - 1e-9:
                score = 0.0
                for i, p in zip(lead.tolist(), place):
                    if p < ends[i] and items[p] == goal:
                        score += weights[p]
                if score >= 1 - 1e-9:
                    hits.append((int(goal), float(score)))
                skip = goal + 1
            else:  # no item up to the end of the shortest block can reach 1
                beyond = here[order[pivot + 1]] if pivot + 1 < len(order) else done
                skip = max(goal + 1, min(blocks_end + 1, int(beyond)))
            for i in lead.tolist():
                at[i] += int(np.searchsorted(items[at[i] : ends[i]], skip))
                here[i] = items[at[i]] if at[i] < ends[i] else done

    def verify(self, item: int, words: list[str]) -> tuple[float, float] | None:
        """Overlaps of question and answer with the passage, if both suffice, also in order and side by side."""
        q, a = self.questions[item], self.answers[item]
        there = set(words)
        asked = sum(w in there for w in q) / len(q) if q else 1.0
        told = sum(w in there for w in a) / len(a) if a else 1.0
        return (asked, told) if asked >= OVERLAP and told >= OVERLAP and beside(q, a, words) else None

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap); the best passage of each text and item."""
        words, starts = words_of(texts)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for text, a, b, terms in self.windows(words, starts):
            found = self.retrieve(terms)
            if found:
                passage = words.slice(a, b - a).to_pylist()
                for item, score in found:
                    if (seen := self.verify(item, passage)) and (score, *seen) > best.get((text, item), (0.0, 0.0, 0.0)):
                        best[text, item] = (score, *seen)
        return [(*k, v[0] * SCORE_PART, *v[1:]) for k, v in sorted(best.items())]


def spans(part: list[str], words: list[str]) -> list[tuple[int, int]]:
    """(first word, word after the last) where OVERLAP of ``part`` occurs in order within SPAN times its length.

    One span, the shortest, per first word: a longest common subsequence in bits, one word of the text a step.
    """
    need, width = math.ceil(OVERLAP * len(part) - 1e-9), math.ceil(SPAN * len(part))
    bits: dict[str, int] = {}
    for i, w in enumerate(part):
        bits[w] = bits.get(w, 0) | 1 << i
    rows = [bits.get(w, 0) for w in words]
    known = np.concatenate([[0], np.cumsum([r > 0 for r in rows])])
    start = np.arange(len(words))
    enough = known[np.minimum(start + width, len(words))] - known[start] >= need
    full, out = (1 << len(part)) - 1, []
    for s in np.flatnonzero(enough).tolist():
        if not rows[s]:
            continue
        state = full  # zero bits: where the subsequence grew
        for e in range(s, min(s + width, len(words))):
            if row := rows[e]:
                hit = state & row
                state = (state + hit | state - hit) & full
                if len(part) - state.bit_count() >= need:
                    out.append((s, e + 1))
                    break
    return out


def beside(question: list[str], answer: list[str], words: list[str]) -> bool:
    """Whether both parts occur, the question also without the words that make the answer; an empty part always does."""
    if not question or not answer:
        return bool(spans(question or answer, words))
    asked = spans(question, words)
    told = spans(answer, words) if asked else []
    return any(spans(question, words[:s] + words[e:]) for s, e in told)


def _tokens(items: DataFrame, item_id: str, question: str, answer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for column in batch.columns[1:]:
                words, starts = words_of(column)
                flat = words.to_pylist()
                lists.append(pa.array([[w for w in flat[a:b] if w] for a, b in zip(starts, starts[1:])], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["i", "q", "a"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(
        F.col(item_id).alias("i"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a")
    ).mapInArrow(run, f"i {kind}, q array<string>, a array<string>").filter(F.size("q") + F.size("a") > 0)


def indexes(items: DataFrame, item_id: str = "item_id", question: str = "question", answer: str = "answer") -> Iterator[Index]:
    """The index, block by block. Document frequencies and the mean length cover all items."""
    words = F.concat("q", "a")
    tokens = _tokens(items, item_id, question, answer).withColumn("words", words)
    facts = tokens.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean"),
        F.sum(F.octet_length(F.array_join("words", " "))).alias("size"),
    ).first()
    if not facts["n"]:
        return
    df = tokens.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    blocks = math.ceil(facts["size"] / BLOCK_BYTES)
    placed = tokens.withColumn("block", F.expr(f"pmod(xxhash64(q, a), {blocks})"))
    for block in range(blocks):
        own = placed.filter(F.col("block") == block)
        rows = own.select("i", "q", "a").collect()  # about BLOCK_BYTES of text
        counts = own.select(F.explode(F.array_distinct("words")).alias("w")).distinct().join(df, "w").collect()
        if rows:
            rows.sort(key=lambda r: (str(r["i"]), r["q"], r["a"]))
            index = Index([r["i"] for r in rows], [r["q"] for r in rows], [r["a"] for r in rows])
            yield index.build({r["w"]: r["df"] for r in counts}, facts["n"], facts["mean"])


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
    question: str = "question", answer: str = "answer",
) -> DataFrame:
    """One row per text and item found in it: ``key``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``.

    ``score`` is the passage's BM25 score as a part of the item's own. Every passage of every whole text
    queries every item; nothing is shuffled. Null and empty texts contain nothing; items without a word are in
    nothing; a null answer asks for the question alone. Repeated rows and repeated items are each reported;
    null keys stay. No items or no documents give no rows. Only the named columns are read.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    item_type, item_kind = to_arrow_type(items.schema[item_id].dataType), items.schema[item_id].dataType.simpleString()
    schema = f"k {kind}, i {item_kind}, score double, q double, a double"
    inner = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = []
    for index in indexes(items, item_id, question, answer):
        shared = spark.sparkContext.broadcast(index)  # bounded by BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in by_size(batches, 1, 8 << 20):
                hits = shared.value.search(batch.column(1))
                if hits:
                    keys = batch.column(0).take(pa.array([h[0] for h in hits]))
                    names = pa.array([shared.value.ids[h[1]] for h in hits], item_type)
                    numbers = [pa.array([h[j] for h in hits], pa.float64()) for j in (2, 3, 4)]
                    yield pa.RecordBatch.from_pydict(dict(zip(("k", "i", "score", "q", "a"), (keys, names, *numbers))))

        found.append(inner.mapInArrow(run, schema))
    rows = reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)
    return rows.toDF(key, item_id, "score", "question_overlap", "answer_overlap")


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text contains no item."""
    names, spark = docs.columns, docs.sparkSession
    at = names.index(text)
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for index in indexes(items, **columns):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in by_size(batches, at, 8 << 20):
                hit = {h[0] for h in shared.value.search(batch.column(at))}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)])) if hit else batch

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*names)


def question_and_answer(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Items of one text each: the last sentence is the answer, what stands before it the question."""
    parts = rf"(?s)^(.*[.!?])\s+(\S.*)$"
    body = F.coalesce(F.col(text), F.lit(""))
    answer = F.regexp_extract(body, parts, 2)
    return benchmark.select(
        item_id, F.when(answer == "", body).otherwise(F.regexp_extract(body, parts, 1)).alias("question"),
        F.when(answer != "", answer).alias("answer"),
    )
