"""Benchmark items that stand in a text with a changed word, a label or the answer first."""

import random

from feedloom.llm import decontaminate
from feedloom.llm.common import ready


def test_items_with_small_changes_are_found(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]
    items, texts, want = [], [], set()
    for i in range(30):
        q, a = some(12 + i % 5), some(1 + i % 7)
        items.append((i, " ".join(q), " ".join(a)))
        changed = list(q)
        changed[len(q) // 2] = "changed"
        for body in ([*q, *a], [*changed, *a], [*q, "answer", "is", *a], [*a, *some(3), *q], [*q, *some(30), *a]):
            want.add((len(texts), i))
            texts.append(" ".join([*some(20), *body, *some(20)]))
        mixed = [*q, *a]
        rng.shuffle(mixed)
        texts += [" ".join(mixed), " ".join([*some(20), *q, *some(20)]), " ".join([*q[: len(q) // 2], *some(40), *q[len(q) // 2 :], *a])]
    docs = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table = spark.createDataFrame(items, "item_id int, question string, answer string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, table).collect()} == want


def test_span_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        part, words = ([rng.choice("abcdef") for _ in range(n)] for n in (rng.randint(1, 9), 20))
        need, width = -(-8 * len(part) // 10), -(-5 * len(part) // 4)

        def common(x):
            row = [0] * (len(part) + 1)
            for w in x:
                row = _next(row, part, w)
            return row[-1]

        want = []
        for s in range(20):
            for e in range(s + 1, min(s + width, 20) + 1):
                if words[s] in part and common(words[s:e]) >= need:
                    want.append((s, e))
                    break
        assert decontaminate.spans(part, words) == want


def _next(row, part, word):
    out = [0]
    for j, p in enumerate(part):
        out.append(row[j] + 1 if p == word else max(row[j + 1], out[j]))
    return out
