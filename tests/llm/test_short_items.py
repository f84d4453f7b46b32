"""Operator 1 on short items: every alignment that its rule accepts, by brute force over all diagonals."""

import random

from crategraph.llm import decontaminate


def accepted(doc: list[str], item: list[str]) -> tuple | None:
    """(equal, item start, words) of the best alignment under the operator's rule, trying all diagonals."""
    best = None
    for diagonal in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        same = [doc[diagonal + k] == item[k] for k in range(lo, hi)]
        top = (0, 0, 0)
        for i in range(len(same)):
            score = 0
            for j in range(i, len(same)):
                score += 1 if same[j] else -2
                if score > top[0] or (score == top[0] and j + 1 == top[2] and i < top[1]):
                    top = (score, i, j + 1)
        equal = sum(same[top[1] : top[2]])
        if equal >= min(13, -(-4 * len(item) // 5)) and equal >= 0.75 * (top[2] - top[1]):
            best = max(best or (0,), (equal, diagonal, lo + top[1], top[2] - top[1]))
    return best


def test_one_word_of_a_short_item_may_differ(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    items = [(100 * n + k, [rng.choice(words) for _ in range(n)]) for n in range(3, 10) for k in range(4)]
    docs = []
    for _, item in items:
        for left_out in range(-1, len(item)):
            said = [("other" if k == left_out else x) for k, x in enumerate(item)]
            docs += [[*rng.choices(words, k=6), *said, *rng.choices(words, k=4)], said, said[1:], said[:-1], [*said[: len(said) // 2], "in", *said[len(said) // 2 :]]]
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string").repartition(3)
    items = [*items, (9_999, items[-1][1])]  # an item twice
    found = decontaminate.overlaps(frame, spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    wanted = {(k, i) for k, doc in enumerate(docs) for i, item in items if len(item) >= 5 and accepted(doc, item)}
    assert got == wanted and len(found) == len(got)
    assert len(wanted) > 250 and any(i == 9_999 for _, i in wanted)
