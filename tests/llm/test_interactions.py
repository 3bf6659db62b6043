"""The audit of filters against counting documents order by order, and the matrix against plain counts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tracemill.llm import interactions

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    fails = []
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        smaller = i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows)
        own = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
               "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}
        fails.append((i, source or "", {x for x in own if own[x]}))
    out = defaultdict(Counter)
    for part in {s for _, s, _ in fails}:
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                c = out[part, order, step]
                for i, own_part, bad in fails:
                    if own_part == part:
                        removed = letter in bad and not bad & set(order[: step - 1])
                        c["kept"] += not bad & set(order[:step])
                        c["removed"] += removed
                        c["redundant"] += letter in bad and not removed
                        c["unique_fails"] += bad == {letter}
                        c["good_lost"] += removed and i in good
                        c["toxic_lost"] += removed and i in toxic
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s, *(c[x] for x in names), shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


@pytest.fixture(scope="module")
def odd():
    body = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, body, "a"), (1, body, "a"), (2, body, "a"), (3, body, "b"), (None, body, "a"), (None, body, None), (0, None, None), (4, "", ""), (5, " \t\n ", "b"),
        (6, "BIG Words " * 40, "a"), (7, "same " * 60, "a"), (8, body + " #1", "b"), (9, body + " é\xa0É\x1cz", "a"), (1, "other text", "b"),
        (10, " ".join(f"x{k % 9000}" for k in range(40_000)), "a"), (11, "x" * 200_000, "b"), (None, None, "a"), (12, body.replace("word1", "Word1"), "b"),
    ]
    rows += [(100 + k, "copied " + body, "ab"[k % 2]) for k in range(30)]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, None), (None, 1, 1), (101, 1, 1), (102, 1, 0), (7, 0, 1), (555, 1, 1)]
    return rows, labels


def test_audit_equals_plain_orders(spark, odd):
    rows, labels = odd
    docs = spark.createDataFrame([(*r, 1, "p", True, 2) for r in rows], DOCS + ", part int, mask string, good boolean, n long").repartition(5)
    marks = spark.createDataFrame([(*r, 3) for r in labels], LABELS + ", digest int")
    got = [tuple(r) for r in interactions.audit(docs, marks, range_bytes=60_000).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    ).collect()]
    assert len(got) == 3 * 600 and set(got) == plain(rows, labels)


def test_empty_tables(spark, odd):
    rows, labels = odd
    none = spark.createDataFrame([], LABELS)
    assert interactions.audit(spark.createDataFrame([], DOCS), none).collect() == []
    got = interactions.audit(spark.createDataFrame(rows[:3], DOCS), none).collect()
    assert len(got) == 600 and {r["good_lost"] for r in got} == {0}


def test_matrix_holds_all_words(spark, odd):
    """One number for a word in all shards, and the counts of the texts."""
    rows, _ = odd
    shards = interactions.matrix(spark.createDataFrame(rows, DOCS).repartition(4), range_bytes=100_000).collect()
    assert len({s["shard"] for s in shards}) == len(shards) > 1
    number, seen, found = {}, {}, []
    texts = defaultdict(list)
    for i, text, source in rows:
        texts[i, source or "", text or ""].append(Counter(WORD.findall(text or "")))
    import hashlib

    by_digest = {(i, s, hashlib.sha256(t.encode()).digest()): c[0] for (i, s, t), c in texts.items()}
    for s in shards:
        for k, key in enumerate(zip(s["doc_ids"], s["parts"], s["digests"])):
            a, b = s["indptr"][k], s["indptr"][k + 1]
            entries = dict(zip(s["indices"][a:b], s["counts"][a:b]))
            want = by_digest[key[0], key[1], bytes(key[2])]
            assert len(entries) == b - a and sorted(entries.values()) == sorted(want.values())
            found.append((want, entries))
    # Words that are alone in having a count name their number; any other use of the number must be that word.
    for want, entries in found:
        once = Counter(want.values())
        for word, n in want.items():
            if once[n] == 1:
                (index,) = [i for i, m in entries.items() if m == n]
                assert number.setdefault(word, index) == index and seen.setdefault(index, word) == word
    for want, entries in found:
        assert {number[w] for w in want if w in number} <= set(entries)
    every = {i for _, entries in found for i in entries}
    assert len(every) == len({w for want, _ in found for w in want})
