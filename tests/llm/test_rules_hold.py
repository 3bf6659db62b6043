"""URL rules on held-out labels, and licence windows against plain windows."""

from __future__ import annotations

import random

from tracemill.llm import licenses, urls


def test_rules_of_noise_do_not_stay(spark):
    rng = random.Random(1)
    pages = [(i, f"https://www{i % 7}.site{i % 40}.com/{rng.choice(['a', 'b', 'c'])}/{rng.choice(['x', 'y'])}?q{i % 9}=1") for i in range(3000)]
    labels = [(i, int(rng.random() > 0.24), 0) for i in range(3000)]
    pages += [(i, f"https://casino.example{i % 50}.net/deals/{i}") for i in range(3000, 3300)]
    labels += [(i, int(rng.random() < 0.1), 0) for i in range(3000, 3300)]
    df, marks = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {tuple(r["tokens"]) for r in urls.mine(df, marks).collect()}
    assert ("h:casino",) in found and all(set(t) & {"h:casino", "p:deals", "p:0", "h:net"} for t in found)
    noise = urls.mine(df.where("page_id < 3000"), marks).collect()
    assert noise == []
    judged = urls.judge(df.where("page_id < 3000"), marks, rules=()).collect()
    assert len(judged) == 3000 and {r["verdict"] for r in judged} == {"allow"}


def plain_windows(text, at_least=0.8):
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    pairs = [" ".join(p) for p in zip(words, words[1:])]
    found = {}
    for name, template in licenses.LONG_TEMPLATES:
        gram = licenses.template_bigrams(template)
        size = len("".join(c.lower() if c.isalnum() else " " for c in template).split()) - 1
        for at, pair in enumerate(pairs):
            if pair in gram:
                own = set(pairs[at : at + size])
                dice = 2 * len(own & set(gram)) / (len(own) + len(gram))
                if dice >= at_least:
                    found[name] = max(found.get(name, 0), dice)
    return found


def test_windows_equal_plain_windows(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(90):
        name, template = licenses.LONG_TEMPLATES[i % len(licenses.LONG_TEMPLATES)]
        words = template.split()
        for _ in range(int(len(words) * rng.choice([0, 0.05, 0.1, 0.15, 0.2]))):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"]])
        rows.append((i, "before it all " * 5 + " ".join(words) + " and after it" * 4))
        want[i] = plain_windows(rows[-1][1])
    got = {}
    for r in licenses.notices(spark.createDataFrame(rows, "doc_id long, text string"), templates=licenses.TEMPLATES[:1], at_least=0.8).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["dice"]
    # Of overlapping windows only the best licence stays.
    assert sum(bool(w) for w in want.values()) > 40 and any(not w for w in want.values())
    for i, found in want.items():
        best = max(found.values(), default=0)
        mine = {k: v for k, v in got.get(i, {}).items() if k in dict(licenses.LONG_TEMPLATES)}
        assert bool(mine) == bool(found) and (not found or abs(max(mine.values()) - best) < 1e-12)


def test_texts_with_enough_pairs_hold_a_telling_word():
    rng = random.Random(9)
    for _, template in licenses.LONG_TEMPLATES:
        gram = licenses.template_bigrams(template)
        needed = 0.8 / 1.2 * len(gram) - 1e-6
        words = set(licenses.telling_words(gram, needed))
        assert sum(not set(pair.split()) & words for pair in gram) < needed
        for _ in range(50):
            some = rng.sample(gram, int(needed) + 1)
            assert any(set(pair.split()) & words for pair in some)
