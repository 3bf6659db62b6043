"""Phrases against counts of all windows, and the compacted graph against plain walks."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tracemill.llm import collocations

DOCS = "doc_id long, text string, lang string, source string"


def plain(rows, least=10, inside=50, most=2000):
    """All windows of one to three words, counted and scored one by one."""
    grams, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                grams[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in grams.items():
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {p for g, a in often.items() if len(g) == 3 for p in (g[:2], g[1:]) if p in often and 100 * a >= inside * often[p]}
        scored = []
        for g, a in often.items():
            if g not in gone:
                score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def made(seed, texts):
    rng = random.Random(seed)
    word = ["a", "b", "C", "é", "dd", "\x1c", "x\xa0y", "-", "o'n", "中"]
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for i in range(texts):
        parts = [rng.choice(word) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(40))]
        text = "".join(parts) + (passage if rng.random() < 0.4 else "") + rng.choice(["", " ", ". a b a b a b a b"])
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize(("least", "inside", "bucket_bytes"), [(10, 50, 16_000_000), (2, 80, 700)])
def test_phrases_equal_plain_counts(spark, least, inside, bucket_bytes):
    rows = made(least, 120) + [(None, "en"), ("", None), (" \n\t.", "fr"), ("loop " * 3000, "en"), ("one", "xx")]
    df = spark.createDataFrame([(i % 50 or None, *row, "s", 1, "g", 2) for i, row in enumerate(rows)], DOCS + ", n int, gram string, rank int")
    got = collocations.phrases(df.repartition(4), least=least, inside=inside, bucket_bytes=bucket_bytes).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, least, inside)
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_first_phrases_only(spark):
    rows = made(3, 200)
    got = collocations.phrases(spark.createDataFrame([(0, *r, "s") for r in rows], DOCS), least=2, most=7).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 2, 50, 7)


def test_empty_table(spark):
    assert collocations.phrases(spark.createDataFrame([], DOCS)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = [(9_999_999_999, 9_999_999_999, 10_000_000_000), (10, 10, 9_999_999_999_999), (3_000_000_000_000, 3_000_000_000_007, 3_000_000_000_001)]
    got = spark.createDataFrame(big, "a long, l long, r long").select("a", "l", "r", collocations._score("a", "l", "r").alias("score")).collect()
    assert [r["score"] for r in got] == [1_000_000 * a * a // (left * right) for a, left, right in big]


def test_grams_of_all_widths(spark):
    rows = made(5, 80)
    grams = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.lower()):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                grams[lang or "und", k].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    got = collocations.counts(spark.createDataFrame([(0, *r, "s") for r in rows], DOCS), least=1, bucket_bytes=500).where("gram IS NOT NULL").collect()
    want = {(lang, k, g): n for (lang, k), own in grams.items() for g, n in own.items()}
    assert {(r["lang"], r["width"], r["gram"]): r["n"] for r in got} == want and len(got) == len(want)


def walked(rows, least):
    """The paths of the frequent graph, edge by edge."""
    f = Counter()
    for text, _ in rows:
        for piece in text.split("."):
            words = piece.split()
            f.update(tuple(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1))
    edges = {g: n for g, n in f.items() if len(g) == 3 and n >= least}
    into, out = defaultdict(list), defaultdict(list)
    for g in edges:
        out[g[:2]].append(g)
        into[g[1:]].append(g)
    inner = {v for v in out if len(out[v]) == 1 == len(into[v]) and edges[out[v][0]] == edges[into[v][0]] == f[v]}
    found = {}

    def follow(first):
        place, g = 0, first
        while g not in found:
            found[g] = (first, place)
            if g[1:] not in inner:
                break
            place, g = place + 1, out[g[1:]][0]

    for g in edges:
        if g[:2] not in inner:
            follow(g)
    while rest := sorted((" ".join(g), g) for g in edges if g not in found):
        follow(rest[0][1])
    return {" ".join(g): (" ".join(p), place, edges[g]) for g, (p, place) in found.items()}


def test_paths_equal_walks(spark):
    chain = " ".join(f"c{k:03d}" for k in range(150))
    rows = [(chain, "en")] * 3 + [("c010 c011 c012 other. " + chain[:200], "en")]
    rows += [("z y x w z y x w z y", "en")] * 2  # flows out at its end, so one node of the cycle is none of the inner ones
    rows += [(" ".join(f"d{k}" for k in range(9)), "en")] * 3 + [("l l l l l", "en")] * 2
    grams = collocations.counts(spark.createDataFrame([(0, *r, "s") for r in rows], DOCS), least=2)
    got = collocations.paths(*collocations.graph(grams)).collect()
    assert {r["gram"]: (r["path"], r["place"], r["n"]) for r in got} == walked(rows, 2)
    assert max(r["place"] for r in got) > 100 and len(got) == len({r["gram"] for r in got})


def test_cycles_begin_at_their_smallest_gram(spark):
    """A cycle without a way in does not come from pieces; the compaction takes any graph."""
    ring = ["q", "r", "a", "s", "t"]
    grams = [" ".join((ring * 2)[k : k + 3]) for k in range(5)]
    edges = spark.createDataFrame([("en", g, g.rsplit(" ", 1)[0], g.split(" ", 1)[1], 4) for g in grams], "lang string, gram string, tail string, head string, n long")
    ends = [(g.rsplit(" ", 1)[0], g, grams[k - 1]) for k, g in enumerate(grams)]
    nodes = spark.createDataFrame([("en", v, after, before, True) for v, after, before in ends], "lang string, node string, after string, before string, inner boolean")
    got = {r["gram"]: (r["path"], r["place"]) for r in collocations.paths(edges, nodes).collect()}
    first = grams.index(min(grams))
    assert got == {grams[(first + k) % 5]: (min(grams), k) for k in range(5)}
