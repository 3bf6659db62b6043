"""What the operators must not leave out, each on rows made for it."""

from __future__ import annotations

import textwrap
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tracemill.llm import decontaminate, licenses, line_rules, sharding, tokens

DOCS = "doc_id long, text string, source string, n_chars long"


def own_words(name, n):
    """Words that differ in letters, since digits of lines count as equal."""
    return "".join(chr(97 + int(c)) if c.isdigit() else c for c in " ".join(f"{name}x{k}" for k in range(n)))


def test_lines_above_the_limit_are_removed(spark):
    line = own_words("nav", 20)
    rows = [(i, f"{line}\n{own_words(i, 60)}\n\n  {line.upper()}", "a", 0) for i in range(25)]
    rows += [(100, f"{line}\n{own_words(100, 45)}", "a", 0), (101, f"{own_words(101, 70)}", "a", 7), (102, f"{line}\n{own_words(102, 60)}", None, 7)]
    rows += [(103, f"{line}\n" + " ".join([own_words(103, 20)] * 2 + [own_words("tail", 38)]), "a", 0)]  # half of what is left, not of the whole, repeats
    df = spark.createDataFrame(rows, DOCS)
    options = dict(limit_share=0.02, limit_docs=20, depleted=0.8)
    got = {r["doc_id"]: r for r in line_rules.passing(df, **options).collect()}
    assert sorted(got) == [*range(25), 101, 102]
    for i in range(25):
        assert got[i]["text"] == f"{own_words(i, 60)}\n" and got[i]["n_chars"] == len(got[i]["text"])
    assert [tuple(got[i]) for i in (101, 102)] == [r for r in rows if r[0] in (101, 102)]
    judged = {r["doc_id"]: r for r in line_rules.verdicts(df, **options).collect()}
    assert {i for i, r in judged.items() if r["kept"]} == set(got)
    assert not judged[100]["base_failed"] and not judged[103]["base_failed"] and judged[100]["n_words"] == 65


def test_line_rule_alone_rejects_by_default(spark):
    """With the production limits, on a host so large that a share of its texts would let the line pass."""
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    line, some = own_words("nav", 40), own_words("foot", 20)
    rows = [(i, f"{line}\n{own_words(letters(i) + 'y', 60)}", "a", 0) for i in range(7)]
    rows += [(100 + i, f"{some}\n{own_words(letters(i) + 'z', 60)}", "a", 0) for i in range(7)]
    rows += [(200 + i, f"{own_words('rare', 40)}\n{own_words(letters(i) + 'v', 60)}", "a", 0) for i in range(6)]
    rows += [(1000 + i, own_words(letters(i) + "w", 50), "a", 0) for i in range(480)]
    got = line_rules.verdicts(spark.createDataFrame(rows, DOCS)).collect()
    assert not any(r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(7))
    assert {r["doc_id"] for r in got if r["boilerplate_words"]} == {*range(7), *range(100, 107)}


def test_repeated_items_and_passes_change_nothing(spark):
    own = [f"item{k}" for k in range(59)]
    near = own[:50] + [f"other{k}" for k in range(9)]
    docs = [(1, " ".join(["before", *own[:30], "edited", *own[31:], "after"])), (2, " ".join(near[:5] + ["edited"] + near[6:])), (3, "nothing of it " * 30)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for times, words in ((1, 200_000), (3, 200_000), (3, 1)):
        items = [(i, " ".join(x)) for i, x in enumerate([own] * times + [near] + [own[:50] + [f"third{k}" for k in range(9)]])]
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = decontaminate.leaks(docs, bench, words_a_pass=words).collect()
        text_of = dict(items)
        found.append({(r["doc_id"], text_of[r["item_id"]], r["start_word"], round(r["similarity"], 9)) for r in got})
        assert sum(r["doc_id"] == 1 and text_of[r["item_id"]] == " ".join(own) for r in got) == times
        assert any(r["doc_id"] == 2 and text_of[r["item_id"]] == " ".join(near) for r in got)
    assert found[0] == found[1] == found[2]


def test_cut_items_are_leaks_and_rows_without_id_go(spark):
    own = [f"item{k}" for k in range(59)]
    bench = spark.createDataFrame([(9, " ".join(own))], "item_id long, text string")
    rows = [(1, " ".join(own[2:57])), (2, " ".join(own[:40])), (None, "so " + " ".join(own)), (None, "free of it"), (3, None), (3, " ".join(own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["start_word"], round(r["similarity"], 6)) for r in got) == [(-1, 1, 1.0), (1, 0, round(51 / 55, 6)), (3, 0, 1.0)]
    kept = decontaminate.clean(docs, bench)
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id = 2 OR text = 'free of it' OR text IS NULL").collect()))


def test_pipeline_joins_at_five_words_and_80_percent(spark):
    body = [f"w{k}" for k in range(104)]
    rows = [(1, " ".join(body)), (2, " ".join(body + [f"more{k}" for k in range(22)])), (3, " ".join(body + [f"tail{k}" for k in range(30)]))]
    grams = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    alike = [len(grams[0] & g) / len(grams[0] | g) for g in grams]
    assert 0.8 <= alike[1] < 0.85 and alike[2] < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_copies(spark, docs, "").collect()) == [1, 3]


def test_whole_licences_are_found_wrapped_and_embedded(spark):
    before, after = own_words("before", 90), own_words("after", 90)
    rows, expected = [], set()
    for i, (name, text) in enumerate(licenses.LONG_TEMPLATES):
        wrapped = textwrap.fill(text, 70, initial_indent=" * ", subsequent_indent=" * ")
        rows += [(i, wrapped), (100 + i, f"{before}\n{wrapped}\n{after}"), (200 + i, f"{before} {text} {after}")]
        expected |= {(k + i, name) for k in (0, 100, 200)}
    rows += [(999, "Some page.\nThis work is licensed under a Creative Commons\nAttribution 4.0 International License.\nBye.")]
    got = licenses.notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got if r["license"] != "BSD"} == expected | {(999, "CC-BY-4.0")}


@pytest.mark.parametrize("most", [200, 4_000_000])
def test_added_tokens_are_encoded_as_the_library_does(most):
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b  c", "plain text", "<|endoftext |>", "", "two\n <|endoftext|><|endoftext|> x"]
    library = Tokenizer.from_file(path)
    expected = [library.encode(text, add_special_tokens=False).ids for text in made]
    got = []
    for _, ids, begins in tokens.encoded(pa.array(made), tokens.encoder(path), most):
        got += [ids[a:b].tolist() for a, b in zip(begins.tolist(), begins[1:].tolist())]
    assert got == expected and expected[1] == [library.token_to_id("<|endoftext|>")]


def test_equal_records_spread_over_buckets(spark):
    """A bucket is one value of one row; the largest is looked at through the order that it leaves in the places."""
    rows = [(None, None)] * 3000 + [(7, "equal text")] * 3000 + [(100 + i, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.read_shards(spark, sharding.write_shards(docs, shards=9, bucket_bytes=8000)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    in_shard = Counter((r["shard"], r["doc_id"] if r["doc_id"] in (None, 7) else "own") for r in got)
    assert len(in_shard) == 27 and max(in_shard.values()) < 600
