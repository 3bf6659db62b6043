"""The pipeline's operators against plain versions, on hand-made rows and the small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from tracemill.llm import chat, classifier, components, decontaminate, huffman, jaccard, licenses, line_rules, packing, queries, sharding, tokens, urls, words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    body = " ".join(f"word{k}" for k in range(80))
    rows = [
        (1, body, "en", "a", 5), (1, body, "en", "a", 5), (2, body, None, None, None), (None, body + " more", "en", "a", 1), (3, None, "en", "b", 0),
        (4, "", "en", "b", 0), (5, LONG, "en", "a", 9), (6, " \n\t ", "en", "a", 1), (7, "one two", "en", "a", 7), (8, "ONE  two", "en", "a", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS rep", "'x' AS _digest", "2 AS score", "3 AS n", "'t' AS x", "4 AS row", "5 AS host")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def ids_of(text, end):
    return np.array([*tokens.encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_equals_library_on_any_cut():
    rng = random.Random(5)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", ".", "'s", "ñé", "<|endoftext|>", "1", "½", "\x1c", "\xa0", "　", "😀", "中", "\r\n", ",", "\x85"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    own = tokens.encoder(TOKENIZER)
    got = []
    for _, ids, begins in tokens.encoded(pa.array(made), own, 2000):
        cuts = begins.tolist()
        got += [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    assert got == [own.whole(text) for text in made]


def test_words_and_shingles_in_runs(spark, tables):
    made = [*texts_of(spark, tables).values(), "", " \n", "É à A"]
    column, at = pa.array(made), 0
    for first, stop in words.portions(column, 5000):
        assert first == at
        at = stop
        hashes, begins = words.word_hashes(column.slice(first, stop - first), lower=True)
        for j, text in enumerate(made[first:stop]):
            own = [w.decode() for w in text.encode().lower().split()]
            assert begins[j + 1] - begins[j] == len(own)
            assert len(set(hashes[begins[j] : begins[j + 1]].tolist())) == len(set(own))
    assert at == len(made)


@pytest.mark.parametrize("limit", [16, 100])
def test_cuts_are_optimal(limit):
    rng = random.Random(limit)
    for _ in range(60):
        places = [0]
        while len(places) < 14:
            places.append(places[-1] + rng.randrange(1, limit // 2))
        penalties = [rng.choice([0, 3, 9]) for _ in places]
        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = places[j] - places[i]
                if n <= limit:
                    best[j] = min(best[j], best[i] + packing.padded(n, limit) - n + penalties[j])
        cuts = packing.choose_cuts(places, penalties, limit)
        cost = sum(packing.padded(places[b] - places[a], limit) - places[b] + places[a] + penalties[b] for a, b in zip(cuts, cuts[1:]))
        assert cost == best[-1]


def check_pieces(rows, expected):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    for own in by_window.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["sequence_tokens"] <= 2048
    for doc_id, ids in expected.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    full = sum(packing.padded(x[0]["sequence_tokens"], 2048) for x in by_window.values())
    return 1 - sum(r["length"] for r in rows) / full


def test_packing(spark, tables):
    rows = queries.op3_packing(spark, tables).collect()
    assert check_pieces(rows, {i: ids_of(t, 1) for i, t in texts_of(spark, tables).items()}) < 0.02


def test_packing_odd_rows(spark, odd, none):
    rows = packing.pack(odd, TOKENIZER, block_tokens=500).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(r["text"], 1)) for r in odd.collect())
    check_pieces([r for r in rows], {5: ids_of(LONG, 1), 4: ids_of("", 1)})
    assert packing.pack(none, TOKENIZER).collect() == []


def test_code_lengths_are_limited_and_optimal():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 10**6, 300))
    lengths = huffman.code_lengths(counts, 20)
    assert (2.0**-lengths).sum() == 1 and (np.diff(lengths) <= 0).all()
    short = huffman.code_lengths(2 ** np.arange(20), 6)
    assert short.max() == 6 and (2.0**-short).sum() == 1
    assert huffman.code_lengths(np.array([7])).tolist() == [1]
    code = huffman.Code(np.arange(300), lengths)
    ids = rng.integers(0, 300, 1000)
    bits, offsets = code.encode(ids)
    assert (code.decode([(bits, offsets, 1000), (bits, offsets, 1000)])[1] == ids).all()


def test_token_ids(spark, tables):
    texts, at = texts_of(spark, tables), 0
    for r in queries.op7_token_ids(spark, tables).orderBy("doc_id").collect():
        ids = ids_of(texts[r["doc_id"]], 0)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)




def test_token_ids_odd_rows(spark, odd, none):
    got = huffman.read(spark, huffman.write(odd, TOKENIZER, block_tokens=200), with_ids=True).collect()
    expected = Counter((r["doc_id"], tuple(ids_of(r["text"], 0).tolist())) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expected
    assert sorted(r["start"] for r in got)[0] == 0
    assert huffman.read(spark, huffman.write(none, TOKENIZER)).collect() == []


def plain_components(texts):
    sets = {}
    for i, text in texts.items():
        w = [x.decode() for x in text.encode().lower().split()]
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    name = {i: i for i in texts}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                name[b] = a
    return {(i, len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("row_cost", [jaccard.ROW_COST, 0.0])
def test_jaccard_near_copies(spark, row_cost):
    """Chains of near copies of texts of all lengths, with and without merged units (row_cost 0 makes them free)."""
    rng = random.Random(int(row_cost) + 1)
    texts, i = {}, 0
    for n in [*range(1, 30), 60, 200, 900]:
        own = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(5):
            texts[i] = " ".join(own)
            i += 1
            own = list(own)
            for _ in range(rng.randrange(0, 1 + n // 25 + (n > 6))):
                own[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard.join(df, row_cost=row_cost).collect()} == plain_components(texts)


def test_jaccard_in_many_ranges(spark, tables, monkeypatch):
    """Ranges made in several steps give the same links."""
    monkeypatch.setattr(jaccard, "FAN", 5)
    monkeypatch.setattr(jaccard, "RANGE_ROWS", 20_000)
    texts = dict(list(texts_of(spark, tables).items()))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard.join(df).collect()} == plain_components(texts)


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_shared_signatures_from_packs(ranges):
    """Packs, cut again and read in small batches, give the rows whose signature another document has."""
    rng = np.random.default_rng(ranges)
    ids = np.array([-(2**63), -5, 0, 3, 2**40, 2**63 - 1])
    rows, sent = defaultdict(set), []
    for _ in range(30):
        sig = rng.integers(0, 1 << jaccard.SIGNATURE_BITS, 20)
        sig[:5] = rng.integers(0, 60, 5) << 40
        doc, whole = rng.choice(ids, 20), rng.random(20) < 0.5
        for x, d, w in zip(sig.tolist(), doc.tolist(), whole.tolist()):
            rows[x].add((d, w))
        coarse = jaccard._cut(sig, doc, whole, 2)
        sent += [r for fine in jaccard._finer([coarse], ranges) for r in fine.to_pylist()]
    sent.sort(key=lambda r: r["range"])
    batches = [pa.RecordBatch.from_pylist(sent[i : i + 3]) for i in range(0, len(sent), 3)]
    got = defaultdict(lambda: defaultdict(bool))
    for batch in jaccard._shared(batches):
        for r in batch.to_pylist():
            got[r["sig"]][r["doc_id"]] |= r["whole"]
    want = {x: {d: any(w for e, w in own if e == d) for d, _ in own} for x, own in rows.items() if len({d for d, _ in own}) > 1}
    assert {x: dict(v) for x, v in got.items()} == want


def test_jaccard_query_and_odd_rows(spark, tables, odd, none):
    assert {tuple(r) for r in queries.op6_jaccard(spark, tables).collect()} == plain_components(texts_of(spark, tables))
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.join(odd).collect()), key=str)
    assert got == sorted([(1, 77, 1), (1, 77, 1), (2, 77, 1), (-1, 78, None), (3, 0, 3), (4, 0, 4), (5, 29997, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7)], key=str)
    assert jaccard.join(none).collect() == []
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 7), (200, 201), (202, 201), (5, 5)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in [*range(41), 100]} | {(k, 200) for k in (200, 201, 202)}


def test_leaks(spark, tables, none):
    bench = spark.read.parquet(f"{tables}/benchmark.parquet").collect()
    items = {r["item_id"]: r["text"].lower().split() for r in bench}
    expected = set()
    for i, text in texts_of(spark, tables).items():
        own = [tuple(text.lower().split()[k : k + 5]) for k in range(len(text.split()) - 4)]
        for item, w in items.items():
            grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
            inside = set(grams)
            for k in [k for k in range(len(own) - len(grams) + 1) if own[k] in inside or own[k + len(grams) // 2] in inside]:
                a, b = Counter(own[k : k + len(grams)]), Counter(grams)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    expected.add((i, item))
    got = queries.op1_leaks(spark, tables)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == expected
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    blocks = decontaminate.leaks(docs, spark.read.parquet(f"{tables}/benchmark.parquet"), words_a_pass=300)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == expected
    assert decontaminate.leaks(none, spark.createDataFrame(bench)).collect() == []


def test_leaks_in_edited_and_odd_texts(spark, odd):
    own = [f"item{k}" for k in range(60)]
    edited = own[:30] + ["other"] + own[31:]
    bench = spark.createDataFrame([(9, " ".join(own)), (10, None), (11, ""), (12, "one two")], "item_id long, text string")
    rows = [(1, "before it " + " ".join(edited) + " after"), (2, " ".join(own[:20])), (None, " ".join(own)), (3, "x " * 50_000 + " ".join(own).upper())]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["start_word"]) for r in got} == {(1, 9, 2), (None, 9, 0), (3, 9, 50_000)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, bench).collect()} == {(7, 12), (8, 12)}
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2


def plain_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times, covered = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), set()
    for k in range(len(w) - 2):
        if times[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_line_rules(spark, tables):
    got = {r["doc_id"]: tuple(r)[1:7] for r in queries.op4_quality_rules(spark, tables).collect()}
    assert got == {i: plain_rules(t) for i, t in texts_of(spark, tables).items()}


def test_boilerplate_depletes_documents(spark, none):
    line = " ".join(f"nav{k}" for k in range(30))
    body = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    rows = [(i, f"{line}\n{line.upper()}\n{body(i, 5)}", "a") for i in range(30)] + [(100 + i, f"{line}\n{body(i, 90)}", "a") for i in range(5)]
    rows += [(200, f"{line}\n{line.upper()}\n{body(7, 5)}", None)] + [(300 + i, body(999, 60), "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in line_rules.verdicts(df, limit_share=0.1, limit_docs=20).collect()}
    assert [i for i, kept in sorted(got.items()) if not kept] == [i for i in range(30)]  # not the same text at a null host, nor 40 copies
    passing = line_rules.passing(df, limit_share=0.1, limit_docs=20)
    assert sorted(r["doc_id"] for r in passing.collect()) == sorted(i for i, kept in got.items() if kept)
    assert line_rules.verdicts(none).collect() == [] and line_rules.passing(none).collect() == []


def test_line_rules_odd_rows(spark, odd):
    got = line_rules.verdicts(odd).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == Counter({(1, True): 2, (2, True): 1, (None, True): 1, (5, True): 1, **{(i, False): 1 for i in (3, 4, 6, 7, 8)}})
    kept = line_rules.passing(odd)
    assert kept.columns == odd.columns and kept.count() == 5


def test_classifier(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op10_classifier(spark, folder).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    judged = [got[i]["predicted"] == q for i, q in truth.items() if got[i]["held_out"]]
    assert len(judged) > 50 and sum(judged) >= 0.95 * len(judged)
    assert classifier.scores(odd, labels).count() == odd.count() and classifier.scores(none, labels).collect() == []
    assert {r["score"] for r in classifier.scores(odd, labels.limit(0)).collect()} == {0.5}
    kept = classifier.accepted(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_held_out_labels_teach_nothing(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn("quality", labels["quality"] * 0 + (classifier.held_out(labels["doc_id"])).cast("int") * (1 - labels["quality"]) + (~classifier.held_out(labels["doc_id"])).cast("int") * labels["quality"])
    a = {r["doc_id"]: round(r["score"], 6) for r in classifier.scores(docs, labels).collect()}
    assert a == {r["doc_id"]: round(r["score"], 6) for r in classifier.scores(docs, turned).collect()}


def test_chats(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", odd), (-1, 1, "assistant", odd)]:
        by[conv].append((turn, role, text or ""))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in queries.op2_chats(spark, tables).collect():
        turns = sorted(by[r["conv_id"]])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert tuple(r)[:5] == (r["conv_id"], len(turns), digest("".join(f"{role}\n{x}\n" for _, role, x in turns)), len(loss), digest(loss))
        roles = ",".join(role for _, role, _ in turns)
        assert r["valid"] == bool(re.fullmatch("(system,)?user,assistant(,user,assistant)*", roles))


def test_chats_round_trip_and_order(spark):
    texts = ["~1 ~0 ~", "<|end|><|turn|>", "~<|text|>", "[INST][/INST]</s>", "", None, "[/IN[INST]ST]", "~~1</s"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rows += [(2, 0, "assistant", "a"), (3, None, None, "b"), (3, 1, "<s>", "c"), (None, 0, "user", "d"), (4, 0, "user", "e")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.read_chats(made).collect()}
    assert [x["text"] for x in got[1]["turns"]] == [t or "" for t in texts]
    assert got[1]["loss_texts"] == [t or "" for t in texts[1::2]]
    assert [tuple(x) for x in got[3]["turns"]] == [("", "b"), ("<s>", "c")]
    assert {i: r["bad_turn"] for i, r in got.items()} == {1: None, 2: 0, 3: 0, None: 1, 4: 1}
    assert all(sum(s["loss"] for s in r["segments"]) == sum(x["role"] == "assistant" for x in got[r["conv_id"]]["turns"]) for r in made.collect())
    with pytest.raises(ValueError):
        chat.Template(end="<|turn|>x")


def plain_dice(piece, template):
    def grams(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return set(zip(w, w[1:])) or set(w)

    a, b = grams(piece), grams(template)
    return 2 * len(a & b) / (len(a) + len(b)) if a else 0


def test_licenses(spark, tables, odd, none):
    expected = {}
    for i, text in texts_of(spark, tables).items():
        lines = text.split("\n")
        pieces = {*lines, *[s for x in lines for s in re.split(r"(?<=[.!?:;])\s+", x)], *re.split(r"\n\s*\n", text), text}
        for piece in pieces:
            best = max(((plain_dice(piece, t), -k, name) for k, (name, t) in enumerate(licenses.TEMPLATES)), default=None)
            if best and best[0] >= 0.8:
                expected[i, best[2]] = max(expected.get((i, best[2]), 0), best[0])
    got = {(r["doc_id"], r["license"]): r["dice"] for r in queries.op5_licenses(spark, tables).collect()}
    assert got == pytest.approx(expected) and got
    assert licenses.notices(none).collect() == [] and licenses.notices(odd).collect() == []
    rows = [(1, "Some page. Released under the\tMIT license!\r\nBye."), (1, "Released under the MIT License"), (None, "all rights RESERVED")]
    got = licenses.notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["license"]) for r in got) == Counter({(1, "MIT"): 2, (None, "proprietary"): 1})


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark, tables):
    odd = ["HTTP://É.Example.NET/en/x?y#z", "no scheme", None, "", "a://", "a://net", "a://net/", "a://xnet/", "x://b.example.com/de/", "x://org/fr/?q=://", "s://h#a/b", "s://h?a", "://net/a"]
    pages = [(k, u) for k, u in enumerate(odd)] + [(0, odd[0])]
    spam = [(100 + k, f"http://site{k}.example.org/{'casino' if k % 3 == 0 else 'news'}/{k}") for k in range(120)]
    labels = spark.createDataFrame([(100 + k, 0 if k % 3 == 0 else 1, 0) for k in range(90)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(pages + spam, "page_id long, url string")
    got = urls.judge(df, labels).collect()
    assert len(got) == len(pages) + len(spam)
    url_of = dict(pages + spam)
    for r in got:
        host, path, rule, verdict = plain_url(url_of[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url_of[r["page_id"]]
        assert r["verdict"] == (verdict or ("block" if "casino" in (url_of[r["page_id"]] or "") else "allow"))
    mined = urls.mine(df, labels).collect()
    assert {tuple(r["tokens"]) for r in mined} == {("p:casino",)}
    assert urls.judge(df.limit(0), labels).collect() == [] and urls.mine(df, labels.limit(0)).collect() == []
    assert queries.op8_urls(spark, tables).count() == spark.read.parquet(f"{tables}/pages.parquet").count()


def test_shards(spark, tables, odd, none):
    texts = texts_of(spark, tables)
    rows = queries.op9_shards(spark, tables).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    in_order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a < b for a, b in zip(in_order, in_order[1:])) in range(len(rows) * 2 // 5, len(rows) * 3 // 5)
    got = sharding.read_shards(spark, sharding.write_shards(odd, bucket_bytes=2000)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert sharding.read_shards(spark, sharding.write_shards(none)).collect() == []


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    found, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found.append(stage(spark, found[-1], tables))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert found[-1].columns == columns
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in found]
    texts = texts_of(spark, tables)
    scored = {r["doc_id"] for r in queries.op10_classifier(spark, tables).collect() if r["predicted"]}
    assert ids[1] == scored
    assert ids[2] == {i for i in ids[1] if not plain_rules(texts[i])[-1]}
    assert ids[3] == {c for _, _, c in plain_components({i: texts[i] for i in ids[2]})}
    leaked = {r["doc_id"] for r in queries.op1_leaks(spark, tables).collect()}
    assert ids[4] == ids[3] - leaked == ids[5]
    check_pieces(corpus_pipeline.run(spark, tables).collect(), {i: ids_of(texts[i], 1) for i in ids[4]})


def test_chats_against_sql(spark, tables):
    from oracle import difference

    assert difference(spark, "op2_chats", queries.op2_chats, queries.SQL["op2_chats"], tables) is None
