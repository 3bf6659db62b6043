"""Exact Jaccard join over word shingles by partitioning the universe, without all pairs of a group.

Sets are put into size bands such that linked sets lie in one band or in neighbours. In a band two
linked sets differ in at most H shingles. The universe is hashed into H + 1 units, so in some unit
two linked sets agree wholly (pigeonhole): the subset of each unit is a signature. Where the cost
model says so, units are merged in pairs: one segment that may differ in one shingle takes the
place of two that must agree, and is indexed by its subset and all its one-deletions.

A unit in which a set has nothing would tie all such sets together, so empty units give no
signature. The universe gets E units more for that: then linked sets agree in at least E + 1 units,
one of which is not empty if a set has at most E empty ones. E is a few more than a set of the band
is expected to have. Sets with more, which are rare, are partitioned once more under another hash;
two linked sets that both have more both take part in that, so no link is lost.

Most signatures occur once. So they travel sorted, as differences in compressed packs of a range of
signatures, and a task that holds a range keeps one entry per signature, however often it occurs.

Candidates are not multiplied out. Sets that are equal form a class with one representative. First
each signature's sets are held against its smallest one only. After the components of these links
are known, only pairs of one signature from different components remain, and these are tested as
well. Every test first compares parity bitmaps, a sure bound of the difference, for large sets also
counts per class, a closer bound, and then the sets.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tracemill.llm import line_rules, packs
from tracemill.llm.components import components
from tracemill.llm.words import distinct, mixed, portions, shingles, word_hashes
from tracemill.session import scratch, written

#: Partitions of the universe that a set with too many empty units goes through; the last keeps them.
LEVELS = 8
#: Cost of a row of the index against that of a pair whose bitmaps are compared, and the chance that
#: two sets of a band share a given shingle.
ROW_COST, SHARED = 30.0, 1e-3

#: Bits by which documents that no pair needs are passed over, 8 MB at most; beyond what they can tell apart, more sets than
#: needed are built, and the join drops them.
MOST_BITS = 1 << 26

#: Classes of shingles whose parity is kept per set, as longs; and equal sets that a task remembers.
PARITY, SEEN = 16, 200_000
#: Size beyond which parities tell little, so that shingles are counted as well, in so many classes.
LARGE, CLASSES = 512, 4096

#: Bits of a signature that travel, so that two share them by chance now and then, which the tests find; signatures
#: that a task holds at a time; and ranges that a portion is cut into at once.
SIGNATURE_BITS, RANGE_ROWS, FAN = 48, 1 << 20, 1024

_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def bands(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last set size of each band, and the most shingles in which two linked sets differ there."""
    low = [1]
    while low[-1] * 100 // percent < largest:
        low.append(low[-1] * 100 // percent + 1)
    high = [x * 100 // percent for x in low]
    apart = []
    for x in high:  # linked sets of s shingles together share at least percent / (100 + percent) of s
        most = np.arange(max(2, 2 * x - 40), 2 * x + 1)
        apart.append(int((most - 2 * -(-percent * most // (100 + percent))).max()))
    return np.array(low), np.array(high), np.array(apart)


def spare_units(size: float, apart: int) -> int:
    """Units beyond H + 1 of a band: the expected number of empty units and three deviations."""
    if not apart:
        return 0  # one unit, which holds the whole set
    spare = 0
    for _ in range(3):
        units = apart + 1 + spare
        mean = units * np.exp(-size / units)
        spare = int(np.ceil(mean + 3 * np.sqrt(mean)))
    return spare


def merged_units(sets: int, size: float, units: int, row_cost: float = ROW_COST, shared: float = SHARED) -> int:
    """How many pairs of units to merge in a band: the total cost is linear in it, so none or all.

    An unmerged unit costs a row per set and the pairs of sets whose few shingles there agree by
    chance; a merged pair costs a row per shingle and pairs that are far rarer.
    """
    mean = size / units
    single = np.exp(-mean) * np.expm1(mean * shared)
    double = np.exp(-2 * mean) * np.expm1(2 * mean * shared) * (1 + 4 * mean)
    slope = row_cost * (2 * mean - 1) + sets / 2 * (double - 2 * single)
    return units // 2 if slope < 0 else 0


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(*word_hashes(texts, lower=True), k))


def _sums(values: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the low and of the high halves of 64-bit values per group; exact below 2^21 values."""
    halves = ((values & _LOW).astype(np.float64), (values >> _32).astype(np.float64))
    return tuple(np.bincount(group, half, groups).astype(np.uint64) for half in halves)


def _of_text(begins: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins))


_BITS = [f"b{i}" for i in range(PARITY)]


def _features(batches, k: int):
    """Per document: set size, a 128-bit key of the set, the parity of its shingles in 64 * PARITY classes, and counts of large sets."""
    for got in batches:
        for first, stop in portions(got.column(1)):
            values, begins = _sets(got.column(1).slice(first, stop - first), k)
            text, n = _of_text(begins), stop - first
            keys = []
            for salt in (1, 2):
                low, high = _sums(mixed(values + np.uint64(salt)), text, n)
                keys.append(mixed(low + mixed(high)).view(np.int64))
            classes = 64 * PARITY
            parity = np.bincount(text * classes + (values & np.uint64(classes - 1)).astype(np.int64), minlength=n * classes) & 1
            bits = np.packbits(parity.astype(np.uint8).reshape(n, classes), axis=1).view(np.int64)
            columns = [np.diff(begins), *keys, *bits.T]
            cuts = begins.tolist()
            counts = [_counts(values[a:b]) if b - a > LARGE else None for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [got.column(0).slice(first, n), *[pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], pa.array(counts, pa.binary())],
                ["doc_id", "n", "ka", "kb", *_BITS, "counts"],
            )


def _counts(values: np.ndarray) -> bytes:
    """Shingles of a set per class, each number modulo 256."""
    own = (values >> np.uint64(20) & np.uint64(CLASSES - 1)).astype(np.int64)
    return np.bincount(own, minlength=CLASSES).astype(np.uint8).tobytes()


def _near(batches, percent: int):
    """The pairs that may be linked: sets differ in as many shingles as their counts per class do, at least."""
    for got in batches:
        keep = []
        for n, m, x, y in zip(*(got.column(c).to_pylist() for c in range(2, 6))):
            if x is None or y is None:
                keep.append(True)
                continue
            apart = np.frombuffer(x, np.uint8) - np.frombuffer(y, np.uint8)  # wraps round as the counts do
            keep.append(int(np.minimum(apart, -apart).sum(dtype=np.int64)) * (100 + percent) <= (n + m) * (100 - percent))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (got.column(0), got.column(1))], ["a", "b"])


def _signatures_of(doc, begins, values, band, units, merged, spare):
    """(document, signature, whole) rows of sets in one band each; whole is false for a one-deletion."""
    out = []
    for level in range(LEVELS):
        text = _of_text(begins)
        own = mixed(values ^ mixed(np.array([level + 11], np.uint64)))
        m = units[text]
        unit = ((own >> _32) * m.astype(np.uint64) >> _32).astype(np.int64)
        pairs = merged[text]
        segment = np.where(unit < 2 * pairs, unit // 2, unit - pairs)
        wide = unit < 2 * pairs
        per = units - merged
        base = np.concatenate([[0], np.cumsum(per)])
        slot = base[:-1][text] + segment
        low, high = _sums(own, slot, base[-1])
        size = np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(per)), per)
        at = np.arange(base[-1]) - base[:-1][owner]
        salt = mixed((band[owner].astype(np.uint64) << _32) + at.astype(np.uint64)) + np.uint64(level)
        kept = (size > 0) | (level + 1 == LEVELS)
        out.append((doc[owner][kept], mixed(mixed(low + mixed(high)) ^ salt)[kept], np.ones(kept.sum(), bool)))
        gone = np.flatnonzero(wide & ((size[slot] > 1) | (level + 1 == LEVELS)))
        if len(gone):
            s = slot[gone]
            left_low, left_high = low[s] - (own[gone] & _LOW), high[s] - (own[gone] >> _32)
            out.append((doc[text[gone]], mixed(mixed(left_low + mixed(left_high)) ^ salt[s]), np.zeros(len(gone), bool)))
        # Too many empty units, or merged ones that a deletion empties, send the set to the next partition.
        # With merged units, linked sets agree in (E + 1) / 2 segments at least.
        empty = np.bincount(owner[(size == 0) | ((size == 1) & (at < merged[owner]))], minlength=len(per))
        weak = empty > np.where(merged > 0, spare // 2, spare)
        if not weak.any():
            break
        chosen = weak[text]
        values = values[chosen]
        begins = np.concatenate([[0], np.cumsum(np.diff(begins)[weak])])
        doc, band, units, merged, spare = doc[weak], band[weak], units[weak], merged[weak], spare[weak]
    return out


def _cut(sig: np.ndarray, doc: np.ndarray, whole: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Signatures as packs of (range, body), one for each range that has any."""
    order = np.argsort(sig)
    sig, doc, whole = sig[order], doc[order].view(np.uint64), whole[order].astype(np.uint8)
    of = (sig >> (SIGNATURE_BITS - 32)).astype(np.uint64) * np.uint64(ranges) >> _32
    starts = np.flatnonzero(np.diff(of, prepend=np.uint64(ranges)))
    bodies = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sig)]):
        apart, least = np.diff(sig[a:b], prepend=sig[a]), doc[a:b].view(np.int64).min().view(np.uint64)
        head = np.array([sig[a], least], np.uint64)
        bodies.append(packs.pack(pa.array([], pa.string()), head, apart & 0xFFFFFFFF, apart >> 32, doc[a:b] - least, whole[a:b]))
    return pa.RecordBatch.from_arrays([pa.array(of[starts].view(np.int64)), pa.array(bodies, pa.binary())], ["range", "body"])


def _unpacked(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, documents and whether whole, of packs."""
    out = []
    for body in bodies:
        _, (head, low, high, doc, whole) = packs.unpack(body)
        out.append((head[0] + np.cumsum(low + (high << 32)), head[1] + doc, whole.astype(bool)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _gathered(batches):
    """(range, bodies) of consecutive packs of one range, about RANGE_ROWS signatures at a time."""
    at, bodies, size = None, [], 0
    for got in batches:
        for own, body in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
            if bodies and (own != at or size > 8 * RANGE_ROWS):
                yield at, bodies
                bodies, size = [], 0
            at, size = own, size + len(body)
            bodies.append(body)
    if bodies:
        yield at, bodies


def _finer(batches, ranges: int):
    """Packs cut into more ranges."""
    for _, bodies in _gathered(batches):
        yield _cut(*_unpacked(bodies), ranges)


def _met(known: tuple, sig: np.ndarray, doc: np.ndarray, whole: np.ndarray) -> tuple[tuple, tuple]:
    """What is known of each signature after more rows, and the rows now found to share theirs with another document.

    Known are signature, first document, whether any row was whole, and whether the signature is shared.
    """
    sig, doc, whole = (np.concatenate(c) for c in zip(known[:3], (sig, doc, whole)))
    told = np.concatenate([known[3], np.zeros(len(sig) - len(known[3]), bool)])
    order = np.argsort(sig, kind="stable")
    sig, doc, whole, told = sig[order], doc[order], whole[order], told[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sig))))
    shared = told[first] | np.logical_or.reduceat(doc != doc[first][group], first)
    give = shared[group] & ~told
    return (sig[first], doc[first], np.logical_or.reduceat(whole, first), shared), (sig[give], doc[give], whole[give])


def _shared(batches):
    """(sig, doc_id, whole) of the signatures that more than one document has, from packs sorted by range."""
    at, known = None, ()
    for own, bodies in _gathered(batches):
        if own != at:
            at, known = own, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))
        known, out = _met(known, *_unpacked(bodies))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["sig", "doc_id", "whole"])


def _signatures(
    batches, k: int, low: np.ndarray, units: np.ndarray, merged: np.ndarray, spare: np.ndarray, percent: int, ranges: int
):
    """Packs of the signatures of each set in its band and, as the smaller side, in the next; equal sets of a task once."""
    seen: set[tuple[int, int]] = set()
    for got in batches:
        for first, stop in portions(got.column(1)):
            if len(seen) > SEEN:
                seen.clear()  # sets that come again only give their signatures again
            values, begins = _sets(got.column(1).slice(first, stop - first), k)
            doc = got.column(0).slice(first, stop - first).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(begins)
            a, b = _sums(mixed(values + np.uint64(1)), _of_text(begins), len(sizes))
            fresh = np.zeros(len(sizes), bool)
            for j, key in enumerate(np.stack([mixed(a + mixed(b)), sizes.astype(np.uint64)], 1).tolist() if len(sizes) else []):
                if sizes[j] and (key := tuple(key)) not in seen:
                    seen.add(key)
                    fresh[j] = True
            rows = []
            for up in (0, 1):
                band = np.searchsorted(low, sizes, "right") - 1 + up
                inside = fresh & (band < len(low))
                inside[inside] &= sizes[inside] * 100 >= low[band[inside]] * percent
                chosen = np.repeat(inside, sizes)
                starts = np.concatenate([[0], np.cumsum(sizes[inside])])
                own = band[inside]
                rows += _signatures_of(doc[inside], starts, values[chosen], own, units[own], merged[own], spare[own])
            doc, sig, whole = (np.concatenate(c) for c in zip(*rows))
            if len(sig):
                yield _cut((sig >> np.uint64(64 - SIGNATURE_BITS)).astype(np.int64), doc, whole, ranges)


def _stored_sets(batches, k: int, needed: np.ndarray):
    """Sets of documents whose bit is set; needed has 64 bits a word."""
    for got in batches:
        bit = got.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        inside = needed[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)
        got = got.filter(pa.array(inside.astype(bool)))
        for first, stop in portions(got.column(1)):
            values, begins = _sets(got.column(1).slice(first, stop - first), k)
            cuts = begins.tolist()
            sets = [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([got.column(0).slice(first, stop - first), pa.array(sets, pa.binary())], ["doc_id", "items"])


_PACKS = "range long, body binary"


def _linked(batches, percent: int):
    for got in batches:
        keep = []
        for x, y in zip(got.column(2).to_pylist(), got.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = int((y[at] == x).sum())
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (got.column(0), got.column(1))], ["a", "b"])


def _alike(a: str, b: str, percent: int):
    """A sure test on sizes and bitmaps that two sets could be linked: they differ in as many shingles as classes of odd difference, at least."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    apart = sum((F.bit_count(x(b).bitwiseXOR(y(b))) for b in _BITS[1:]), F.bit_count(x("b0").bitwiseXOR(y("b0"))))
    both = x("n") + y("n")
    return (
        (apart * (100 + percent) <= both * (100 - percent))
        & (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n")))
    )


def join(
    docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", row_cost: float = ROW_COST,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs.

    Two documents are linked when 100 * shared >= percent * united of their distinct k-word
    shingles, of lower-cased (A-Z) words between ASCII white space; with fewer words the whole
    sequence is the only shingle. component_id is the smallest id reachable by links.

    Defined cases: a null or empty text, or one without words, has no shingles and is linked with
    nothing; rows without an id are returned with a null component and take no part; repeated
    rows each get the same result; rows of one id with different texts count as one document
    whose texts are linked. Other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return keep(_joined(rows, k, percent, row_cost), "components")


def _joined(rows: DataFrame, k: int, percent: int, row_cost: float) -> DataFrame:
    """The join of (doc_id, text)."""
    found = written(
        rows.mapInArrow(partial(_features, k=k), ", ".join(f"{c} long" for c in ("doc_id", "n", "ka", "kb", *_BITS)) + ", counts binary"), "sets"
    )
    able = found.where("doc_id IS NOT NULL AND n > 0")
    classes = able.groupBy("ka", "kb", "n").agg(F.min("doc_id").alias("rep"))
    members = written(able.join(classes, ["ka", "kb", "n"]).select("doc_id", "rep", "n", *_BITS).distinct(), "members")

    # Sets of each size are counted over all documents; a band has one row.
    largest = members.agg(F.max("n")).first()[0] or 1
    low, high, apart = bands(largest, percent)
    edges = F.array(*[F.lit(int(x)) for x in low])
    band = F.size(F.filter(edges, lambda x: x <= F.col("n"))) - 1
    held = {r["band"]: r["c"] for r in members.where("doc_id = rep").groupBy(band.alias("band")).agg(F.count("*").alias("c")).collect()}
    # The smaller side of a pair may be as small as percent of the band's first size.
    spare = np.array([spare_units(low[j] * percent / 100, apart[j]) for j in range(len(low))])
    units = apart + 1 + spare
    merged = np.array([merged_units(held.get(j, 0) + held.get(j - 1, 0), low[j], units[j], row_cost) for j in range(len(low))])

    # Distinct signatures in all: a row per segment, and one per shingle of a merged segment.
    each = units - merged + 2 * merged * (low / units + 1)
    ranges = 1 + int(sum((held.get(j, 0) + held.get(j - 1, 0)) * each[j] for j in range(len(low))) / RANGE_ROWS)
    by, now = Window.partitionBy("sig"), min(ranges, FAN)
    sent = rows.where("doc_id IS NOT NULL").mapInArrow(
        partial(_signatures, k=k, low=low, units=units, merged=merged, spare=spare, percent=percent, ranges=now), _PACKS
    )
    while now < ranges:  # so that no portion is cut into packs of next to nothing, more ranges are made step by step
        now, salts = min(ranges, now * FAN), -(-min(ranges, now * FAN) // now)
        salted = sent.withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(salts)))
        sent = written(
            salted.repartition("range", "salt").select("range", "body").sortWithinPartitions("range")
            .mapInArrow(partial(_finer, ranges=now), _PACKS), "packs"
        )
    # Written by itself, so the shuffle of all signatures is gone before what is shared is joined.
    shared = written(
        sent.repartition("range").sortWithinPartitions("range").mapInArrow(_shared, "sig long, doc_id long, whole boolean"), "shared"
    )
    reps = members.select("doc_id", "rep").distinct()
    hits = written(shared.join(reps, "doc_id").groupBy("sig", "rep").agg(F.max("whole").alias("whole")), "hits")

    features = members.where("doc_id = rep").drop("doc_id")
    first = F.min(F.when(F.col("whole"), F.col("rep")))
    pairs = (
        hits.withColumn("a", first.over(by)).where("a IS NOT NULL AND a <> rep")
        .select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    )

    same_id = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    # Counts of the large sets that pairs may name; an id with several sets has none, so its pairs pass.
    counted = written(
        able.where("counts IS NOT NULL").join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
        .join(same_id.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"]).select("doc_id", "n", "counts"), "counts"
    )

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs without those whose sets are too far apart by their counts, so that no large set travels for them."""
        x, y = (counted.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"c_{c}")) for c in "ab")
        both = pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", "n_a", "n_b", "c_a", "c_b")
        return both.mapInArrow(partial(_near, percent=percent), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are linked. The sets of their documents are built again where the texts are read; no text is shuffled."""
        needed = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "needed")
        n = needed.count()
        if not n:
            return pairs.select("a", "b")
        bits = min(MOST_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
        bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        word = needed.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("v")
        ).toPandas()
        flags = np.zeros(bits // 64, np.uint64)
        flags[word["word"].to_numpy(np.int64)] = word["v"].to_numpy(np.int64).view(np.uint64)
        marked = rows.where("doc_id IS NOT NULL").select("doc_id", "text", bit.alias("bit"))
        built = marked.mapInArrow(partial(_stored_sets, k=k, needed=flags), "doc_id long, items binary")
        stored = written(built.join(needed, "doc_id", "left_semi").distinct(), "items")
        x, y = stored.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), stored.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
        both = pairs.join(x, "a").join(y, "b").where("octet_length(x) > 0 AND octet_length(y) > 0").select("a", "b", "x", "y")
        return both.mapInArrow(partial(_linked, percent=percent), "a long, b long").distinct()

    x, y = features.alias("x"), features.alias("y")
    pairs = written(near(
        pairs.alias("p").join(x, F.col("p.a") == F.col("x.rep")).join(y, F.col("p.b") == F.col("y.rep"))
        .where(_alike("x", "y", percent)).select("p.a", "p.b").distinct()), "pairs"
    )
    links = written(verified(pairs).unionByName(same_id.select("a", "b")), "links")
    labels = components(links)

    # What is left: pairs of one signature whose sets are in different components.
    named = hits.join(labels, hits["rep"] == labels["node"], "left").select("sig", "rep", "whole", F.coalesce("component", "rep").alias("label"))
    open_ = named.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("c")).where("l <> h AND c > 2")
    rest = written(named.join(open_.select("sig"), "sig").join(features, "rep"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    more = written(near(
        x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") < F.col("y.label")) & (F.col("x.whole") | F.col("y.whole")) & _alike("x", "y", percent))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")),
        "pairs",
    )
    links = written(links.unionByName(verified(more)), "links")
    labels = components(links)
    final = reps.join(labels, reps["rep"] == labels["node"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those that are linked to one of a smaller id, with all their columns.

    Rows of one id count as one document; of these the one with the smallest hash of its columns
    stays. Rows without an id take no part and stay.
    """
    own, least, times = (line_rules.fresh(name, docs) for name in ("_row", "_least", "_times"))
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    rows = docs.withColumn(own, F.xxhash64(*plain))
    with scratch(docs.sparkSession) as keep:
        found = join(docs, id_col=id_col, **options).where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
        # What stays is chosen among ids and hashes; whole rows meet the choice once, and only repeated ones are grouped.
        each = rows.select(id_col, own).groupBy(id_col, own).agg(F.count("*").alias(times)).join(found, id_col, "left_semi")
        chosen = each.groupBy(id_col).agg(F.min(F.struct(own, times)).alias(least)).select(id_col, f"{least}.*")
        chosen = keep(chosen, "chosen")
    once = rows.join(chosen.where(F.col(times) == 1), [id_col, own], "left_semi")
    more = rows.join(chosen.where(F.col(times) > 1), [id_col, own], "left_semi").dropDuplicates([id_col])
    return once.unionByName(more).select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
