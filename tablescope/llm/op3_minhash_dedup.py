"""MinHash near-duplicates with b-bit signatures.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes). Texts
   with equal sets are one class, compared once. A class goes by a 64-bit hash
   of its set, never by a doc_id, which may stand for several texts.
2. ``BANDS`` x ``ROWS`` seeded minima per class. Each band's minima make a band
   key; of each minimum only the low 4 bits are kept, packed into eight longs.
3. Candidates. First round: in every band bucket each class is paired with the
   bucket's smallest class only, so a bucket of m classes gives m - 1 pairs. After
   those are checked, only buckets that still hold two or more components are
   joined with themselves, and a pair leaves that join only if its ends lie in
   different components and the packed signatures agree well enough.
4. b-bit estimate: the share of equal nibbles, counted by bit operations and
   corrected for chance agreement (1 / 16), estimates the similarity. In the
   second round a longer signature (2048 minima, 2 bits each), made only for the
   texts still in question, is asked as well. Estimates only discard pairs 4
   standard errors below 0.75 or more; nothing is linked by an estimate.
5. Each remaining pair is confirmed on the full sets of both whole texts:
   100 x intersection >= 75 x union.

A pair of similarity 0.75 shares a band with probability 1 - (1 - 0.75^5)^32 >
0.9998. Pairs inside one component need no check, since only components are
reported; every link between two components that shares a bucket is checked.

Defined results: null or blank texts have an empty set and link with nothing;
under five words the whole sequence is the only shingle; repeated doc_ids keep
a row each and are one document, which links with all that any of its texts links with; a null doc_id is kept with its own null
component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.blocks import block_units, units
from tablescope.llm.common import lean, pin, small_batches
from tablescope.llm.components import components

WORDS, BANDS, ROWS, BITS, SEED, PERCENT = 5, 32, 5, 4, 41, 75
_LONGS = BANDS * ROWS * BITS // 64
#: Signature of round 2: minima and bits kept of each. Its standard error at similarity 0.75 is 0.0115, that of the first 0.036.
FINE, FINE_BITS = 2048, 2
#: Pairs estimated below these (4.3 and 5 standard errors under 0.75) are not checked.
LEAST_ESTIMATE, LEAST_FINE, BLOCK = 0.57, 0.70, 512


class _Words(dict):
    """word -> 64-bit hash, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | bytes | None, seen: dict, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower and bytes.split know exactly
    A-Z and the six ASCII gaps, which is the word rule."""
    if not text:
        return np.zeros(0, np.uint64)
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(len(h), k)):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(out)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Seeded minima of a set, one per (a, b), in chunks of bounded size."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i:i + 2048, None] * a
        part += b
        np.minimum(out, part.min(0), out=out)
    return out


def _class(shingles: np.ndarray) -> int:
    """The class of a text, as a signed 64-bit number."""
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - 2**64 if h >= 2**63 else h


def _sketched(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
        seen = _Words()
        shift = np.arange(0, 64, BITS, dtype=np.uint64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                n, key, bands, bits = [], [], [], []
                for text in batch.column("text").cast(pa.large_binary()):
                    s = shingle_set(text.as_py(), seen)
                    n.append(len(s))
                    if not len(s):
                        key.append(None), bands.append(None), bits.append(None)
                        continue
                    low = minima(s, a, b)
                    key.append(_class(s))
                    parts = low.reshape(BANDS, ROWS)
                    band = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
                    for r in range(ROWS):
                        band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
                    bands.append(band.view(np.int64))
                    # minima crowd near 0, so only their low bits tell them apart
                    nibbles = (low & np.uint64(2**BITS - 1)).reshape(_LONGS, 64 // BITS)
                    bits.append((nibbles << shift).sum(1, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "rep", "bands", "bits"])
    return run


def _refined(seed: int):
    """The longer signature of the few texts that are compared in round 2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, 1])
        a = rng.integers(1, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, FINE, dtype=np.uint64)
        seen, shift = _Words(), np.arange(0, 64, FINE_BITS, dtype=np.uint64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                rep, n, fine = [], [], []
                for text in batch.column("text").cast(pa.large_binary()):
                    s = shingle_set(text.as_py(), seen)
                    rep.append(_class(s)), n.append(len(s))
                    low = (minima(s, a, b) & np.uint64(2**FINE_BITS - 1)).reshape(-1, 64 // FINE_BITS)
                    fine.append((low << shift).sum(1, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(n, pa.int64()), pa.array(fine, pa.list_(pa.int64()))],
                                                 names=["rep", "n", "fine"])
    return run


def estimate(left: list, right: list, bits: int):
    """Collision-corrected similarity of two packed signatures (lists of long columns)."""
    agree, per = F.lit(0), 64 // bits
    ones = F.lit(sum(1 << (i * bits) for i in range(per)))
    for x, y in zip(left, right):
        x = x.bitwiseXOR(y)
        step = 1
        while step < bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        agree = agree + F.lit(per) - F.bit_count(x.bitwiseAND(ones))
    chance = 1 / 2**bits
    return (agree / F.lit(float(per * len(left))) - chance) / (1 - chance)


def estimates(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """The same estimate for rows of packed signatures, as arrays."""
    per = 64 // bits
    ones = np.uint64(sum(1 << (i * bits) for i in range(per)))
    d = x ^ y
    step = 1
    while step < bits:
        d |= d >> np.uint64(step)
        step *= 2
    agree = per * x.shape[1] - np.bitwise_count(d & ones).sum(1, dtype=np.int64)
    chance = 1 / 2**bits
    return (agree / (per * x.shape[1]) - chance) / (1 - chance)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a unit that lie in different components and may be similar enough.
    Cheapest test first: components, set sizes, packed and longer signatures."""
    for t, left, right in units(batches):
        part, n = t.column("component").to_numpy(), t.column("n").to_numpy()
        pairs = part[left][:, None] != part[right][None, :]
        if left is right:
            pairs = np.triu(pairs, 1)
        pairs &= 100 * np.minimum(n[left][:, None], n[right][None, :]) >= PERCENT * np.maximum(n[left][:, None], n[right][None, :])
        i, j = (x for x in np.nonzero(pairs))
        if not len(i):
            continue
        i, j = left[i], right[j]
        for column, bits, least in (("bits", BITS, LEAST_ESTIMATE), ("fine", FINE_BITS, LEAST_FINE)):
            packed = t.column(column).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(t), -1)
            near = [estimates(packed[i[k:k + 50_000]], packed[j[k:k + 50_000]], bits) >= least for k in range(0, len(i), 50_000)]
            near = np.concatenate(near) if near else np.zeros(0, bool)
            i, j = i[near], j[near]
        if len(i):  # a pair that shares several buckets is reported by the first of them only
            keys, rep = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), -1), t.column("rep").to_numpy()
            first = (keys[i] == keys[j]).argmax(1)
            own = keys[i, first] == t.column("bucket")[0].as_py()
            i, j = i[own], j[own]
            i, j = np.where(rep[i] < rep[j], i, j), np.where(rep[i] < rep[j], j, i)
            doc = t.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[i], rep[j], doc[i], doc[j])], names=["a", "b", "doc_a", "doc_b"])


def _longs(column: str, n: int, name: str) -> list:
    return [F.get(column, F.lit(i)).alias(f"{name}{i}") for i in range(n)]


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, doc_a, doc_b, text_a, text_b) -> the documents of pairs whose full sets are
    similar enough. Texts of other classes that stand under the same id are passed over."""
    seen = _Words()
    known, known_set, known_class = None, None, None
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            keep = []
            texts = (batch.column(c).cast(pa.large_binary()) for c in ("text_a", "text_b"))
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), *texts):
                ta = ta.as_py()
                if ta != known:  # rows come sorted by document, so its set is mostly at hand
                    known, known_set = ta, shingle_set(ta, seen)
                    known_class = _class(known_set)
                other = shingle_set(tb.as_py(), seen)
                if known_class != a or _class(other) != b:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(known_set, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= PERCENT * (len(known_set) + len(other) - both))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("doc_a"), out.column("doc_b")], names=["a", "b"])


def _confirm(pairs: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """Join both whole texts to each pair (skewed joins are split by AQE) and check."""
    with_b = pairs.join(texts.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
    both = with_b.join(texts.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a")), "doc_a")
    return both.select("a", "b", "doc_a", "doc_b", "text_a", "text_b").mapInArrow(lean(_confirmed), f"a {kind}, b {kind}")


def near_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = pin(docs.mapInArrow(lean(_sketched(seed)), f"doc_id {kind}, n_shingles long, rep long, bands array<long>, bits array<long>"), "sketches")
    named = rows.where("doc_id is not null and rep is not null")
    classes = named.groupBy("rep").agg(F.min("doc_id").alias("doc"))  # whose text is looked up
    reps = named.join(classes.withColumnRenamed("doc", "doc_id"), ["doc_id", "rep"]).dropDuplicates(["rep"]).select("rep", F.col("doc_id").alias("doc"), "bands", "bits")
    banded = reps.select("rep", F.explode("bands").alias("band"))  # signatures are fetched later, for few
    # one id, several classes: the documents that these classes go by are one
    several = named.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
    same = pin(named.select("doc_id", "rep").join(several, "doc_id", "left_semi").distinct().join(classes, "rep")
               .where("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).distinct(), "same-ids")

    # round 1: every class against the smallest class of each of its buckets
    anchors = banded.groupBy("band").agg(F.min("rep").alias("anchor"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "anchor")
    # written once, for both rounds: most band rows are alone in their bucket and end here
    shared = pin(banded.join(anchors, "band"), "shared-buckets")
    star = shared.where("rep <> anchor").select(F.col("anchor").alias("a"), F.col("rep").alias("b")).distinct()
    bits = reps.select("rep", "doc", "bits")
    star = (star.join(bits.select(F.col("rep").alias("b"), F.col("doc").alias("doc_b"), F.col("bits").alias("bits_b")), "b")
            .join(bits.select(F.col("rep").alias("a"), F.col("doc").alias("doc_a"), F.col("bits").alias("bits_a")), "a")
            .where(estimate(_longs("bits_a", _LONGS, "x"), _longs("bits_b", _LONGS, "y"), BITS) >= LEAST_ESTIMATE).select("a", "b", "doc_a", "doc_b"))
    texts = docs.where("text is not null")
    first = pin(_confirm(star, texts, kind), "links-1").distinct().unionByName(same)

    # round 2: what the first round left apart inside a bucket
    part = components(first)
    where = classes.join(part, classes.doc == part.node, "left").select("rep", F.coalesce("component", "doc").alias("component"))
    placed = shared.join(where, "rep").select("band", "rep", "component")
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    open_ = pin(placed.join(mixed, "band", "left_semi"), "open-buckets")
    wanted = open_.select("rep").distinct()
    fine = (texts.join(classes.join(wanted, "rep", "left_semi").select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
            .mapInArrow(lean(_refined(seed)), "rep long, n long, fine array<long>").dropDuplicates(["rep"]))
    open_ = open_.withColumnRenamed("band", "bucket").join(pin(fine.join(reps.select("rep", "doc", "bits", "bands"), "rep"), "refined"), "rep")
    rest = (block_units(open_, BLOCK, "rep").mapInArrow(lean(_apart), "a long, b long, doc_a long, doc_b long").distinct()
            .join(star, ["a", "b"], "left_anti"))
    second = pin(_confirm(rest, texts, kind), "links-2").distinct()

    final = components(first.unionByName(second)) if not second.isEmpty() else part
    found = classes.join(final, classes.doc == final.node, "left").select("rep", F.coalesce("component", "doc").alias("_c"))
    out = rows.select("doc_id", "n_shingles", "rep").join(found, "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"),
                      F.col("doc_id").eqNullSafe(F.coalesce("_c", "doc_id")).alias("kept"))
