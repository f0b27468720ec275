"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

A text is the sequence of its words' characters with one space between words, start
marks before it and an end mark after it. The model predicts each character from the
three before it: 4-grams that run across the ends of words, with three discounts
(counts of one, two, three and more) in every order. Invented spellings, shouting,
symbol noise, foreign scraps, words that follow each other as trusted text has not,
and words repeated without end cost more than trusted text does. All trusted text is
counted (documents whose quality label is 1), and counts grow with it.

Counting: tasks count the 4-grams of their trusted texts; Spark sums them. The lower
orders are continuation counts (distinct left neighbours), the discounts come from
counts of counts (a few numbers per order).

Scoring by sharded count joins: documents are read in chunks of bounded size. Each
chunk asks for what its distinct 4-grams need of all orders: counts of grams, totals
of contexts and what discounts free in them, known by 64-bit hashes. Requests and model meet shard
by shard, answers go back by chunk and meet the chunk's texts (compressed, shuffled
once). The most frequent entries of the model, at most CACHE of them at any size, are
broadcast, so chunks need not ask for these; the driver gets no other part of it.

A trusted document would find all its own grams in the model. It is judged by the
counts without its own (the discounts stay), so thresholds hold for texts never counted.

Trusted ids meet the texts by a join; a bitmap of fixed size, made from the ids,
drops most other texts before that shuffle. It can let a text through but never
hold one back, and the join decides.

Threshold: per language, the ``keep`` quantile of the perplexity of trusted
documents, read off a histogram of log2 perplexity (steps of 1/500). Languages
without trusted text use that of all trusted documents together.

Defined results: a text without words has no perplexity and is rejected; without
any trusted document the model is uniform and nothing with words is rejected;
a null language is a language of its own; U+0002 and U+0003 (the marks) count as
U+FFFD, like bytes that are no text; repeated label rows count once (the
lowest quality wins); repeated rows keep a row each; an empty table gives an
empty result; extra columns are ignored. ``docs`` must read the same rows in the
same order twice, as files do: a chunk is known by a digest of its ids and texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import lean, pin, small_batches

ORDER, KEEP, CHUNK_ROWS, CHUNK_BYTES, BITMAP_BITS, PROBES, STEPS = 4, 0.998, 2000, 8_000_000, 26, 3, 500
#: Entries of the model that are broadcast, at most; entries of a shard, about.
CACHE, SHARD = 1 << 18, 100_000
#: Code points whose windows are made in one go (or one text): bounds a task's memory, not what is read.
AT_ONCE = 1 << 18
_START, _END, _MARK = "\x02" * (ORDER - 1), "\x03", 2
#: Multiplier of the running hash of code points, and what tells contexts from grams.
_TIMES, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _marked(text: bytes) -> str:
    """The sequence that is scored; empty without words. The marks cannot occur in it."""
    words = text.decode("utf-8", "replace").replace("\x02", "\ufffd").replace("\x03", "\ufffd").split()
    return _START + " ".join(words) + _END if words else ""


def grams_of(text: str) -> list[str]:
    marked = _marked(text.encode())
    return [marked[i:i + ORDER] for i in range(len(marked) - ORDER + 1)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """(code points of some marked texts one after the other, windows of each)."""
    held, counts, size = [], [], 0
    for t in texts:
        held.append(_marked(t))
        counts.append(max(0, len(held[-1]) - ORDER + 1))
        size += len(held[-1])
        if size >= AT_ONCE:
            yield _codes("".join(held)), counts
            held, counts, size = [], [], 0
    if held:
        yield _codes("".join(held)), counts


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each row's code points; columns on the left may be zero (a shorter gram)."""
    h = columns[0].astype(np.uint64)
    for c in columns[1:]:
        h = h * _TIMES + c
    return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, the number of each key among the distinct ones)."""
    by = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[by[1:]] != keys[by[:-1]]
    one = np.empty(len(keys), np.int64)
    one[by] = np.cumsum(new) - 1
    return by[new], one


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams as rows of code points, the number of each window's gram) of the
    windows that belong to one text: those that do not end in a start mark."""
    if len(codes) < ORDER:
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    at = np.flatnonzero(codes[ORDER - 1:] != _MARK)
    plus = codes.astype(np.uint64) + np.uint64(1)
    first, one = _grouped(_hashed([plus[i:len(plus) - ORDER + 1 + i] for i in range(ORDER)])[at])
    return codes[at[first][:, None] + np.arange(ORDER)], one


def _texts(grams: np.ndarray) -> list[str]:
    one = np.ascontiguousarray(grams).astype("<u4").tobytes().decode("utf-32-le")
    return [one[i:i + ORDER] for i in range(0, len(one), ORDER)]


def _key(grams: np.ndarray, context: bool = False) -> np.ndarray:
    """The model's key of grams, or of contexts, given as rows of code points."""
    plus = [c.astype(np.uint64) + np.uint64(1) for c in grams.T]
    return _mixed(_hashed(plus)) ^ (_CONTEXT if context else np.uint64(0))


def _orders(grams: np.ndarray) -> list[tuple]:
    """Per order, the longest first: (the distinct grams' keys, their number among the
    next shorter grams, the distinct contexts' keys, the number of each gram's context)."""
    out = []
    for order in range(ORDER, 0, -1):
        keys = _key(grams)
        if order == 1:
            out.append((keys, None, np.zeros(0, np.uint64), None))
            break
        first, context = _grouped(_key(grams[:, :-1], True))
        contexts = _key(grams[first][:, :-1], True)
        first, shorter = _grouped(_key(grams[:, 1:]))
        out.append((keys, shorter, contexts, context))
        grams = grams[first][:, 1:]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed trusted texts -> (gram, n), summed piece by piece."""
    unpack = zstandard.ZstdDecompressor()

    def out(texts):
        for codes, _ in _pieces(texts):
            grams, one = _distinct(codes)
            yield pa.RecordBatch.from_arrays([pa.array(_texts(grams), pa.string()), pa.array(np.bincount(one, minlength=len(grams)), pa.int64())], names=["gram", "n"])
    texts, size = [], 0
    for batch in batches:
        for value in batch.column("packed"):
            texts.append(unpack.decompress(value.as_py()))
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield from out(texts)
                texts, size = [], 0
    yield from out(texts)


def _marks(batch: pa.RecordBatch, bits: np.ndarray) -> np.ndarray:
    """Which rows' bits are all set."""
    out = np.ones(batch.num_rows, bool)
    for i in range(PROBES):
        p = batch.column(f"p{i}").to_numpy()
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


def _packed(bitmap):
    """(doc_id, text, p0, p1, ..) -> (doc_id, packed) of texts whose bits are all set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.filter(pa.array(_marks(batch, bitmap.value)))
            packed = [pack.compress(t.as_py()) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])
    return run


def _probe(i: int):
    return F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(1 << BITMAP_BITS))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """The bits of all ids, 2**BITMAP_BITS of them whatever the number of ids:
    tasks set theirs in bytes, Spark ORs the bytes, the driver gets 8 MB at most."""
    bits = ids.select(F.explode(F.array(*[_probe(i) for i in range(PROBES)])).alias("p"))
    longs = (bits.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
             .groupBy(F.shiftright("at", 12).alias("page")).agg(F.collect_list(F.struct("at", "v")).alias("longs")))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for row in longs.toLocalIterator():
        for at, v in row.longs:
            out[at] = v & 0xFFFFFFFFFFFFFFFF
    return out.view(np.uint8)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q >= 1").select("doc_id")


def trusted_texts(docs: DataFrame, ids: DataFrame, bitmap) -> DataFrame:
    """(packed): all trusted texts, compressed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = (docs.where("text is not null").select("doc_id", "text", *[_probe(i).alias(f"p{i}") for i in range(PROBES)])
             .mapInArrow(lean(_packed(bitmap)), f"doc_id {kind}, packed binary"))
    return texts.join(ids, "doc_id", "left_semi").select("packed")


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n): all 4-grams of all trusted text."""
    return texts.mapInArrow(lean(_counted), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def count_trusted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return count_grams(trusted_texts(docs, ids, docs.sparkSession.sparkContext.broadcast(_bitmap(ids))))


def discounts(grams: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of one order, from how many grams were counted once to four times."""
    n = {r.n: r.k for r in grams.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    return tuple(min(float(i), max(0.05, i - (i + 1) * y * more / few if few else i / 2))
                 for i, few, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def kneser_ney(counts: DataFrame) -> list[dict]:
    """Per order 1, 2, ..: {"grams": (gram, n), "contexts": (context, all, freed),
    "discounts"}: counts of grams, and per context their sum and that of their discounts."""
    out, grams = [], counts
    for order in range(ORDER, 0, -1):
        d1, d2, d3 = discounts(grams)
        d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = grams.groupBy(F.substring("gram", 1, order - 1).alias("context")).agg(F.sum("n").alias("all"), F.sum(d).alias("freed"))
        out.append({"grams": grams, "contexts": pin(contexts, f"contexts-{order}"), "discounts": (d1, d2, d3)})
        # continuation counts: in how many different left contexts the shorter gram was seen
        grams = pin(grams.groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"continued-{order}") if order > 1 else grams
    return out[::-1]


def model_table(model: list[dict]) -> DataFrame:
    """(key, n, freed): the counts of all grams (freed 0), the sums of all contexts."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            codes = _codes("".join(g.rjust(ORDER, "\0") for g in grams)).reshape(-1, ORDER).astype(np.uint64) + np.uint64(1)
            codes[np.arange(ORDER) < ORDER - np.fromiter(map(len, grams), np.int64, len(grams))[:, None]] = 0
            key = _mixed(_hashed(list(codes.T))) ^ np.where(batch.column("context").to_numpy(zero_copy_only=False), _CONTEXT, np.uint64(0))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("n"), batch.column("freed")], names=["key", "n", "freed"])

    rows = None
    for order, tables in enumerate(model, 1):
        some = tables["grams"].select("gram", F.lit(False).alias("context"), "n", F.lit(0.0).alias("freed"))
        if order > 1:
            some = some.unionByName(tables["contexts"].select(F.col("context").alias("gram"), F.lit(True).alias("context"), F.col("all").alias("n"), "freed"))
        rows = some if rows is None else rows.unionByName(some)
    return rows.mapInArrow(keyed, "key long, n long, freed double")


def _table(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    by = np.argsort(keys := keys.view(np.uint64))
    return (keys[by], *[v[by] for v in values])


def frequent(table: DataFrame, most: int = CACHE) -> tuple[np.ndarray, ...]:
    """(keys, counts, freed) of the entries whose count has the least binary logarithm,
    in quarters, above which there are ``most`` entries or fewer."""
    level = F.floor(F.log2("n") * 4).cast("int")
    above, least = 0, 1 << 30
    for r in sorted(table.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        above += r["count"]
        if above > most:
            break
        least = r.level
    got = table.where(level >= least).toArrow()
    return _table(*[got.column(c).to_numpy() for c in ("key", "n", "freed")])


def _found(table: tuple[np.ndarray, ...], asked: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which of ``asked`` are there, their values ..)."""
    keys, *values = table
    if not len(keys):
        return (np.zeros(len(asked), bool), *[v[:0] for v in values])
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    there = keys[at] == asked
    return (there, *[v[at[there]] for v in values])


class _Model:
    """What a task knows of the model: the numbers of all texts (discounts by order,
    and the sums of the empty context: total, freed, symbols), and the entries that
    are broadcast or answered to a chunk."""

    def __init__(self, numbers: tuple, *tables: tuple[np.ndarray, ...]):
        self.discounts, self.empty = numbers
        self.table = _table(*(np.concatenate(x) for x in zip(*tables, strict=True))) if len(tables) > 1 else tables[0]

    def _values(self, asked: np.ndarray) -> np.ndarray:
        out = np.zeros((2, len(asked)))
        there, *values = _found(self.table, asked)
        out[:, there] = values
        return out

    def _discount(self, order: int, n: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discounts[order - 1]])[np.minimum(n, 3).astype(np.int64)]

    def known(self, grams: np.ndarray) -> list[tuple]:
        """Per order, the longest first: (count, number of the shorter gram, number of the
        context, its total, its freed) of the distinct grams."""
        out = []
        for keys, shorter, contexts, context in _orders(grams):
            if shorter is None:
                shorter = context = np.zeros(len(keys), np.int64)
                total, freed = (np.full(1, float(x)) for x in self.empty[:2])
            else:
                total, freed = self._values(contexts)
            out.append((self._values(keys)[0], shorter, context, total[context], freed[context]))
        return out

    def _step(self, p, order, n, total, freed, symbols):
        """Interpolated probability of an order from that of the one below."""
        sure = np.maximum(total, 1)
        back = np.where(total > 0, freed / sure, 1.0)
        return (p if order > 1 else 1.0 / (symbols + 1)) * back + np.where(n > 0, (n - self._discount(order, n)) / sure, 0.0)

    def log2(self, known: list[tuple]) -> np.ndarray:
        p = None
        for order, (n, shorter, _, total, freed) in enumerate(known[::-1], 1):
            p = self._step(p if p is None else p[shorter], order, n, total, freed, self.empty[2])
        return np.log2(p)

    def unseen(self, known: list[tuple], at: np.ndarray, k: np.ndarray) -> float | None:
        """log2 probability of a text that has the grams ``at`` ``k`` times, by the counts
        without its own; None where these counts cannot hold it."""
        gone, steps = k.astype(np.float64), []
        for order, row in zip(range(ORDER, 0, -1), known, strict=True):
            n, shorter, context, total, freed = (x[at] for x in row)
            if (n < gone).any():
                return None
            left = n - gone
            _, c = _grouped(context)
            total = total - np.bincount(c, gone)[c]
            freed = freed - np.bincount(c, self._discount(order, n) - self._discount(order, left))[c]
            first, place = _grouped(shorter)
            steps.append((left, place, total, np.maximum(freed, 0.0)))
            gone, at = np.bincount(place, left == 0).astype(np.float64), shorter[first]  # a gram that is gone continues no shorter one
        p, symbols = None, self.empty[2] - int((steps[-1][0] == 0).sum())
        for order, (left, place, total, freed) in enumerate(steps[::-1], 1):
            p = self._step(p if p is None else p[place], order, left, total, freed, symbols)
        return float((np.log2(p) * k).sum())

    def score(self, texts: list[bytes], marks: list[bool]) -> tuple[np.ndarray, np.ndarray, list]:
        """(symbols, log2 probability, the same without the text's own counts if it is marked) of each text."""
        sizes, totals, others, marks = [], [], [], iter(marks)
        for codes, counts in _pieces(texts):
            grams, one = _distinct(codes)
            known, n = self.known(grams), np.array(counts, np.int64)
            ends, total = np.cumsum(n), np.zeros(len(n))
            if len(one):
                total[n > 0] = np.add.reduceat(self.log2(known)[one], (ends - n)[n > 0])
            for end, size in zip(ends, n, strict=True):
                others.append(self.unseen(known, *np.unique(one[end - size:end], return_counts=True)) if next(marks) and size else None)
            sizes.append(n)
            totals.append(total)
        return np.concatenate(sizes), np.concatenate(totals), others


def _chunks(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None = None) -> Iterator[tuple[int, list, list, list, list]]:
    """(name, ids, languages, texts, marks of ``bits``) of bounded size. The name is a digest
    of ids and texts; chunks of one name are equal and share their answers."""
    ids, langs, texts, marks, size = [], [], [], [], 0

    def name():
        h = xxhash.xxh3_64()
        for i, t in zip(ids, texts, strict=True):
            h.update(f"{i}:{len(t)};")
            h.update(t)
        return h.intdigest() - (1 << 63)
    for batch in batches:
        marked = [False] * batch.num_rows if bits is None else _marks(batch, bits).tolist()
        for i, lang, text, mark in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), marked, strict=True):
            t = text.as_py() or b""
            ids.append(i), langs.append(lang), texts.append(t), marks.append(mark)
            size += len(t)
            if len(ids) >= CHUNK_ROWS or size >= CHUNK_BYTES:
                yield name(), ids, langs, texts, marks
                ids, langs, texts, marks, size = [], [], [], [], 0
    if ids:
        yield name(), ids, langs, texts, marks


def _lists(values: np.ndarray, starts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)], pa.int32()), pa.array(values, kind))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _requests(cache, shards: int):
    """Rows (shard, chunk, keys): the entries that a chunk needs and the cache has not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cache.value
        for name, _, _, texts, _ in _chunks(batches):
            asked = []
            for codes, _ in _pieces(texts):
                asked += [x for keys, _, contexts, _ in _orders(_distinct(codes)[0]) for x in (keys, contexts)]
            keys = np.unique(np.concatenate(asked))
            keys = keys[~_found(known, keys)[0]]
            home = _shard(keys, shards)
            keys, home = keys[by := np.argsort(home, kind="stable")], home[by]
            starts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]][:len(home)])
            yield pa.RecordBatch.from_arrays([pa.array(home[starts]), pa.array([name] * len(starts), pa.int64()), _lists(keys.view(np.int64), starts, pa.int64())],
                                             names=["shard", "chunk", "keys"])
    return run


_VALUES = ("keys", "ns", "freed")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, the model's row first -> (chunk, keys, ns, freed) of what is there."""
    now, table = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            shard, (keys, *values) = row.column("shard")[0].as_py(), (row.column(c).flatten().to_numpy() for c in _VALUES)
            if row.column("ns").is_valid()[0].as_py():
                now, table = shard, _table(keys, *values)
            elif shard == now:
                there, *found = _found(table, keys.view(np.uint64))
                if there.any():
                    lists = [_lists(x, np.array([0]), pa.from_numpy_dtype(x.dtype)) for x in (keys[there], *found)]
                    yield pa.RecordBatch.from_arrays([row.column("chunk"), *lists], names=["chunk", *_VALUES])


_BODY = "chunk long, doc_ids array<{kind}>, langs array<string>, ends array<long>, marks array<boolean>, packed binary"


def _bodies(schema: pa.Schema, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for name, ids, langs, texts, marks in _chunks(batches, bitmap.value):
            ends = np.cumsum([len(t) for t in texts])
            yield pa.RecordBatch.from_pylist([{"chunk": name, "doc_ids": ids, "langs": langs, "ends": ends.tolist(), "marks": marks,
                                               "packed": pack.compress(b"".join(texts))}], schema=schema)
    return run


def _scored(numbers: tuple, cache):
    """Rows sorted by chunk, answers before texts -> one row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, answers, model = zstandard.ZstdDecompressor(), None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if (chunk := row.column("chunk")[0].as_py()) != now:
                    now, answers, model = chunk, [], None
                if not row.column("packed").is_valid()[0].as_py():
                    answers.append([row.column(c).flatten().to_numpy() for c in _VALUES])
                    continue
                if model is None:
                    own = [_table(*(np.concatenate(x) for x in zip(*answers, strict=True)))] if answers else []
                    model = _Model(numbers, cache.value, *own)
                ends, text = row.column("ends").flatten().to_pylist(), unpack.decompress(row.column("packed")[0].as_py())
                symbols, total, others = model.score([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], row.column("marks").flatten().to_pylist())
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), row.column("langs").flatten(), pa.array(symbols), pa.array(total), pa.array(others, pa.float64())],
                                                 names=["doc_id", "lang", "n_symbols", "log2_prob", "unseen_prob"])
    return run


def model_numbers(model: list[dict]) -> tuple:
    """(discounts by order, (total, freed, symbols) of the empty context)."""
    first = model[0]["contexts"].first()
    return [m["discounts"] for m in model], (first["all"] if first else 0, first.freed if first else 0.0, model[0]["grams"].count())


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, log2_prob, judged_prob, perplexity of every whole text:
    log2_prob is by all counts; judged_prob, and so perplexity, without a trusted text's own."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    small_batches(docs.sparkSession)
    broadcast, ids = docs.sparkSession.sparkContext.broadcast, pin(trusted_ids(labels), "trusted-ids")
    bitmap = broadcast(_bitmap(ids))
    model = kneser_ney(pin(count_grams(trusted_texts(docs, ids, bitmap)), "trusted-grams"))
    table = pin(model_table(model), "model")
    shards = max(1, -(-table.count() // SHARD))
    cache = broadcast(frequent(table))

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", lang.alias("lang"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    home = F.expr(f"cast(shiftrightunsigned(key, 33) % {shards} as bigint)")
    blocks = (table.groupBy(home.alias("shard")).agg(F.collect_list(F.struct("key", F.col("n").cast("double").alias("n"), "freed")).alias("x"))
              .select("shard", F.lit(None).cast("long").alias("chunk"), F.col("x.key").alias("keys"), F.col("x.n").alias("ns"), F.col("x.freed").alias("freed")))
    asked = rows.mapInArrow(lean(_requests(cache, shards)), "shard long, chunk long, keys array<long>")
    answers = (blocks.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("ns").isNull())
               .mapInArrow(lean(_answers), "chunk long, keys array<long>, ns array<double>, freed array<double>"))
    schema = StructType.fromDDL(_BODY.format(kind=kind))
    probed = rows.select("*", *[_probe(i).alias(f"p{i}") for i in range(PROBES)])
    bodies = probed.mapInArrow(lean(_bodies(to_arrow_schema(schema), bitmap)), schema)
    scored = pin(bodies.unionByName(answers, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("packed").isNotNull())
                 .mapInArrow(lean(_scored(model_numbers(model), cache)), f"doc_id {kind}, lang string, n_symbols long, log2_prob double, unseen_prob double"), "scored")
    # only texts that may have been counted meet the trusted ids
    counted = F.col("doc_id").isNotNull() & F.col("unseen_prob").isNotNull()
    own = F.when(F.col("trusted"), F.col("unseen_prob")).otherwise(F.col("log2_prob")).alias("judged_prob")
    out = (scored.where(counted).join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left").select("doc_id", "lang", "n_symbols", "log2_prob", own)
           .unionByName(scored.where(~counted).select("doc_id", "lang", "n_symbols", "log2_prob", F.col("log2_prob").alias("judged_prob"))))
    return out.withColumn("perplexity", F.when(F.col("n_symbols") > 0, F.pow(F.lit(2.0), -F.col("judged_prob") / F.greatest("n_symbols", F.lit(1)))))


def thresholds(scored: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """(stratum, threshold): one row per language with trusted text, and one for all of it (stratum null)."""
    cell = F.ceil(F.log2("perplexity") * STEPS).cast("long")
    own = (scored.where("perplexity is not null").join(trusted_ids(labels), "doc_id", "left_semi")
           .select(F.coalesce("lang", F.lit("\x00")).alias("stratum"), cell.alias("cell")).groupBy("stratum", "cell").agg(F.count(F.lit(1)).alias("n")))
    cells = own.unionByName(own.groupBy("cell").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("stratum"), "cell", "n"))
    run, every = Window.partitionBy("stratum").orderBy("cell"), Window.partitionBy("stratum")
    cells = cells.withColumn("_to", F.sum("n").over(run)).withColumn("_all", F.sum("n").over(every))
    return (cells.where(F.col("_to") >= F.col("_all") * keep).groupBy("stratum").agg(F.pow(F.lit(2.0), F.min("cell") / STEPS).alias("threshold")))


def judge(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, n_symbols, log2_prob, perplexity, threshold, kept."""
    scored = pin(perplexities(docs, labels), "perplexities")
    limits = pin(thresholds(scored, labels, keep), "thresholds")
    overall = limits.where("stratum is null").first()
    out = (scored.withColumn("stratum", F.coalesce("lang", F.lit("\x00"))).join(limits.where("stratum is not null"), "stratum", "left")
           .withColumn("threshold", F.coalesce("threshold", F.lit(overall.threshold if overall else float("inf")))))
    return out.select("doc_id", "n_symbols", "log2_prob", "perplexity", "threshold",
                      F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
