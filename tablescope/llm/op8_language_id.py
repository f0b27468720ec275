"""Language identification by compression with per-language zstandard dictionaries.

A language's raw-content dictionary holds the words that occur in most of its
training texts, the commonest last (zstandard reaches near matches more cheaply),
up to ``dictionary_bytes``; many languages share ``total_bytes`` evenly. Those two
sizes are the only bounds: every word of every whole training text is counted, by
texts, so neither boilerplate inside a text nor one long text fills a dictionary.
Words of equal counts come in a seeded hash order.

A whole text, reduced to its lower-case words, is compressed with every dictionary,
its words once in their order and once in the opposite order (sizes are whole
bytes; the sum tells finer). The smallest sum names the language, at every length
by the same rule. Equal sums go to the language with more training texts. The
prediction is marked ``narrow`` (rejected by users who want certainty) when the
best saves less than ``least_margin`` of the second best.

Learned only from text and non-null lang of rows outside the held-out fold;
lang, source and doc_id are never inputs of a prediction. The dictionaries, at
most ``total_bytes`` together, are all that reaches the driver and is broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
with no training language every text is ``und``; a word longer than a dictionary
is in none, and a language of which no word fits is not learned; repeated rows
keep a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import TEXTS_AT_ONCE, held_out, lean, pin, small_batches

DICTIONARY_BYTES, TOTAL_BYTES, LEVEL, LEAST_MARGIN, SEED, SALTS = 112_000, 16_000_000, 6, 0.02, 53, 64

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The words of a whole text in lower case: runs of letters (and of the signs that count as such)."""
    return _WORD.findall(text.lower())


def word_counts(rows: DataFrame) -> DataFrame:
    """``rows(lang, text)`` -> lang, word, n: in how many texts of the language a word
    occurs; the empty word stands for the texts that have a letter at all. Texts are
    counted together batch by batch before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                part, counts = whole.slice(start, TEXTS_AT_ONCE), Counter()
                for lang, text in zip(part.column("lang"), part.column("text")):
                    found = set(words_of(text.as_py()))
                    if any(c.isalpha() for w in found for c in w):
                        name = lang.as_py()
                        counts.update((name, w) for w in found)
                        counts[name, ""] += 1
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                                  pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])
    return rows.mapInArrow(lean(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, seed: int = SEED, dictionary_bytes: int = DICTIONARY_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """language -> dictionary content, the language with most training texts first."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    counts = pin(word_counts(rows), "language-words")
    texts = counts.where("word = ''").select("lang", F.col("n").alias("texts"))
    share = min(dictionary_bytes, total_bytes // max(1, texts.count()))
    # a language's words are cut in SALTS parts first: what does not fit as a part's best cannot be among the best of all
    order = [F.col("n").desc(), "h", "word"]
    best = (counts.where((F.col("word") != "") & (F.octet_length("word") < share)).withColumn("h", F.xxhash64(F.lit(seed), "word"))
            .withColumn("salt", F.pmod("h", F.lit(SALTS))))
    for keys in (["lang", "salt"], ["lang"]):
        upto = F.sum(F.octet_length("word") + 1).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        best = best.withColumn("upto", upto).where(F.col("upto") <= share)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("upto", "word")), asc=False), lambda x: x["word"]), " ")
    found = best.groupBy("lang").agg(joined.alias("words")).join(texts, "lang").collect()  # at most total_bytes of words
    return {r.lang: r.words.encode() for r in sorted(found, key=lambda r: (-r.texts, r.lang))}


def predictor(dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN):
    """text -> (language, score, narrow). Languages come in order of preference for ties."""
    langs, compressors = list(dictionaries), []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(text: str | None) -> tuple[str, float, bool]:
        words = words_of(text) if text and langs else []
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0, True
        there, back = " ".join(words).encode(), " ".join(reversed(words)).encode()
        sizes = [len(c.compress(there)) + len(c.compress(back)) for c in compressors]
        order = sorted(range(len(langs)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(langs) > 1 else 2 * best
        margin = (second - best) / second
        return langs[order[0]], min(1.0, max(0.0, margin)), margin < least_margin
    return predict


def identify(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred, score, narrow of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, seed))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shipped.value)
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(start, TEXTS_AT_ONCE)
                out = [predict(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()),
                                                  pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
                                                 names=["doc_id", "held_out", "lang_pred", "score", "narrow"])
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, narrow boolean")
