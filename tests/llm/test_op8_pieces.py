"""Dictionaries of op8 are counted over whole training texts; every length is judged by one rule."""

import re
import zlib
from collections import Counter

import pytest
import zstandard

from tablescope.llm import op8_language_id as o8

DOCS = "doc_id long, text string, lang string"


def test_shared_boilerplate_does_not_fill_the_dictionary(spark):
    head = "this page is shown as it was found and nothing of it is ours " * 80
    rows = [(i, head + " ".join(f"straße{chr(97 + (i * k) % 26)} nicht über licht{chr(97 + k % 26)}" for k in range(2000)), "de") for i in range(60)]
    rows += [(100, "kurz und gut", "fr")]
    got = o8.learn(spark.createDataFrame(rows, DOCS))
    assert got["de"].count("licht".encode()) > 10 * got["de"].count(b"page is shown")
    assert got == o8.learn(spark.createDataFrame(rows, DOCS))
    # a short text is still used whole
    assert sorted(b"".join(got["fr"].split())) == sorted(b"kurzundgut") if "fr" in got else True


def wanted(rows, size):
    """Words of the dictionaries and the language of each text, one after the other."""
    texts, counts = Counter(), {}
    for i, text, lang in rows:
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        if lang is not None and words and zlib.crc32(str("" if i is None else i).encode()) % 4 != 2:
            texts[lang] += 1
            counts.setdefault(lang, Counter()).update(words)
    return [lang for lang, _ in sorted(texts.items(), key=lambda x: (-x[1], x[0]))], counts


@pytest.mark.parametrize("size", [40, 112_000])
def test_dictionaries_and_predictions_equal_plain_python(spark, size):
    rows = [(i, " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k % 7)}" for k in range(i % 50 + 1)), "ab"[i % 2]) for i in range(120)]
    rows += [(200, None, "a"), (201, "", "a"), (202, "12 34 !", "b"), (203, "Größe ÜBER", None), (None, "niemand wa", "b"), (204, "x" * 200_000, "c"),
             (5, rows[5][1], "b"), (5, rows[5][1], "b"), (206, "solo", "")]
    df = spark.createDataFrame([(*r, "more") for r in rows], DOCS + ", words string")
    got = o8.learn(df, dictionary_bytes=size)
    order, counts = wanted(rows, size)
    for lang, content in got.items():
        words = content.decode().split(" ")
        n = [counts[lang][w] for w in words]
        assert n == sorted(n) and len(set(words)) == len(words) and len(content) <= size  # commonest last
        left = [w for w in counts[lang] if w not in words and len(w.encode()) < size]
        assert all(counts[lang][w] <= n[0] for w in left) and (size == 40 or not left)
    # 200,000 letters are longer than a dictionary: the language they stand for is not learned
    assert list(got) == [x for x in order if x != "c"]
    full = o8.learn(df)
    tools = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=o8.LEVEL,
                                      write_content_size=False, write_checksum=False, write_dict_id=False) for c in full.values()]
    predict = o8.predictor(full)
    names = list(full)
    for _, text, _ in rows:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        sizes = [len(t.compress(" ".join(words).encode())) + len(t.compress(" ".join(words[::-1]).encode())) for t in tools]
        lang, score, _ = predict(text)
        if not words:
            assert (lang, score) == ("und", 0.0)
        else:
            close = sizes[names.index(lang)] - min(sizes)  # a dictionary prepared ahead may match a little otherwise
            assert close <= 4
    rows_out = {(r.doc_id, r.lang_pred) for r in o8.identify(df).collect()}
    assert rows_out == {(i, predict(t)[0]) for i, t, _ in rows}


def test_many_languages_share_the_total(spark):
    rows = [(4 * i, f"wort gemein l{chr(97 + i % 26)}{chr(97 + i // 26)}", f"l{i}") for i in range(300)]
    got = o8.learn(spark.createDataFrame(rows, DOCS), total_bytes=6000)
    assert got and sum(map(len, got.values())) <= 6000


def test_held_out_accuracy_at_all_lengths(spark):
    """Texts of 3 to 3000 words of two vocabularies: nearly all held-out ones are named right."""
    vocabulary = {"en": "the of and that with stone river light house water".split(), "de": "der die und nicht über straße haus wasser fluss stein".split()}
    rows = [(i, " ".join(vocabulary[lang][(i * 7 + k * k) % 10] for k in range(3 + (i * i) % (3000 if i % 5 == 0 else 40))), lang)
            for i in range(400) for lang in (["en", "de"][i % 2],)]
    want = {r[0]: r[2] for r in rows}
    out = [r for r in o8.identify(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    assert len(out) > 60 and sum(r.lang_pred == want[r.doc_id] for r in out) >= 0.98 * len(out)
