"""Every stage of the pipeline against a plain Python version, row by row."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tablescope.llm import op6_quality_lm as o6
from tablescope.llm import op9_source_mix as o9
from tests.llm.test_llm import GAP, closure, plain_kneser_ney, sets

COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(labels, input and output rows of each stage, rows of run())"""
    rng, top = random.Random(12), str(tmp_path_factory.mktemp("corpus"))
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    text = lambda n=80: " ".join(rng.choices(words, k=n))
    junk = lambda: " ".join("".join(rng.choice("QXZ#%|09") for _ in range(9)) for _ in range(80))
    rows = [(i, text(60 + i), ("en", "de", None)[i % 3], f"s{i % 2}") for i in range(45)]
    near = " ".join(rows[7][1].split()[:-2])
    rows += [(100, text(), "en", "s0"), (100, junk(), "en", "s0"), (None, text(), "en", "s1"), (None, junk(), "en", "s1"), (None, text(), "de", "s1"),
             (101, near, "en", "s1"), (None, near, "en", "s1"), (None, near, "en", "s1"), (3, junk(), "de", "s0")]
    rows += [(102, text(), "en", "s0")] * 3 + [(103, "a b", "en", "s0"), (104, None, "en", "s0"), (105, "", None, None), (106, "it is so " * 40, "en", "s1")]
    rows += [(107, rows[11][1], "fr", "s0"), (108, junk(), "fr", None)]
    marks = [(i, 1, 0) for i in range(0, 45, 2)] + [(4, 0, 0), (101, 1, 0), (108, 0, 1), (None, 1, 0), (9, None, 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    out = [rows]
    docs = corpus_pipeline.load(spark, top, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.pin(stage(spark, docs, top), f"test-{k}")
        out.append([tuple(r) for r in docs.collect()])
    return marks, out, [tuple(r) for r in corpus_pipeline.run(spark, top).collect()]


def trusted(marks):
    low = {}
    for i, q, _ in marks:
        if i is not None and q is not None:
            low[i] = min(q, low.get(i, q))
    return {i for i, q in low.items() if q >= 1}


def test_quality_classifier(stages):
    marks, out, _ = stages
    rows, good = out[0], trusted(marks)
    lp = plain_kneser_ney([r[1] or "" for r in rows if r[0] in good])
    costs = [-lp(r[1], r[0] in good) / n if n else None for r in rows for n in [len(o6.grams_of(r[1] or ""))]]

    def limit(values):
        cells = sorted(math.ceil(x * o6.STEPS) for x in values)
        return next(c for k, c in enumerate(cells, 1) if k >= o6.KEEP * len(cells)) / o6.STEPS
    known = [(r[2], c) for r, c in zip(rows, costs) if r[0] in good and c is not None]
    limits = {lang: limit([c for x, c in known if x == lang]) for lang in {x for x, _ in known}}
    want = [r for r, c in zip(rows, costs) if c is not None and c <= limits.get(r[2], limit([c for _, c in known]))]
    assert Counter(out[1]) == Counter(want) and len(want) < len([r for r in rows if r[1]])
    # one row's junk does not take the clean rows of its id, nor of the null id
    assert sum(r[0] == 100 for r in want) == 1 and sum(r[0] is None for r in want) >= 2 and sum(r[0] == 3 for r in want) == 1


def test_quality_rules(stages):
    """Too few labels to certify a cutoff: the base rule alone decides."""
    _, out, _ = stages

    def passes(text):
        w = re.findall(GAP, text or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w) >= 50 and 100 * len(cover) <= 50 * len(w)
    assert Counter(out[2]) == Counter(r for r in out[1] if passes(r[1]))


def test_near_duplicates(stages):
    _, out, _ = stages
    rows, s = out[2], [sets(r[1]) for r in out[2]]
    low = closure(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])])
    best = {}
    for k, r in enumerate(rows):
        best[low[k]] = min(best.get(low[k], (True, math.inf)), (r[0] is None, r[0] if r[0] is not None else math.inf))
    groups = Counter(low.values())
    got = out[3]
    assert len(got) == len(groups) < len(rows) and not Counter(got) - Counter(rows)
    # each group's one row has the group's smallest id
    at = {r: low[k] for k, r in enumerate(rows)}
    assert {at[r]: (r[0] is None, r[0] if r[0] is not None else math.inf) for r in got} == best
    assert sum(r[0] == 102 for r in got) == 1


def test_mix_and_tokens(stages):
    _, out, ran = stages
    size = lambda r: len(re.findall(GAP, r[1]))
    sizes, taken, copies = Counter(), Counter(), Counter(out[4])
    for r in out[3]:
        sizes[r[3]] += size(r)
    for r in out[4]:
        taken[r[3]] += size(r)
    assert set(copies) <= set(out[3]) and max(copies.values()) <= 2
    want, most = o9.targets(dict(sizes)), max(map(size, out[3]))
    assert all(abs(taken[s] - want[s]) <= most for s in want)
    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    ids = [tuple(t.encode(r[1], add_special_tokens=False).ids) for r in out[4]]
    expected = Counter((r[0], r[2], r[3], len(x), x) for r, x in zip(out[4], ids))
    assert Counter((*r[:4], tuple(r[4])) for r in out[5]) == expected
    assert Counter((*r[:4], tuple(r[4])) for r in ran) == expected
