"""The training-data operators against brute force, round trips and edge tables."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablescope.llm import (op1_embedding_dedup as o1, op2_hash_tree_shards as o2, op3_minhash_dedup as o3, op4_quality_rules as o4,
                            op5_toxicity as o5, op6_quality_lm as o6, op7_reply_trees as o7, op8_language_id as o8,
                            op9_source_mix as o9, op10_bpe_automaton as o10, queries)
from tablescope.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, bands string, n long, pattern string"
GAP = "[^\x20\x09-\x0D]+"


def make_docs(spark):
    rng = random.Random(3)
    words = {"en": "the of and that with stone river light".split(), "de": "der die und nicht über straße licht".split()}
    rows = []
    for i in range(40):
        lang = "de" if i % 3 == 0 else "en"
        t = " ".join(rng.choice(words[lang]) + str(rng.randrange(30)) * (rng.random() < .5) for _ in range(60 + i))
        rows.append((i, t, lang, f"s{i % 3}"))
    base = rows[5][1].split()
    rows += [(100, " ".join(base[:-2]), "en", "s1"), (101, rows[5][1].upper(), "en", None), (102, rows[5][1], None, "s2"),
             (103, None, None, None), (104, "", "en", "s0"), (105, " \t\n", "en", "s0"), (106, "a b", "en", "s0"), (106, "a b", "en", "s0"),
             (107, "x " * 5000, "en", "s2"), (108, "¿éñ 中文 <|endoftext|>\n\nok\nok", "es", "s1"), (109, "123 !!", "en", "s1")]
    return spark.createDataFrame([(*r, "x", 7, "p") for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return make_docs(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)] + [(107, 0, 0), (3, 1, 0), (None, 1, 1), (5, None, None)],
                                 "doc_id long, quality int, toxic int")


def sets(text):
    w = re.findall(GAP, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def closure(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_components_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1} | {k: 1 for k in range(200, 260)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(rng.standard_normal((60, 16)))]
    for k in range(20):  # near copies, exact copies
        rows.append((100 + k, (np.array(rows[k % 4][1]) + rng.standard_normal(16) * .03 * (k % 3)).tolist(), rows[k % 4][2]))
    odd = [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] + [1.0] * 15, 0), (204, rows[0][1], None), (205, [], 1), (206, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1))
    got = {r.vec_id: r for r in o1.near_vectors(df, block=8).collect()}
    links = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2]
             and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= .98]
    low, n = closure([r[0] for r in rows + odd], links), Counter(x for p in links for x in p)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], low[i], low[i] == i) for i in low}


def test_embeddings_of_any_finite_size_and_repeated_ids(spark):
    """Very small, very large and denormal components; ids that repeat are vectors of their own."""
    rows = [(1, [1e-200, 1e-200]), (2, [5e-324, 1e-323]), (3, [1.0, 0.5]), (4, [1e200, 2e200]), (5, [1.0, 2.0]), (6, [1e308, 1e308]), (7, [-1e200, -2e200]),
            (8, [1e308, 1.1e308]), (9, [1e-300, 1e300]), (10, [0.0, 3.0]), (5, [1.0, 2.0]), (11, [float("inf"), 1.0]), (12, [1.7976931348623157e308, 1e-320]), (13, [1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in o1.near_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")).collect())
    exact = [[Fraction(x) for x in v] if math.isfinite(v[0]) else None for _, v in rows]

    def near(a, b):
        if not a or not b:
            return False
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        return dot > 0 and dot * dot >= Fraction(98, 100) ** 2 * sum(x * x for x in a) * sum(x * x for x in b)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if near(exact[a], exact[b])]
    low, n = closure([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in links]), Counter(x for p in links for x in p)
    assert got == sorted((i, n[k], low[i]) for k, (i, _) in enumerate(rows))
    assert (5, 3, 2) in got and (3, 0, 3) in got


def test_shards(spark, docs):
    got = o2.shard_documents(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        t = by[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert r.grown_shard in (r.shard, 16)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shard_weights_move_only_in_their_subtree(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    heavier = tuple(o2.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 2 else 1.0) for x in o2.SIXTEEN)
    moved = keys.select(o2.shard_of(F.col("k"), o2.SIXTEEN).alias("a"), o2.shard_of(F.col("k"), heavier).alias("b")).where("a <> b").collect()
    assert moved and all(r.b < 8 for r in moved)  # only into the region whose weight grew
    assert all(r.b < 4 for r in moved if r.a >= 4 and r.a < 8)


def test_slots_of_repeated_rows(spark):
    df = spark.createDataFrame([(0, 5)] * 25 + [(0, 6)] + [(1, 5)], "shard int, doc_id long")
    got = o2.number_slots(df, "shard", ["doc_id"], buckets=4, piece=10).collect()
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(26)) and [r.slot for r in got if r.shard == 1] == [0]


def test_minhash(spark, docs):
    got = {r.doc_id: r for r in o3.near_documents(docs).collect()}
    s = {r.doc_id: sets(r.text) for r in docs.collect()}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    low = closure(s, links)
    assert len(links) >= 3
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s[i]), low[i], low[i] == i) for i in s}


def test_bbit_estimate_is_close():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**63, o3.FINE, dtype=np.uint64) for _ in range(2))
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    y = np.concatenate([x[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    shift = np.arange(0, 64, o3.FINE_BITS, dtype=np.uint64)
    pack = lambda s: ((o3.minima(s, a * np.uint64(2) + np.uint64(1), b) & np.uint64(3)).reshape(-1, 32) << shift).sum(1, dtype=np.uint64)[None]
    assert abs(o3.estimates(pack(x), pack(y), o3.FINE_BITS)[0] - .8) < .06


def test_rules_measures_and_bound(spark, docs, labels):
    got = {r.doc_id: r for r in o4.judge(docs, labels).collect()}
    for r in docs.collect():
        w, g = re.findall(GAP, r.text or ""), Counter()
        for i in range(len(w) - 2):
            g[tuple(w[i:i + 3])] += 1
        cover = {j for i in range(len(w) - 2) if g[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if re.search(GAP, x)]
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(cover))
        assert x.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (x.kept and x.base_failed)
    exact = lambda n, p, level: max([k for k in range(min(n, 30) + 1) if n and sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)) <= level], default=-1)
    ns = spark.createDataFrame([(n,) for n in (0, 10, 300, 900, 2000)], "n long")
    for r in ns.select("n", o4.most_rejected(F.col("n"), .01, F.lit(1e-3)).alias("k")).collect():
        assert r.k == exact(r.n, .01, 1e-3)


def test_toxicity_finds_words_in_held_out_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = [(i, " ".join([word() for _ in range(30)] + ["vilest", "scumbag"] * (i % 8 == 0)), 1) for i in range(1600)]
    df = spark.createDataFrame(rows + [(9000, None, 1), (9001, "", 1)], "doc_id long, text string, n int")
    marks = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(1600)], "doc_id long, quality int, toxic int")
    got = o5.score(df, marks).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= .3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got} == {True}
    assert all(r.predicted == (r.doc_id % 8 == 0) for r in held) and len(held) > 200


def plain_kneser_ney(texts):
    """(text, own) -> log2 probability: interpolated modified Kneser-Ney over the characters
    of whole texts; with ``own``, by the counts without the text's, discounts as they are."""
    every, given = Counter(g for t in texts for g in o6.grams_of(t)), []

    def orders(counts, out):
        for k in range(o6.ORDER):
            if len(given) <= k:
                n = Counter(counts.values())
                y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else .5
                given.append([min(float(i), max(.05, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2)) for i in (1, 2, 3)])
            total, freed = Counter(), Counter()
            for g, n in counts.items():
                total[g[:-1]] += n
                freed[g[:-1]] += given[k][min(n, 3) - 1]
            out.insert(0, ({g: (n - given[k][min(n, 3) - 1]) / total[g[:-1]] for g, n in counts.items()}, {c: freed[c] / total[c] for c in total}))
            counts = Counter(g[1:] for g in counts)
        return out
    whole = orders(every, [])

    def lp(text, own=False):
        grams = o6.grams_of(text)
        tables, total = orders(every - Counter(grams), []) if own else whole, 0.0
        for gram in grams:
            p = tables[0][1].get("", 1.0) / (len(tables[0][0]) + 1)
            for k, (of, back) in enumerate(tables):
                p = p * (back.get(gram[-k - 1:-1], 1.0) if k else 1.0) + of.get(gram[-k - 1:], 0.0)
            total += math.log2(p)
        return total
    return lp


def test_kneser_ney_sums_to_one(spark, docs, labels):
    tables = o6.kneser_ney(o6.count_trusted(docs, o6.trusted_ids(labels)))
    symbols = [r.gram for r in tables[0]["grams"].collect()]
    model = o6._Model(o6.model_numbers(tables), o6.frequent(o6.model_table(tables)))
    for history in ("\x02\x02\x02", "the", "zzz", "f t"):
        grams = o6._codes("".join(history + s for s in [*symbols, "\u4e2d"])).reshape(-1, o6.ORDER)
        assert abs((2 ** model.log2(model.known(grams))).sum() - 1) < 1e-9


@pytest.mark.parametrize("cache, chunk, shard, piece", [(1 << 18, 2000, 100_000, 1 << 20), (0, 3, 50, 500), (40, 7, 300, 1)])
def test_perplexity_matches_one_by_one(spark, docs, labels, monkeypatch, cache, chunk, shard, piece):
    """The same whatever is broadcast, and over many chunks, shards and pieces."""
    for name, value in (("CHUNK_ROWS", chunk), ("SHARD", shard), ("AT_ONCE", piece)):
        monkeypatch.setattr(o6, name, value)
    monkeypatch.setattr(o6.frequent, "__defaults__", (cache,))
    path = queries.op6_quality_lm.pin(docs, "test-docs")
    rows = [(r.doc_id, r.text) for r in path.select("doc_id", "text").collect()]
    good = {r.doc_id for r in o6.trusted_ids(labels).collect()}
    lp = plain_kneser_ney([t or "" for i, t in rows if i in good])
    want = sorted((i, len(o6.grams_of(t or "")), lp(t or "", i in good)) for i, t in rows)
    got = sorted((r.doc_id, r.n_symbols, r.judged_prob) for r in o6.perplexities(path, labels).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want, strict=True))
    judged = {r.doc_id: r.kept for r in o6.judge(path, labels).collect()}
    assert not judged[103] and not judged[104] and judged[0]


def test_perplexity_of_texts_that_hold_the_marks(spark, docs, labels):
    texts = ["the of and", "a\x03b the", "\x02a\x02 \x03", "a\ufffdb the", "\ufffda\ufffd \ufffd"]
    more = docs.unionByName(spark.createDataFrame([(200 + i, t, "en", "s0", "x", 7, "p") for i, t in enumerate(texts)], DOCS))
    marks = labels.unionByName(spark.createDataFrame([(201, 1, 0), (204, 1, 0)], labels.schema))  # one of them is trusted
    got = {r.doc_id: r for r in o6.judge(more, marks).collect()}
    assert len(got) == more.select("doc_id").distinct().count() and [got[200 + i].n_symbols for i in range(5)] == [11, 8, 6, 8, 6]
    assert math.isclose(got[201].log2_prob, got[203].log2_prob) and math.isclose(got[202].log2_prob, got[204].log2_prob)


def test_word_order_counts(spark):
    """The words of trusted text in another order, and one of them again and again, cost more."""
    rng, said = random.Random(8), "the stone lies under a river of light and that is old".split()
    rows = [(i, " ".join(said[rng.randrange(6):6 + rng.randrange(1, 7)] * 3), "en") for i in range(30)]
    rows += [(50, " ".join(said * 3), "en"), (51, " ".join(rng.sample(said * 3, 36)), "en"), (52, "the " * 36, "en"), (53, "a newword the", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got, lp = {r.doc_id: r for r in o6.perplexities(df, marks).collect()}, plain_kneser_ney([t for i, t, _ in rows if i < 30])
    assert all(math.isclose(got[i].judged_prob, lp(t, i < 30), abs_tol=1e-6) for i, t, _ in rows)
    assert got[50].n_symbols == got[51].n_symbols
    assert got[50].perplexity < got[51].perplexity and got[50].perplexity < got[52].perplexity


def test_reply_tree_paths_and_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|a <\\\\|b [\\INST] <<SYS>><", "", None, "中[INST"]
    rows = [("t", 1, None, 0., "user", hard[0]), ("t", 2, 1, 1., "assistant", hard[1]), ("t", 3, 1, 5., "assistant", hard[2]), ("t", 4, 3, 5., "us\ner", hard[3]),
            ("t", 5, 2, 0., "user", hard[4]), ("u", 1, 99, 0., "assistant", hard[5]), ("v", 1, 2, 0., "user", "cycle"), ("v", 2, 1, 0., "user", "cycle"), (None, 1, None, 0., None, "a")]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    every = o7.choose_paths(nodes.select("tree", "node", "parent", "score"), None).collect()
    paths = {(t, p): [r.node for r in sorted((x for x in every if (x.tree, x.path) == (t, p)), key=lambda x: x.pos)] for t, p in {(r.tree, r.path) for r in every}}
    assert paths == {("t", 4): [1, 3, 4], ("t", 5): [1, 2, 5], ("u", 1): [1], (None, 1): [1]}
    best = o7.choose_paths(nodes.select("tree", "node", "parent", "score"))
    back = {r.tree: r for r in o7.read_back(o7.format_paths(best, nodes)).collect()}
    assert [(x.role, x.text) for x in back["t"].turns] == [("user", hard[0]), ("assistant", hard[2]), ("us\ner", "")]
    assert back["t"].loss_text == hard[2] and back["u"].loss_text == hard[5]
    piece = back["t"].formatted
    assert o7.START in piece and "[INST]" not in piece and "</s>" not in piece


def test_language_id(spark, docs):
    got = {r.doc_id: r for r in o8.identify(docs).collect()}
    assert [got[i].lang_pred for i in (103, 104, 105, 109)] == ["und"] * 4
    want = {r.doc_id: r.lang for r in docs.where("doc_id < 40").collect()}
    assert sum(got[i].lang_pred == x for i, x in want.items()) >= 38
    assert all(0 <= r.score <= 1 for r in got.values())


def test_targets_and_flow():
    sizes = {"a": 100, "b": 10, None: 50}
    t = o9.targets(sizes)
    assert abs(sum(t.values()) - 240) < 1e-9 and all(t[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    # words of the shared pattern serve the short source; repetition only when fresh words are used up
    dealt = o9.flow({("a",): 50, ("a", "b"): 30, ("b",): 10}, {"a": 40, "b": 40})
    assert sum(v for (_, _, s), v in dealt.items() if s == "a") == 40 and sum(v for (_, _, s), v in dealt.items() if s == "b") == 40
    assert sum(v for (_, level, _), v in dealt.items() if level == 1) == 0
    assert sum(v for (_, level, _), v in o9.flow({("b",): 10}, {"b": 15}).items() if level == 1) == 5


def test_mix(spark, docs):
    got, again = (sorted((r.doc_id, r["size"], r.taken, r.target) for r in o9.mix_digest(docs).collect()) for _ in range(2))
    assert got == again and len(got) == docs.count() and all(t <= 2 * n for _, n, t, _ in got)
    rows = o9.apply_mix(docs)
    assert rows.columns == docs.columns
    assert rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4  # one id stands for two rows


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(200)]
    slim, goals = o9.mix(spark.createDataFrame(rows, "doc_id long, text string, m array<string>"), F.col("m"))
    want = {r.source: r.target for r in goals.collect()}
    taken = {r.member: r.n for r in slim.select("size", F.explode("takes").alias("t")).groupBy("t.member").agg(F.sum("size").alias("n")).collect()}
    # both want 4500 words of 2000, which may be used twice
    assert all(taken[s] <= want[s] + 20 for s in want) and 3960 <= sum(taken.values()) <= 4000


def test_bpe_equals_the_library(spark, docs):
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in o10.decode(o10.encode(docs, PATH), PATH).collect()}
    for r in got.values():
        assert r.ids == t.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    a, rng = o10.Automaton(o10.read_vocabulary(PATH)), random.Random(2)
    for _ in range(3000):
        w = "".join(rng.choice("aab =-\té中") for _ in range(rng.randint(1, 24)))
        split = o10.splitter({})(w)[0][1]
        assert [i for x in split for i in a.encode_word(x.encode())] == t.encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize("op", [o2.shard_documents, o3.near_documents, o8.identify, o9.mix_digest, o9.apply_mix,
                                lambda d: o10.encode_digest(d, PATH), lambda d: o4.judge(d, NONE(d)), lambda d: o5.score(d, NONE(d)), lambda d: o6.judge(d, NONE(d))])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], DOCS)).count() == 0


def NONE(d):
    return d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")


def test_without_labels_nothing_is_learned(spark, docs):
    assert all(r.kept == (not r.base_failed) for r in o4.judge(docs, NONE(docs)).collect())
    assert len({r.score for r in o5.score(docs, NONE(docs)).collect()}) == 1
    assert all(r.kept == (r.n_symbols > 0) for r in o6.judge(docs, NONE(docs)).collect())


def test_empty_conversations_and_vectors(spark):
    assert o7.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert o1.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and set(queries.QUERIES) == {k for k in queries.QUERIES if re.match(r"op\d+_", k)}
