"""Line dedup, the Merkle manifest and the prefix trie against plain Python, on edge rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablescope.llm import op11_line_dedup as o11, op12_merkle_manifest as o12, op13_prefix_trie as o13
from tablescope.llm.running import running

BLANKS = " \t\n\x0b\f\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, lost string, grp string, n long, rank long"
CONVS = "conv_id long, turn long, role string, text string, depth long, alone boolean, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain_lines(docs, chars=20, least=3):
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        lost = [len(ids := held.get(key(x), ())) >= least and max(ids, key=lambda d: (d is not None, d)) != i for x in lines]
        out.append((i, len(lines), sum(lost), sha("\n".join(x for x, gone in zip(lines, lost, strict=True) if not gone))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    common = [f"This is a COMMON line number {k} of the set" for k in range(6)] + ["short", "", "é" * 20, "É" * 20, "ABCDEFGHIJKLMNOPQRST", "abcdefghijklmnopqrs"]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t", "\x0b"]) + (rng.choice(common) if rng.random() < .6 else f"a line of document {i} alone {rng.random()}") + rng.choice(["", "\r", " \x0c"])
                          for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(3, "This is a common line number 0 of the set\n\n"), (3, rows[3][1]), (3, rows[3][1]), (None, None), (None, "this is a common line number 1 of the set"),
             (None, "this is a common line number 1 of the set"), (200, "x"), (201, ""), (202, "\n\n"), (203, "this is a common line number 2 of the set\n" * 3000 + "end"),
             (-5, "this is a common line number 2 of the set\x00"), (99, "   " + "a" * 19 + "   ")]
    return rows


def frame(spark, rows):
    rng = random.Random(5)
    return spark.createDataFrame([(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "Ä", "", None, "=", "a"]), None if t is None else len(t), "r", "l", "g", 4, 9)
                                  for i, t in rows], DOCS)


def test_lines_equal_plain_python(spark, texts):
    got = sorted((tuple(r) for r in o11.line_digest(frame(spark, texts)).collect()), key=repr)
    assert got == plain_lines(texts)


def test_lines_keep_other_columns_and_empty_tables(spark, texts):
    docs = frame(spark, texts).withColumnRenamed("grp", "n_lines")
    out = o11.drop_common_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert out.count() == len(texts) and out.where("row <> 'r' or lost <> 'l' or n <> 4").count() == 0
    assert o11.line_digest(docs.limit(0)).collect() == []


def test_lines_spread_over_more_documents_than_a_task(spark):
    rows = [(i, f"the passage that all the documents share\nown line of the document {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.n_dropped for r in o11.line_digest(docs).collect()}
    assert got == {i: int(i != 2999) for i in range(3000)}


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def grow(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        start = at // 3 * 3
        out.append((level[start:at], level[at + 1:start + 3]))
        at //= 3
    return out


def plain_manifest(rows):
    by = defaultdict(list)
    for d, t, lang, s, n in rows:
        leaf = sha("".join(map(field, (d, s, lang, n, t))))
        bent = t if t is None or d is None or zlib.crc32(str(d).encode()) % 2 else t.replace("\n", "")
        by[s].append((d is not None, d or 0, leaf, sha("".join(map(field, (d, s, lang, n, bent)))), d))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(by[s])]) for s in names}
    top = grow([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, found, d) in enumerate(sorted(by[s])):
            steps = siblings(trees[s], at) + siblings(top, k)
            node = found
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            out.append((d, leaf, trees[s][-1][0], top[-1][0], sha("".join(x for left, right in steps for x in left + right)), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 3, 4, 28, 72])
def test_manifest_equals_plain_python(spark, texts, size):
    docs = frame(spark, texts[-size:])
    want = plain_manifest([tuple(r)[:5] for r in docs.collect()])
    assert sorted((tuple(r) for r in o12.manifest_digest(docs).collect()), key=repr) == want


def test_manifest_of_one_large_source_and_many_small(spark):
    rows = [(i, f"line {i}\nend", "en", "hot" if i % 3 else f"s{i % 50}", i) for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = o12.manifest_digest(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_no_rows(spark, texts):
    assert o12.manifest_digest(frame(spark, texts).limit(0)).collect() == []


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - int(abs(c) % 100) * (1 if c > 0 else -1), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)))) for p, m in members.items()), key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(13)
    rows = [(rng.choice([100 * f + k for f in range(3) for k in range(40)] + [-7, -107]), rng.choice([None, 0, 1, 2, 3, 4, 5, 6]), rng.choice(["user", "assistant", None, ""]),
             rng.choice(["a", "bb", "é", None, "", "ccc"])) for _ in range(500)]
    rows = list({(r[0], r[1]): r for r in rows}.values())  # one row per turn: ties are ranked by a hash
    rows += [(700 + k, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for k in range(60) for t in range(8 if k % 3 else 5)]
    rows += [(900, t, "user", "same") for t in range(300)] + [(901, t, "user", "same") for t in range(300)] + [(902, 0, "user", "same"), (902, 0, "user", "same")]
    return rows + [(None, 0, "user", "x"), (1011, 0, "user", "gone")]


def as_rows(df):
    return sorted((tuple(r[c] for c in o13.NODE) for r in df.collect()), key=repr)


@pytest.mark.parametrize("cells", [o13.BLOCK, o13.MAX_CELLS])
def test_trie_equals_plain_python(spark, talks, cells):
    df = spark.createDataFrame([(*r, 1, True, "k") for r in talks], CONVS).repartition(6)
    assert as_rows(o13.trie(df, cells)) == plain_trie(talks)


def test_trie_when_no_prefix_is_proved_alone(spark, talks, monkeypatch):
    """Counters full of twos: every prefix is grouped exactly."""
    import numpy as np
    monkeypatch.setattr(o13, "sketch", lambda rows, width: np.full(o13.ROWS * width // 4, 0xAA, np.uint8))
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    assert as_rows(o13.trie(df)) == plain_trie(talks)


def test_sketch_never_counts_too_little(spark):
    rows = spark.range(4000).selectExpr("xxhash64(id % 3000) as d1", "xxhash64(id % 3000, 7) as d2").repartition(5)
    counters, width = o13.sketch(rows, o13.BLOCK), o13.BLOCK
    marked = o13.screened(rows.selectExpr("d1 as conv_id", "1L as depth", "d1", "d2"), counters, width)
    judged = marked.groupBy("d1").agg(F.count("*").alias("n"), F.max("alone").alias("alone"))
    assert judged.where("n > 1 and alone").count() == 0
    assert judged.where("n = 1 and alone").count() > 1800


def test_trie_of_no_rows_and_of_no_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert o13.trie(spark.createDataFrame([], schema)).collect() == []
    h = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(h, 0, "user", "x"), (h, 1, "assistant", "y")]
    assert as_rows(o13.trie(spark.createDataFrame(rows, schema))) == plain_trie(rows)


def test_running_totals_cross_pieces(spark):
    rows = [(i % 2, i, i * 7 % 13) for i in range(5000)]
    df = spark.createDataFrame([("a" if g else "b", i, v) for g, i, v in rows], "g string, i long, v long").repartition(9)
    got = {r.i: (r.rank, r.n, r.v_run) for r in running(df, "g", ["i"], "test-order", sums=["v"]).collect()}
    for g in (0, 1):
        total = 0
        for k, i in enumerate(x[1] for x in rows if x[0] == g):
            total += i * 7 % 13
            assert got[i] == (k, 2500, total)
