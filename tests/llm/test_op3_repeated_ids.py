"""One id with several texts: op3 against the closure over documents, any text of which may link."""

import random

from tablescope.llm import op3_minhash_dedup as o3
from tests.llm.test_llm import closure, sets


def test_every_text_of_a_repeated_id_is_compared(spark):
    rng = random.Random(6)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(0, 60, 6):  # id k has four texts, each with a near copy under another id
        four = [text() for _ in range(4)]
        rows += [(k, " ".join(t)) for t in four] + [(k + i + 1, " ".join(t[:-3])) for i, t in enumerate(four)]
    rows += [(70, rows[0][1]), (70, rows[8][1]), (None, rows[0][1]), (80, None), (80, ""), (90, " ".join(text())), (90, " ".join(text()))]
    got = o3.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    s = [(i, sets(t)) for i, t in rows if i is not None]
    low = closure({i for i, _ in s}, [(a, b) for a, x in s for b, y in s if a < b and near(x, y)])
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(i, low[i], low[i] == i) for i in low}
