"""Word memory, word walk and fast split of op10, against the plain forms."""

import random

import public_tokenizers
import pytest
import regex

from tablescope.llm import op10_bpe_automaton as o10


@pytest.fixture(scope="module")
def vocabulary():
    return o10.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_frequent_words_are_encoded_once_while_rare_ones_come_and_go(vocabulary, monkeypatch):
    monkeypatch.setattr(o10, "REMEMBERED", 4)
    words, asked = o10._Words(o10.Automaton(vocabulary), True), []
    encode = words.automaton.encode_word
    words.automaton.encode_word = lambda w: asked.append(w) or encode(w)
    for i in range(50):
        ids, said = words[" often"]
        assert (ids, said) == (encode(b" often"), ",".join(map(str, encode(b" often"))))
        words[f" rare{i}"]
    assert asked.count(b" often") == 1
    assert len(words) + len(words.old) <= 2 * o10.REMEMBERED
    words.forget()
    assert not words and not words.old


def merged(rank, single, word):
    """The word's tokens by the merges, one after another."""
    ids = [single[b] for b in word]
    while found := [(rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]:
        i = min(found)[1]
        ids[i:i + 2] = [rank[ids[i], ids[i + 1]][1]]
    return tuple(ids)


def test_walk_equals_merges(vocabulary):
    rng, automaton = random.Random(7), o10.Automaton(vocabulary)
    words = [bytes(rng.choice(b"aenrt hio\xc3\xa9\xe4\xb8\xad\n1") for _ in range(rng.randint(1, 24))) for _ in range(1500)]
    words += [bytes(rng.randrange(256) for _ in range(rng.randint(1, 12))) for _ in range(300)] + [c * k for c in (b"a", b" ", b"-", b"\xe4") for k in (1, 2, 7, 65, 300)]
    rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(vocabulary["merges"])}
    single = {label[0]: i for i, label in vocabulary["labels"].items() if len(label) == 1}
    assert [automaton.encode_word(w) for w in words] == [merged(rank, single, w) for w in words]
    assert automaton.encode_word(b"") == ()


def test_split_equals_the_pattern_for_every_character(vocabulary):
    split, plain = o10.splitter(vocabulary["special"]), regex.compile(o10.SPLIT)
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x30000)]]
    texts = [j.join(every[i:i + 500]) for i in range(0, len(every), 500) for j in ("a", " ", "1'", "\n")]
    rng = random.Random(3)
    texts += ["".join(rng.choices(" \n\t\r'sdlvretm1a\x1c\x1f\x85\xa0　​́²½_.é中𝟘😀", k=rng.randint(0, 60))) for _ in range(5000)]
    assert all(split(t) == [(False, plain.findall(t))] for t in texts)
