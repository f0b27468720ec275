"""Byte-pair encoding by a tokenization automaton.

The automaton's arcs carry tokens; it accepts exactly the token sequences that
the merges produce. It is compiled by one merge gadget after another, starting
from a single state with a loop for every byte. For a merge (u, v) -> w, every
state with an u-arc into a state that has a v-arc gets a w-arc to where that v
led, and its u-arc is led to a copy of that state which lacks v (and, when u is
v, also w, since pairs form from the left). The target of an arc depends only on
its label, so one state per label exists at a time and the gadget is one step on
a shared state: the copy is the old state plus one forbidden entry (v, time).

Arcs are read off on demand: from the state after x, token y has an arc unless
some entry (u, time) of that state meets a token u on y's left spine that was
still unmerged then. Each answer is stored in the transition table.

A pre-split word is encoded by walking its bytes: at each state the matching
arcs are tried longest first, stepping back on dead ends; the accepted path is
unique, and ends are remembered so no (position, state) is entered twice.
Decoding emits the arc labels' bytes.

The vocabulary file is read on the driver and shipped to the tasks; its size is
bounded by the file, whatever the corpus. Texts are encoded whole, a batch at a
time; finished words are remembered up to a fixed number.

Defined results: a null text is an empty one: no tokens, empty digests; the
special token's string inside a text is that token, as the library has it;
repeated rows keep a row each; an empty table gives an empty result; extra
columns are ignored by ``encode_digest`` and kept by ``encode``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import lean, small_batches

#: Fixed value: the split pattern of byte-level BPE (public with the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """{"labels": {id: bytes}, "merges": [(left id, right id, id)], "special": {text: id}}."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names, ids = byte_names(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    labels = {i: bytes(names[c] for c in t) for t, i in ids.items() if t not in special}
    labels |= {i: t.encode() for t, i in special.items()}
    merges = []
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((ids[a], ids[b], ids[a + b]))
    return {"labels": labels, "merges": merges, "special": special}


#: Bytes by which the tokens that may begin a string are looked up; the lengths below that are always tried.
HEAD = 4
SHORT = tuple(range(HEAD - 1, 0, -1))


class Automaton:
    """States are named by the label that leads to them; -1 is the start."""

    def __init__(self, vocabulary: dict):
        self.labels = labels = vocabulary["labels"]
        special = set(vocabulary["special"].values())
        self.left: dict[int, tuple[int, int]] = {}  # token -> (left part, time it was formed)
        self.forbidden: dict[int, dict[int, int]] = {-1: {}}
        produced = {t for _, _, t in vocabulary["merges"]}
        self.bytes = {label[0]: i for i, label in labels.items() if len(label) == 1 and i not in special and i not in produced}
        for i in self.bytes.values():
            self.forbidden[i] = {}
        for time, (u, v, w) in enumerate(vocabulary["merges"]):
            self._gadget(u, v, w, time)
        self.arcs: dict[tuple[int, int], bool] = {}
        self.match: dict[bytes, int] = {labels[i]: i for i in self.forbidden if i != -1}
        self.length: dict[int, int] = {i: len(label) for label, i in self.match.items()}
        self.sizes: dict[bytes, tuple[int, ...]] = self._sizes()
        # token -> the longest token that its label begins with, itself not counted; -1: none
        self.shorter: dict[int, int] = {i: self._longest(label[:-1]) for label, i in self.match.items()}

    def _sizes(self) -> dict[bytes, tuple[int, ...]]:
        """The first bytes of a string -> the lengths that tokens beginning so have, longest first, then all smaller ones."""
        found: dict[bytes, set[int]] = {}
        for label in self.match:
            if len(label) >= HEAD:
                found.setdefault(label[:HEAD], set()).add(len(label))
        return {head: (*sorted(sizes, reverse=True), *SHORT) for head, sizes in found.items()}

    def _longest(self, word: bytes, at: int = 0) -> int:
        """The longest token that ``word`` has at ``at``; -1: none. A slice beyond the end
        is the rest of the word, which no longer match can beat."""
        for size in self.sizes.get(word[at:at + HEAD], SHORT):
            token = self.match.get(word[at:at + size])
            if token is not None:
                return token
        return -1

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        if u not in self.forbidden or v not in self.forbidden or w in self.forbidden or not self._open(u, v, time):
            return  # the merge can never fire (or its token exists): no state changes
        self.left[w] = (u, time)
        # w leads where v led: that state as it is now; later gadgets change only one of the two
        self.forbidden[w] = dict(self.forbidden[v])
        self.forbidden[u][v] = min(time, self.forbidden[u].get(v, time))
        if u == v:
            self.forbidden[u].setdefault(w, time)

    def _open(self, state: int, token: int, now: int) -> bool:
        """Is there an arc from ``state`` labelled ``token``? A left part forbidden
        before the token was formed from it rules the token out."""
        rules = self.forbidden[state]
        formed = now + 1
        while True:
            since = rules.get(token)
            if since is not None and since < formed:
                return False
            if token not in self.left:
                return True
            token, formed = self.left[token]

    def step(self, state: int, token: int) -> bool:
        key = (state, token)
        there = self.arcs.get(key)
        if there is None:
            if len(self.arcs) > 500_000:
                self.arcs.clear()
            there = self.arcs[key] = self._open(state, token, 1 << 60)
        return there

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The accepted path. What matches at a position is the longest match there and,
        one after another, the next shorter token that begins it."""
        n, path, dead = len(word), [], set()
        if not n:
            return ()
        length, shorter, arcs, longest = self.length, self.shorter, self.arcs, self._longest
        at, state, token = 0, -1, longest(word)
        while True:
            while token != -1:
                there = arcs.get((state, token))
                if (self.step(state, token) if there is None else there) and (not dead or (at + length[token], token) not in dead):
                    break
                token = shorter[token]
            if token != -1:
                path.append(token)
                at, state = at + length[token], token
                if at == n:
                    return tuple(path)
                token = longest(word, at)
                continue
            if not path:
                raise ValueError("a byte of the word is not in the vocabulary")
            dead.add((at, state))
            last = path.pop()
            at, state, token = at - length[last], path[-1] if path else -1, shorter[last]

    def decode(self, ids) -> bytes:
        """The arc labels, one after another."""
        return b"".join(map(self.labels.__getitem__, ids))


def _members(property_: str) -> str:
    """The characters up to U+FFFF that ``property_`` matches, as the inside of a character class."""
    every, out = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000)))), []
    for run in regex.finditer(property_ + "+", every):
        out.append(f"\\u{ord(run[0][0]):04x}-\\u{ord(run[0][-1]):04x}")
    return "".join(out)


@cache
def _plain_pattern() -> re.Pattern:
    """SPLIT for texts without characters above U+FFFF: the same classes written out, for
    the faster ``re``. Only an apostrophe begins a short form, so its place does not matter."""
    letter, number, space = map(_members, (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _pieces(pattern: regex.Pattern, plain: re.Pattern, text: str) -> list[str]:
    above = not text.isascii() and len(text.encode("utf-16-le")) > 2 * len(text)
    return (pattern if above else plain).findall(text)


def splitter(special: dict):
    pattern, plain = regex.compile(SPLIT), _plain_pattern()
    parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def split(text: str):
        """(is special, string) pieces of a whole text."""
        if parts is None or not any(s in text for s in special):
            return [(False, _pieces(pattern, plain, text))]
        return [(True, p) if p in special else (False, _pieces(pattern, plain, p)) for p in parts.split(text) if p]
    return split


#: Words that a Python worker remembers before the older ones go; at most twice as many are held.
REMEMBERED = 100_000


class _Words(dict):
    """word -> (ids, ids as text if they are wanted), filled by the automaton, bounded:
    when full, all words become old ones, and old ones not met again till it is full once more go."""

    def __init__(self, automaton: Automaton, said: bool):
        super().__init__()
        self.automaton, self.said, self.old = automaton, said, {}

    def __missing__(self, word: str):
        out = self.old.pop(word, None)
        if out is None:
            ids = self.automaton.encode_word(word.encode())
            out = (ids, ",".join(map(str, ids)) if self.said else "")
            if len(word) > 64:
                return out
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}


def _encoder(vocabulary, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.value
        # one compiled automaton and one word memory per Python worker: later tasks of the worker find them beside the vocabulary
        if "words" not in table:
            table["words"] = _Words(Automaton(table), digest)
        words, special, labels = table["words"], table["special"], table["labels"]
        split = splitter(special)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                counts, left, right, lists = [], [], [], []
                for value in batch.column("text"):
                    out, said = [], []
                    for is_special, piece in split(value.as_py() or ""):
                        if is_special:
                            out.append(special[piece])
                            said.append(str(special[piece]))
                        elif piece:
                            found = list(map(words.__getitem__, piece))
                            out.extend(chain.from_iterable(map(itemgetter(0), found)))
                            if digest:
                                said.extend(map(itemgetter(1), found))
                    if digest:
                        counts.append(len(out))
                        left.append(sha(",".join(said).encode()))
                        # decoded from the ids alone; invalid UTF-8 would become replacement characters
                        right.append(sha(b"".join(map(labels.__getitem__, out)).decode("utf-8", "replace").encode()))
                    else:
                        lists.append(out)
                if digest:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(left, pa.string()),
                                                      pa.array(right, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])
        words.forget()  # an idle worker holds the automaton alone
    return run


def shipped(spark: SparkSession, path: str):
    """The vocabulary at ``path``, broadcast: a few MB, bounded by the file."""
    small_batches(spark)
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, decoded from its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_encoder(shipped(docs.sparkSession, path), True)),
                                                    f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs(text, ...)`` with ``ids`` array<int>, replacing a column of that name."""
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c != "ids"])
    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lean(_encoder(shipped(docs.sparkSession, path), False)), schema)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """``ids(ids array<int>, ...)`` with ``decoded`` string, replacing a column of that name."""
    ids = ids.select([F.col(f"`{c}`") for c in ids.columns if c != "decoded"])
    table = shipped(ids.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = table.value["labels"]
        for batch in batches:
            texts = [b"".join(map(labels.__getitem__, x.as_py() or [])).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
    from pyspark.sql import types as T
    return ids.mapInArrow(run, T.StructType([*ids.schema.fields, T.StructField("decoded", T.StringType())]))
