"""BPE encoding and decoding through a tokenization automaton (operator 10).

The merges are compiled into a deterministic automaton over tokens by one merge gadget
after another. It starts with one state that loops on every base symbol. The gadget of the
merge (u, v) -> uv

* copies the state that u leads to, without the copy's arc for v, and lets u lead to the
  copy: u followed by v is no longer a tokenization;
* lets uv lead where v led, and gives an arc for uv to every state that has one for u.

If the state that u leads to has no arc for v by then, uv is in no tokenization and gets no arc.

A state is therefore its parent state minus one token, and whether a state has an arc for a
token follows from the order in which states and tokens were made (:meth:`Automaton.arc`).
The automaton accepts exactly the BPE tokenizations, one for each string; hence each prefix
of a word has one last token, and a word is encoded in one pass over its symbols with the
tables of arcs. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricslake.llm.common import lean

#: Words whose codes a Python worker remembers; a memory bound, without effect on results.
WORD_CACHE = 300_000
#: Slots of the table of arcs (8 bytes each), a power of two.
ARC_TABLE = 1 << 20
ARC_MASK = ARC_TABLE - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Automaton:
    """States and arcs for ``merges`` over ``vocab`` (label -> id)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.labels = [""] * size
        for label, i in vocab.items():
            self.labels[i] = label
        self.made = [0] * size  # the gadget that made a token; base symbols: 0
        self.left = [-1] * size
        self.target = [0] * size  # the state that a token leads to
        self.parent, self.without = [-1], [-1]  # state 0 has every arc
        self.arcs = array("q", [-1]) * ARC_TABLE
        arises = [len(symbols(label)) == 1 for label in self.labels]
        for step, (a, b) in enumerate(merges, 1):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if self.made[uv]:
                raise ValueError(f"two merges make {a + b!r}")
            self.made[uv], self.left[uv] = step, u
            if not (arises[u] and arises[v] and self.arc(self.target[u], v) & 1):
                # u is never followed by v: other merges come first, and uv is in no tokenization
                self.parent.append(0)
                self.without.append(-1)
                continue
            arises[uv] = True
            self.target[uv] = self.target[v]
            self.parent.append(self.target[u])
            self.without.append(v)
            self.target[u] = step
        # labels as a tree: a symbol leads to the next node and to the token whose label ends there (or -1)
        self.tree: dict[str, tuple[dict, int]] = {}
        self.longest = 0  # symbols of a label
        for label, i in vocab.items():
            if arises[i]:
                self._add(label, i)

    def _add(self, label: str, token: int) -> None:
        node = self.tree
        *before, end = symbols(label)
        self.longest = max(self.longest, len(before) + 1)
        for symbol in before:
            if symbol not in node:
                node[symbol] = ({}, -1)
            node = node[symbol][0]
        node[end] = (node[end][0] if end in node else {}, token)

    def arc(self, state: int, token: int) -> int:
        """Compiles whether ``state`` has an arc for ``token`` (the lowest bit) into the table of arcs. It
        has a fixed size; a slot holds the pair it was last compiled for (the other bits)."""
        key, s, t = state * len(self.labels) + token, state, token
        while s and not (self.made[t] < s and self.without[s] == t):
            if self.made[t] >= s:
                t = self.left[t]  # made after the state: it got the arc with its left part
            else:
                s = self.parent[s]
        held = self.arcs[key & ARC_MASK] = key << 1 | (not s)
        return held

    def encode(self, word: list[str]) -> list[int]:
        """Token ids of a word's base symbols: the arcs of the path that ends with the word.

        Longer tokens are tried first. A prefix has one path only, so a place is left from at
        most once and the work is that of the table look-ups of a single pass.
        """
        n, size, arcs, tree, target = len(word), len(self.labels), self.arcs, self.tree, self.target
        ids: list[int] = []
        untried: list[list[tuple[int, int]]] = []  # for each place of the path, the (token, end) not tried yet
        start = state = 0
        while start < n:
            node, end, ahead = tree, start, []
            for symbol in word[start : start + self.longest]:
                found = node.get(symbol)
                if found is None:
                    break
                node, token = found
                end += 1
                if token >= 0:
                    ahead.append((token, end))
            untried.append(ahead)
            while True:
                if not ahead:  # no path goes on from here
                    untried.pop()
                    if not untried:
                        raise ValueError("a symbol is not in the vocabulary")
                    ids.pop()
                    ahead, state = untried[-1], target[ids[-1]] if ids else 0
                    continue
                token, end = ahead.pop()
                if state:
                    key = state * size + token
                    held = arcs[key & ARC_MASK]
                    if held >> 1 != key:
                        held = self.arc(state, token)
                    if not held & 1:
                        continue
                ids.append(token)
                start, state = end, target[token]
                break
        return ids


END = "</w>"


def symbols(label: str) -> list[str]:
    """Base symbols of a token's label: characters, the last one with the word end if there is one."""
    if label.endswith(END) and len(label) > len(END):
        body = label[: -len(END)]
        return [*body[:-1], body[-1] + END]
    return list(label)


#: Texts of characters below this one need no composing, and every Unicode version agrees on them.
LATIN = "ɐ"


class Codec:
    """Encoder and decoder for a tokenizer file with lower-casing, word pieces and word ends."""

    def __init__(self, spec: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        told = json.loads(spec)
        model = told["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if model["end_of_word_suffix"] != END or told.get("decoder") is not None:
            raise ValueError("expects a vocabulary with word ends and no decoder")
        self.automaton = Automaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special_label = {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the white space of Unicode below LATIN, which a search in whole texts has to name
        self.piece = regex.compile(pattern.replace(r"[^\s", "[^\t-\r \x85\xa0"))
        self.normalize = Tokenizer.from_str(spec).normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.symbol = byte_symbols()
        self.names = [*self.automaton.labels, *[""] * (1 + max(self.special_label, default=0) - len(self.automaton.labels))]
        for i, label in self.special_label.items():
            self.names[i] = label
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if max(text) < LATIN:
            return self.piece.findall(text.lower())
        return [piece for piece, _ in self.split(self.normalize(text))]

    def word(self, piece: str) -> bytes:
        """Packed ids of a piece."""
        coded = self.known.get(piece)
        if coded is None:
            base = [self.symbol[b] for b in piece.encode()]
            base[-1] += END
            ids = self.automaton.encode(base)
            coded = pack(f"<{len(ids)}I", *ids)
            if len(self.known) < WORD_CACHE:
                self.known[piece] = coded
        return coded

    def encode(self, text: str | None) -> tuple[int, bytes, str]:
        """Number of tokens, ids as little-endian unsigned 32-bit integers, decoded text."""
        parts = self.cut.split(text or "") if self.cut else [text or ""]
        coded = [pack("<I", self.special[p]) if k % 2 else b"".join(map(self.word, self.pieces(p))) for k, p in enumerate(parts)]
        ids = b"".join(coded)
        return len(ids) // 4, ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        """The labels of packed ids."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids and decoded text of every whole text.

    Returns ``id_col``, ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit) and
    ``decoded`` string, one row for each row of ``docs``. A null or empty text has no token;
    repeated rows and null ids are kept; other columns are not read, so their names may clash.
    The vocabulary file (a few MB, fixed) is read by the driver and sent with the task.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    ids = docs.schema[id_col]
    schema = f"`{id_col}` {ids.dataType.simpleString()}, n_tokens long, ids binary, decoded string"

    def run(batches):
        own = codec(spec.value)
        for batch in batches:
            coded = [own.encode(t) for t in batch.column(1).to_pylist()]
            n, ids, text = zip(*coded) if coded else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(text, pa.string())],
                names=[id_col, "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)


def decode(coded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the arc labels of the packed ids in ``ids_col`` (null: empty text)."""
    spark = coded.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    kept = [c for c in coded.columns if c != "decoded"]
    schema = coded.select(*kept).schema.add("decoded", "string")
    at = kept.index(ids_col)

    def run(batches):
        own = codec(spec.value)
        for batch in batches:
            text = [own.decode(x or b"") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*kept, "decoded"])

    return coded.select(*kept).mapInArrow(lean(run), schema)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query: token count and the digests of ids and decoded text."""
    return coded.select(
        F.col(id_col),
        F.col("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
