"""Language ID with interpolated Kneser-Ney character models (operator 7).

One model per language, trained on a bounded sample of labelled rows. A model is a set of
sorted arrays: for each order the hashes of its n-grams with their interpolated
probabilities, and the hashes of its contexts with their back-off weights. A text gets the
language whose model gives the lowest cross-entropy per symbol. It is rejected if that
entropy lies above what the calibration texts of the language allow at its length, or if it
has no letter.

Symbols are lower-cased letters; everything between two runs of letters is one space. A
symbol's hash is the low 16 bits of its code point, and an n-gram's hash packs those of its
symbols, so that contexts and suffixes are shifts and masks of it.
"""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricslake.llm.common import lean, thinned

#: Longest n-gram.
ORDER = 4
#: Bound of the training sample: rows and characters for each language.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 2_000_000
#: One of so many sample rows calibrates the rejection instead of training the model.
CALIBRATE_EVERY = 5
#: A text is rejected if its entropy lies this far on the way from its language's mean to the
#: mean of the same calibration texts with their symbols shuffled (no language at all), and
#: so many standard errors of a text of its length beyond.
REJECT_SHARE = 0.75
REJECT_ERRORS = 4.0
#: Seed of that shuffle.
SEED = 20
#: Symbols scored at a time, a bound on memory.
CHUNK_SYMBOLS = 1_000_000

SPACE = 32
SYMBOL_BITS = 16
SYMBOLS = 1 << SYMBOL_BITS
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point the 16-bit symbol of its lower-case letter, or a space."""
    table = np.full(0x110000, SPACE, np.uint16)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            symbol = ord(char.lower()[0]) & (SYMBOLS - 1)
            table[code] = symbol if symbol != SPACE else SPACE + 1
    return table


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts on end, the start of each text, and its number of letters.

    Each text begins with a space, so none is empty.
    """
    joined = "".join(["\n" + (t or "") for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    symbol = letter_table()[codes]
    letter = symbol != SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of several characters between letters
    keep[starts] = True
    after_start = starts + 1
    after_start = after_start[after_start < len(codes)]
    after_start = after_start[~letter[after_start]]
    keep[after_start[~np.isin(after_start, starts)]] = False  # the start is a space already
    position = np.cumsum(keep) - 1
    letters = np.add.reduceat(letter.astype(np.int64), starts)
    return symbol[keep], position[starts], letters


def ngrams(symbol: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each symbol; before a text there are spaces."""
    place = np.arange(len(symbol)) - np.repeat(starts, np.diff(np.append(starts, len(symbol))))
    keys = symbol.astype(np.uint64)
    for back in range(1, order):
        before = np.full(len(symbol), SPACE, np.uint64)
        before[back:] = symbol[:-back]
        before[place < back] = SPACE
        keys |= before << np.uint64(SYMBOL_BITS * back)
    return keys


def suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (SYMBOL_BITS * order)) - 1)


def context(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(SYMBOL_BITS)


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


class Model:
    """Interpolated Kneser-Ney probabilities of one language."""

    def __init__(self, symbol: np.ndarray, starts: np.ndarray):
        keys, counts = np.unique(ngrams(symbol, starts, ORDER), return_counts=True)
        levels = {ORDER: (keys, counts)}
        for order in range(ORDER - 1, 0, -1):  # in how many contexts an n-gram has been seen
            keys, counts = np.unique(suffix(levels[order + 1][0], order), return_counts=True)
            levels[order] = keys, counts
        self.keys: dict[int, np.ndarray] = {}
        self.probability: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.weight: dict[int, np.ndarray] = {}
        for order in range(1, ORDER + 1):
            keys, counts = levels[order]
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            contexts, of = np.unique(context(keys), return_inverse=True)
            total, kinds = np.bincount(of, counts), np.bincount(of)
            weight = discount * kinds / total
            self.probability[order] = (counts - discount) / total[of] + weight[of] * self.of(suffix(keys, order - 1), order - 1)
            self.keys[order], self.contexts[order], self.weight[order] = keys, contexts, weight

    def of(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Probability of the last symbol of each n-gram."""
        if order == 0:
            return np.full(len(keys), 1 / SYMBOLS)
        at, known = found(self.keys[order], keys)
        out = np.where(known, self.probability[order][at], 0.0)
        rest = keys[~known]
        if len(rest):
            at, seen = found(self.contexts[order], context(rest))
            out[~known] = np.where(seen, self.weight[order][at], 1.0) * self.of(suffix(rest, order - 1), order - 1)
        return out


def calibration(model: Model, texts: list[str]) -> tuple[float, float, float]:
    """Mean entropy per symbol of texts, the same of their shuffled symbols, deviation of a symbol."""
    symbol, starts, _ = symbols(texts)
    bits = -np.log2(model.of(ngrams(symbol, starts, ORDER), ORDER))
    shuffled = np.random.default_rng(SEED).permutation(symbol)
    noise = -np.log2(model.of(ngrams(shuffled, starts, ORDER), ORDER))
    return float(bits.mean()), float(noise.mean()), float(bits.std())


def train(rows: pd.DataFrame) -> pd.DataFrame:
    """The model of one language's sample as one row of sorted arrays."""
    rows = rows.sort_values(["pick", "text"], kind="stable")
    texts = rows["text"].tolist()
    fit = [t for k, t in enumerate(texts) if k % CALIBRATE_EVERY or len(texts) < CALIBRATE_EVERY]
    model = Model(*symbols(fit)[:2])
    told = calibration(model, texts[::CALIBRATE_EVERY])
    out = io.BytesIO()
    arrays = {f"{name}{order}": getattr(model, name)[order] for order in range(1, ORDER + 1) for name in ("keys", "probability", "contexts", "weight")}
    np.savez(out, calibration=np.array(told), **arrays)
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "model": [out.getvalue()]})


def loaded(saved: bytes) -> tuple[Model, np.ndarray]:
    told = np.load(io.BytesIO(saved))
    model = Model.__new__(Model)
    for name in ("keys", "probability", "contexts", "weight"):
        setattr(model, name, {order: told[f"{name}{order}"] for order in range(1, ORDER + 1)})
    return model, told["calibration"]


class Models:
    """The models of all languages, merged: one sorted array of hashes for each order."""

    def __init__(self, saved: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in saved]
        models, told = zip(*(loaded(s) for _, s in saved))
        self.mean, self.noise, self.deviation = np.array(told).T
        self.keys, self.bits, self.contexts, self.weight = {}, {}, {}, {}
        for order in range(1, ORDER + 1):
            keys = self.keys[order] = np.unique(np.concatenate([m.keys[order] for m in models]))
            self.bits[order] = np.stack([-np.log2(m.of(keys, order)) for m in models], 1).astype(np.float32)
            contexts = self.contexts[order] = np.unique(np.concatenate([m.contexts[order] for m in models]))
            weight = np.zeros((len(contexts), len(models)), np.float32)
            for k, m in enumerate(models):
                at, known = found(m.contexts[order], contexts)
                weight[known, k] = -np.log2(m.weight[order][at[known]])
            self.weight[order] = weight

    def score(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of each n-gram's last symbol under every language."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), SYMBOL_BITS, np.float32)
        at, known = found(self.keys[order], keys)
        out = self.bits[order][at]
        if not known.all():
            rest = keys[~known]
            at, seen = found(self.contexts[order], context(rest))
            out[~known] = self.weight[order][at] * seen[:, None] + self.score(suffix(rest, order - 1), order - 1)
        return out

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text under every language, its symbols and letters."""
        symbol, starts, letters = symbols(texts)
        size = np.diff(np.append(starts, len(symbol)))
        keys = ngrams(symbol, starts, ORDER)
        total = np.zeros((len(texts), len(self.langs)))
        owner = np.repeat(np.arange(len(texts)), size)
        for begin in range(0, len(keys), CHUNK_SYMBOLS):
            part = slice(begin, begin + CHUNK_SYMBOLS)
            first = np.flatnonzero(np.diff(owner[part], prepend=-1))
            total[owner[part][first]] += np.add.reduceat(self.score(keys[part], ORDER), first, axis=0, dtype=np.float64)
        return total / size[:, None], size, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (share of the best language's likelihood per symbol) and rejection."""
        bits, size, letters = self.entropy(texts)
        best = bits.argmin(1)  # of equal languages the first by name
        lowest = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(lowest[:, None] - bits).sum(1)
        allowed = self.mean[best] + REJECT_SHARE * (self.noise - self.mean)[best] + REJECT_ERRORS * self.deviation[best] / np.sqrt(size)
        none = letters == 0
        lang = [UNKNOWN if n else self.langs[b] for n, b in zip(none, best)]
        return lang, np.where(none, 0.0, score), none | (lowest > allowed)


def is_held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is divisible by 5 (or no id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """Models by language name, from at most SAMPLE_ROWS rows and SAMPLE_CHARS characters of each.

    The sample is drawn by a hash of the id from rows that have a language, at least one
    letter and are not held out. Empty if there is no such row. The result is what the
    sample's bound allows: a few MB for each language.
    """
    rows = docs.select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.lit(7), F.col(id_col).cast("string")).alias("pick"),
        F.length(text_col).alias("size"),
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~is_held_out(id_col))
    near = thinned(rows, "lang", "pick", SAMPLE_ROWS)
    first = Window.partitionBy("lang").orderBy("pick", "size", "text")
    sample = (
        near.withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= SAMPLE_ROWS)
        .withColumn("chars", F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("chars") <= SAMPLE_CHARS) | (F.col("n") == 1))
    )
    models = sample.select("lang", "text", "pick").groupBy("lang").applyInPandas(train, "lang string, model binary")
    return sorted((r.lang, bytes(r.model)) for r in models.collect())


def predict(docs: DataFrame, models: list[tuple[str, bytes]], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``rejected``; every row and column stays.

    A null, empty or letterless text is ``und`` with score 0 and rejected, as is every text if
    there is no model. Columns of these three names are replaced.
    """
    added = ["lang_pred", "lang_score", "rejected"]
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("lang_score", "double").add("rejected", "boolean")
    sent = docs.sparkSession.sparkContext.broadcast(models)
    at = kept.index(text_col)

    def run(batches):
        own = Models(sent.value) if sent.value else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, scores, rejected = [], [], []
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end] or "") < CHUNK_SYMBOLS):
                    size += len(texts[end] or "")
                    end += 1
                part = texts[begin:end]
                lang, score, no = own.predict(part) if own else ([UNKNOWN] * len(part), [0.0] * len(part), [True] * len(part))
                langs += lang
                scores += list(score)
                rejected += list(no)
                begin = end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*kept, *added],
            )

    return docs.select(*kept).mapInArrow(lean(run), schema)
