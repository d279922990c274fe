"""Toxicity by noisy-channel deobfuscation.

A token that looks disguised (digits or signs among letters, signs between letters,
letters repeated) and a run of single letters set apart by spaces become a lattice:
each sign may stand for a letter, a separator may be nothing, a run of one letter may
be one or two. Viterbi decoding finds the reading of least cost under a character
language model plus the cost of each substitution. The restored words are then looked
up in a lexicon of log-odds of words and word beginnings, and a logistic curve over
the strongest of them gives the score.

Lexicon, language model and curve are fitted on all labelled texts outside the held-out
fold: words and forms are counted by grouping, the curve takes Newton steps on sums of all
their features. The lexicon and the counts of the language model reach the driver; every
text is restored and scored whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, give_back, read, stored
from .labelled import fit_logistic, fit_logistic_rows, fold, labelled_texts, logistic

#: Different words and forms that a task counts before it hands its counts on.
COUNTED = 400_000
#: Lengths of the beginnings that are forms of a word.
BEGINNINGS = (4, 5, 6, 7)
CACHE = 50_000
HELD_OF, HELD = 5, 0

#: Signs and digits that stand for letters, and look-alike letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "*": "aeiou",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "к": "k", "ѕ": "s",
    "α": "a", "ο": "o", "ι": "i", "ν": "v", "τ": "t", "υ": "u",
}
SEPARATORS = set(" .-_*~'`·•,/\\:;#%&^=­​‌‍⁠﻿")
#: Costs in nats: a letter read as another sign, a separator dropped, a letter repeated.
SUBSTITUTE, DROP, REPEAT, KEEP_SIGN = 1.0, 0.5, 0.7, 6.0
MARGIN = 1.5
ORDER = 4

_edge = re.compile(r"^[^\w@$!|+€£(¡*]+|[^\w@$!|+€£(¡*]+$")
_sign_run = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
_spaced = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
_letters = re.compile(r"[^\W\d_]+")
_triple = re.compile(r"(.)\1\1")
_double = re.compile(r"(.)\1")
_lookalike = re.compile("[" + "".join(c for c in LEET if c.isalpha()) + "]")


def suspicious(token: str) -> bool:
    """Whether a token has more than one reading worth a lattice."""
    if token.isalpha():
        if _double.search(token) and (_triple.search(token) or len(_double.findall(token)) > 1):
            return True
        return not token.isascii() and _lookalike.search(token) is not None
    return len(_letters.findall(token)) > 0 and sum(c.isalpha() or c in LEET for c in token) > 3


def sequences(words) -> Counter:
    """Counts of up to ORDER characters in a row, and of what comes before the last of them
    (marked by a null character), from pairs of a word and its number."""
    counts: Counter = Counter()
    for word, n in words:
        padded = " " * (ORDER - 1) + word + " "
        for i in range(ORDER - 1, len(padded)):
            for k in range(ORDER):
                counts[padded[i - k : i + 1]] += n
                counts["\0" + padded[i - k : i]] += n
    return counts


@dataclass
class CharModel:
    """Interpolated character n-gram model of words; costs are negative logs."""

    counts: dict[str, int] = field(default_factory=dict)
    alphabet: int = 64
    _costs: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_costs": {}}

    @classmethod
    def fit(cls, words: Counter) -> CharModel:
        """From all words and how often they occur."""
        return cls(dict(sequences(words.items())), len({c for w in words for c in w}) + 1)

    def cost(self, context: str, char: str) -> float:
        """Of char after context, whose last ORDER - 1 characters count (Witten-Bell like)."""
        key = context[1 - ORDER :] + char
        known = self._costs.get(key)
        if known is None:
            p, get = 1 / (self.alphabet + 400), self.counts.get
            for k in range(ORDER):
                seen = key[len(key) - 1 - k :]
                total = get("\0" + seen[:-1], 0)
                if total:
                    p = (get(seen, 0) + 3 * p) / (total + 3)
            known = -math.log(p)
            if len(self._costs) > CACHE:
                self._costs.clear()
            self._costs[key] = known
        return known


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each sign or run of one sign: its readings and their costs."""
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n, arcs = j - i, []
        if c.isalpha():
            arcs += [(c * m, abs(n - m) and REPEAT * math.log2(1 + n - m)) for m in range(1, min(n, 2) + 1)]
            arcs += [(x * m, SUBSTITUTE) for x in LEET.get(c, "") for m in range(1, min(n, 2) + 1)]
        elif c in LEET:
            arcs += [(x * m, SUBSTITUTE * n + (REPEAT if m < n else 0)) for x in LEET[c] for m in range(1, min(n, 2) + 1)]
            arcs += [("", DROP * n)] if c in SEPARATORS else [(c * n, KEEP_SIGN * n)]
        elif c in SEPARATORS:
            arcs += [("", DROP), (" ", DROP)]
        else:
            arcs += [(c * n, KEEP_SIGN * n)]
        yield arcs
        i = j


def decode(token: str, lm: CharModel) -> str:
    """The reading of least cost, by Viterbi decoding over all states of the language model
    (the last ORDER - 1 characters). Of readings of equal cost the one whose pieces come
    first, compared from the first piece on.

    A state holds its cost, the place of its pieces in that order among all states, and
    its reading as a chain of pieces, which states share as far as they agree: time and
    memory grow with the token's length."""
    states: dict[str, tuple[float, int, tuple]] = {" " * (ORDER - 1): (0.0, 0, ())}
    for arcs in lattice(token):
        step: dict[str, tuple[float, int, str, tuple]] = {}
        for state, (cost, place, chain) in states.items():
            for piece, extra in arcs:
                at, total = state, cost + extra
                for c in piece:
                    if c == " " and at[-1] == " ":
                        continue
                    total += lm.cost(at, c)
                    at = " " * (ORDER - 1) if c == " " else at[1:] + c
                old = step.get(at)
                if old is None or (total, place, piece) < old[:3]:
                    step[at] = (total, place, piece, chain)
        order = sorted(step, key=lambda at: step[at][1:3])
        states = {at: (step[at][0], k, (step[at][2], step[at][3])) for k, at in enumerate(order)}
    chain = min((cost + lm.cost(at, " "), place, chain) for at, (cost, place, chain) in states.items())[2]
    pieces = []
    while chain:
        piece, chain = chain
        pieces.append(piece)
    return "".join(reversed(pieces))


def restore(text: str, lm: CharModel) -> str:
    """Lower-cased text, its disguised tokens and spaced runs decoded."""
    text = _spaced.sub(lambda m: decode(m[0], lm), text.lower())
    return " ".join(restore_token(t, lm) for t in text.split())


def restore_token(token: str, lm: CharModel) -> str:
    if token.isalpha() and not suspicious(token):
        return token
    bare = _edge.sub("", _sign_run.sub("", token))
    if bare.endswith("!"):
        bare = bare.rstrip("!")
    return decode(bare, lm) if suspicious(bare) else bare


@dataclass
class ToxicModel:
    lm: CharModel
    lexicon: dict[str, float]
    weights: np.ndarray
    _cache: dict = field(default_factory=dict, repr=False, compare=False)
    _heads: set = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}, "_heads": None}

    def word_weight(self, word: str) -> float:
        """Log-odds of the longest known form of a word: itself or a beginning."""
        if self._heads is None:
            self._heads = {key[:4] for key in self.lexicon}
        if word[:4] not in self._heads:
            return 0.0
        for key in (word, *(word[:n] + "*" for n in (7, 6, 5, 4) if len(word) > n)):
            w = self.lexicon.get(key)
            if w is not None:
                return w
        return 0.0

    def token_weight(self, token: str) -> tuple[float, str]:
        """The largest weight among a token's restored words, and that word. Only tokens
        that need restoring are remembered."""
        if token.isalpha() and not suspicious(token):
            return self.word_weight(token), token
        got = self._cache.get(token)
        if got is None:
            words = _letters.findall(restore_token(token, self.lm))
            got = max(((self.word_weight(w), w) for w in words), default=(0.0, ""))
            if len(self._cache) > CACHE:
                self._cache.clear()
            self._cache[token] = got
        return got

    def features(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for k, text in enumerate(texts):
            text = (text or "").lower()
            if _spaced.search(text):
                text = _spaced.sub(lambda m: decode(m[0], self.lm), text)
            found: dict[str, float] = {}
            for t in set(text.split()):
                w, word = self.token_weight(t)
                if w > 0:
                    found[word] = w
            top = sorted(found.values(), reverse=True)[:3] + [0.0] * 3
            out[k] = top[0], top[1], top[2]
        return out

    def score(self, texts) -> np.ndarray:
        return logistic(self.features(texts), self.weights)


def _copy_key(lowered: str) -> str:
    """Equal for texts of the same words in the same order."""
    return hashlib.blake2b(" ".join(lowered.split()).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _leaders(lowered: list[str], y: np.ndarray) -> list[int]:
    """One text of each group of copies (equal label, the same words in the same order), so
    that the chance words of a copied text don't count many times. Every different text
    counts."""
    seen, lead = set(), []
    for i, text in enumerate(lowered):
        key = (y[i], _copy_key(text))
        if key not in seen:
            seen.add(key)
            lead.append(i)
    return lead


def _forms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def _lexicon(docs: list[set[str]], y: np.ndarray, least: int = 3) -> dict[str, float]:
    """Cautious log-odds (estimate less MARGIN standard errors) of forms that at least
    `least` toxic texts hold; a form counts once a text. Forms that speak for neither
    class are left out, but for those that stop a longer word from matching a shorter
    beginning."""
    seen = {0: Counter(), 1: Counter()}
    for words, label in zip(docs, y, strict=True):
        if label == 1:
            seen[1].update({f for w in words for f in _forms(w)})
    seen[1] = Counter({f: n for f, n in seen[1].items() if n >= least})
    heads = {f[:4] for f in seen[1]}
    for words, label in zip(docs, y, strict=True):  # clean texts: only forms akin to those
        if label == 0:
            seen[0].update({f for w in words if w[:4] in heads and any(g in seen[1] for g in _forms(w)) for f in _forms(w)})
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))

    def odds(f: str) -> float:
        a, b = seen[1][f] + 0.3, seen[0][f] + 0.3
        return math.log(a / (n1 + 1)) - math.log(b / (n0 + 1)) - MARGIN * math.sqrt(1 / a + 1 / b)

    strong = {f: o for f in seen[1] if (o := odds(f)) > 1}
    beginnings = {f for f in strong if f.endswith("*")}
    stop = {f: 0.0 for f, n in seen[0].items() if n >= least and f not in strong and any(f[:k] + "*" in beginnings for k in (4, 5, 6, 7))}
    return stop | strong


def fit(texts: list[str], y: np.ndarray, positives: float = 0.5) -> ToxicModel:
    """Lexicon features for the curve come from a lexicon that did not see the text.
    Without texts of both classes every text gets the same score."""
    lowered = [t.lower() for t in texts]
    lead = _leaders(lowered, y)
    texts, lowered, y = [texts[i] for i in lead], [lowered[i] for i in lead], y[lead]
    lm = CharModel.fit(Counter(w for t in lowered for w in _letters.findall(t)))
    if not len(y) or y.min() == y.max():
        return ToxicModel(lm, {}, np.array([0.0, 0.0, 0.0, 35.0 if len(y) and y.min() else -35.0]))
    pool: dict[str, str] = {}  # one object for each word, whatever texts hold it
    docs = [{pool.setdefault(w, w) for w in _letters.findall(t)} for t in lowered]
    half = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        half[np.flatnonzero(y == c)[::2]] = True
    x = np.zeros((len(y), 3))
    for part in (half, ~half):
        at = np.flatnonzero(~part)
        lex = _lexicon([docs[i] for i in at], y[at], 2)
        fitted = ToxicModel(lm, lex, np.zeros(4))
        rows = np.flatnonzero(part)
        x[rows] = fitted.features([texts[i] for i in rows])
    return ToxicModel(lm, _lexicon(docs, y), fit_logistic(x, y, 1e-3, positives=min(max(positives, 0.01), 0.99)))


def leaders(texts: DataFrame) -> DataFrame:
    """_leaders of texts(_id, y, half, text): of each group the row of the smallest id."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(key=[_copy_key(t.lower()) for t in pdf["text"]])
        give_back()

    keys = texts.mapInPandas(keyed, f"_id {texts.schema['_id'].dataType.simpleString()}, y int, half int, text string, key string")
    first = F.min_by(F.struct("_id", "half", "text"), "_id").alias("first")
    return keys.groupBy("y", "key").agg(first).select("first._id", "y", "first.half", "first.text")


def counted_sequences(words: DataFrame) -> DataFrame:
    """key, n: sequences of all words(word, n), counted in the tasks that hold the words."""

    def rows(counts: Counter) -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])
        counts.clear()
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            counts.update(sequences(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
            if len(counts) > COUNTED:
                yield rows(counts)
        yield rows(counts)
        give_back()

    return words.select("word", "n").mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def counted(texts: DataFrame) -> DataFrame:
    """key, n0 to n3 and n4 from texts(y, half, text): in place 2 y + half the number of texts
    that hold a form, in n4 the occurrences of a word."""

    def rows(counts: list[Counter]) -> Iterator[pa.RecordBatch]:
        for place, seen in enumerate(counts):
            columns = pa.array(list(seen), pa.string()), pa.array([place] * len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns), ["key", "place", "n"])
            seen.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(5)]
        for b in batches:
            for y, half, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = _letters.findall(text.lower())
                counts[4].update(words)
                held = set(words)
                counts[2 * y + half].update(held.union(*([w[:n] + "*" for w in held if len(w) > n] for n in BEGINNINGS)))
            if sum(map(len, counts)) > COUNTED:
                yield from rows(counts)
        yield from rows(counts)
        give_back()

    found = texts.select("y", "half", "text").mapInArrow(count, "key string, place int, n long")
    return found.groupBy("key").agg(*[F.sum(F.when(F.col("place") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(5)])


def _counted_lexicon(forms: DataFrame, c1, c0, n1: int, n0: int, least: int = 3) -> dict[str, float]:
    """_lexicon from counts: forms(key, ...), of which c1 toxic texts of n1 and c0 clean ones of
    n0 hold key. Only the lexicon reaches the driver."""
    a, b = c1 + 0.3, c0 + 0.3
    odds = F.log(a / (max(1, n1) + 1)) - F.log(b / (max(1, n0) + 1)) - MARGIN * F.sqrt(1 / a + 1 / b)
    known = forms.select("key", c0.alias("c0"), odds.alias("odds"), ((c1 >= least) & (odds > 1)).alias("strong"))
    strong = {r["key"]: r["odds"] for r in known.where("strong").collect()}
    head = F.explode(F.array(*[F.concat(F.substring("key", 1, k), F.lit("*")) for k in BEGINNINGS])).alias("head")
    beginnings = known.where("strong and endswith(key, '*')").select(F.col("key").alias("head"))
    stop = known.where(~F.col("strong") & (F.col("c0") >= least)).select("key", head).join(beginnings, "head", "left_semi").select("key").distinct()
    return {r["key"]: 0.0 for r in stop.collect()} | strong


def fit_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """fit on all labelled texts outside the held-out fold, counted and added up by Spark."""
    texts, positives = labelled_texts(bounded_batches(docs), labels, "toxic", HELD_OF, HELD, text_col, id_col)
    lead = stored(leaders(texts), "toxic-leaders")
    sizes = {2 * r["y"] + r["half"]: r["n"] for r in lead.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sizes.get(k, 0) for k in range(4)]
    counts = stored(counted(lead), "toxic-counts")
    words = counts.where("n4 > 0").select(F.col("key").alias("word"), F.col("n4").alias("n"))
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().count()
    lm = CharModel({r["key"]: r["n"] for r in counted_sequences(words).collect()}, letters + 1)
    if not n[0] + n[1] or not n[2] + n[3]:
        return ToxicModel(lm, {}, np.array([0.0, 0.0, 0.0, 35.0 if n[2] + n[3] else -35.0]))
    halves = [ToxicModel(lm, _counted_lexicon(counts, F.col(f"n{2 + h}"), F.col(f"n{h}"), n[2 + h], n[h], 2), np.zeros(4)) for h in (0, 1)]

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for half in (0, 1):
                part = pdf[pdf["half"] == half]
                x = halves[1 - half].features(part["text"].tolist())  # a lexicon that did not see the text
                yield pd.DataFrame({"y": part["y"].to_numpy(), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2]})
        give_back()

    rows = stored(lead.select("y", "half", "text").mapInPandas(featured, "y int, x0 double, x1 double, x2 double"), "toxic-features")
    weights = fit_logistic_rows(rows, ["x0", "x1", "x2"], 1e-3, positives=min(max(positives, 0.01), 0.99))
    return ToxicModel(lm, _counted_lexicon(counts, F.col("n2") + F.col("n3"), F.col("n0") + F.col("n1"), n[2] + n[3], n[0] + n[1]), weights)


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col. Null and empty texts have no words and get the curve's
    value for that; an existing column of that name is replaced."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()), dtype="float64")
        give_back()

    return bounded_batches(docs).withColumn(score_col, scored(F.col(text_col)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_from(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", (fold("doc_id", HELD_OF) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
