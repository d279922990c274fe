"""BPE encoding and decoding with a pair occurrence index.

Texts are cut at spaces and line ends into units; units met before are looked up, and the words of
the new units of a stretch of a partition are laid out as one array of symbols. The index maps each adjacent pair that has a merge rule to the
places where it occurs. The lowest active rank is applied to all its places at once;
the merged symbols' new pairs are looked up and put on the lists of their ranks, and
places that a merge has changed fall away when their list's turn comes. A merge can
only make pairs of higher rank (checked when the vocabulary is read), so ranks are
applied in ascending order and each word sees the merges it would see alone.

Units met before are kept in a bounded memory of each task or worker. Vocabulary files
are read by the driver and travel with the task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read

#: Units remembered by a task, and characters whose new words are merged together.
MEMORY = 200_000
STRETCH = 12_000_000


@cache
def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand
    for themselves, the others for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Letters and numbers that Unicode 16 added, which Python's own tables may not have.
NEWER = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}
#: First capital, last capital and first small letter of what Unicode 16 and 17 added.
NEWER_CASES = "1C89 1C89 1C8A, A7CB A7CB 264, A7CC A7CC A7CD, A7CE A7CE A7CF, A7D2 A7D2 A7D3, A7D4 A7D4 A7D5, A7DA A7DA A7DB, A7DC A7DC 19B, 10D50 10D65 10D70, 16EA0 16EB8 16EBB"
_small = {c: int(to, 16) + c - int(a, 16) for a, z, to in map(str.split, NEWER_CASES.split(",")) for c in range(int(a, 16), int(z, 16) + 1)}


@cache
def category_class(kind: str, last: int = sys.maxunicode) -> str:
    """A character class body of the code points whose general category begins with kind."""
    newer = {c for r in NEWER.get(kind, "").split() for a, z in [r.split("-") if "-" in r else (r, r)] for c in range(int(a, 16), int(z, 16) + 1)}
    points = [c for c in range(last + 1) if unicodedata.category(chr(c))[0] == kind or c in newer]
    cuts = [0, *(k for k in range(1, len(points)) if points[k] != points[k - 1] + 1), len(points)]
    return "".join(f"\\U{points[i]:08x}-\\U{points[j - 1]:08x}" for i, j in zip(cuts, cuts[1:], strict=False))


SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space that words share in a way that cuts before spaces and around line ends would miss.
_space_run = re.compile(f"[{SPACE}](?:[{SPACE.replace(' ', '')}]| (?:[{SPACE}]|\\Z))")
#: Signs that may end a unit; a run of them is one word.
SIGNS = ".,!?;:#$%&*|<>"
TAILS = "'s|'t|'re|'ve|'m|'ll|'d"


@cache
def word_patterns(spaced: bool) -> tuple[re.Pattern, ...]:
    """The pattern of words for ASCII texts, texts up to U+FFFF and all texts. spaced: a
    word takes a space before it along, and white space is kept."""
    made = []
    short = 0xFFFF
    for letters, digits, space in (("A-Za-z", "0-9", " \\t-\\r"), (category_class("L", short), category_class("N", short), SPACE), (category_class("L"), category_class("N"), SPACE)):
        # tails begin with a sign, so letters and digits may be tried before them
        if spaced:
            made.append(re.compile(f" ?[{letters}]+| ?[{digits}]+|{TAILS}| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"))
        else:
            made.append(re.compile(f"[{letters}]+|[{digits}]|{TAILS}|[^{space}{letters}{digits}]+"))
    return tuple(made)


class Vocabulary:
    """Merge rules and ids of a tokenizer file of the BPE kind with byte letters."""

    def __init__(self, source: bytes):
        j = json.loads(source)
        model = j["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.lower = j["normalizer"] is not None
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.size = max(self.tokens) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([self.ids[b] for _, b in merges], dtype=np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in merges], dtype=np.int32)
        born = {int(c): r for r, c in enumerate(self.merged)}
        if any(born.get(int(x), -1) >= r for side in (left, right) for r, x in enumerate(side)):
            raise ValueError("a merge rule comes before the rule that makes its symbol")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        letters = byte_letters()
        self.first = np.array([self.ids[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([self.ids[letters[b] + self.suffix] for b in range(256)], dtype=np.int32)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs without a rule."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def units(self, text: str) -> list[str]:
        """text cut before spaces and around line ends, where no word crosses the cut, so
        that a unit's words don't depend on its neighbours. Where white space follows white
        space, a word may hold both, and the words themselves are the units."""
        if self.lower:
            return text.replace("\n", " ").split(" ")
        if "\0" in text or _space_run.search(text):
            return self.words(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def words(self, text: str) -> list[str]:
        """The pieces that are encoded on their own; special tokens are pieces."""
        core = text.rstrip(SIGNS)  # most units are a word and perhaps signs
        sign = text[len(core) :]
        if self.lower:
            if core.isascii() and core.isalpha():
                core = core.lower()
                return [core] if len(core) == len(text) else [core, sign]
        elif core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):
            return [core] if len(core) == len(text) else [core, sign]
        if any(map(text.__contains__, self.special)):
            cut = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
            return [w for k, part in enumerate(cut) for w in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        ascii_, short, every = word_patterns(not self.lower)
        if text.isascii():
            return ascii_.findall(text.lower() if self.lower else text)
        if self.lower:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(_small)
        return (short if not text or max(text) <= "\uffff" else every).findall(text)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all words one after another, by the pair occurrence index over all of
        them, and where each word's ids begin, with the end last."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(data)
        sym = self.first[data]
        full = ends[sizes > 0] - 1
        sym[full] = self.last[data[full]]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[full] = -1
        before[np.append(0, full[:-1] + 1) if len(full) else []] = -1
        self._merge_all(sym, after, before)
        kept = sym >= 0
        return sym[kept], np.append(0, np.cumsum(kept))[np.append(0, ends)].tolist()

    def _merge_all(self, sym: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """Applies every rule in place; absorbed symbols become -1."""
        places = np.flatnonzero(after >= 0).astype(np.int32)
        ranks = self.rank_of(sym[places], sym[after[places]])
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for k, r in enumerate(ranks[starts[:-1]].tolist()):
                part = places[starts[k] : starts[k + 1]]
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        if len(ranks):
            enlist(ranks, places)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:
                at = _apart(np.sort(at), after)
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = self.merged[r], -1
            follow = after[gone]
            after[at] = follow
            inner = follow >= 0
            before[follow[inner]] = at[inner]
            starts = np.concatenate([at[inner], before[at][before[at] >= 0]])
            if len(starts):
                new = self.rank_of(sym[starts], sym[after[starts]])
                if (new >= 0).any():
                    enlist(new[new >= 0], starts[new >= 0])


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places of a pair of equal symbols, from the left those that don't overlap."""
    keep, taken = [], -1
    for p in at.tolist():
        if p != taken:
            keep.append(p)
            taken = int(after[p])
    return np.array(keep, dtype=at.dtype)


class WordMemory:
    """Encoded units of one task. made(ids, bounds) turns words' ids, given as one array
    and the words' bounds, into what is kept of each word; joined puts a unit's words
    together."""

    def __init__(self, vocabulary: Vocabulary, made, joined):
        self.vocabulary, self.made, self.joined = vocabulary, made, joined
        self.known: dict[str, object] = {}

    def learn(self, texts: Iterable[str]) -> None:
        """After this, all units of texts are in known."""
        needed: set[str] = set()
        for t in texts:
            needed.update(self.vocabulary.units(t))
        if len(self.known) + len(needed) > MEMORY:  # what these texts don't need goes
            self.known = {u: k for u, k in self.known.items() if u in needed}
        new = [u for u in needed if u not in self.known]
        del needed
        special, split, pieces = self.vocabulary.special, {}, set()
        for u in new:
            parts = self.vocabulary.words(u)
            if len(parts) == 1 and parts[0] == u:
                pieces.add(u)
            else:
                split[u] = parts
                pieces.update(parts)
        plain = [w for w in pieces if w not in special]
        words = dict(zip(plain, self.made(*self.vocabulary.encode_words(plain)), strict=True))
        words |= {w: self.made(np.array([i], dtype=np.int32), [0, 1])[0] for w, i in special.items()}
        self.known.update(words)  # a word is a unit of its own, too
        for u, parts in split.items():
            self.known[u] = words[parts[0]] if len(parts) == 1 else self.joined([words[w] for w in parts])


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values of all the ranges that start at begin and are size long, one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def stretches(batches: Iterator[pd.DataFrame], text_col: str, most: int = STRETCH) -> Iterator[pd.DataFrame]:
    """Batches cut so that a stretch has about `most` characters (or is one row)."""
    for pdf in batches:
        sizes = pdf[text_col].str.len().fillna(0).to_numpy()
        group = (np.cumsum(sizes) // most).astype(np.int64)
        for _, part in pdf.groupby(group, sort=True):
            yield part


def vocabulary_file(path: str | None, name: str) -> bytes:
    """The file's bytes, read by the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


_vocabularies: dict[str, Vocabulary] = {}


def opened(source: bytes) -> Vocabulary:
    """The vocabulary, parsed once in each worker."""
    key = hashlib.sha1(source).hexdigest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(source)
    return _vocabularies[key]


def encode_decode(docs: DataFrame, source: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the
    ids themselves and the decoded text. A null text counts as empty and has no tokens.
    Columns other than id_col and text_col are not read."""
    handle = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary file: bounded
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def kept(vocabulary: Vocabulary):
        name, number = [vocabulary.tokens.get(i, "") for i in range(vocabulary.size)], [str(i) for i in range(vocabulary.size)]

        def made(ids: np.ndarray, bounds: list[int]) -> list[tuple[bytes, bytes, int]]:
            ids = ids.tolist()
            words = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            return [(" ".join([number[i] for i in w]).encode(), " ".join([name[i] for i in w]).encode(), len(w)) for w in words]

        return made

    def joined(words: list[tuple[bytes, bytes, int]]) -> tuple[bytes, bytes, int]:
        return b" ".join([w[0] for w in words]), b" ".join([w[1] for w in words]), sum([w[2] for w in words])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = opened(handle.value)
        memory = WordMemory(vocabulary, kept(vocabulary), joined)
        for pdf in stretches(batches, "text"):
            texts = [t or "" for t in pdf.pop("text")]
            memory.learn(texts)
            n, ids_hash, decoded_hash, all_ids, all_decoded = [], [], [], [], []
            for text in texts:  # cut again, as the units of all texts would fill the memory
                known = [k for k in map(memory.known.__getitem__, vocabulary.units(text)) if k[2]]
                ids = b" ".join([k[0] for k in known])
                decoded = b" ".join([k[1] for k in known])
                n.append(sum([k[2] for k in known]))
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                decoded_hash.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in ids.split()])
                    all_decoded.append(decoded.decode())
            out = pdf.assign(n_tokens=n, ids_sha256=ids_hash, decoded_sha256=decoded_hash)
            yield out.assign(ids=all_ids, decoded=all_decoded) if with_ids else out

    source_rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return source_rows.mapInPandas(run, schema).withColumnRenamed("_id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), vocabulary_file(path, "word_bpe_49k.json"))
