"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text.
A text is cut into blocks, every block is compressed with each dictionary, and the
difference of the two sums, divided by their mean, says which kind of text it is
like. A logistic curve fitted on other labelled rows turns that difference, together
with the plain compression ratio, into a probability.

Blocks keep a long text from teaching the compressor its own contents, after which
neither dictionary would matter; all blocks of a text are read. A tiny trailing block
joins the one before it. Model size is bounded by DICT_BYTES, so it travels with the
task.

All labelled texts outside the held-out fold are learned from. One half of them, dealt by a
hash of the id into groups of about GROUP_BYTES, makes a dictionary a group; dictionaries are
then merged, FAN at a time, by building one from their contents, until one a class is
left. The other half gives the curve, by Newton steps on sums of their features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, give_back, read, stored
from .labelled import fit_logistic, fit_logistic_rows, fold, labelled_texts, logistic

BLOCK = 1024
DICT_BYTES = 64 << 10
#: Text of a group, about, and dictionaries that are merged at a time. No header is longer than HEADER.
GROUP_BYTES, FAN, HEADER = 8 << 20, 64, 256
LEVEL = 3
HELD_OF, HELD = 3, 1


def blocks(data: bytes, size: int = BLOCK) -> list[bytes]:
    """data in pieces of size bytes, the last of size / 2 to 3 / 2 size (or all of it)."""
    n = max(1, round(len(data) / size))
    return [data[i * size : (i + 1) * size if i < n - 1 else None] for i in range(n)]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    default: float = 0.5
    _zs: list = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_zs": None}

    def features(self, texts) -> np.ndarray:
        if self._zs is None:
            own = lambda d: zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            made = [zstd.ZstdCompressionDict(d) for d in (self.good, self.bad)]
            for d in made:
                d.precompute_compress(level=LEVEL)
            self._zs = [own(d) for d in made]
        good, bad = self._zs
        out = np.zeros((len(texts), 4))
        for k, text in enumerate(texts):
            data = (text or "").encode("utf-8", "replace")
            parts = blocks(data)
            g = sum(len(good.compress(b)) for b in parts)
            b = sum(len(bad.compress(b)) for b in parts)
            diff, ratio = 2 * (b - g) / (b + g), (b + g) / (2 * len(data) + 8)
            out[k] = diff, ratio, diff * abs(diff) * 4, abs(diff) * ratio
        return out

    def score(self, texts) -> np.ndarray:
        """Probability of label 1; default for texts without content."""
        p = logistic(self.features(texts), self.weights)
        return np.where([bool(t and t.strip()) for t in texts], p, self.default)


def _dictionary(texts: list[str] | list[bytes]) -> bytes:
    """A dictionary of DICT_BYTES at most. Where the trainer finds too little text, the
    texts' own bytes serve as a raw dictionary."""
    parts = [b for t in texts for b in blocks(t if isinstance(t, bytes) else t.encode("utf-8", "replace"))]
    total = sum(map(len, parts))
    try:
        return zstd.train_dictionary(min(DICT_BYTES, max(1024, total // 4)), parts).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[-DICT_BYTES:] or b" "


def dictionaries(texts: DataFrame, group_bytes: int = GROUP_BYTES, fan: int = FAN) -> dict[int, bytes]:
    """A dictionary of each label from all of texts(_id, y, text)."""
    sizes = {r["y"]: r["b"] for r in texts.groupBy("y").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    groups = {y: max(1, round(b / group_bytes)) for y, b in sizes.items()}
    many = F.when(F.col("y") == 1, F.lit(groups.get(1, 1))).otherwise(F.lit(groups.get(0, 1)))
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("_id", F.lit("group")), many))

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        data = _dictionary(pdf.sort_values("_id")["text"].tolist())
        return pd.DataFrame({"y": pdf["y"].iloc[:1], "part": pdf["part"].iloc[:1], "data": [data]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values("part")["data"].tolist()
        whole = data[0] if len(data) == 1 else _dictionary([d[HEADER:] if d[:4] == zstd_magic else d for d in data])
        return pd.DataFrame({"y": pdf["y"].iloc[:1], "part": pdf["part"].iloc[:1] // fan, "data": [whole]})

    zstd_magic, schema = (0xEC30A437).to_bytes(4, "little"), "y int, part long, data binary"
    made = stored(dealt.groupBy("y", "part").applyInPandas(built, schema), "dictionaries")
    most = max(groups.values(), default=1)
    while most > 1:
        made = stored(made.groupBy("y", F.floor(F.col("part") / fan)).applyInPandas(merged, schema), "merged-dictionaries")
        most = -(-most // fan)
    return {r["y"]: bytes(r["data"]) for r in made.collect()}


def _constant(share: float) -> CompressionModel:
    """The model that scores every text with the share."""
    odds = np.log(max(share, 1e-12)) - np.log(max(1 - share, 1e-12))
    return CompressionModel(b" ", b" ", np.array([0.0] * 4 + [odds]), share)


def fit(texts: list[str], y: np.ndarray, positives: float | None = None) -> CompressionModel:
    """Dictionaries from every other text of each class, the curve from the rest.
    Without texts of both classes, every score is the share of label 1 (or 0.5).
    positives: that share among all labelled rows, which texts without content get."""
    order = {c: [i for i in range(len(y)) if y[i] == c] for c in (0, 1)}
    if min(map(len, order.values())) < 2:
        return _constant(float(y.mean()) if len(y) else 0.5)
    kinds = {c: _dictionary([texts[i] for i in order[c][::2]]) for c in (0, 1)}
    model = CompressionModel(kinds[1], kinds[0], np.zeros(5))
    rest = [i for c in (0, 1) for i in order[c][1::2]]
    model.weights = fit_logistic(model.features([texts[i] for i in rest]), y[rest], 1e-4)
    model.default = float(np.mean(y)) if positives is None else positives
    return model


def fit_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, fan: int = FAN) -> CompressionModel:
    """fit on all labelled texts outside the held-out fold."""
    texts, positives = labelled_texts(bounded_batches(docs), labels, "quality", HELD_OF, HELD, text_col, id_col)
    texts = stored(texts, "quality-labelled")
    seen = {(r["y"], r["half"]): r["n"] for r in texts.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 4:  # a class has no text in one of the halves
        return _constant(positives if seen else 0.5)
    kinds = dictionaries(texts.where("half = 0"), group_bytes, fan)
    model = CompressionModel(kinds[1], kinds[0], np.zeros(5), positives)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = model.features(pdf["text"].tolist())
            yield pd.DataFrame({"y": pdf["y"], **{f"x{k}": x[:, k] for k in range(4)}})
        give_back()

    rows = stored(texts.where("half = 1").select("y", "text").mapInPandas(featured, "y int, x0 double, x1 double, x2 double, x3 double"), "quality-features")
    return replace(model, weights=fit_logistic_rows(rows, [f"x{k}" for k in range(4)], 1e-4))


def score_quality(docs: DataFrame, model: CompressionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col. A null, empty or blank text gets the model's default; an
    existing column of that name is replaced."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()), dtype="float64")
        give_back()

    return bounded_batches(docs).withColumn(score_col, scored(F.col(text_col)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_from(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", (fold("doc_id", HELD_OF) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
