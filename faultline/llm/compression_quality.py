"""Quality classifier by compression with two zstandard dictionaries.

Dictionaries are cut from good and from bad labelled text, and from both texts' letter shapes.  A
text is compressed block by block against them; the difference of the compressed sizes over their
sum (the normalised difference) says which kind it resembles, and a logistic curve fitted on other
labelled rows turns it into a probability.  Texts are read whole; only the texts and labels of the
training rows are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of what training looks at; everything else covers all rows.
TRAIN_ROWS = 300         # labelled rows of each class that feed the dictionaries, at most
FIT_ROWS = 4000          # labelled rows that fit the curve, at most
ROW_CHARS = 8192         # characters of one row that a dictionary may draw on
SLICES = 4               # of equal length, from the head to the tail of the text, that make them up
DICT_BYTES = 1 << 18     # size of a dictionary of text
SHAPE_BYTES = 1 << 15    # size of a dictionary of letter shapes
BLOCK = 2048             # bytes compressed at once
LEVEL = 3
SOFTEN = 200             # bytes added to the sum of sizes, so that a few bytes of text prove little

#: Letter shape of each byte: lower case and non-ASCII, upper case, digit, itself.
SHAPE = bytes(97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i
              for i in range(256))
FEATURES = ("text_difference", "shape_difference", "text_ratio", "shape_ratio", "text_worst", "shape_worst")


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, bytes, bytes, bytes]   # text good, text bad, shape good, shape bad
    weights: tuple[float, ...]                        # intercept, then one weight for each feature
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    empty: float                                      # score of a text without bytes


class _Scorer:
    def __init__(self, model: Model):
        import zstandard as z

        self.model = model
        self.packers = []
        for raw in model.dictionaries:
            d = z.ZstdCompressionDict(raw or b"\n" * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False,
                                                 write_dict_id=False))

    def features(self, text: str | None) -> list[float] | None:
        """Over the whole text and its letter shapes: normalised size difference (bad minus good over
        their sum), log of the size with the good dictionary over the length, worst block difference."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return None
        total, worst = [0, 0, 0, 0], [1.0, 1.0]
        for at in range(0, len(raw), BLOCK):
            block = raw[at:at + BLOCK]
            views = (block, block, *[block.translate(SHAPE)] * 2)
            sizes = [len(p.compress(v)) for p, v in zip(self.packers, views)]
            total = [t + s for t, s in zip(total, sizes)]
            for k in (0, 1):
                good, bad = sizes[2 * k], sizes[2 * k + 1]
                worst[k] = min(worst[k], (bad - good) / (bad + good + SOFTEN))
        difference = [(total[k + 1] - total[k]) / (total[k + 1] + total[k] + SOFTEN) for k in (0, 2)]
        ratio = [float(np.log((total[k] + 20) / (len(raw) + 60))) for k in (0, 2)]
        return [*difference, *ratio, *worst]

    def score(self, text: str | None) -> float:
        found, m = self.features(text), self.model
        if found is None:
            return m.empty
        x = m.weights[0] + float(((np.array(found) - m.mean) / m.scale) @ np.array(m.weights[1:]))
        return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _dictionary(texts: list[str], size: int, shape: bool) -> bytes:
    """Raw dictionary content: an equal share of every text, so that no long text crowds out others, in slices
    from its head to its tail."""
    parts = []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        raw = raw.translate(SHAPE) if shape else raw
        share = max(64, size // len(texts))
        n = min(SLICES, max(1, share // 64))
        part = share // n
        starts = [max(0, len(raw) - part) * i // max(1, n - 1) for i in range(n)] if len(raw) > share else [0]
        parts.extend(raw[at:at + (part if len(raw) > share else share)] for at in starts)
    return b"\n".join(parts)[:size]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the intercept is not penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fold_of(id_col: Column) -> Column:
    """crc32(id as text) mod 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Fit on labelled rows outside fold 0: folds 1-3 feed the dictionaries, fold 4 the curve.

    Training takes a bounded sample (the constants above): rows are picked by the hash order of their
    ids.  Null labels, null ids and null texts take no part; an id with several labels counts with
    each.  Without rows of both classes the curve is flat at the share of label 1 (0.5 without rows).
    """
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.where("__id IS NOT NULL AND y IN (0, 1)").distinct().withColumn("fold", fold_of(F.col("__id"))).where("fold <> 0")
    order = [F.xxhash64(F.lit(5), "__id"), F.col("__id")]
    picked = None
    for cond, rows in (("fold <> 4 AND y = 1", TRAIN_ROWS), ("fold <> 4 AND y = 0", TRAIN_ROWS),
                       ("fold = 4", FIT_ROWS)):
        part = marks.where(cond).orderBy(*order).limit(rows)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    sample = texts.join(F.broadcast(picked), "__id")  # at most 2 * TRAIN_ROWS + FIT_ROWS ids
    room = F.char_length("text") - ROW_CHARS // SLICES
    slices = F.concat(*[F.substring("text", (F.floor(room * i / (SLICES - 1)) + 1).cast("int"), F.lit(ROW_CHARS // SLICES)) for i in range(SLICES)])
    drawn = F.when(F.char_length("text") <= ROW_CHARS, F.col("text")).otherwise(slices)
    train = (sample.where("fold <> 4").groupBy("__id", "y").agg(F.min(drawn).alias("part")).toPandas()
             .sort_values(["__id", "y"]))
    good, bad = (list(train[train.y == k].part) for k in (1, 0))
    packs = tuple(_dictionary(part, size, shape) for size, shape in ((DICT_BYTES, False), (SHAPE_BYTES, True))
                  for part in (good, bad))
    none = tuple(0.0 for _ in FEATURES)
    draft = Model(packs, (0.0, *none), none, tuple(1.0 for _ in FEATURES), 0.5)

    @F.pandas_udf("array<double>")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(draft)
        for part in parts:
            yield pd.Series([scorer.features(t) for t in part], dtype="object")

    # Null measures (empty texts) are left out only here: a filter would measure all documents first.
    held = (sample.where("fold = 4").withColumn("x", measure("text")).groupBy("__id", "y")
            .agg(F.min("x").alias("x")).toPandas().dropna(subset=["x"]).sort_values(["__id", "y"]))
    marked = [*train.y, *held.y]
    share = float(np.mean(held.y if len(held) else marked)) if marked else 0.5
    if held.y.nunique() < 2 or not good or not bad:
        flat = float(np.log(share / (1 - share))) if 0 < share < 1 else (35.0 if share else -35.0)
        return Model(packs, (flat, *none), none, draft.scale, share)
    x = np.array([list(v) for v in held.x])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - mean) / scale, held.y.to_numpy(dtype=float))
    return Model(packs, w, tuple(mean.tolist()), tuple(scale.tolist()), share)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column: the probability of label 1 for the whole text.

    Null texts count as empty; an empty text gets the share of label 1 among the fitted rows.  All
    other columns pass through, so ``name`` must not be among them.  The model (four dictionaries of
    fixed size) is the only thing sent to the tasks.
    """
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(model)
        for texts in parts:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, run(F.col(text_col)))
