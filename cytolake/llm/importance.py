"""Quality by importance resampling.

Two bags of hashed words and word pairs are counted: one over all documents, one
over documents that are known to be good. A document's weight is the ratio of the
probabilities that the two models give it. Gumbel noise on the logarithm and the k
greatest keys make a sample without replacement in proportion to the weights.

The k-th greatest key is found exactly by counting, sixteen bits of the keys at a
time, so no sort of the corpus and no task with all the keys is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


@dataclass(frozen=True)
class Model:
    """buckets: of the hashed n-grams; target_rows: most labelled documents that the target model is
    fitted on (a hash of the id picks them); seed: of the hashes and the noise."""

    buckets: int = 10_000
    target_rows: int = 20_000
    seed: int = 5


#: Words whose hashes a worker keeps, and words of one text handled at once.
_KEEP, _PART = 300_000, 1 << 18


class Hasher:
    """Buckets of the words and word pairs of a text."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known, seed = self.known, self.model.seed
        if len(known) > _KEEP:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, seed)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, text: str | None) -> Iterator[np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        for at in range(0, len(words), _PART):
            h = self._hashes(words[at : at + _PART + 1])
            pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(7)) ^ (h[1:] << np.uint64(21))
            pair ^= pair >> np.uint64(29)
            own = h[: min(_PART, len(words) - at)]
            yield (np.concatenate([own, pair]) % np.uint64(self.model.buckets)).astype(np.int64)


def _count(model: Model, good: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(model)
        raw, target = (np.zeros(model.buckets, dtype=np.int64) for _ in range(2))
        for b in batches:
            for i, doc in enumerate(b.column(0).to_pylist()):
                one = np.zeros(model.buckets, dtype=np.int64)
                for part in hasher(b.column(1)[i].as_py()):
                    one += np.bincount(part, minlength=model.buckets)
                raw += one
                if doc is not None and len(good) and good[min(np.searchsorted(good, doc), len(good) - 1)] == doc:
                    target += one
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    return run


def _weigh(model: Model, ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(model)
        for b in batches:
            ids = b.column(0).to_pylist()
            weight, key = np.zeros(len(ids)), np.zeros(len(ids))
            for i, doc in enumerate(ids):
                for part in hasher(b.column(1)[i].as_py()):
                    weight[i] += ratio[part].sum()
                u = (xxhash.xxh64_intdigest(str(doc), model.seed + 1) + 0.5) / 2.0**64
                key[i] = weight[i] - np.log(-np.log(u))
            bits = (key + 0.0).view(np.int64)
            order = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)  # sorts as the keys do
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (weight, key, order))], ["_id", "log_weight", "gumbel_key", "_order"])

    return run


def threshold(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th greatest value of a column of longs, by counts of 16 bits at a time; None if there are fewer."""
    if k <= 0:
        return None
    shifted, prefix, left = F.col(column), None, k
    for shift in (48, 32, 16, 0):
        rows = keys if prefix is None else keys.where(F.shiftright(shifted, shift + 16) == prefix)
        counts = rows.groupBy(F.shiftright(shifted, shift).alias("p")).agg(F.count("*").alias("n")).collect()
        for p, n in sorted(((r["p"], r["n"]) for r in counts), reverse=True):
            if n >= left:
                prefix = p
                break
            left -= n
        else:
            return None
    return prefix


def resample(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    toxic_col: str | None = "toxic",
    share: float | None = None,
    model: Model | None = None,
) -> DataFrame:
    """One row per input row: id, ``log_weight``, ``gumbel_key``, ``kept``.

    ``share`` of all rows is kept; by default the share of quality 1 among the labelled rows.
    The target model is of documents of quality 1 that are not toxic. Rows whose key equals the k-th are all kept, as are rows that
    repeat an id if one is. Null and empty texts have weight 0. Null ids share one noise. Without
    a good label all weights are 0 and only the noise decides. Texts of any length are taken whole, their
    words in parts; no rows: no rows. Other columns are ignored.
    """
    model = model or Model()
    fine = F.col(f"`{quality_col}`") == 1
    good = fine if toxic_col is None else fine & (F.coalesce(F.col(f"`{toxic_col}`"), F.lit(0)) != 1)
    judged = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), fine.alias("_fine"), good.alias("_good"))
    judged = judged.where("_id is not null and _fine is not null")
    if share is None:
        share = judged.agg(F.avg(F.col("_fine").cast("double"))).first()[0]
        share = 1.0 if share is None else share
    picked = judged.where("_good").select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(model.target_rows)
    ids = np.array(sorted(r["_id"] for r in picked.collect()), dtype=np.int64)
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    counted = src.mapInArrow(_count(model, ids), "bucket long, raw long, target long")
    raw, target = np.zeros(model.buckets), np.zeros(model.buckets)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.zeros(model.buckets)
    if target.any():
        ratio = np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    keyed = save(src.mapInArrow(_weigh(model, ratio), "_id long, log_weight double, gumbel_key double, _order long"), "weights")
    least = threshold(keyed, "_order", round(share * keyed.count()))
    kept = F.lit(False) if least is None else F.col("_order") >= F.lit(least)
    return keyed.select(F.col("_id").alias(id_col), "log_weight", "gumbel_key", kept.alias("kept"))
