"""Quality rules by compression bands.

A text is compressed with zstandard, whole and in fixed chunks. Repetitive text
shrinks too well and noise hardly shrinks; both leave the band of ratios that
prose of that length has. The base counts beside it are plain word statistics.

Bands of whole texts can be fitted: labelled good documents give, for each language and
each doubling of length, the mean of the ratio and its spread. Where there are too few
of them, and without labels, wide fixed limits hold, which judge no language by another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, unused

#: Length-specific limits, fixed values: from this many UTF-8 bytes on, (least, greatest) compressed/raw.
#: Set by hand outside the range of natural-language prose of that length at zstandard level 3. A text of more
#: than one chunk of 4096 bytes is judged by its chunks too, so its own lower bound only has to tell what no prose
#: reaches: legal texts, which repeat their terms, go down to 0.334 at 17 KB, mixed documents to 0.35 at 1 MB, and a
#: text that comes twice is at half of its ratio. The level's window is 2 MB; from there on ratios stay the same.
LIMITS = (
    (0, 0.25, 2.00),
    (128, 0.40, 1.10),
    (256, 0.50, 0.85),
    (512, 0.44, 0.75),
    (1024, 0.43, 0.65),
    (2048, 0.435, 0.58),
    (4096, 0.415, 0.53),
    (4097, 0.33, 0.53),
    (8192, 0.32, 0.51),
    (16384, 0.31, 0.50),
    (32768, 0.30, 0.50),
    (131072, 0.29, 0.50),
    (524288, 0.28, 0.50),
    (2097152, 0.27, 0.50),
)


@dataclass(frozen=True)
class Bands:
    """fitted: (least, greatest) by language and bits of the length, from ``fit``; where it has none,
    ``limits`` hold. chunk_bytes: size of the fixed chunks. chunk_slack widens a limit for chunks,
    which vary more than whole texts; bad_share: share of a text's bytes in chunks
    outside their band from which the text is rejected."""

    level: int = 3
    limits: tuple = LIMITS
    chunk_bytes: int = 4096
    chunk_slack: float = 0.10
    bad_share: float = 0.30
    fitted: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)

    def whole(self, size: int, lang: str | None) -> tuple[float, float]:
        """The limits of a whole text of ``size`` bytes."""
        return self.fitted.get((lang, size.bit_length())) or self.band(size)

    def band(self, size: int) -> tuple[float, float]:
        low, high = self.limits[0][1:]
        for least, a, b in self.limits:
            if size < least:
                break
            low, high = a, b
        return low, high


def measure(raw: bytes, bands: Bands, z: zstandard.ZstdCompressor, lang: str | None = None) -> tuple[float | None, float, bool]:
    """(whole ratio, share of bytes in bad chunks, inside all bands); an empty text has no ratio and is outside."""
    if not raw:
        return None, 0.0, False
    ratio = len(z.compress(raw)) / len(raw)
    low, high = bands.whole(len(raw), lang)
    bad = 0
    for at in range(0, len(raw), bands.chunk_bytes):
        part = raw[at : at + bands.chunk_bytes]
        a, b = bands.band(len(part))
        if not a - bands.chunk_slack <= len(z.compress(part)) / len(part) <= b + bands.chunk_slack:
            bad += len(part)
    share = bad / len(raw)
    return ratio, share, low <= ratio <= high and share < bands.bad_share


SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_CONTINUATION = bytes(c for c in range(256) if not 0x80 <= c < 0xC0)


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of UTF-8 bytes.

    ``bytes.split()`` splits at exactly the six ASCII blanks 0x20 and 0x09 to 0x0D."""
    words = raw.split()
    n = len(words)
    size = sum(map(len, words))
    chars = size - len(raw.translate(None, _CONTINUATION))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 2:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
        pair = w[:-2] * len(ids) + w[1:-1]
        if len(ids) > 2_000_000:  # else the three ids would not fit one long
            pair = np.unique(pair, return_inverse=True)[1]
        _, where, count = np.unique(pair * len(ids) + w[2:], return_inverse=True, return_counts=True)
        twice = count[where] > 1
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):  # a window covers three words
            covered[shift : n - 2 + shift] |= twice
        repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_share double"
)


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _rules(bands: Bands, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=bands.level)
        for batch in slices(batches):
            lang, text = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            rows = []
            for i in range(batch.num_rows):
                t = text[i].as_py()
                raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
                n, chars, symbols, dup, repeat = base_counts(raw)
                failed = fails_base(n, repeat)
                ratio, share, inside = measure(raw, bands, z, lang[i].as_py())
                rows.append((n, chars, symbols, dup, repeat, failed, inside and not failed, ratio, share))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names)

    return run


def quality_rules(
    df: DataFrame, text_col: str = "text", carry: list[str] | None = None, bands: Bands | None = None, lang_col: str | None = None
) -> DataFrame:
    """One row per input row: the ``carry`` columns (default: all), then the base counts, verdicts and ratios.

    One pass, no shuffle; any text length (chunks are slices of the text in hand).
    Null text counts as no text and empty text has no words: both fail. Repeated rows
    are judged alike. ``lang_col`` names the column by which fitted bands are chosen; without
    it, and for null and unknown languages, the fixed limits hold. An input column that bears
    the name of a result column is left out of the result. No rows: no rows.
    """
    bands = bands or Bands()
    made = [x.split()[0] for x in OUT.split(", ")]
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in made]
    lang = F.lit(None) if lang_col is None else F.col(f"`{lang_col}`")
    own = unused(carry, "_lang", "_text")
    src = df.select(*[F.col(f"`{c}`") for c in carry], lang.cast("string").alias(own[0]), F.col(f"`{text_col}`").cast("string").alias(own[1]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-2])
    return src.mapInArrow(_rules(bands, [*carry, *made]), f"{kinds}, {OUT}" if carry else OUT)


@dataclass(frozen=True)
class Fit:
    """least: good documents of a language and doubling of length, below which it has no band of its own; below, above: standard
    deviations from the mean to a limit, more above, since addresses and keys raise a clean text's ratio now and
    then; margin: added to both, and to the least and greatest ratio seen."""

    least: int = 30
    below: float = 4.0
    above: float = 8.0
    margin: float = 0.005


def _ratios(level: int):
    """(id, lang, text) to (id, lang, bits, ratio) of the texts that pass the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=level)
        for batch in slices(batches):
            rows = []
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                n, *_, repeat = base_counts(raw)
                if not fails_base(n, repeat):
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(raw).bit_length(), len(z.compress(raw)) / len(raw)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["_id", "lang", "bits", "ratio"])

    return run


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quality_col: str = "quality",
    how: Fit | None = None,
    bands: Bands | None = None,
) -> Bands:
    """``bands`` with limits fitted on all documents of quality 1 that pass the base rules.

    Rows with a null id, text or language are ignored; without a good label nothing is fitted. Every text is
    measured where it is read, and its ratio, not the text, meets the labels; a row for each language and doubling of length
    comes to the driver."""
    how, bands = how or Fit(), bands or Bands()
    good = labels.where(F.col(f"`{quality_col}`") == 1).select(F.col(f"`{id_col}`").cast("long").alias("_id")).where("_id is not null")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    measured = docs.dropna().mapInArrow(_ratios(bands.level), "_id long, lang string, bits int, ratio double")
    cells = measured.join(good, "_id", "left_semi").groupBy("lang", "bits").agg(
        F.count("*").alias("n"), F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("sd"), F.min("ratio").alias("low"), F.max("ratio").alias("high")
    )
    fitted = {}
    for r in cells.where(F.col("n") >= how.least).collect():
        low, high = min(r["mean"] - how.below * r["sd"], r["low"]), max(r["mean"] + how.above * r["sd"], r["high"])
        fitted[r["lang"], r["bits"]] = (low - how.margin, high + how.margin)
    return replace(bands, fitted=fitted)
