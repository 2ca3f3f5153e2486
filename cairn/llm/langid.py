"""Language identification with bit-sliced Bloom filters.

One table of language bitmasks serves as a Bloom filter for every language at once:
an n-gram's hashes pick slots, and the AND of their masks is the set of all languages
whose profile holds the n-gram.  A text's masks are counted language by language, the
counts are corrected for each language's false-positive rate, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cairn.llm.common import flat, fresh, lean, own_columns, slices, small_batches

GRAM = 4
HASHES = 3
#: Profiles are picked in so many parts before they are picked as a whole.
PARTS = 16
UNKNOWN = "und"

#: Letters keep their (lower-case) byte, all else of ASCII turns to a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All byte 4-grams with at most one space, and where each text's begin.

    ASCII and Latin-1 capitals are folded; n-grams never cross texts, and a space
    stands before and after each text.
    """
    n = len(bounds) - 1
    lengths = np.diff(bounds)
    folded = np.full(len(buf) + 2 * n + GRAM, 32, np.uint8)
    inside = np.ones(len(buf) + 2 * n, bool)
    first = bounds[:-1] + 2 * np.arange(n)
    inside[first] = inside[first + lengths + 1] = False
    folded[: len(inside)][inside] = FOLD[buf]
    latin = np.flatnonzero(folded[:-1] == 0xC3) + 1
    latin = latin[(folded[latin] >= 0x80) & (folded[latin] <= 0x9E)]
    folded[latin] += 0x20
    size = len(inside)
    gram = folded[:size].astype(np.uint32)
    for k in range(1, GRAM):
        gram |= folded[k : size + k].astype(np.uint32) << np.uint32(8 * k)
    blank = (folded == 32).astype(np.int8)
    good = blank[:size] + blank[1 : size + 1] + blank[2 : size + 2] + blank[3 : size + 3] <= 1
    last = first + lengths + 2
    for k in range(1, GRAM):
        good[last[last - k >= first] - k] = False
    where = np.flatnonzero(good)
    return gram[where], np.searchsorted(where, np.append(first, size))


def slots(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    h = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(64 - bits - 13 * k)) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    """languages in order of bit; masks[slice][slot]; fill is the share of slots set."""

    languages: list[str]
    bits: int
    masks: list[np.ndarray]
    false_positive: np.ndarray
    usual: int

    def counts(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts per text and language, and the n-grams per text."""
        gram, at = grams(buf, bounds)
        n, starts = np.diff(at), at[:-1]
        places = slots(gram, self.bits)
        out = np.zeros((len(n), len(self.languages)))
        full = np.flatnonzero(n)
        for s, table in enumerate(self.masks):
            found = table[places[0]]
            for p in places[1:]:
                found &= table[p]
            for b in range(min(64, len(self.languages) - 64 * s)):
                bit = ((found >> table.dtype.type(b)) & table.dtype.type(1)).astype(np.int32)
                if len(full):
                    out[full, 64 * s + b] = np.add.reduceat(bit, starts[full])
        out = (out - n[:, None] * self.false_positive) / (1 - self.false_positive)
        return np.maximum(out, 0), n

    def predict(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the share of n-grams that the language explains.

        Ties go to the language first in order; a text with letters but without any
        n-gram of a profile gets the commonest language and score 0.  A model that
        learned no language knows none.
        """
        if not self.languages:
            return [UNKNOWN] * (len(bounds) - 1), np.zeros(len(bounds) - 1)
        found, n = self.counts(buf, bounds)
        best = np.argmax(found, axis=1)
        top = found[np.arange(len(n)), best]
        best[top == 0] = self.usual
        score = np.clip(top / np.maximum(n, 1), 0, 1)
        ascii_letter = np.zeros(256, np.int32)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = 1
        total = np.concatenate([[0], np.cumsum(ascii_letter[buf])])
        names = [self.languages[b] for b in best]
        for i in np.flatnonzero(total[bounds[1:]] == total[bounds[:-1]]):
            if not any(map(str.isalpha, buf[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "ignore"))):
                names[i], score[i] = UNKNOWN, 0.0
        return names, score


def train(docs: DataFrame, per_language: int = 2000, profile: int = 6000, least: int = 3, bits: int = 18, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fit on about ``per_language`` whole texts of each language (a hash of the id
    and text chooses them; fewer where there are fewer), the documented bound of the sample.

    A profile is a language's ``profile`` most frequent n-grams that occur ``least``
    times (of equally frequent ones the smallest).  Rows without language or text are
    left out; where no row is left the model knows no language.
    """
    rows = own_columns(docs, doc_id=id_col, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], bits, [], np.zeros(0), 0)
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([languages.index(x) for x in batch.column("lang").to_pylist()], np.uint64)
            buf, bounds = flat(batch.column("text"))
            for i, j in slices(bounds, 1 << 20):
                gram, at = grams(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                key, n = np.unique(gram | (np.repeat(codes[i:j], np.diff(at)) << np.uint64(32)), return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": pa.array((key >> np.uint64(32)).astype(np.int32)), "gram": pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), "n": pa.array(n)})

    found = chosen.select("text", "lang").mapInArrow(lean(count), "code int, gram long, n long").groupBy("code", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # the best of each part and then, of at most PARTS * profile rows per language, of each language
    for part in ([F.pmod(F.xxhash64("gram"), F.lit(PARTS))], []):
        order = Window.partitionBy("code", *part).orderBy(F.desc("n"), "gram")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= profile).drop("place")
    table = found.toPandas()  # at most profile rows per language
    masks = [np.zeros(1 << bits, np.uint64) for _ in range(0, len(languages), 64)]
    fill = np.zeros(len(languages))
    for code in range(len(languages)):
        own = table[table["code"] == code]
        where = np.unique(np.concatenate(slots(own["gram"].to_numpy(np.uint32), bits)))
        masks[code // 64][where] |= np.uint64(1 << (code % 64))
        fill[code] = len(where) / (1 << bits)
    if len(languages) <= 8:
        masks = [m.astype(np.uint8) for m in masks]
    return Model(languages, bits, masks, fill**HASHES, languages.index(max(sizes, key=lambda x: (sizes[x], x))))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The id, the kept columns, and language and score under ``named`` for every row;
    null or letterless text is ``und``.  Only the text decides.  No rows give no rows."""
    names = [id_col, *(keep or [])]
    if clash := {c.lower() for c in names} & {c.lower() for c in named}:
        raise ValueError(f"kept columns have the names of results: {sorted(clash)}")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = flat(batch.column(len(names)))
            for i, j in slices(bounds, 1 << 20):
                found, score = model.predict(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                own = [batch.column(k).slice(i, j - i) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[f.name for f in schema.fields])

    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(fresh(docs, "_text")))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(named[0], T.StringType()), T.StructField(named[1], T.DoubleType())])
    return rows.mapInArrow(lean(label), schema)


def held_out(id_col: str = "doc_id"):
    """The fold that training never sees; a null id counts as seen."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(4)) == 2, F.lit(False))
