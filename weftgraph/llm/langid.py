"""Language identification by language-bitmask n-gram filters.

A Bloom filter for each learned language holds the n-grams that are common in it. The filters are
bit-sliced: a position holds one bit for each language, so that one lookup for each hash returns
all languages containing an n-gram. A text's n-grams are counted for each language; the counts,
corrected for each filter's false positives, decide.

Defined results. `und` with score 0 if the text is null, empty or has no letter, or if nothing was
learned. The sample of labelled rows from which is learned is bounded by SAMPLE, LANGUAGES and SHARE,
parameters of ``learn``; predictions look at all of a text. Equal counts go to the language first by code point; a text of which no n-gram is known goes
to the language with the most training text, with score 0. Whole texts are read, in pieces of
bounded size. Rows without a language or an id are predicted but not learned from. Repeated rows
are alike. An empty table gives an empty result. Other columns, whatever their names, are carried
along untouched, but never an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, release, small_batches, stage

GRAM = 4
SAMPLE = 4_000  # documents of a language that are learned from, about; the bound of the training sample
SHARE = 2e-5  # an n-gram is learned if it makes up at least this part of its language's sample: 50,000 n-grams at most
LANGUAGES = 256  # languages that are learned at most, those with the most labelled documents
HASHES = 3
FOLDS = 5
_PIECE = 1 << 20  # characters of a text that are looked up at a time
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)
_letters: np.ndarray | None = None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams(text: str | None, n: int = GRAM) -> np.ndarray:
    """Hashes of the n-grams of a text's lower-case letters, other characters being one space; empty without a letter."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate(([np.uint32(32)], codes, np.full(max(1, n - len(codes) - 1), 32, np.uint32)))
    apart = np.ones(len(codes), bool)
    apart[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    if apart.sum() >= n:
        codes = codes[apart]
    codes = codes.astype(np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        h += codes[j : len(codes) - n + 1 + j] * _MULTIPLIERS[j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """The n-grams of a text, a piece at a time. Pieces overlap, so none is lost where they meet; only the
    borders of words may be counted once more there."""
    for at in range(0, len(text or ""), _PIECE):
        own = grams(text[max(0, at - GRAM + 1) : at + _PIECE])
        if len(own):
            yield own


@dataclass
class Filters:
    """Bit-sliced Bloom filters: masks[position, slice] has a bit for each language."""

    languages: list[str]
    masks: np.ndarray
    false_positives: np.ndarray
    usual: str = "und"  # the language with the most training text

    @staticmethod
    def of(members: dict[str, np.ndarray], usual: str = "und") -> Filters:
        languages = sorted(members)
        size = 1 << max(12, (16 * max((len(x) for x in members.values()), default=1) - 1).bit_length())
        masks = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
        rates = np.zeros(len(languages))
        for k, language in enumerate(languages):
            bit = np.uint64(1 << (k % 64))
            for where in Filters.positions(members[language], size):
                masks[where, k // 64] |= bit
            rates[k] = np.count_nonzero(masks[:, k // 64] & bit) / size
        return Filters(languages, masks, rates**HASHES, usual)

    @staticmethod
    def positions(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(j) * step) & np.uint64(size - 1)).astype(np.int64) for j in range(HASHES)]

    def shares(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """For each language the part of the text's n-grams that it contains, corrected, and how many there
        are; None without a letter."""
        total, hits = 0, np.zeros(len(self.languages), np.int64)
        for own in pieces(text):
            first, *rest = self.positions(own, len(self.masks))
            found = self.masks[first]
            for where in rest:
                found &= self.masks[where]
            total += len(own)
            for k in range(len(hits)):
                hits[k] += np.count_nonzero(found[:, k // 64] & np.uint64(1 << (k % 64)))
        if not total:
            return None, 0
        return np.clip((hits / total - self.false_positives) / (1 - self.false_positives), 0, 1), total

    def decide(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score (its part of the two best shares), share, and the number of the text's n-grams."""
        shares, total = self.shares(text)
        if shares is None or not len(shares):
            return "und", 0.0, 0.0, total
        best = int(np.argmax(shares))
        if not shares[best]:
            return self.usual, 0.0, 0.0, total
        second = np.delete(shares, best).max(initial=0.0)
        share = float(shares[best])
        return self.languages[best], share / (share + float(second)), share, total


def learn(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, share: float = SHARE, most: int = LANGUAGES
) -> Filters:
    """Filters from the labelled rows: about `sample` documents of each of the `most` usual languages, chosen
    by a hash of the id; n-grams are counted on the executors and combined before the shuffle. Those that
    make up less than `share` of their language's are left out."""
    labelled = labelled.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).filter("lang IS NOT NULL AND id IS NOT NULL")
    counts = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most)
    part = counts.select("lang", F.least(F.lit(1.0), sample / F.col("count")).alias("part"))
    chance = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(F.broadcast(part), "lang").filter(chance < F.col("part")).select("lang", "text")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[list[np.ndarray], int]] = {}
        for f in frames:
            for language, text in zip(f["lang"], f["text"], strict=True):
                for new in pieces(text):
                    own, n = held.get(language, ([], 0))
                    own.append(new)
                    held[language] = (own, n + len(new))
                    if n + len(new) > 4 * _PIECE:
                        yield summed(language, held.pop(language)[0])
        for language, (own, _) in held.items():
            yield summed(language, own)

    def summed(language: str, own: list[np.ndarray]) -> pd.DataFrame:
        gram, n = np.unique(np.concatenate(own), return_counts=True)
        return pd.DataFrame({"lang": language, "gram": gram.view(np.int64), "n": n})

    found = chosen.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = stage(found, "grams")
    totals = found.groupBy("lang").agg(F.sum("n").alias("total"))
    usual = totals.orderBy(F.col("total").desc(), "lang").first()
    common = found.join(broadcast_if_small(totals, most), "lang").filter(F.col("n") >= share * F.col("total")).select("lang", "gram")
    common = common.toPandas()  # at most 1 / share rows of each language
    release(found)
    return Filters.of({k: g["gram"].to_numpy(np.int64).view(np.uint64) for k, g in common.groupby("lang")}, usual.lang if usual else "und")


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """row (a struct of all columns), lang_pred, score, share and grams (how many n-grams the text has) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double, share double, grams long")
    def decide(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.decide(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score", "share", "grams"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("found", decide(F.col(f"row.`{text_col}`").cast("string")))
    return rows.select("row", "found.lang_pred", "found.score", "found.share", "found.grams")


def most_share(share: Column, n: Column, z: float = 2.0) -> Column:
    """The upper end of the score interval (Wilson) of a share among n: wide for short texts, close to the
    share for long ones."""
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return F.when(n > 0, (share + z * z / (2 * n) + half) / (1 + z * z / n)).otherwise(1.0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """predict() with filters learned from the labelled rows that are not held out."""
    return predict(docs, learn(docs.filter(~held_out(F.col(f"`{id_col}`"))), id_col, text_col, lang_col), text_col)
