"""Language by rank-order profiles: out-of-place distance between a document's most frequent
character n-grams and each language's.

A profile is learned from at most about `bound` documents of a language, drawn by a hash of the
id; prediction reads whole texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import carried, held_out, release, short_batches, uncarried

#: N-grams in a profile; documents a language is learned from, about.
PROFILE, BOUND = 400, 2000
#: Languages up to which their table is broadcast; beyond it, it is joined by a shuffle.
BROADCAST_LANGUAGES = 50_000
#: What stands for anything between words; a code point that is no letter.
GAP = 1
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Codes and counts of the 1- to 3-grams inside padded words; None if there is no letter.

    A code holds up to three code points of 21 bits each; the gap is a code point, so grams of
    different length differ.
    """
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    x = np.where(_is_letter()[x], x, GAP)
    x = np.concatenate([[GAP], x, [GAP]])
    x = x[np.append(True, (x[1:] != GAP) | (x[:-1] != GAP))]
    if len(x) < 3:
        return None
    two = x[:-1] << 21 | x[1:]
    three = two[:-1] << 21 | x[2:]
    one = x[x != GAP]
    return np.unique(np.concatenate([one, two, three[x[1:-1] != GAP]]), return_counts=True)


def top_grams(text: str, k: int) -> np.ndarray | None:
    """The k most frequent codes, most frequent first; ties by code."""
    found = gram_counts(text)
    if found is None:
        return None
    codes, n = found
    if len(codes) > k:
        least = np.partition(n, -k)[-k]
        keep = n >= least
        codes, n = codes[keep], n[keep]
    return codes[np.lexsort((codes, -n))[:k]]


@dataclass
class Profiles:
    """Languages, all their grams (sorted codes), and the rank of each gram in each language (or `size`)."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, ranked: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(ranked)
        codes = np.unique(np.array([c for x in ranked.values() for c in x], np.int64))
        ranks = np.full((len(codes) + 1, len(languages)), size, np.int64)
        for j, lang in enumerate(languages):
            ranks[np.searchsorted(codes, np.array(ranked[lang], np.int64)), j] = np.arange(len(ranked[lang]))
        return cls(languages, codes, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language and 1 - its distance over the greatest distance; `und`, 0 without letters."""
        top = top_grams(text, self.size) if text and self.languages else None
        if top is None:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        rank = self.ranks[np.where(self.codes[at] == top, at, len(self.codes))]
        away = np.where(rank == self.size, self.size, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (self.size * len(top)))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE, bound: int = BOUND) -> Profiles:
    """Profiles from rows with a text and a language that aren't held out."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # One row a language: the share of its documents that is learned from.
    part = known.groupBy(F.col("lang").alias("of")).agg(F.least(F.lit(1.0), float(bound) / F.count("*")).alias("part"))
    few = part.limit(BROADCAST_LANGUAGES + 1).collect()
    if len(few) <= BROADCAST_LANGUAGES:
        part = F.broadcast(docs.sparkSession.createDataFrame(few, part.schema))
    known = known.join(part, F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20) < F.col("part"))

    def grams(batches):
        total: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for one, t in zip(b["lang"], b["text"]):
                if (found := gram_counts(t)) is not None:
                    total[one].update(dict(zip(found[0].tolist(), found[1].tolist())))
        for one, c in total.items():
            yield pd.DataFrame({"lang": one, "gram": list(c), "n": list(c.values())})

    counted = known.select("lang", "text").mapInPandas(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = defaultdict(list)
    for r in sorted(counted.withColumn("nth", nth).where(F.col("nth") <= size).collect(), key=lambda r: (r["lang"], r["nth"])):
        ranked[r["lang"]].append(r["gram"])
    return Profiles.of(ranked, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Add lang_pred and score to each row.

    Null and empty texts, and texts without a letter, are `und` with score 0, as is all if nothing
    could be learned. Equal distances go to the first language by name. Repeated rows agree; other
    columns pass through, and columns named lang_pred or score are replaced.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        release()
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    found = carried(docs, found=predict(F.col(text)))
    return uncarried(found, docs, lang_pred=F.col("found.lang_pred"), score=F.col("found.score"))
