"""Language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability; a word's probability is the sum over all ways to
cut it into pieces, which a forward pass adds up. Probabilities are fitted by expectation maximisation (forward and
backward passes) on word counts of a bounded sample of documents.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringspark.llm.common import fresh, held_out, small_batches, uniform

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: The probability of a character that no piece covers, alike in all languages.
RARE = 1e-7
TINY = 1e-150


@functools.cache
def letters() -> re.Pattern:
    """Runs of letters, each with the combining marks that follow it; numbers such as fractions are no letters."""

    def ranges(kinds: str) -> str:
        out, begin = [], None
        for code in range(0x32400):
            own = unicodedata.category(chr(code))[0] in kinds
            if own and begin is None:
                begin = code
            elif not own and begin is not None:
                out.append(f"\\U{begin:08x}-\\U{code - 1:08x}")
                begin = None
        return "".join(out)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces of a public sentencepiece vocabulary that letters and word starts can spell."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p.strip(MARK) and letters().fullmatch(p.lstrip(MARK)) and MARK not in p[1:])


def words_of(text: str | None) -> Counter:
    return Counter(letters().findall(text.lower())) if text else Counter()


def forward(word: str, pieces: dict[str, np.ndarray | float], longest: int, zero, one) -> tuple:
    """The sum over all cuts of a marked word and the logarithm of the scale taken out of it.

    Only the last `longest` prefix sums are kept, so a word of any length takes the same memory.
    """
    sums, logs = deque([one], longest), deque([0.0], longest)
    for end in range(1, len(word) + 1):
        total, log = zero, logs[-1]
        known = False
        for back in range(len(sums), 0, -1):
            p = pieces.get(word[end - back : end])
            if p is not None:
                known = known or back == 1
                total = total + sums[-back] * p * (1.0 if logs[-back] == log else math.exp(logs[-back] - log))
        if not known:
            total = total + sums[-1] * RARE
        top = total if isinstance(total, float) else max(total)
        if top < TINY:
            total, log = total / top, log + math.log(top)
        sums.append(total)
        logs.append(log)
    return sums[-1], logs[-1]


def fit(counts: dict[str, int], pieces: list[str], rounds: int = 3, smooth: float = 0.05) -> dict[str, float]:
    """Piece probabilities of one language from its word counts.

    A word's cuts (begin, end, piece) are looked up once; a character without a piece of its own is a cut of probability
    RARE. Words are at most some tens of letters here, so plain products are far from underflow.
    """
    vocab, longest = set(pieces), max(map(len, pieces), default=1)
    words, start = [], Counter()
    for word, n in counts.items():
        w = MARK + word
        cuts = []
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                if w[i:j] in vocab:
                    cuts.append((i, j, w[i:j]))
                    start[w[i:j]] += n
                elif j == i + 1:
                    cuts.append((i, j, None))
        words.append((len(w), n, cuts))
    total = sum(start.values()) or 1
    p = {k: v / total for k, v in start.items()} | {None: RARE}
    for _ in range(rounds):
        expected: dict[str, float] = dict.fromkeys(start, 0.0)
        for size, n, cuts in words:
            ahead, back = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            for i, j, piece in cuts:  # in order of begin, so ahead[i] is whole
                ahead[j] += ahead[i] * p[piece]
            for i, j, piece in reversed(cuts):
                back[i] += p[piece] * back[j]
            whole = n / ahead[size] if ahead[size] > 0 else 0.0
            for i, j, piece in cuts:
                if piece is not None:
                    expected[piece] += ahead[i] * p[piece] * back[j] * whole
        total = sum(expected.values()) + smooth * len(expected)
        p = {k: (v + smooth) / total for k, v in expected.items()} | {None: RARE}
    return {k: v for k, v in p.items() if k is not None}


def train(docs: DataFrame, path: str = VOCABULARY, per_language: int = 600, longest_word: int = 30, languages: int = 100, words: int = 100_000) -> dict:
    """A model from text and lang of the rows whose crc32(doc_id) mod 4 is not 2.

    Fitted on a sample: the `languages` values of lang that most rows have (equal ones: by code point), about per_language
    documents of each, those with the smallest hash of doc_id, and of them the `words` words that come most often; words
    of over longest_word letters are left out of the fit (scoring takes all words). Null texts and langs teach nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out("doc_id", 4, 2))
    share = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = share.select("lang", (F.lit(float(per_language)) / F.col("n")).alias("share"))
    chosen = usable.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").where(uniform(F.col("doc_id")) < F.col("share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                c: Counter = Counter()
                for t in texts:
                    c.update(words_of(t))
                yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    counts = chosen.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    often = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    counts = counts.where(F.length("word") <= longest_word).withColumn("at", often).where(F.col("at") <= words)
    pieces = spark.sparkContext.broadcast(vocabulary(path))

    def fit_one(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        p = fit(dict(zip(b["word"], b["n"], strict=True)), pieces.value)
        return pd.DataFrame({"lang": key[0], "piece": list(p), "p": list(p.values())})

    rows = counts.groupBy("lang").applyInPandas(fit_one, "lang string, piece string, p double").toPandas()
    langs = sorted(rows["lang"].unique())
    if not langs:
        return {"langs": [], "pieces": {}, "longest": 1}
    wide = rows.pivot(index="piece", columns="lang", values="p")[langs]
    floor = wide.min(axis=0) * 0.1
    return {"langs": langs, "pieces": dict(zip(wide.index, wide.fillna(floor).to_numpy(), strict=True)), "longest": int(wide.index.str.len().max())}


class Scorer:
    """Scores texts in batches. Log probabilities of words seen before are kept, at least `most` of them."""

    def __init__(self, model: dict, most: int = 300_000):
        self.langs, self.pieces, self.longest, self.most = model["langs"], model["pieces"], model["longest"], most
        self.number = {piece: i for i, piece in enumerate(self.pieces, 1)}
        self.p = np.vstack([np.zeros(len(self.langs)), *self.pieces.values()]) if self.pieces else np.zeros((1, len(self.langs)))
        self.ids: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.langs)))

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probabilities of marked words of one length, all languages side by side."""
        n, size = len(words[0]), len(self.langs)
        if n > 32:  # the plain product could underflow
            one = [forward(w, self.pieces, self.longest, np.zeros(size), np.ones(size)) for w in words]
            return np.array([np.log(np.maximum(total, 1e-300)) + log for total, log in one])
        sums, get = [np.ones((len(words), size))], self.number.get
        for end in range(1, n + 1):
            total = np.zeros((len(words), size))
            for begin in range(max(0, end - self.longest), end):
                found = np.array([get(w[begin:end], 0) for w in words])
                if begin == end - 1:
                    total[found == 0] += sums[begin][found == 0] * RARE
                hit = np.flatnonzero(found)
                if len(hit):
                    total[hit] += sums[begin][hit] * self.p[found[hit]]
            sums.append(total)
        return np.log(np.maximum(sums[-1], 1e-300))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > self.most:
            self.ids, self.logs, new = {}, self.logs[:0], list(words)
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        parts = [self.logs]
        for group in by_length.values():
            self.ids.update(zip(group, range(len(self.ids), len(self.ids) + len(group)), strict=True))
            parts.append(self.forward([MARK + w for w in group]))
        self.logs = np.vstack(parts)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [words_of(t) for t in texts]
        if self.langs:
            self.learn(set().union(*counts))
        return [self.best(c) if c and self.langs else ("und", 0.0) for c in counts]

    def best(self, counts: Counter) -> tuple[str, float]:
        at = np.fromiter(map(self.ids.__getitem__, counts), np.int64, len(counts))
        total = np.fromiter(counts.values(), float, len(counts)) @ self.logs[at]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs with held_out, lang_pred and score (the posterior under equal priors) added; columns of these names are replaced.

    `und` with score 0 if the text is null or has no letter. Equal scores: the language first by code point. Texts of any
    length are read whole; rows that repeat, and null doc_ids, are rows like others. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    found = fresh(docs, "found")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for batch in texts:
            yield pd.DataFrame(scorer.texts(batch.tolist()), columns=["lang_pred", "score"])

    out = docs.withColumn("held_out", held_out("doc_id", 4, 2)).withColumn(found, predict("text"))
    return out.withColumns({"lang_pred": F.col(f"{found}.lang_pred"), "score": F.col(f"{found}.score")}).drop(found)
