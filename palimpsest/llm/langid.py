"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum, over all ways to cut it into pieces, of the products of the pieces' probabilities: the
forward algorithm gives it in one pass over the word. The probabilities are fitted by expectation
maximisation (forward and backward over the same cuts) on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, plain_text, wrapped

UNKNOWN = "und"
START = "▁"
#: The code of all characters that the sample lacks.
OTHER = 0x110000
#: Training learns from longer words in parts of so many characters at most; probabilities are scaled every EVERY characters.
PART, EVERY = 64, 16
MOST_WORDS, STRETCH = 500_000, 200_000
#: Characters of words that are scored together, ends of padding included.
CELLS = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def public_pieces(model_file: str) -> list[str]:
    """Lower-cased letter pieces of a sentencepiece vocabulary, word starts marked."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(x for x in found if x.removeprefix(START).isalpha())


def words_of(text: str) -> list[str]:
    """Lower-cased runs between white space, with a mark at the start."""
    return [START + w for w in text.lower().split()]


def hashed(codes: Iterable[int]) -> int:
    """The key of a piece: a polynomial of its characters' codes modulo 2^64."""
    key = 0
    for c in codes:
        key = (key * int(BASE) + c + 1) % 2**64
    return key


class Model:
    """Probabilities of pieces by language. rows: the keys' rows in logits; a last row of zeros stands for what is no piece."""

    def __init__(self, languages: list[str], letters: list[str], pieces: list[str]):
        self.languages = languages
        self.known = np.zeros(OTHER, bool)
        self.known[[ord(c) for c in letters]] = True
        told = [x for x in dict.fromkeys([*letters, *pieces]) if self.known[[ord(c) for c in x]].all()]
        self.spelled = [[ord(c) for c in x] for x in told] + [[OTHER]]
        self.other = len(told)
        row = {hashed(x): i for i, x in enumerate(self.spelled)}
        # the ends of pieces: a run of characters that ends no piece can't be made one by more in front
        ends = sorted({hashed(x[k:]) for x in self.spelled for k in range(len(x))})
        self.keys, self.rows = np.array(ends, np.uint64), np.array([row.get(k, len(row)) for k in ends])
        self.longest = max(map(len, self.spelled))
        self.logits = np.zeros((len(row) + 1, len(languages)))

    def codes(self, words: list[str]) -> np.ndarray:
        """A row of codes for each word, filled to the longest."""
        width = max(map(len, words))
        found = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
        return np.where(self.known[found], found, OTHER).astype(np.uint64) + np.uint64(1)

    def cuts(self, codes: np.ndarray, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, words, their rows in logits) for the pieces that can end at `end`."""
        who, key, power = np.arange(len(codes)), np.zeros(len(codes), np.uint64), 1
        for k in range(1, min(self.longest, end) + 1):
            key = key + codes[who, end - k] * np.uint64(power)
            power = power * int(BASE) % 2**64
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == key
            if not ok.any():
                return
            who, key, at = who[ok], key[ok], at[ok]
            rows = self.rows[at]
            piece = rows < len(self.logits) - 1
            if piece.any():
                yield end - k, who[piece], rows[piece]

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, over all its segmentations. Words of about one length are scored together, the longest first; only the ends that a piece can reach back to are held."""
        out = np.zeros((len(words), len(self.languages)))
        length = np.array([len(w) for w in words])
        for who in _alike(length):
            n, codes = length[who], self.codes([words[i] for i in who])
            ring = self.longest + 1
            alpha, log = np.zeros((ring, len(who), len(self.languages))), np.zeros((len(who), len(self.languages)))
            alpha[0] = 1
            for j in range(1, int(n[0]) + 1):
                active = int(np.searchsorted(-n, -j, side="right"))
                alpha[j % ring, :active] = 0
                for i, some, rows in self.cuts(codes[:active], j):
                    alpha[j % ring, some] += alpha[i % ring, some] * self.logits[rows]
                if j % EVERY == 0:
                    scale = alpha[:, :active].max(axis=0)
                    alpha[:, :active] /= scale
                    log[:active] += np.log(scale)
                over = slice(int(np.searchsorted(-n, -j)), active)
                out[who[over]] = log[over] + np.log(alpha[j % ring, over])
        return out

    def expected(self, words: list[str], weight: np.ndarray, language: int) -> np.ndarray:
        """Expected uses of each piece in the weighted words, of any length: forward and backward over the same cuts, both scaled."""
        p, out = self.logits[:, language], np.zeros(len(self.logits))
        length = np.array([len(w) for w in words])
        for n in np.unique(length):
            same, most = np.flatnonzero(length == n), max(1, min(2000, CELLS // int(n)))
            for who in (same[k : k + most] for k in range(0, len(same), most)):
                codes = self.codes([words[i] for i in who])
                alpha, beta = np.zeros((n + 1, len(who))), np.zeros((n + 1, len(who)))
                log, behind = np.zeros((n + 1, len(who))), np.zeros(len(who))
                alpha[0] = beta[n] = 1
                for j in range(1, n + 1):
                    for i, some, rows in self.cuts(codes, j):
                        alpha[j, some] += alpha[i, some] * p[rows]
                    if j % EVERY == 0:
                        lately = slice(max(0, j - self.longest), j + 1)
                        scale = alpha[lately].max(axis=0)
                        alpha[lately] /= scale
                        log[lately.start :] += np.log(scale)
                whole = weight[who] / alpha[n]
                for j in range(n, 0, -1):
                    if j % EVERY == 0:
                        ahead = slice(max(0, j - self.longest), j + 1)
                        scale = beta[ahead].max(axis=0)
                        beta[ahead] /= scale
                        behind += np.log(scale)
                    for i, some, rows in self.cuts(codes, j):
                        used = p[rows] * beta[j, some]
                        beta[i, some] += used
                        out += np.bincount(rows, alpha[i, some] * used * whole[some] * np.exp(log[i, some] + behind[some] - log[n, some]), minlength=len(out))
        return out


def _alike(length: np.ndarray) -> Iterator[np.ndarray]:
    """Places by falling length, in parts whose lengths are within a power of two and which fill CELLS characters at most."""
    order = np.argsort(-length, kind="stable")
    power = np.frexp(length[order])[1]
    for k in np.unique(power)[::-1]:
        some = order[power == k]
        most = max(1, CELLS // int(length[some[0]]))
        yield from (some[i : i + most] for i in range(0, len(some), most))


def in_parts(counts: pd.DataFrame) -> pd.DataFrame:
    """counts (lang, word, n) with longer words in nearly equal parts of PART characters at most; their cuts at the seams aren't learned from."""
    long = counts["word"].str.len() > PART
    parts = [(lang, w[len(w) * i // k : len(w) * (i + 1) // k], n) for lang, w, n in counts[long].itertuples(index=False) for k in [-(-len(w) // PART)] for i in range(k)]
    return pd.concat([counts[~long], pd.DataFrame(parts, columns=counts.columns)]).groupby(["lang", "word"], as_index=False)["n"].sum()


def fit(counts: pd.DataFrame, pieces: list[str], rounds: int = 4, smooth: float = 0.1) -> Model:
    """counts: lang, word, n. All letters of the words are pieces; characters never seen, and signs, share one that tells nothing. Words of any length count."""
    counts = in_parts(counts)
    letters = sorted({c for w in counts["word"] for c in w if c.isalpha() or c == START} | {START})
    model = Model(sorted(counts["lang"].unique()), letters, pieces)
    model.logits[:-1] = 1 / (len(model.logits) - 1)
    for k, lang in enumerate(model.languages):
        mine = counts[counts["lang"] == lang]
        words, weight = mine["word"].tolist(), mine["n"].to_numpy(float)
        for _ in range(rounds):
            use = model.expected(words, weight, k)[:-1]
            use[model.other] = 0
            model.logits[:-1, k] = (use + smooth) / (use + smooth).sum()
            model.logits[model.other, k] = 1e-3  # the same for each language
    return model


def train(docs: DataFrame, pieces: list[str], usable, per_language: int = 200, words_per_language: int = 200_000, rounds: int = 4) -> Model | None:
    """Fits on at most `per_language` rows of each language among the rows that `usable` allows and whose lang isn't null, and on at most `words_per_language` of their distinct words (those of least hash, both); None if there is none."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "doc_id", F.xxhash64("doc_id", "text").alias("h"))
    best = Window.partitionBy("lang").orderBy("h", "doc_id")
    sample = rows.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= per_language).select("lang", "doc_id", "h")
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).join(F.broadcast(sample), ["doc_id", "h"])
    words = texts.groupBy("lang", "doc_id", "h").agg(F.first("text").alias("text")).mapInPandas(_counted, "lang string, word string, n long")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("word"), "word"))
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("_nth", nth).filter(F.col("_nth") <= words_per_language).drop("_nth").toPandas()
    return fit(counts.sort_values(["lang", "word"]), pieces, rounds) if len(counts) else None


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            c = Counter(words_of(text))
            yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})


class Words(dict):
    """word → its row among the words scored so far; new words wait in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predictor(spark: SparkSession, model: Model | None):
    """A column function: text → struct<lang_pred, score>.

    lang_pred is the language of the largest forward probability (ties: the first by name); score is
    its share when the probabilities, each to the power of one over the root of the number of words,
    are summed to 1. Null texts and those without a letter are `und` with score 0, and so is every
    text if there was nothing to learn from. A text in letters never learned scores one over the
    number of languages. A worker holds a bounded table of words; all words of all texts count, and
    the words of a long text are added up in bounded stretches.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held.value
        n_lang = len(model.languages) if model else 1
        table, scores = Words(), np.zeros((0, n_lang))

        def scored(texts: list[str]) -> list[tuple[str, float]]:
            nonlocal table, scores
            total, size = np.zeros((len(texts), n_lang)), np.zeros(len(texts))
            waiting: list[tuple[int, np.ndarray]] = []

            def add():
                nonlocal scores
                if table.new:
                    scores = np.concatenate([scores, model.forward(table.new)])
                    table.new.clear()
                doc = np.repeat([i for i, _ in waiting], [len(r) for _, r in waiting])
                rows = scores[np.concatenate([r for _, r in waiting])]
                for k in range(n_lang):
                    total[:, k] += np.bincount(doc, rows[:, k], minlength=len(texts))
                waiting.clear()

            held_words = 0
            for i, text in enumerate(texts):
                words = words_of(text)
                size[i] = len(words)
                for a in range(0, len(words), STRETCH):
                    if len(table) > MOST_WORDS:
                        if waiting:
                            add()
                        table, scores, held_words = Words(), scores[:0], 0
                    part = words[a : a + STRETCH]
                    waiting.append((i, np.array(list(map(table.__getitem__, part)), np.int64)))
                    held_words += len(part)
                    if held_words > STRETCH:
                        add()
                        held_words = 0
            if waiting:
                add()
            log = total / np.sqrt(np.maximum(size, 1))[:, None]
            share = np.exp(log - log.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            top = share.argmax(axis=1)
            return [(model.languages[k], float(share[i, k])) for i, k in enumerate(top)]

        for texts in batches:
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            told = [i for i, x in enumerate(texts) if model and x and _has_letter(x)]
            if told:
                for i, found in zip(told, scored([texts.iat[i] for i in told])):
                    out[i] = found
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predicted


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, as `predictor` tells. Columns other than doc_id and text are not read."""
    told = predictor(docs.sparkSession, model)
    return documents(docs).select("doc_id", told("text").alias("told")).select("doc_id", "told.lang_pred", "told.score")


def keep_told(docs: DataFrame, model: Model | None, margin: float = 1.2) -> DataFrame:
    """The rows of docs whose language can be told: texts with a letter whose score is over `margin` times what all languages alike would have (one language learned: any text with a letter).

    Each row is judged by its own text, whatever its id; null and empty texts go, repeated rows stay
    each, and all columns are as they were. With nothing to learn from no text can be told, and none stays.
    """
    told = predictor(docs.sparkSession, model)
    rows = wrapped(docs, told=told(plain_text(docs)))
    alike = 1 / len(model.languages) if model and len(model.languages) > 1 else 0.0
    return rows.filter((F.col("told.lang_pred") != UNKNOWN) & (F.col("told.score") >= margin * alike)).select("row.*")


def held_out() -> F.Column:
    """True for the rows that training never sees: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify_languages(docs: DataFrame, vocabulary: str, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, trained on the rows that aren't held out.

    Null texts, null languages and null ids: the first is `und`, the second isn't learned from, the
    third isn't held out. Repeated rows give repeated results; an empty table gives an empty result.
    """
    model = train(docs, public_pieces(vocabulary), ~held_out(), **settings)
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
