"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by a forward
algorithm; words are independent, so a text's log probability is the sum over its
words. The piece probabilities are fitted by expectation maximisation (forward-backward
over the distinct words) on at most ``SAMPLE`` labelled documents of each language,
those whose doc_id hashes lowest. Predictions read whole texts and nothing else.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import shared as S

#: Documents of a language that the fit reads at most.
SAMPLE = 400
#: Rounds of expectation maximisation, and the count added to every piece.
ROUNDS, SMOOTH = 3, 0.05
#: Probability of a character outside the vocabulary, in every language.
UNKNOWN = 1e-7
#: Least average gain of a character over the background in a text that counts as identified.
GAIN = 0.25
#: Words that the cache of a task holds.
CACHE = 250_000
#: Longer words are scored with rescaling, one at a time.
LONG = 40
#: Bytes of text whose new words are scored together.
SLICE = 1 << 20
MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Pieces of the vocabulary file (without control and byte pieces) and their numbers."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): n for n, i in enumerate(own)}


class Pieces:
    """The vocabulary with piece probabilities of some languages (rows: pieces, then
    the unknown character). Spans of many words at once are looked up by a rolling
    hash in an open-addressing table."""

    BASE, SPREAD, SLOTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 18

    def __init__(self, pieces: dict[str, int], probability: np.ndarray) -> None:
        self.of = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)
        self.p = np.vstack([probability, np.full((1, probability.shape[1]), UNKNOWN)])
        mask = (1 << self.SLOTS) - 1
        assert len(pieces) < mask // 2
        self.keys, self.ids = np.zeros(mask + 1, np.uint64), np.full(mask + 1, -1, np.int32)
        by_length = defaultdict(list)
        for w in pieces:
            by_length[len(w)].append(w)
        for n, own in by_length.items():
            codes, h = self._codes(own, n), np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * self.BASE + codes[:, k]
            for w, key, at in zip(own, h.tolist(), self._slot(h).tolist(), strict=True):
                while self.keys[at]:
                    at = (at + 1) & mask
                self.keys[at], self.ids[at] = key, pieces[w]

    def _codes(self, words: list[str], n: int) -> np.ndarray:
        return np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * self.SPREAD >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = self._slot(h)
        got, ids = self.keys[at], self.ids[at]
        ids = np.where(got == h, ids, -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[at[open_]]
            right = got == h[open_]
            ids[open_[right]] = self.ids[at[open_[right]]]
            open_ = open_[~right & (got != 0)]
        return ids

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words with a piece there, the pieces) of words of equal length."""
        n = len(words[0])
        codes, h = self._codes(words, n), np.zeros((n, len(words)), np.uint64)
        for end in range(1, n + 1):
            first = max(0, end - self.longest)
            h[first:end] *= self.BASE
            h[first:end] += codes[:, end - 1]
            found = self._find(h[first:end].reshape(-1)).reshape(end - first, len(words))
            last = found[-1]
            last[last < 0] = self.unknown
            at, own = np.nonzero(found >= 0)
            bounds = np.searchsorted(at, np.arange(end - first + 1))
            ids = found[at, own]
            for k, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if y > x:
                    yield first + k, end, own[x:y], ids[x:y]

    def forward(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Forward sums (position, word, language) of marked words of equal length."""
        n, many = len(words[0]), self.p.shape[1]
        a = np.zeros((n + 1, len(words), many))
        a[0] = 1
        spans = list(self.spans(words))
        for start, end, own, ids in spans:
            a[end][own] += a[start][own] * self.p[ids]
        return a, spans

    def one(self, word: str) -> np.ndarray:
        """Log probability of one long marked word, rescaled as it goes."""
        of, keep = self.of.get, self.longest
        a, log = [np.ones(self.p.shape[1])], np.zeros(self.p.shape[1])
        for end in range(1, len(word) + 1):
            now = np.zeros(self.p.shape[1])
            for back in range(1, min(keep, end) + 1):
                i = of(word[end - back : end], self.unknown if back == 1 else -1)
                if i >= 0:
                    now += a[-back] * self.p[i]
            a.append(now)
            del a[:-keep]
            if end % 8 == 0:
                log += np.log(now)
                a = [x / now for x in a]
        return log + np.log(a[-1])

    def log_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), self.p.shape[1]))
        groups = defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w)].append(i)
        for n, own in groups.items():
            if n > LONG:
                for i in own:
                    out[i] = self.one(MARK + words[i])
                continue
            for k in range(0, len(own), 2048):
                some = own[k : k + 2048]
                a, _ = self.forward([MARK + words[i] for i in some])
                out[some] = np.log(a[-1])
        return out


def fit_language(words: Counter, pieces: dict[str, int]) -> np.ndarray:
    """Piece probabilities of one language from its word counts (longer words teach in stretches of LONG letters)."""
    p = np.full(len(pieces), 1 / max(1, len(pieces)))
    counts: Counter = Counter()
    for w, n in words.items():
        for k in range(0, len(w), LONG):
            counts[w[k : k + LONG]] += n
    groups = defaultdict(list)
    for w in counts:
        groups[len(w)].append(w)
    model = Pieces(pieces, p[:, None])
    for _ in range(ROUNDS):
        model.p[:-1, 0] = p
        expected = np.zeros(len(pieces) + 1)
        for own in groups.values():
            for k in range(0, len(own), 2048):
                batch = own[k : k + 2048]
                a, spans = model.forward([MARK + w for w in batch])
                b = np.zeros_like(a)
                b[-1] = 1
                weight = np.array([counts[w] for w in batch], float)[:, None] / a[-1]
                for start, end, some, ids in reversed(spans):
                    through = model.p[ids] * b[end][some]
                    b[start][some] += through
                    expected += np.bincount(ids, (a[start][some] * through * weight[some])[:, 0], len(expected))
        p = expected[:-1] + SMOOTH
        p /= p.sum()
    return p


class Model:
    """Languages and their piece probabilities."""

    def __init__(self, langs: list[str], probability: np.ndarray, vocabulary_path: str | None) -> None:
        self.langs, self.probability, self.path = langs, probability, vocabulary_path

    def scorer(self) -> Scorer:
        pieces = vocabulary(self.path)
        flat = np.full((len(pieces), 1), 1 / len(pieces))
        return Scorer(Pieces(pieces, np.hstack([self.probability, flat])), self.langs)


class Scorer:
    """Scores texts; the last column of ``pieces`` is the background, all pieces alike."""

    def __init__(self, pieces: Pieces, langs: list[str]) -> None:
        self.pieces, self.langs = pieces, langs
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs) + 1))

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, posterior, and by how much a character is likelier in that language
        than in the background (natural log) of each text."""
        split = [t.split() if t and _LETTER.search(t) else None for t in texts]
        if len(self.known) > CACHE:
            self.clear()
        new = list(set().union(*(w for w in split if w)) - self.known.keys())
        at = len(self.known)
        while len(self.table) < at + len(new):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        if new and self.langs:
            self.table[at : at + len(new)] = self.pieces.log_scores(new)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        langs, scores, gains = [], [], []
        for words in split:
            if not words or not self.langs:
                langs.append("und")
                scores.append(0.0)
                gains.append(0.0)
                continue
            total = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)
            total, background = total[:-1], total[-1]
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
            gains.append(float((total[best] - background) / sum(map(len, words))))
        return langs, scores, gains


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang[lang].update(text.split())
        for lang, counts in by_lang.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE, vocabulary_path: str | None = None) -> Model:
    """Fit on at most ``sample`` documents of each language, outside the held-out fifth."""
    rows = docs.where(~_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # languages, each a column of the model
    place = F.xxhash64("doc_id")
    for lang, n in many.items():  # about twice the sample goes on, so that no task holds a language's rows
        share = min(1.0, 2 * sample / n + 50 / n)
        place = F.when((F.col("lang") == lang) & (F.xxhash64("doc_id") >= int((2 * share - 1) * 2**63) if share < 1 else F.lit(False)), None).otherwise(place)
    near = rows.select("doc_id", "lang", place.alias("place")).where("place is not null")
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select(F.col("doc_id").alias("_id")).distinct()
    chosen = F.broadcast(chosen)  # at most ``sample`` ids of each language
    texts = rows.join(chosen, F.col("doc_id") == F.col("_id"), "left_semi")
    words = texts.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in words.toLocalIterator():  # of the bounded sample only
        counts[r["lang"]][r["word"]] = r["n"]
    langs = sorted(counts)
    pieces = vocabulary(vocabulary_path)
    p = np.stack([fit_language(counts[x], pieces) for x in langs], axis=1) if langs else np.zeros((len(pieces), 0))
    return Model(langs, p, vocabulary_path)


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in batches:
            _, offsets = S.text_bytes(batch.column("text"))
            for i, j in S.slices_of(offsets, SLICE):
                part = batch.slice(i, j - i)
                langs, scores, _ = scorer.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a language of the model, or ``und`` with score 0 where the text is
    null, empty or has no letter, or the model has no language. ``score`` is the
    posterior of the prediction among the model's languages. ``held_out``: crc32 of the
    doc_id as text is divisible by 5 (false for a null doc_id). lang, source and all
    other columns are never read. Repeated rows are each returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, fixed by the vocabulary
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labelled documents and predict all of them."""
    return predict(docs, fit(docs, sample))


def keep_identified(docs: DataFrame, least: float = 0.5, gain: float = GAIN, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told.

    Kept: texts with a letter, a posterior of ``least`` or more, and a character that is
    by ``gain`` or more (natural log, on average) likelier in that language than in the
    background of equally likely pieces. Null and empty texts go.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    keep = S.fresh(docs, "keep")
    schema = T.StructType([*docs.schema.fields, T.StructField(keep, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in batches:
            _, offsets = S.text_bytes(batch.column("text").cast(pa.string()))
            for i, j in S.slices_of(offsets, SLICE):
                part = batch.slice(i, j - i)
                found = zip(*scorer.predict(part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([lang != "und" and p >= least and g >= gain for lang, p, g in found], pa.bool_())], names=[*part.schema.names, keep])

    return docs.mapInArrow(run, schema).where(F.col(keep)).drop(keep)
