"""Language identification by unigram pieces, with all segmentations of a word summed.

Each language has a probability for every all-letter piece of a fixed public vocabulary, whatever its
length. A word's probability is the sum, over all ways to cut it into pieces, of the product of their
probabilities; the forward algorithm gives it in one pass over the word's letters, in logarithms, so words
may have any length. Very long words are cut into chunks whose transfer matrices (from the sums at the boundaries
before a chunk to those at its end) are computed side by side and then multiplied, which loses no segmentation.
Piece probabilities are learned by expectation-maximisation with the same sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import hash_sample, small_batches

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
START = "▁"
#: Keys are polynomials of the letters' codes in this number, modulo 2**64 (fixed value): letters have no limit.
BASE = 0x5851F42D4C957F2D
#: Code of a letter neither in the vocabulary nor in the training texts; above all others, as there are fewer letters.
STRANGE = 1 << 21
#: Words of more letters are scored by chunks of so many.
CHUNK = 1024
#: Words of more letters teach nothing (they are scored like all others).
LEARNED = 64
NONE = -1e30
#: A text is strange if its log likelihood per letter is by so much lower than that of any training text.
STRANGER = 1.0


WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (category L); WORD also takes numerals and fractions, which part the run that holds them."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


@dataclass
class Pieces:
    """The vocabulary's all-letter pieces, and every letter for itself; keys by length, and those of all beginnings."""

    letters: dict[str, int]
    keys: np.ndarray  # sorted
    begins: list[np.ndarray]  # sorted keys of the pieces' first s letters, for s = 1, 2, ...

    @classmethod
    def load(cls, path: str, extra_letters: str) -> Pieces:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
        found = {p for p in found if p == START or p.removeprefix(START).isalpha()}
        letters = {c: i + 1 for i, c in enumerate(sorted({START, *extra_letters, *(c for p in found for c in p)}))}
        return cls.of(letters, [[letters[c] for c in p] for p in found | set(letters)])

    @classmethod
    def of(cls, letters: dict[str, int], pieces: list[list[int]]) -> Pieces:
        keys = np.array(sorted({cls.key(p) for p in pieces}), np.int64)
        begins = [np.array(sorted({cls.key(p[:s]) for p in pieces if len(p) >= s}), np.int64) for s in range(1, max(map(len, pieces)) + 1)]
        return cls(letters, keys, begins)

    @staticmethod
    def key(codes: list[int]) -> int:
        k = 0
        for c in codes:
            k = (k * BASE + c) % 2**64
        return k - 2**64 if k >= 2**63 else k

    def coded(self, words: list[str]) -> np.ndarray:
        """Letter codes, a row for each word; 0 fills up and STRANGE is an unknown letter."""
        width = max(map(len, words), default=1)
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
        table = self.table()
        out = table[np.minimum(flat, len(table) - 1)].astype(np.int64)
        out[(flat == 0)] = 0
        return out

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            t = np.full(max(map(ord, self.letters)) + 2, STRANGE, np.int32)
            for c, i in self.letters.items():
                t[ord(c)] = i
            self._table = t
        return self._table

    def entries(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, piece) of every piece in rows of codes; an unknown letter is piece len(keys).

        Places are followed letter by letter only while what they hold is the beginning of a piece."""
        row, start = np.nonzero(codes)
        at, key, out = start.copy(), np.zeros(len(row), np.int64), []
        odd = codes[row, start] == STRANGE
        out.append((row[odd], start[odd], start[odd] + 1, np.full(int(odd.sum()), len(self.keys))))
        for begin in self.begins:
            ok = at < codes.shape[1]
            row, start, at, key = row[ok], start[ok], at[ok], key[ok]
            key = key * np.int64(BASE) + codes[row, at]
            k = np.minimum(np.searchsorted(begin, key), len(begin) - 1)
            ok = begin[k] == key
            row, start, at, key = row[ok], start[ok], at[ok] + 1, key[ok]
            if not len(row):
                break
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            full = self.keys[k] == key
            out.append((row[full], start[full], at[full], k[full]))
        return tuple(np.concatenate(c) for c in zip(*out))


def _sums(total: np.ndarray, order: np.ndarray, here: np.ndarray, there: np.ndarray, at: np.ndarray, log: np.ndarray, places: range) -> None:
    """total[:, here] = log of the sum over entries of exp(total[:, there] + log); every row has an entry at each place."""
    low = min(places, default=0)
    cuts = np.searchsorted(here[order], np.arange(low, low + len(places) + 1))
    for p in places:
        e = order[cuts[p - low] : cuts[p - low + 1]]
        if not len(e):
            continue
        rows = at[e]
        term = total[rows, there[e]] + log[e]
        new = np.empty(len(e), bool)
        new[0] = True
        np.not_equal(rows[1:], rows[:-1], out=new[1:])
        first = np.flatnonzero(new)
        top = np.maximum.reduceat(term, first)
        term -= top[np.cumsum(new) - 1]
        np.exp(term, out=term)
        total[rows[first], p] = top + np.log(np.add.reduceat(term, first))


def grouped(texts: list[str]) -> Iterator[np.ndarray]:
    """Indices of texts of the same length together, about a million letters at most."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        most = max(1, 200_000 // max(1, int(sizes[part[0]])))
        for i in range(0, len(part), most):
            yield part[i : i + most]


@dataclass
class LanguageModel:
    langs: list[str]
    pieces: Pieces
    prob: np.ndarray  # (pieces, languages)
    prior: np.ndarray
    unknown: float = 1e-7
    least: float = NONE  # log likelihood per letter below which a text is strange

    def logs(self) -> np.ndarray:
        """Logarithms of the pieces' probabilities, and last that of an unknown letter."""
        return np.log(np.append(self.prob, np.full((1, self.prob.shape[1]), self.unknown), axis=0))

    @staticmethod
    def forward(entries, log: np.ndarray, start: np.ndarray, width: int, first: int = 0) -> np.ndarray:
        """Sums at boundaries 0 to width, (rows, boundaries, languages); start holds those up to boundary first."""
        row, begin, end, piece = entries
        total = np.full((len(start), width + 1, log.shape[1]), NONE)
        total[:, : first + 1] = start
        use = np.flatnonzero(end > first)
        order = use[np.lexsort((row[use], end[use]))]
        _sums(total, order, end, begin, row, log[piece], range(first + 1, width + 1))
        return total

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        log = self.logs()
        out = np.zeros((len(words), log.shape[1]))
        marked = [START + w for w in words]
        for g in grouped(marked) if marked else ():
            width = len(marked[g[0]])
            if width > 2 * CHUNK:
                for i in g:
                    out[i] = self.long_score(marked[i], log)
                continue
            entries = self.pieces.entries(self.pieces.coded([marked[i] for i in g]))
            out[g] = self.forward(entries, log, np.zeros((len(g), 1, log.shape[1])), width)[:, -1]
        return out

    def long_score(self, word: str, log: np.ndarray) -> np.ndarray:
        """Log probability of one very long word, by transfer matrices of its chunks."""
        s, n_lang = len(self.pieces.begins), log.shape[1]
        codes = np.concatenate([np.zeros(s - 1, np.int64), self.pieces.coded([word])[0]])
        state = np.full((s, n_lang), NONE)  # sums at the last s boundaries
        state[-1] = 0
        basis = np.full((s, s, n_lang), NONE)
        basis[np.arange(s), np.arange(s)] = 0
        n = len(word)
        starts = np.arange(0, n, CHUNK)
        for lo in range(0, len(starts), 32):
            part = starts[lo : lo + 32]
            for width in sorted({min(CHUNK, n - int(x)) for x in part}, reverse=True):
                own = [int(x) for x in part if min(CHUNK, n - int(x)) == width]
                rows = np.stack([codes[x : x + s - 1 + width] for x in own])
                row, begin, end, piece = self.pieces.entries(rows)
                total = np.stack([self.forward((row, begin, end, piece), log, np.repeat(basis[b][None], len(own), axis=0), s - 1 + width, s - 1)[:, -s:] for b in range(s)], axis=1)
                for m in total:  # (from, to, languages)
                    term = state[:, None] + m
                    top = term.max(0)
                    state = top + np.log(np.exp(term - top).sum(0))
        return state[-1]

    def learn(self, words: Counter, lang: int) -> np.ndarray:
        """Expected number of uses of every piece in one language's words."""
        texts = [START + w for w in words if len(w) < LEARNED]
        weight = np.array([words[t[1:]] for t in texts], float)
        log = self.logs()[:, lang : lang + 1]
        used = np.zeros(len(log))
        for g in grouped(texts) if texts else ():
            width = len(texts[g[0]])
            row, begin, end, piece = entries = self.pieces.entries(self.pieces.coded([texts[i] for i in g]))
            front = self.forward(entries, log, np.zeros((len(g), 1, 1)), width)
            back = np.full_like(front, NONE)
            back[:, width] = 0
            _sums(back, np.lexsort((row, begin)), begin, end, row, log[piece], range(width - 1, -1, -1))
            share = np.exp(front[row, begin, 0] + log[piece, 0] + back[row, end, 0] - front[row, width, 0])
            used += np.bincount(piece, share * weight[g][row], len(used))
        return used[:-1]


def fit(texts: list[tuple[str, str]], vocabulary: str | None = None, rounds: int = 4) -> LanguageModel:
    """Learn from (text, language) pairs on the driver; the pairs are a bounded sample."""
    langs = sorted({lang for _, lang in texts})
    words = {lang: Counter() for lang in langs}
    for text, lang in texts:
        words[lang].update(words_of(text))
    letters = {c for w in words.values() for k in w for c in k}
    pieces = Pieces.load(vocabulary or public_tokenizers.path(VOCABULARY), "".join(sorted(letters)))
    n = len(pieces.keys)
    prob = np.full((n, len(langs)), 1.0 / n)
    docs = Counter(lang for _, lang in texts)
    model = LanguageModel(langs, pieces, prob, np.array([docs[k] / len(texts) for k in langs]))
    for _ in range(rounds):
        new = np.stack([model.learn(words[lang], i) for i, lang in enumerate(langs)], axis=1) + 0.01
        model.prob = new / new.sum(0)
    known = {w: i for i, w in enumerate({w for c in words.values() for w in c})}
    scores = model.word_scores(list(known))
    fits = []
    for text, _ in texts:
        own = words_of(text)
        if own:
            fits.append(scores[[known[w] for w in own]].sum(0).max() / sum(map(len, own)))
    model.least = float(min(fits, default=NONE)) - STRANGER
    return model


def sample(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_bytes: int = 1 << 26) -> list[tuple[str, str]]:
    """At most limit labelled texts whose crc32 of the id as text leaves no remainder of 1 by 3, chosen by a hash
    of id and text; of those, in that order, as many as most_bytes hold together (one at least)."""
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = hash_sample(rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("id")), limit, "id", "text")
    rows = rows.withColumn("h", F.xxhash64("id", "text", "lang"))
    sizes = [r["size"] for r in rows.select("h", F.octet_length("text").alias("size")).orderBy("h").collect()]
    most = max(1, int(np.searchsorted(np.cumsum(sizes), most_bytes, side="right")))
    return [(r["text"], r["lang"]) for r in rows.orderBy("h").limit(most).select("text", "lang").collect()] if sizes else []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predictor(spark, model: LanguageModel | None, min_letters: int = 1):
    """A column function from text to struct(lang, score, strange): strange texts are less likely, letter by letter,
    than any that the model was learned from."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, strange boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known: dict[str, int] = {}
        scores = np.zeros((0, len(m.langs) if m else 0))
        for texts in batches:
            parts = []
            for first in range(0, len(texts), 512):  # few at once: a row of doubles for each word of them
                part = texts.iloc[first : first + 512]
                if m is None:
                    parts.append(pd.DataFrame({"lang": [UNDETERMINED] * len(part), "score": 0.0, "strange": True}))
                    continue
                if len(known) > 200_000:
                    known, scores = {}, scores[:0]
                places, new, bounds, letters = [], [], [0], []
                for t in part:
                    found = words_of(t) if t else []
                    letters.append(sum(map(len, found)))
                    for w in found:
                        k = known.get(w)
                        if k is None:
                            k = known[w] = len(known)
                            new.append(w)
                        places.append(k)
                    bounds.append(len(places))
                if new:
                    scores = np.concatenate([scores, m.word_scores(new)])
                total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores[np.array(places, np.int64)], axis=0)])
                doc = np.diff(total[np.array(bounds)], axis=0)
                odd = doc.max(1) < m.least * np.array(letters)
                doc += np.log(m.prior)
                doc = np.exp(doc - doc.max(1, keepdims=True))
                doc /= doc.sum(1, keepdims=True)
                best, some = doc.argmax(1), np.diff(bounds) > 0
                parts.append(pd.DataFrame({"lang": np.where(some, np.array(m.langs, object)[best], UNDETERMINED), "score": np.where(some, doc.max(1), 0.0), "strange": odd | ~some}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang": [], "score": [], "strange": []}).astype({"lang": object, "strange": bool})

    return predict


def identify(docs: DataFrame, train_limit: int = 3000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """All columns of docs with lang_pred and score (of those names, the old columns go).

    Only the text decides. A null text and one without a letter are 'und' with score 0; so is all
    if no labelled text can be learned from. score is the posterior of the predicted language; ties go to
    the smaller name. Letters are Unicode's (category L): digits, numerals and fractions are none. Very long texts
    and words are scored whole. Repeated rows are judged alike; an empty table gives no rows. At most train_limit
    labelled texts of together 64 MB are gathered to learn from, chosen by a hash of id and text, so null and
    repeated ids count like others. Nothing is shuffled but that sample.
    """
    texts = sample(docs, train_limit, doc_id, text, lang)
    model = fit(texts, vocabulary) if texts else None
    predict = predictor(docs.sparkSession, model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    judged = docs.select(*names, predict(F.col(text)).alias("__lang"))
    return judged.select(*names, F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))
