"""Reading level of each document (problem 8).

Counts of sentences, words, letters, syllables and long words of whole texts feed
several readability formulas, each of which estimates a school grade; the median of
the estimates is the grade of the text. English and Vietnamese texts have formulas of
their own (a written Vietnamese word is one syllable, so word length carries what
syllables carry in English); the language is told from the accents, not from the
``lang`` column. Syllables are counted by patterns in the manner of hyphenation: a
pattern gives the places between its letters a number, the highest one counts, and
odd numbers part syllables.

Texts without punctuation (sentence ends and pauses together) have no sentence length.
Two are tried: a standard one, and an estimate from the words, each of which opens
sentences at a certain rate in rated texts with punctuation. Grades become levels by
cuts fitted on rated documents, for each language with and without punctuation; the
fit also tells which of the two lengths serves better.

Defined results: a text without words (null, empty, digits only) has no grade and no
level, but keeps its row; rows without id are ignored; repeated rows count once;
ratings outside 1..5 are ignored; where a kind of text has too few ratings, the cuts
of all ratings serve, and without any rating evenly spaced ones.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .words import _table, hash_runs, slices

LEVELS = 5
#: Words per mark (sentence end or pause) above which a text counts as unpunctuated, and the standard length of its sentences.
UNPUNCTUATED, STANDARD = 40.0, 15.0
#: Rated documents that the cuts and rates are fitted on, at most; ratings that a kind of text needs for cuts of its own.
FIT_SAMPLE, FIT_LEAST = 20_000, 40
#: Words that have a rate of their own, at most, and how often one must occur for it; rate of the others.
RATED_WORDS, RATED_LEAST, RARE_RATE = 20_000, 5, 0.02
# Characters that end a sentence, and those that mark a pause.
ENDS = ".!?…•。．！？\n"
PAUSES = ",;:，；："
# Where syllables part. Between vowels by the first group of patterns, not where the second says so;
# the third silences endings, with exceptions in the fourth. A dot is an end of the word.
PATTERNS = (
    "i1a i1o i1u i1i e1o u1a u1o u1u a1e a1o y1a y1o o1em o1et e1ing o1ing u1ing y1ing i1er. i1est. sc3i3en cli3en ide1a qui1et di1et e1a2t re1a cre1a u1it u1is ne1on vi1ew ri1ot ui1ti",
    "t2io s2io c2io g2io x2io sh2io c2ia t2ia s2ia g2ia q2u1a g2u1a q2u1o g2u1o q2u1i g2u1i q2u1e g2u1e b2ui f2rui s2ui j2ui r2ui2s a2ea e2au ie2u2r t2iou c2iou g2eo g2eou pe2op t2ient c2ient c2ienc r2ea2d r2ea2c r2ea2l2l r2ea2s r2ea2ch",
    "2e. 2ed. 2es. 2ely. 2eful 2eless 2ement. 2eness 2e1some",
    "bl3e. cl3e. dl3e. fl3e. gl3e. kl3e. pl3e. tl3e. sl3e. zl3e. t3ed. d3ed. s3es. z3es. x3es. ch3es. sh3es. g3es. c3es. l3ement",
)

COUNTS = ("sentences", "words", "letters", "syllables", "polysyllables", "long_words", "long_syllables", "accented", "pauses", "opens_vi", "opens_en")
VOWELS = frozenset("aeiouy")


@cache
def patterns() -> dict[str, tuple[int, ...]]:
    """The letters of each pattern with the numbers before, between and after them."""
    out = {}
    for written in " ".join(PATTERNS).split():
        letters, numbers = "", [0]
        for c in written:
            if c.isdigit():
                numbers[-1] = int(c)
            else:
                letters += c
                numbers.append(0)
        out[letters] = tuple(numbers)
    return out


def word_syllables(word: str) -> int:
    """Syllables of a word in lower-case letters without accents; at least 1."""
    known, longest = patterns(), 7
    dotted = f".{word}."
    marks = [0] * (len(dotted) + 1)
    for i in range(len(dotted)):
        for j in range(i + 1, min(i + longest, len(dotted)) + 1):
            numbers = known.get(dotted[i:j])
            if numbers:
                for k, n in enumerate(numbers):
                    marks[i + k] = max(marks[i + k], n)
    count, before = 0, False
    for i, c in enumerate(word):
        # the vowel after this place: opens a syllable after a consonant unless an even number silences it, after a vowel if an odd one parts them
        vowel = c in VOWELS
        mark = marks[i + 1]
        if vowel and (mark % 2 == 1 if before else not (mark and mark % 2 == 0)):
            count += 1
        before = vowel
    return max(1, count)


_SOUNDS: dict[int, int] = {}


def _sounds(hashes: np.ndarray, chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Syllables of words given once each; what is known stays in the worker, up to a number of words."""
    if len(_SOUNDS) > 2_000_000:
        _SOUNDS.clear()
    out = np.empty(len(hashes), np.int64)
    for n, h in enumerate(hashes.tolist()):
        count = _SOUNDS.get(h)
        if count is None:
            word = chars[begin[n] : end[n] + 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            count = _SOUNDS[h] = word_syllables(word[:64]) if word.isascii() else 1
        out[n] = count
    return out


@dataclass(frozen=True)
class Words:
    """The words of some texts: the text of each, its hash, whether it opens a sentence, and what else is counted per word."""

    owner: np.ndarray
    hashes: np.ndarray
    opens: np.ndarray
    columns: tuple[np.ndarray, ...]


def read_words(texts: list[str]) -> tuple[Words | None, np.ndarray]:
    """The words (runs of letters and digits with a letter among them) of all texts, and the pauses of each text."""
    codes, _ = _table()
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    marked = np.concatenate([[0], np.cumsum(np.isin(raw, np.array([ord(c) for c in PAUSES], np.uint32)))])
    pauses = np.diff(np.concatenate([[0], marked[ends]])) if len(texts) else np.zeros(0)
    folded = codes[raw]
    folded = np.where(folded == np.uint32(0xFFFFFFFF), np.uint32(ord("f")), folded)  # a ligature counts as one letter
    keep = folded != 0
    # accents: a letter that differs from what it folds to, or a mark of its own
    mark = ((raw >= 0xC0) & (raw < 0x250) | (raw >= 0x1E00) & (raw < 0x1F00)) & (folded != 32) | (raw >= 0x300) & (raw < 0x370)
    stop = np.cumsum(np.isin(raw, np.array([ord(c) for c in ENDS], np.uint32)))
    at = np.flatnonzero(keep)
    chars, marks = folded[at], np.cumsum(mark)
    part = chars != 32
    first = part.copy()
    first[1:] &= ~part[:-1]
    begin = np.flatnonzero(first)
    if not begin.size:
        return None, pauses
    final = part.copy()
    final[:-1] &= ~part[1:]
    end = np.flatnonzero(final)
    letters = np.add.reduceat((part & ~((chars >= 48) & (chars <= 57))).astype(np.int64), begin)
    use = letters > 0
    begin, end, letters = begin[use], end[use], letters[use]
    if not begin.size:
        return None, pauses
    inside = np.flatnonzero(part)
    word = np.cumsum(first)[inside] - 1
    hashes = hash_runs(chars[inside], inside - np.flatnonzero(first)[word], np.searchsorted(inside, np.flatnonzero(first)))[use]
    unique, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    sounds = _sounds(unique, chars, begin[one], end[one])[which]
    owner = np.searchsorted(ends, at[begin], side="right")
    sentence = stop[at[begin]]
    new = np.concatenate([[True], (sentence[1:] != sentence[:-1]) | (owner[1:] != owner[:-1])])
    accents = marks[at[end]] - marks[at[begin]] + mark[at[begin]] > 0
    accents |= marks[np.minimum(at[end] + 1, len(raw) - 1)] > marks[at[end]]
    return Words(owner, hashes, new, (new, np.ones(len(begin)), letters, sounds, sounds >= 3, letters > 6, letters >= 5, accents)), pauses


def count_texts(texts: list[str], rates: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """One row of COUNTS per text. ``rates``: hashes of words in order, and how often each opens a sentence in Vietnamese and in English."""
    out = np.zeros((len(texts), len(COUNTS)))
    words, pauses = read_words(texts)
    out[:, COUNTS.index("pauses")] = pauses
    if words is None:
        return out
    columns = [*words.columns]
    if rates is not None and len(rates[0]):
        place = np.minimum(np.searchsorted(rates[0], words.hashes), len(rates[0]) - 1)
        known = rates[0][place] == words.hashes
        opens = [np.where(known, r[place], RARE_RATE) for r in rates[1:]]
    else:
        opens = [np.full(len(words.owner), 1 / STANDARD)] * 2
    for c, x in [*enumerate(columns), (COUNTS.index("opens_vi"), opens[0]), (COUNTS.index("opens_en"), opens[1])]:
        out[:, c] = np.bincount(words.owner, weights=x, minlength=len(texts))[: len(texts)]
    return out


def _vietnamese(counts: np.ndarray) -> np.ndarray:
    return counts[:, COUNTS.index("accented")] > 0.3 * counts[:, 1]


def _punctuated(counts: np.ndarray) -> np.ndarray:
    return counts[:, 1] <= UNPUNCTUATED * np.maximum(counts[:, 0] + counts[:, COUNTS.index("pauses")], 1)


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vi, word, n, opens): how often each word occurs and opens a sentence in the punctuated texts of a batch."""
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for a, b in slices([len(t) for t in texts]):
            words, _ = read_words(texts[a:b])
            if words is None:
                continue
            counts = count_texts(texts[a:b])
            vi, fine = _vietnamese(counts)[words.owner], _punctuated(counts)[words.owner]
            for language in (False, True):
                pick = fine & (vi == language)
                unique, which = np.unique(words.hashes[pick], return_inverse=True)
                n, opens = np.bincount(which, minlength=len(unique)), np.bincount(which, weights=words.opens[pick], minlength=len(unique))
                yield pa.record_batch([pa.array(np.full(len(unique), language)), pa.array(unique.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(opens.astype(np.int64))], names=["vi", "word", "n", "opens"])


def fitted_rates(documents: DataFrame, labels: DataFrame, sample: int = FIT_SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rates at which words open sentences in at most ``sample`` rated documents (doc_id, text)."""
    rated = labels.where(F.col("reading_level").between(1, LEVELS)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id")).limit(sample)
    texts = documents.join(F.broadcast(rated), "doc_id", "left_semi").select("text")  # at most ``sample`` ids
    seen = texts.mapInArrow(_openings, "vi boolean, word bigint, n bigint, opens bigint").groupBy("vi", "word").agg(F.sum("n").alias("n"), F.sum("opens").alias("opens"))
    rows = seen.where(F.col("n") >= RATED_LEAST).orderBy(F.desc("n"), "word", "vi").limit(RATED_WORDS).toArrow()
    hashes = rows["word"].to_numpy().view(np.uint64)
    vi = np.array(rows["vi"].to_pylist(), bool)
    rate = (rows["opens"].to_numpy() + RARE_RATE) / (rows["n"].to_numpy() + 1)
    keys = np.unique(hashes)
    table = np.full((2, len(keys)), RARE_RATE)
    for row, language in enumerate((True, False)):
        table[row, np.searchsorted(keys, hashes[vi == language])] = rate[vi == language]
    return keys, table[0], table[1]


def text_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rates: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, *COUNTS) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            parts = [count_texts(texts[a:b], rates) for a, b in slices([len(t) for t in texts])]
            counts = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)))
            yield pa.record_batch([batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    schema = "doc_id bigint, " + ", ".join(f"{c} double" for c in COUNTS)
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").mapInArrow(run, schema)


def median(*values: Column) -> Column:
    """The middle of an odd number of estimates."""
    return F.element_at(F.array_sort(F.array(*values)), len(values) // 2 + 1)


def _grade(vi: Column, s: Column) -> Column:
    """The median estimate of a text with sentences of ``s`` words."""
    words = F.col("words")
    letters, sounds, many, long_, long5 = (F.col(c) / words for c in ("letters", "syllables", "polysyllables", "long_words", "long_syllables"))
    # The published coefficients of the first five formulas; LIX and RIX are published as scores, and are
    # brought to the scale of grades by straight lines of our own
    english = median(
        0.39 * s + 11.8 * sounds - 15.59,  # Flesch-Kincaid
        0.4 * (s + 100 * many),  # Gunning fog
        1.043 * F.sqrt(30 * many * s) + 3.1291,  # SMOG
        4.71 * letters + 0.5 * s - 21.43,  # automated readability index
        5.88 * letters - 29.6 / s - 15.8,  # Coleman-Liau
        (s + 100 * long_) / 5 - 2,  # LIX
        2.2 * (long_ * s) + 1.5,  # RIX
    )
    # The published coefficients of Nguyen and Henkin; the other three are English formulas whose constants
    # are ours, as Vietnamese words are syllables of at most seven letters
    vietnamese = median(
        2 * letters + 0.2 * s - 6,  # Nguyen and Henkin, 1982
        0.27 * 100 * long5 + 0.13 * s + 1.74,  # Nguyen and Henkin, 1985, with long syllables for difficult words
        4.71 * letters + 0.5 * s - 14,  # automated readability index
        (s + 100 * long5) / 5 - 2,  # LIX, long being five letters
        2.2 * (long5 * s) + 1.5,  # RIX, likewise
    )
    return F.when(words > 0, F.when(vi, vietnamese).otherwise(english))


def grades(counts: DataFrame) -> DataFrame:
    """Adds language ('vi' or 'en'), punctuated, grade, and guessed: the grade with a guessed length of sentences, where there is no punctuation."""
    words, vi = F.col("words"), F.col("accented") > 0.3 * F.col("words")
    punctuated = words <= UNPUNCTUATED * F.greatest(F.col("sentences") + F.col("pauses"), F.lit(1))
    own = words / F.greatest("sentences", F.lit(1))
    guess = words / F.greatest(F.when(vi, F.col("opens_vi")).otherwise(F.col("opens_en")), F.lit(1.0))
    return counts.select(
        "*",
        F.when(words > 0, F.when(vi, "vi").otherwise("en")).alias("language"),
        punctuated.alias("punctuated"),
        _grade(vi, F.when(punctuated, own).otherwise(F.lit(STANDARD))).alias("grade"),
        _grade(vi, F.when(punctuated, own).otherwise(guess)).alias("guessed"),
    ).dropDuplicates(["doc_id"])


def fit_cuts(sample: list[tuple[float, float]], levels: int = LEVELS) -> list[float]:
    """The cuts between levels with the least sum of absolute errors on (grade, rating), exactly, by dynamic programming."""
    sample = sorted(sample)
    n, inf = len(sample), float("inf")
    cost = [[0.0] * (n + 1) for _ in range(levels)]
    for j in range(levels):
        for i, (_, rating) in enumerate(sample):
            cost[j][i + 1] = cost[j][i] + abs(rating - (j + 1))
    best, back = [cost[0][:]], []
    for j in range(1, levels):
        row, come, low, at = [inf] * (n + 1), [0] * (n + 1), inf, 0
        for i in range(n + 1):
            # a cut may lie only between different grades
            if (i == 0 or i == n or sample[i - 1][0] < sample[i][0]) and best[-1][i] - cost[j][i] < low:
                low, at = best[-1][i] - cost[j][i], i
            row[i], come[i] = low + cost[j][i], at
        best.append(row)
        back.append(come)
    cuts, i = [], n
    for come in reversed(back):
        i = come[i]
        cuts.append(inf if i == n else -inf if i == 0 else (sample[i - 1][0] + sample[i][0]) / 2)
    return cuts[::-1]


def level_of(grade: float, cuts: list[float]) -> int:
    return bisect_left(cuts, grade) + 1


def cost_of(sample: list[tuple[float, float]], cuts: list[float]) -> float:
    return sum(abs(level_of(g, cuts) - r) for g, r in sample)


@dataclass(frozen=True)
class Fit:
    """The cuts of a kind of text, and whether they are cuts of the grade with a guessed length of sentences."""

    cuts: list[float]
    guessed: bool = False


def fitted_cuts(graded: DataFrame, labels: DataFrame, sample: int = FIT_SAMPLE) -> dict[tuple[str, bool] | None, Fit]:
    """Cuts by kind of text (language, punctuated), and under None those of all ratings."""
    rated = labels.where(F.col("reading_level").between(1, LEVELS)).groupBy("doc_id").agg(F.median("reading_level").alias("rating"))
    rows = (
        graded.join(rated, "doc_id")
        .where("grade is not null")
        .select("language", "punctuated", "grade", "guessed", "rating", F.xxhash64("doc_id").alias("h"))
        .orderBy("h")
        .limit(sample)
        .collect()
    )
    by: dict = {None: rows} if rows else {}
    for r in rows:
        by.setdefault((r.language, r.punctuated), []).append(r)
    fits = {}
    for kind, held in by.items():
        if kind is not None and len(held) < FIT_LEAST:
            continue
        plain = [(r.grade, r.rating) for r in held]
        fits[kind] = Fit(fit_cuts(plain))
        if kind is not None and not kind[1]:
            guessed = [(r.guessed, r.rating) for r in held]
            cuts = fit_cuts(guessed)
            if cost_of(guessed, cuts) < cost_of(plain, fits[kind].cuts):
                fits[kind] = Fit(cuts, True)
    return fits or {None: Fit([4.0, 7.0, 10.0, 13.0])}


def reading_levels(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = FIT_SAMPLE) -> DataFrame:
    """(doc_id, language, punctuated, words, sentences, grade, level) of every document."""
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rates = fitted_rates(texts, labels, sample)
    graded = checkpoint(grades(text_counts(texts, rates=rates)).select("doc_id", "language", "punctuated", "words", "sentences", "grade", "guessed"))
    fits = fitted_cuts(graded, labels, sample)

    def cut(fit: Fit) -> Column:
        column = F.col("guessed" if fit.guessed else "grade")
        return F.struct(column.alias("grade"), sum(((column > F.lit(v)).cast("int") for v in fit.cuts), F.lit(1)).alias("level"))

    chosen = cut(fits.get(None) or next(iter(fits.values())))
    for kind, fit in fits.items():
        if kind:
            chosen = F.when((F.col("language") == kind[0]) & (F.col("punctuated") == kind[1]), cut(fit)).otherwise(chosen)
    told = F.col("grade").isNotNull()
    return graded.withColumn("x", chosen).select("doc_id", "language", "punctuated", F.col("words").cast("long").alias("words"), F.col("sentences").cast("long").alias("sentences"), F.when(told, F.col("x.grade")).alias("grade"), F.when(told, F.col("x.level")).alias("level"))
