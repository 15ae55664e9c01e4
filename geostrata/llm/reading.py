"""Reading level of each document's own prose: a linear pairwise ranker with isotonic calibration.

What others wrote (quotes), signatures, markup, code and logs are taken out first. Features of syntax (lengths of
sentences and clauses, how many clauses a sentence stacks, brackets, commas, and the share of each word of the closed
classes: articles, pronouns, relatives, auxiliaries, negations, prepositions, conjunctions and subordinators) and of
vocabulary (lengths, syllables, variety) describe the rest. The ranker is fitted to pairs of graded documents, so that the
harder one scores higher; isotonic regression turns scores into levels, whole school grades.
English features mean little in another language, so posts in one are ranked by a second ranker that knows the length of
sentences alone.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: At most about so many labelled documents fit the ranker, chosen by a hash; all others are only scored.
FIT_DOCUMENTS = 20_000
#: All pairs of graded documents fit the ranker up to so many; of more, so many chosen at random.
PAIRS = 100_000
#: Over the number of labelled documents it is the weight of the ridge: few documents bear few features.
RIDGE = 2.0

_BLOCKS = [
    regex.compile(r"\[(code|pre|img|size|color)\b[^\]\n]*\].*?\[/\1\]", regex.I | regex.S),
    regex.compile(r"<(pre|code|script|style)\b[^>\n]*>.*?</\1>", regex.I | regex.S),
    regex.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", regex.S),
]
_QUOTE_MARK = regex.compile(r"(?P<open>\[quote[^\]\n]*\])|(?P<close>\[/quote\])|(?P<openb><blockquote[^>\n]*>)|(?P<closeb></blockquote>)|(?P<rule>^-{5,}[ \t]*$)", regex.I | regex.M)
_SIGNATURE = regex.compile(r"^(?:--[ \t]*|_{5,}[ \t]*)$|^[ \t]*Sent from my\b", regex.M)
_ATTRIBUTION = regex.compile(r"^[ \t]*On\b[^\n]*\bwrote:[ \t]*$", regex.M)
_QUOTED_LINE = regex.compile(r"^[ \t]*(?:>|&gt;).*$", regex.M)
_TAG = regex.compile(r"</?[A-Za-z][^<>\n]*>|\[/?[A-Za-z*]{1,12}(?:=[^\]\n]*)?\]")
_BREAK = regex.compile(r"<(?:br|p|/p|div|/div|li|/li|h\d|/h\d)\b[^<>\n]*>", regex.I)
_LINK = regex.compile(r"(?:https?://|www\.)\S+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{So}\p{Sk}]")
_GONE = regex.compile(r"^[ \t]*[\[<](?:deleted|removed)\b[^\]>\n]*[\]>][ \t]*$", regex.I | regex.M)
_ODD, _ODD_TOKEN = re.compile(r"[\d=_{}<>|\\/]"), re.compile(r"\S*[\d=_{}<>|\\/]\S*")
_ASCII_WORD = re.compile(r"[a-z]+(?:['\-][a-z]+)*")
_WORD = regex.compile(r"\p{L}+(?:['’\-]\p{L}+)*")
_SENTENCE_END = regex.compile(r"[.!?…]+(?=\s|$)|\n[ \t]*\n")
_CLAUSE_END = regex.compile(r"[.!?…,;:()–—]+|\n[ \t]*\n|\b(?:and|but|or|so)\b", regex.I)
_VOWELS = regex.compile(r"[aeiouyáéíóúàèäöü]+", regex.I)
#: Words of closed classes, each a feature.
_CLOSED = "the of to a in it is that which those whom whose who what than be been were had not nor as if one by from with for on at or but and so because after when where though although unless while however therefore i my me you your we he she they them this there can do".split()
_SUBORDINATE = tuple("which whom whose that those what than nor unless although though whereas whether because since while if as were notwithstanding inasmuch insofar lest".split())
#: Frequent words of other languages that are no words of English.
_OTHER = frozenset("el los las una está más pero muy con por para que del der die das und ist nicht ich ein eine bei mit auch war aber es le les des est une je pas dans pour mais très sur il lo gli che non per sono".split())
#: Frequent words of English, against them.
_ENGLISH = ("the", "and", "to", "of", "that", "it", "was", "my", "with")
#: The first ones need no English words.
PLAIN = ("log_sentence",)
NAMES = (*PLAIN, "log_clause", "clauses", "most_clauses", "nesting", "commas", "semicolons", "letters", "long_words", "syllables", "many_syllables", "short_words", "distinct", "subordination", "and_share", *[f"w_{w}" for w in _CLOSED])


def without_quotes(text: str) -> str:
    """text without quotes in brackets or tags, however deep they nest, by one scan that keeps the marks that are still open.

    A quote that is never closed ends at the next rule of dashes outside of other quotes, or with the text.
    """
    spans, rules = [], []
    open_marks: dict[str, list[int]] = {"quote": [], "blockquote": []}
    for mark in _QUOTE_MARK.finditer(text):
        kind = mark.lastgroup
        if kind == "rule":
            rules.append((mark.start(), mark.end()))
            continue
        held = open_marks["quote" if kind in ("open", "close") else "blockquote"]
        if kind in ("open", "openb"):
            held.append(mark.start())
        elif held:
            spans.append((held.pop(), mark.end()))
    left = sorted(open_marks["quote"] + open_marks["blockquote"])
    if left and rules:
        outside = [r for r in rules if not any(a <= r[0] < b for a, b in _joined(spans))] if spans else rules
        starts = [r[0] for r in outside]
        ends = [outside[k][1] if k < len(outside) else len(text) for k in (bisect_left(starts, at) for at in left)]
    else:
        ends = [len(text)] * len(left)
    kept, at = [], 0
    for begin, end in _joined(spans + list(zip(left, ends, strict=True))):
        kept += [text[at:begin], "\n\n"]
        at = end
    return "".join([*kept, text[at:]])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def own_prose(text: str | None) -> str:
    """The author's own prose of a post: without quotes, signature, markup, code, logs, links and invisible marks."""
    if not text:
        return ""
    text = text.replace("\r\n", "\n").replace("\xa0", " ")
    marked = "[" in text or "<" in text
    if marked or "```" in text or "~~~" in text:
        for pattern in _BLOCKS:
            text = pattern.sub("\n\n", text)
    if marked:
        text = without_quotes(text)
    if "wrote:" in text:
        text = _ATTRIBUTION.sub("", text)
    if ">" in text or "&gt;" in text:
        text = _QUOTED_LINE.sub("", text)
    end = _SIGNATURE.search(text)
    text = text[: end.start()] if end else text
    if marked:
        text = _TAG.sub("", _BREAK.sub("\n", _GONE.sub("", text)))
    if "&" in text:
        text = html.unescape(text).replace("\xa0", " ")
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "://" in text or "www." in text:
        text = _LINK.sub("", text)
    # a line of a log, a table or code is mostly tokens that hold digits or signs
    lines = [line for line in text.replace("*", "").split("\n") if not _ODD.search(line) or len(_ODD_TOKEN.findall(line)) <= 0.4 * len(line.split())]
    return "\n".join(lines)


class _Words(dict):
    """Letters and syllables of each word that has been met."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = len(word), max(1, len(_VOWELS.findall(word)) - (word.endswith("e") and not word.endswith("le")))
        return found


_words = _Words()


def features(text: str | None) -> tuple[int, bool, list[float]]:
    """Words of a post's own prose, whether it seems English, and the values of NAMES."""
    prose = own_prose(text)
    lower = prose.lower()
    words = _ASCII_WORD.findall(lower) if lower.isascii() else _WORD.findall(lower.replace("’", "'"))
    n = len(words)
    if not n:
        return 0, True, [0.0] * len(NAMES)
    counts = Counter(words)
    letters = syllables = long_words = many = short = 0
    for word, times in counts.items():
        length, heard = _words[word]
        letters += length * times
        syllables += heard * times
        long_words += times * (length >= 10)
        short += times * (length <= 3)
        many += times * (heard >= 4)
    clauses = [sum(1 for c in _CLAUSE_END.split(s) if c and _WORD.search(c)) for s in _SENTENCE_END.split(prose)]
    clauses = [c for c in clauses if c] or [1]
    other = sum(counts[w] for w in _OTHER if w in counts)
    plain = sum(counts[w] for w in _ENGLISH if w in counts)
    english = sum(times for word, times in counts.items() if word.isascii()) / n > 0.8 and other <= max(plain, 0.03 * n)
    row = [
        math.log(n / len(clauses)), math.log(n / sum(clauses)), sum(clauses) / len(clauses), math.log(max(clauses)), (prose.count("(") + prose.count("—") + prose.count("–")) / len(clauses), prose.count(",") / n, (prose.count(";") + prose.count(":")) / n,
        letters / n, long_words / n, syllables / n, many / n, short / n, len(counts) / n**0.75,
        sum(counts[w] for w in _SUBORDINATE if w in counts) / n, counts["and"] / n, *(counts[w] / n for w in _CLOSED),
    ]
    return n, bool(english), row


@dataclass(frozen=True)
class Ranker:
    columns: tuple[int, ...]
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        held = np.clip((values[:, self.columns] - self.middle) / self.spread, -6, 6)
        return held @ self.weights

    def grade(self, values: np.ndarray) -> np.ndarray:
        """Levels are whole school grades: the nearest one to the mean grade of a score's block."""
        return np.floor(self.levels[np.searchsorted(self.cuts, self.score(values), "right")] + 0.5)


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, levels) of the non-decreasing step function nearest to the grades; cuts lie midway between blocks."""
    order = np.lexsort((grade, score))
    blocks: list[list[float]] = []  # sum, size, first score, last score
    for s, g in zip(score[order], grade[order], strict=True):
        blocks.append([g, 1, s, s])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    levels = np.array([b[0] / b[1] for b in blocks])
    cuts = np.array([(a[3] + b[2]) / 2 for a, b in zip(blocks[:-1], blocks[1:], strict=True)])
    return cuts, levels


def fit_ranker(values: np.ndarray, grades: np.ndarray, columns: tuple[int, ...], pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 0) -> Ranker:
    """Logistic loss over differences of graded pairs, by Newton steps; the weight of a pair grows with its difference."""
    held = values[:, columns]
    middle, spread = held.mean(0), np.maximum(held.std(0), 1e-9)
    z = np.clip((held - middle) / spread, -6, 6)
    rng = np.random.default_rng(seed)
    n = len(z)
    ridge = ridge / max(n, 1)
    if n * (n - 1) <= 2 * pairs:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = rng.integers(0, n, pairs), rng.integers(0, n, pairs)
    gap = grades[i] - grades[j]
    i, j, gap = i[gap != 0], j[gap != 0], gap[gap != 0]
    step = (z[i] - z[j]) * np.sign(gap)[:, None]
    weight = np.minimum(np.abs(gap), 4.0)
    w = np.zeros(len(columns))
    if len(step):
        total = weight.sum()
        for _ in range(30):
            p = 1 / (1 + np.exp(np.clip(step @ w, -40, 40)))
            gradient = -(step * (weight * p)[:, None]).sum(0) / total + ridge * w
            curve = (step.T * (weight * p * (1 - p))) @ step / total + ridge * np.eye(len(w))
            move = np.linalg.solve(curve, gradient)
            w = w - move
            if np.abs(move).max() < 1e-6:
                break
    score = z @ w
    cuts, levels = isotonic(score, grades.astype(float)) if n else (np.zeros(0), np.array([np.nan]))
    return Ranker(tuple(columns), middle, spread, w, cuts, levels)


_FEATURES = "words int, english boolean, features array<float>"


def _featurise(documents: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = [features(t.as_py()) for t in batch.column(1).slice(begin, 500)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, 500), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], names=["_key", "words", "english", "features"])

    return documents.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"_key long, {_FEATURES}")


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, grade: str, least_words: int = 10) -> tuple[Ranker, Ranker] | None:
    """Rankers for English and for other prose, or None without two documents of different grades.

    A document's grade is the mean of its raters' grades that are not null. At most about FIT_DOCUMENTS are used.
    """
    graded = labels.where(F.col(grade).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_key")).agg(F.avg(grade).alias("_grade"))
    rows = graded.count()
    if rows > FIT_DOCUMENTS:
        graded = graded.where(F.pmod(F.xxhash64(F.lit(3), "_key"), F.lit(1 << 30)) < int((1 << 30) * FIT_DOCUMENTS / rows))
    posts = documents.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_t"))
    held = posts.join(F.broadcast(graded.select("_key")), "_key")
    got = _featurise(held, "_key", "_t").where(F.col("words") >= least_words).join(F.broadcast(graded), "_key").select("features", "_grade").toPandas()
    if got["_grade"].nunique() < 2:
        return None
    values, grades = np.stack(got["features"].to_numpy()).astype(float), got["_grade"].to_numpy(float)
    order = np.lexsort((*values.T[::-1], grades))  # the order that rows arrive in has no say
    values, grades = values[order], grades[order]
    return fit_ranker(values, grades, tuple(range(values.shape[1]))), fit_ranker(values, grades, tuple(range(len(PLAIN))))


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade") -> DataFrame:
    """(key, words, english, score, grade): the difficulty of each document's own prose.

    Every document gives a row; one without a word of own prose (a null, empty, blank or removed text, or nothing but
    quotes and the like) has no score and no grade, nor has any document when there are no labels to learn from. Whole
    texts are read. Repeated keys each give their row. Other columns take no part.
    """
    rankers = fit(documents, labels, key, text, grade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = [features(t.as_py()) for t in batch.column(1).slice(begin, 500)]
                words, english = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], bool)
                score, level = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
                if rankers and len(rows):
                    values = np.array([r[2] for r in rows])
                    for ranker, mine in zip(rankers, (english, ~english), strict=True):
                        mine = mine & (words > 0)
                        if mine.any():
                            score[mine], level[mine] = ranker.score(values[mine]), ranker.grade(values[mine])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, 500), pa.array(words), pa.array(english), pa.array(score, mask=np.isnan(score)), pa.array(level, mask=np.isnan(level))], names=[key, "words", "english", "score", "grade"])

    return spread(documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))).mapInArrow(run, f"{key} long, words int, english boolean, score double, grade double")
