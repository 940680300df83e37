"""Reading level of English prose: a linear pairwise ranker over syntax and vocabulary, calibrated by isotonic regression."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.llm.words import INVISIBLE

MIN_WORDS = 30
MOSTLY = 0.5
#: At most so many graded texts are taken for training (those with the lowest ids); all texts are scored.
MAX_GRADED = 20_000
#: The ranker learns from all pairs of texts of different levels, or from so many of them drawn evenly where there are more.
MAX_PAIRS = 200_000
#: A word is a feature when so many graded texts have it.
MIN_TEXTS = 3

# Frequent words of the languages told apart, chosen by hand.
_STOP = {
    "en": "the a an this that these those each every any our your my its his her their some such one and or but nor so of in on at by to for with from into over under after before during without within between is are was were be been being has have had does do did will would can could may might must shall should not no if when while whereas because although unless until which who whose what where there here it we you they he she i as than then also only both either neither all most more many few other another same",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war wird werden wurde wurden hat haben kann muss soll mit von zu zum zur im am auf aus bei nach vor wenn weil dass ob als wie auch noch nur durch für über unter zwischen jede jeder jedes diese dieser dieses kein keine sich es wir sie er sobald zuerst",
    "es": "el la los las un una unos unas y o pero no es son era fue será está están ha han puede debe con de del al en por para sin sobre entre cuando porque que si como también solo cada este esta estos estas ese esa su sus se lo nos hay más antes después desde hasta",
    "fr": "le la les un une des du de et ou mais ne pas est sont était sera a ont peut doit avec dans en par pour sans sur entre quand parce que qui si comme aussi chaque ce cet cette ces son sa ses se il elle on nous vous ils au aux dès plus avant après depuis jusqu lors",
}
_STOP = {k: frozenset(v.split()) for k, v in _STOP.items()}
_OTHERS = (_STOP["de"] | _STOP["es"] | _STOP["fr"]) - _STOP["en"]

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1|\Z)")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--.*?-->", re.DOTALL)
_BLOCK = re.compile(r"</?(?:p|li|ul|ol|div|br|h[1-6]|tr|table|blockquote)\b[^<>]*>", re.IGNORECASE)
_PRE = re.compile(r"(?is)<(pre|script|style)\b.*?</\1>")
_CODE = re.compile(
    r"[{};]\s*$|^\s*[})\]]|[^\w\s]\s*=>|\w\s*(?:[-+*/|&]?=|:=|==|!=|->|::)\s*[\w\"'(\[{&*-]|\w\([^()]*\)\s*[:;{]|\w+\.\w+\([^)]*\)\s*;?\s*$|\w\(.*\)\s*;?\s*$"
    r"|^\s*(?:import|from|using|package|#include|use|return|def|class|func|fn|pub|public|private|static|const|let|var|function|export|elif|else|try|except|raise|yield|async|await|for|while|if|switch|case)\b[^.?!]*[;:{(<>=\"]"
    r"|^\s*(?:return|import|from \S+ import|use|using|package)\b\s+[\w.:{}, /\"'*]+;?\s*$"
)
_COMMENT = re.compile(r"^\s*(?://|/\*|\*/|--\s|\"\"\"|'''|%%)")
_LOG = re.compile(r"^\s*[\[(]?(?:\d{4}-\d\d-\d\d|\d\d:\d\d(?::\d\d)?)|\b(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b|^\s*at [\w.$<>]+\(")
_MARK = re.compile(r"^\s*(?:>+\s?|[-*+•‣·]\s+|#{1,6}\s+|\d+[.)]\s+)+")
_HEADING = re.compile(r"#{1,6}\s")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CAMEL = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Z][a-z]+[A-Z]")


def prose(text: str) -> tuple[str, int]:
    """(prose of the text, words outside it). Each list item is a sentence.

    Fenced blocks, lines of code, comments, logs and tables are outside, headings on neither side; markup and list marks are dropped, and lines
    that were wrapped flow together.
    """
    outside = 0
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _PRE.sub("\n\n", t)
        t = _TAG.sub(" ", _BLOCK.sub("\n\n", t))
    if not t.isascii():
        t = INVISIBLE.sub("", t)
    if "```" in t or "~~~" in t:
        cut = _FENCE.sub("\n\n", t)
        outside += (len(t) - len(cut)) // 7
        t = cut
    kept: list[str] = []
    for line in t.splitlines():
        if not line or line.isspace():
            kept.append(" . ")
            continue
        line = line.strip()
        if "\t" in line or line.count("|") >= 2 or line[0] in "/*'\"%-" and _COMMENT.match(line) or _LOG.search(line, 0, 60) or line[-1] not in ".?!" and _CODE.search(line):
            outside += max(1, line.count(" ") + 1)
            kept.append(" . ")
            continue
        if line[0] == "#" and line.count(" ") <= 6 and line[-1] not in ".?!" and _HEADING.match(line):
            kept.append(" . ")
            continue
        m = None if line[0].isalpha() else _MARK.match(line)
        if m:
            kept.append(" . ")
            line = line[m.end() :]
        kept.append(line)
    return " ".join(kept), outside


class Tokens:
    """What each token of a text stands for; tokens are numbered once and then only looked up."""

    LIMIT = 300_000
    FIELDS = 8
    WORD, ENGLISH, OTHER, END, COMMA, LETTERS, LONG, FOREIGN = range(8)

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.feature: list[int] = []

    def number(self, token: str) -> int:
        at = self.known.get(token)
        if at is None:
            at = self.known[token] = len(self.rows)
            row, feature = self.read(token)
            self.rows.append(row)
            self.feature.append(feature)
        return at

    def read(self, token: str) -> tuple[tuple, int]:
        core = token.strip("\"'“”‘’`*_()[]{}<>.,;:!?…—–-")
        end = token.rstrip("\"'”’`*_)]}>").endswith((".", "!", "?", "…", "。"))
        comma = token.rstrip("\"'”’`*_)]}>").endswith((",", ";", ":", "—"))
        if not core:
            return (0, 0, 0, end, comma, 0, 0, 0), -1
        if not _WORD.fullmatch(core) or _CAMEL.search(core):
            return (0, 0, 0, end, comma, 0, 0, not core.isascii()), -1
        w = core.lower().replace("’", "'")
        return (1, w in _STOP["en"], w in _OTHERS, end, comma, len(w), len(w) >= 8, not w.isascii()), self.vocabulary.get(w, -1)


SYNTAX = ("sentence words", "commas", "letters", "long words", "English words")


def features(tokens: Tokens, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, syntax, sums): the text and the feature of each token that is one, then syntax and sums of Tokens' fields, one row a text."""
    if len(tokens.known) > Tokens.LIMIT:
        tokens.clear()
    get, number = tokens.known.get, tokens.number
    ids: list[int] = []
    sizes = []
    for t in texts:
        parts = t.split()
        parts.append(".")  # so that no text is without a token
        ids += [x if (x := get(p)) is not None else number(p) for p in parts]
        sizes.append(len(parts))
    at = np.array(ids, np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    info = np.array(tokens.rows, np.float32)[at]
    # a sentence ends where words have come since the last end
    is_end = info[:, Tokens.END] > 0
    words_before = np.cumsum(info[:, Tokens.WORD], dtype=np.float64)
    ends = np.flatnonzero(is_end)
    real = np.zeros(len(at), np.float32)
    if len(ends):
        since = np.diff(words_before[ends], prepend=0)
        real[ends[since > 0]] = 1
    info[:, Tokens.END] = real
    sums = np.add.reduceat(info, begin, axis=0).astype(np.float64)
    n = np.maximum(sums[:, Tokens.WORD], 1)
    sentences = np.maximum(sums[:, Tokens.END], 1)
    word = np.array(tokens.feature, np.int64)[at]
    has = word >= 0
    syntax = np.column_stack((np.log(n / sentences), sums[:, Tokens.COMMA] / sentences, sums[:, Tokens.LETTERS] / n, sums[:, Tokens.LONG] / n, sums[:, Tokens.ENGLISH] / n))
    return np.repeat(np.arange(len(texts)), sizes)[has], word[has], syntax, sums


def is_english_prose(sums: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """At least 30 words of prose, more of them than words outside it, and English by its frequent words."""
    n = sums[:, Tokens.WORD]
    english, other = sums[:, Tokens.ENGLISH], sums[:, Tokens.OTHER]
    return (n >= MIN_WORDS) & (n > MOSTLY * (n + outside)) & (english >= 0.15 * n) & (english > 2 * other) & (sums[:, Tokens.FOREIGN] < 0.3 * n)


class Design:
    """The texts' features, standardised: word rates, of which only those above zero are held, and syntax."""

    def __init__(self, row: np.ndarray, word: np.ndarray, syntax: np.ndarray, sums: np.ndarray, n_words: int) -> None:
        self.n, self.n_words, self.syntax = len(syntax), n_words, syntax
        cell, times = np.unique(row * max(1, n_words) + word, return_counts=True)
        self.row, self.word = np.divmod(cell, max(1, n_words))
        self.rate = times / np.maximum(sums[self.row, Tokens.WORD], 1)
        mean = np.bincount(self.word, self.rate, n_words) / self.n
        spread = np.sqrt(np.maximum(np.bincount(self.word, self.rate**2, n_words) / self.n - mean**2, 0)) + 1e-9
        self.mean = np.concatenate((mean, syntax.mean(axis=0)))
        # many words, each a small part
        self.scale = np.concatenate((spread * np.sqrt(max(1, n_words)) / 6, syntax.std(axis=0) + 1e-9))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        w = weights / self.scale
        return np.bincount(self.row, self.rate * w[self.word], self.n) + self.syntax @ w[self.n_words :] - self.mean @ w

    def pulled(self, pull: np.ndarray) -> np.ndarray:
        """The transposed features times ``pull``."""
        return (np.concatenate((np.bincount(self.word, self.rate * pull[self.row], self.n_words), self.syntax.T @ pull)) - self.mean * pull.sum()) / self.scale


def level_pairs(level: np.ndarray, among: np.ndarray, max_pairs: int, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(higher, lower): the texts of ``among`` in pairs of different levels; all pairs, or ``max_pairs`` drawn evenly."""
    by = [among[level[among] == k] for k in np.unique(level[among])]
    blocks = [(by[a], by[b]) for a in range(len(by)) for b in range(a)]
    sizes = np.array([len(x) * len(y) for x, y in blocks], np.int64)
    if sizes.sum() <= max_pairs:
        return np.concatenate([np.repeat(x, len(y)) for x, y in blocks]), np.concatenate([np.tile(y, len(x)) for x, y in blocks])
    take = rnd.multinomial(max_pairs, sizes / sizes.sum())
    return np.concatenate([rnd.choice(x, k) for (x, _), k in zip(blocks, take)]), np.concatenate([rnd.choice(y, k) for (_, y), k in zip(blocks, take)])


def fit_ranker(x: Design, level: np.ndarray, among: np.ndarray, penalty: float = 1.0, steps: int = 300, max_pairs: int = MAX_PAIRS) -> np.ndarray:
    """Weights of scores that put the higher of two levels above, by logistic loss over pairs of the texts ``among``."""
    i, j = level_pairs(level, among, max_pairs, np.random.default_rng(1))
    gap = (level[i] - level[j]).astype(float)
    share = gap / gap.sum()
    w, m, v = (np.zeros(len(x.mean)) for _ in range(3))
    for t in range(1, steps + 1):
        s = x.scores(w)
        c = share / (1 + np.exp(np.clip(s[i] - s[j], -30, 30)))
        pull = np.bincount(i, c, x.n) - np.bincount(j, c, x.n)
        g = -x.pulled(pull) + penalty * 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: (scores, fitted levels) to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for k in order:
        blocks.append([float(level[k]), 1.0, float(score[k]), float(score[k])])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2], b[3]])
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.array([v for b in blocks for v in (b[0], b[0])])


class ReadingModel:
    """Trained on graded texts; immutable, of one number a word of its vocabulary, so it goes to every task."""

    def __init__(self, texts: list[str], levels: list[int], folds: int = 5) -> None:
        plain = [prose(t)[0] for t in texts]
        level = np.array(levels, np.int64)
        first = Tokens({})
        features(first, plain)
        seen: dict[str, int] = {}
        for t in plain:
            for w in {p.strip("\"'“”‘’`*_()[]{}<>.,;:!?…—–-").lower().replace("’", "'") for p in t.split() if first.rows[first.known[p]][Tokens.WORD]}:
                seen[w] = seen.get(w, 0) + 1
        self.vocabulary = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= MIN_TEXTS))}
        x = Design(*features(Tokens(self.vocabulary), plain), len(self.vocabulary))
        self.low, self.high = int(level.min()), int(level.max())
        # calibrated on scores of texts that the ranker hasn't seen
        held = np.zeros(len(level))
        fold = np.random.default_rng(0).permutation(len(level)) % folds
        for f in range(folds):
            known = np.flatnonzero(fold != f)
            if len(np.unique(level[known])) > 1:
                held[fold == f] = x.scores(fit_ranker(x, level, known))[fold == f]
        w = fit_ranker(x, level, np.arange(len(level))) / x.scale
        self.word_weights, self.syntax_weights, self.shift = np.append(w[: x.n_words], 0.0), w[x.n_words :], float(x.mean @ w)
        self.steps = [(k, *isotonic(held, (level >= k).astype(float))) for k in range(self.low + 1, self.high + 1)]
        self.held_out = float(np.mean(self.grade(held) == level))

    def grade(self, score: np.ndarray) -> np.ndarray:
        """The lowest level, and one more for each level that the score reaches rather than not."""
        return self.low + sum((np.interp(score, xs, share) >= 0.5).astype(np.int64) for _, xs, share in self.steps)

    def levels(self, row: np.ndarray, word: np.ndarray, syntax: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The level of each text of :func:`features`."""
        return self.grade(np.bincount(row, self.word_weights[word], len(syntax)) / np.maximum(sums[:, Tokens.WORD], 1) + syntax @ self.syntax_weights - self.shift)


def train(graded: DataFrame, max_graded: int = MAX_GRADED) -> ReadingModel:
    """The model of the graded texts; rows without a text or level are left out."""
    rows = graded.where("text is not null and reading_level is not null").orderBy("text_id", "text").limit(max_graded).select("text", "reading_level").collect()
    if len({r[1] for r in rows}) < 2:
        raise ValueError("graded texts of at least two levels are needed")
    return ReadingModel([r[0] for r in rows], [int(r[1]) for r in rows])


def reading_levels(documents: DataFrame, model: ReadingModel) -> DataFrame:
    """(doc_id, reading_level): one row per document whose text is mostly English prose of at least 30 words.

    Null, empty and other texts have no row; repeated rows are graded each. Nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tokens = Tokens(m.vocabulary)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                split = [prose(t) if t else ("", 0) for t in part.column(1).to_pylist()]
                found = features(tokens, [p for p, _ in split])
                ok = is_english_prose(found[-1], np.array([o for _, o in split], float))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), pa.array(m.levels(*found)[ok].astype(np.int32))], ["doc_id", "reading_level"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, reading_level int")
