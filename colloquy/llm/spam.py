"""Keyword-stuffed and link-list pages: a hidden Markov model over the lines of a text."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship
from .shared import spread

STATES = ("prose", "links", "tags", "menu")

#: Function words of the languages of the corpus: sentences have them, lists do not.
FUNCTION_WORDS = frozenset(
    """a about after all although an and are as at be because been before between but by can could do does for from had has have
    he her his how i if in into is it its just me my no not of off on once only or our over she so some than that the their them
    then there they this though to too toward two under unless until up was we were what when where whether which while who will
    with without would yet you your
    al como con cuando de del el en es esta la las le lo los más mi muy nadie no nos o para pero por que qué queríamos se según si
    sin sobre su sus tan tanto todavía un una y ya
    alors au aux avant avec bien ce ces cette d dans des du elle en est et il ils je l la le les leur mais ne notre nous on ou où
    par pas pour qu que qui sa sans se ses si son sur trop un une vous à été
    aber als am an auch auf aus bei bis das dass dem den der des deshalb die doch durch ein eine einen einer eines er es für hat
    ich ihr im in ist jedoch kein mein mit nach nicht noch nun nur ob oder ohne sehr sich sie sind so über um und uns unser von vor
    war was wäre weil wenn wer weshalb wie wir wird zu zum zur während
    m re s t ve ll""".split()
)
#: Words of navigation bars.
MENU_WORDS = frozenset(
    "about account archive archives back cart categories category contact cookie cookies faq home imprint legal login logout menu more "
    "next newsletter page popular posts previous privacy read recent related rss search share shop sign sitemap subscribe terms top "
    "also like may you view all skip content newer older first last".split()
)
URL = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]|]+|</?a\b[^>]*>|\]\(", re.I)
WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
SEPARATOR = re.compile(r"\s[|>/·•–—-]\s|\s{2,}|[,;|»·•]\s*|\s/\s|(?=#\w)")
SENTENCE = re.compile(r"(?<=[.!?])[\"'’”)]*\s+(?=\S)")
#: Signs of a record: braces, quotes, colons, tabs, equals.
MARK = re.compile(r"[{}\[\]\":=\t]")
#: A spoken line: a name, a colon, a sentence.
SPOKEN = re.compile(r"^[^\W\d_][\w .'’-]{0,30}:\s.*[.!?…]\W*$")
HASHTAG = re.compile(r"#\w")
BULLET = re.compile(r"^\s*(?:[*•-]|\d+[.)])\s+")

#: What is believed of P(bin | state) before any text is seen, per state prose, links, tags, menu; ``fit`` counts it as lines of each state.
BELIEF = {
    "link": [[0.96, 0.03, 0.01], [0.06, 0.24, 0.70], [0.94, 0.05, 0.01], [0.94, 0.05, 0.01]],
    "function": [[0.06, 0.12, 0.82], [0.80, 0.15, 0.05], [0.65, 0.18, 0.17], [0.70, 0.18, 0.12]],
    "menu": [[0.98, 0.015, 0.005], [0.90, 0.08, 0.02], [0.95, 0.04, 0.01], [0.10, 0.25, 0.65]],
    "list": [[0.90, 0.08, 0.02], [0.50, 0.25, 0.25], [0.25, 0.25, 0.50], [0.40, 0.25, 0.35]],
    "stuffed": [[0.985, 0.012, 0.003], [0.90, 0.07, 0.03], [0.25, 0.30, 0.45], [0.80, 0.15, 0.05]],
    "figures": [[0.60, 0.25, 0.15], [0.90, 0.08, 0.02], [0.97, 0.02, 0.01], [0.95, 0.04, 0.01]],
    "marks": [[0.80, 0.12, 0.08], [0.97, 0.02, 0.01], [0.985, 0.01, 0.005], [0.985, 0.01, 0.005]],
    "sentence": [[0.35, 0.65], [0.95, 0.05], [0.75, 0.25], [0.97, 0.03]],
}
STAY = 0.85
START = (0.7, 0.1, 0.1, 0.1)
#: Rounds of the fit, and the lines that the beliefs count for at least.  They count for as many as the corpus has: a fixed
#: number would wear away as a corpus grows, and the states would come to mean whatever tells most of its lines apart.
FIT_ROUNDS = 12
PRIOR = 20_000.0
#: Every combination of bins has a code, its place here.
SHAPE = tuple(len(t[0]) for t in BELIEF.values())
BINS = list(np.ndindex(*SHAPE))
CODE = {b: n for n, b in enumerate(BINS)}
#: Longer pages are cut into spans of so many lines, which are counted side by side; and lines counted at once.
SPAN = 256
GROUP_LINES = 200_000


@dataclass(frozen=True, eq=False)
class Model:
    """Log-probabilities of a hidden Markov model over lines: first state, next state, and bin of each feature by state."""

    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]

    def table(self, bins: np.ndarray) -> np.ndarray:
        """log P(line | state) of lines given by their bins."""
        return sum(e[:, b].T for e, b in zip(self.emit, bins.T))

    @classmethod
    def believed(cls) -> Model:
        move = np.full((4, 4), (1 - STAY) / 3)
        np.fill_diagonal(move, STAY)
        return cls(np.log(START), np.log(move), tuple(np.log(np.array(t)) for t in BELIEF.values()))


class Expected:
    """What a model expects of the pages added: how often each state comes first, follows each state and shows each code.

    All are sums over pages, so those of parts of a corpus add up to those of the whole.
    """

    def __init__(self, model: Model):
        self.start, self.move, self.show = np.exp(model.start), np.exp(model.move), np.exp(model.table(np.array(BINS)))
        self.first, self.moves, self.seen = np.zeros(4), np.zeros((4, 4)), np.zeros((len(BINS), 4))

    def add(self, codes: np.ndarray, size: np.ndarray, times: np.ndarray) -> None:
        """codes: those of the lines of all pages, one page after the other; the lines of each page; how often it occurs.

        A page of more than SPAN lines is cut.  The product of the steps through a span tells what is known before it from
        what is known before the span ahead of it, and likewise backwards, so its counts are those of the uncut page.
        """
        spans = -(-size // SPAN)
        page = np.repeat(np.arange(len(size)), spans)
        nth = np.arange(len(page)) - np.repeat(np.cumsum(spans) - spans, spans)
        at, n = (np.cumsum(size) - size)[page] + nth * SPAN, np.minimum(SPAN, size[page] - nth * SPAN)
        before, after = np.zeros((len(page), 4)), np.ones((len(page), 4))
        order = np.argsort(-n, kind="stable")
        cut = spans[page] > 1
        if cut.any():
            through = {}
            for g in _groups(order[cut[order]], n):
                through.update(zip(g.tolist(), self._through(codes, at[g], n[g])))
            whole = np.flatnonzero(cut).tolist()
            enter = self.start
            for i in whole:
                if nth[i]:
                    before[i] = enter @ through[i - 1]
                    before[i] /= before[i].sum()
                enter = before[i] @ self.move if nth[i] else self.start
            for i in reversed(whole):
                if nth[i] + 1 < spans[page[i]]:
                    after[i] = self.move @ (through[i + 1] @ after[i + 1])
                    after[i] /= after[i].sum()
        for g in _groups(order, n):
            self._count(codes, at[g], n[g], before[g], after[g], nth[g] > 0, times[page[g]])

    def _through(self, codes, at, n):
        """P(last state and the lines | first state) of spans, the longest first, up to a factor of each span."""
        p = self.show[codes[at]][:, :, None] * np.eye(4)
        for t, live in enumerate(_live(n)):
            if t:
                q = (p[:live] @ self.move) * self.show[codes[at[:live] + t]][:, None, :]
                p[:live] = q / q.sum(axis=(1, 2), keepdims=True)
        return p

    def _count(self, codes, at, n, before, after, follows, times):
        """Forward and backward over spans side by side, the longest first: step t concerns the first live[t] of them."""
        live = _live(n)
        step = [codes[at[:k] + t] for t, k in enumerate(live)]
        forward, scale = [], []
        for t, x in enumerate(step):
            f = (forward[-1][: len(x)] @ self.move if t else np.where(follows[:, None], before @ self.move, self.start)) * self.show[x]
            scale.append(f.sum(axis=1, keepdims=True))
            forward.append(f / scale[-1])
        back, states = np.zeros((0, 4)), []
        for t in range(len(live) - 1, -1, -1):
            ends = slice(len(back), live[t])  # spans whose last line this is; a page counts as often as it occurs
            last = after[ends] * (times[ends] / (forward[t][ends] * after[ends]).sum(axis=1))[:, None]
            back = np.concatenate([back, last])
            states.append(forward[t] * back)
            into = back * self.show[step[t]] / scale[t]
            self.moves += self.move * ((forward[t - 1][: live[t]] if t else before).T @ into)
            back = into @ self.move.T
        self.first += states[-1][~follows].sum(axis=0)
        where, states = np.concatenate(step[::-1]), np.concatenate(states)
        for k in range(4):
            self.seen[:, k] += np.bincount(where, states[:, k], len(BINS))

    def total(self) -> np.ndarray:
        """First states, moves, and bins of each feature by state, one after the other."""
        seen = self.seen.T.reshape(4, *SHAPE)
        by = [seen.sum(axis=tuple(a + 1 for a in range(len(SHAPE)) if a != f)) for f in range(len(SHAPE))]
        return np.concatenate([self.first, self.moves.ravel(), *(c.ravel() for c in by)])


def _live(n: np.ndarray) -> list[int]:
    """For each step the number of those that have it, sizes falling."""
    return (len(n) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")).tolist()


def _groups(order: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Runs of about GROUP_LINES lines."""
    return [g for g in np.split(order, np.flatnonzero(np.diff(np.cumsum(n[order]) // GROUP_LINES)) + 1) if len(g)]


def _learnt(total: np.ndarray, prior: float | None) -> Model:
    """The model of what was expected (``Expected.total``), smoothed by the beliefs."""
    belief, places = Model.believed(), np.cumsum([4, 16] + [4 * n for n in SHAPE])
    first, moves, *emit = np.split(total, places[:-1])
    prior = max(PRIOR, emit[0].sum()) if prior is None else prior

    def smooth(seen, believed):
        c = seen.reshape(believed.shape) + prior * np.exp(believed)
        return np.log(c / c.sum(axis=-1, keepdims=True))

    return Model(smooth(first, belief.start), smooth(moves, belief.move), tuple(map(smooth, emit, belief.emit)))


def fit(pages: list[np.ndarray], rounds: int = FIT_ROUNDS, prior: float | None = None) -> Model:
    """The model that explains the lines of the pages best (Baum-Welch), starting from and smoothed by the beliefs.

    pages: the bins of each page's lines, one row per line.  No page needs a label: the beliefs name the states, the
    lines and their neighbours decide how often each state shows each feature and what follows it.
    prior: the lines that the beliefs count for; None for as many as the pages have, PRIOR at least.
    """
    model = Model.believed()
    pages = [np.ravel_multi_index(np.asarray(p).T, SHAPE) for p in pages if len(p)]
    for _ in range(rounds if pages else 0):
        expected = Expected(model)
        expected.add(np.concatenate(pages), np.array([len(p) for p in pages]), np.ones(len(pages)))
        model = _learnt(expected.total(), prior)
    return model


def lines_of(text: str) -> list[str]:
    """Lines; a line of running text is cut into its sentences."""
    out = []
    for line in text.splitlines():
        if line.strip():
            out += [s for s in SENTENCE.split(line) if s.strip()]
    return out


def stuffed_words(words: list[str]) -> frozenset[str]:
    """Content words that make up an unusual share of a text.

    A word of a sentence may recur often in a long text; a stuffed keyword fills a twentieth of it.
    """
    bar = max(4, 0.05 * len(words))
    return frozenset(w for w, n in Counter(words).items() if n >= bar and w not in FUNCTION_WORDS and not CJK.search(w))


@dataclass(frozen=True, slots=True)
class Line:
    """A line, its lower-cased words outside links, the length of its links, and its words with those of the links."""

    text: str
    words: list[str]
    links: int
    size: int

    @classmethod
    def of(cls, text: str) -> Line:
        low = text.lower()
        if "http" in low or "www." in low or "<" in low or "](" in low:
            found = URL.findall(low)
            words = WORD.findall(URL.sub(" ", low))
            return cls(text, words, sum(map(len, found)), len(WORD.findall(low)))
        words = WORD.findall(low)
        return cls(text, words, 0, len(words))


def features(line: Line, hot: frozenset[str]) -> tuple[int, ...]:
    text, words = line.text, line.words
    n = len(words)
    link = 0 if not line.links else (2 if line.links / max(1, len(text.strip())) >= 0.35 or n <= 6 else 1)
    cjk = not text.isascii() and CJK.search(text)
    share = 1.0 if cjk else sum(map(FUNCTION_WORDS.__contains__, words)) / n if n else 0.0
    function = 0 if share < 0.06 else 1 if share < 0.16 else 2
    menu_share = sum(map(MENU_WORDS.__contains__, words)) / n if n else 0.0
    menu = 0 if menu_share < 0.2 else 1 if menu_share < 0.4 and "»" not in text else 2
    numbers = sum(map(str.isdigit, words))
    figures = 0 if not numbers else 1 if numbers < 0.25 * n else 2
    signs = 0 if line.links else len(MARK.findall(text))
    marks = 2 if signs >= 0.5 * max(1, n) or SPOKEN.match(text) else 1 if signs >= 0.1 * n and signs > 1 else 0
    stuffed = listed = 0
    if figures < 2 and marks < 2:  # what a table, a record or a log repeats from line to line is no stuffing
        items = [i for i in SEPARATOR.split(BULLET.sub("", text)) if i and not i.isspace()]
        if len(items) >= 3 and sum(len(i.split()) <= 4 for i in items) >= 0.6 * len(items):
            listed = 2 if len(items) >= 6 or HASHTAG.search(text) else 1
        if n >= 3 and hot:
            inside = [w for w in words if w in hot]
            if len(inside) >= 0.3 * n:
                stuffed = 2 if len(inside) - len(set(inside)) >= 2 else 1
    sentence = int(n >= 5 and text.rstrip().rstrip("\"'’”)")[-1:] in ".!?。！？")
    return link, function, menu, listed, stuffed, figures, marks, sentence


def _bins(text: str) -> tuple[list[tuple[int, ...]], list[int]]:
    """The bins and the words of every line; a link counts by its own words."""
    lines = [Line.of(x) for x in lines_of(text)]
    hot = stuffed_words([w for x in lines for w in x.words])
    return [features(x, hot) for x in lines], [max(1, x.size) for x in lines]


class Labeller:
    """Viterbi labels under a model; the bins of a line are few, so their probabilities are kept."""

    def __init__(self, model: Model, chained: bool = True):
        self.model, self.known = model, {}
        self.start, self.move = (model.start.tolist(), model.move.T.tolist()) if chained else ([0.0] * 4, [[0.0] * 4] * 4)

    def emission(self, bins: tuple[int, ...]) -> list[float]:
        if bins not in self.known:
            self.known[bins] = self.model.table(np.array([bins]))[0].tolist()
        return self.known[bins]

    def labels(self, bins: list[tuple[int, ...]]) -> list[int]:
        """The most probable states of the lines together."""
        if not bins:
            return []
        score, back = [a + b for a, b in zip(self.start, self.emission(bins[0]))], []
        for x in bins[1:]:
            e, new, step = self.emission(x), [], []
            for k, into in enumerate(self.move):
                ways = [score[j] + into[j] for j in range(4)]
                best = ways.index(max(ways))
                step.append(best)
                new.append(ways[best] + e[k])
            back.append(step)
            score = new
        path = [score.index(max(score))]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def share(self, text: str | None) -> float:
        """Share of a text's words on lines that are no prose."""
        if not text or text.isspace():
            return 0.0
        bins, weight = _bins(text)
        return sum(n for n, s in zip(weight, self.labels(bins)) if s) / sum(weight)


def _coded(batches):
    """The codes of each text's lines, two bytes each, and their words, four bytes each."""
    for batch in batches:
        codes, words = [], []
        for text in batch.column("text").to_pylist():
            bins, size = _bins(text) if text and not text.isspace() else ([], [])
            codes.append(np.array([CODE[b] for b in bins], "<u2").tobytes())
            words.append(np.array(size, "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.binary()), pa.array(words, pa.binary())], ["doc_id", "codes", "words"])


def _expecting(model: Model):
    def expect(batches):
        expected = Expected(model)
        for batch in batches:
            pages = Counter(batch.column("codes").to_pylist())
            pages.pop(b"", None)
            if pages:
                expected.add(np.frombuffer(b"".join(pages), "<u2"), np.array([len(p) // 2 for p in pages]), np.array([*pages.values()], float))
        yield pa.RecordBatch.from_arrays([pa.array([expected.total().tolist()], pa.list_(pa.float64()))], ["total"])

    return expect


def _sharing(model: Model):
    def share(batches):
        labeller = Labeller(model)
        for batch in batches:
            off, shares = {b"": np.zeros(0, bool)}, []
            for codes, words in zip(batch.column("codes").to_pylist(), batch.column("words").to_pylist()):
                if codes not in off:
                    off[codes] = np.array(labeller.labels([BINS[c] for c in np.frombuffer(codes, "<u2").tolist()])) > 0
                size = np.frombuffer(words, "<u4")
                shares.append(float(size[off[codes]].sum() / max(1, size.sum())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shares, pa.float64())], ["doc_id", "share"])

    return share


def _lines(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    ship(documents.sparkSession)
    docs = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return spread(docs).mapInArrow(_coded, "doc_id long, codes binary, words binary")


def _fitted(lines: DataFrame) -> Model:
    model = Model.believed()
    for _ in range(FIT_ROUNDS):
        parts = [r["total"] for r in lines.select("codes").mapInArrow(_expecting(model), "total array<double>").collect()]
        if not parts:
            break
        model = _learnt(np.array([math.fsum(x) for x in zip(*parts)]), None)  # exact sums, whatever part comes first
    return model


def fitted(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model of a corpus, fitted on every line of every page.

    The codes of the lines are a table in the shared folder, made once.  Each round of the fit passes over it, and each
    task hands a hundred sums to the driver.  Null ids are left out; a row delivered twice counts twice.
    """
    scratch = Scratch(documents.sparkSession, "spam")
    lines = scratch.save(_lines(documents, doc_id, text), "lines")
    model = _fitted(lines)
    scratch.drop(lines)
    return model


def page_shares(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id`` and ``share``: of each text, the share of words on link, tag and menu lines.

    The model is fitted on the same corpus, all of it (``fitted``), unless given.  Texts are read once, whole and without a
    shuffle; the fit and the labels read the codes of their lines, a table in the shared folder.  Defined cases: a
    null, empty or blank text has share 0; null ids are left out; other columns
    are ignored; a row delivered twice gives two equal rows.
    """
    lines = _lines(documents, doc_id, text)
    if model is None:
        lines = Scratch(documents.sparkSession, "spam").save(lines, "lines")
        model = _fitted(lines)
    return lines.mapInArrow(_sharing(model), "doc_id long, share double")


def spam_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", above: float = 0.5, model: Model | None = None) -> DataFrame:
    """The ids of texts with more than ``above`` non-prose words, once each."""
    return page_shares(documents, doc_id, text, model).filter(F.col("share") > above).select("doc_id").distinct()
