"""Template residue and error-page text: positive-unlabelled naive Bayes by expectation-maximization.

A bounded sample of documents is cut into passages (lines and sentences). Passages that begin with a trusted phrase of
an error page, a notice, filler or a placeholder are labelled; all others are unlabelled, and expectation-maximization
decides between them what share each word has in residue and in content. Every passage of every document is then scored
with these words: as a whole, and by its best stretch of neighbouring words, since residue is also spliced into sentences.
Words inside quotation marks count as quoted words of their own, so text that only quotes or discusses residue scores as
content. A document is a case when one of its passages is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.session import durable
from auditloom.functions.text import column

# How passages of error pages, notices, filler and unfilled templates begin, in lower case.
TRUSTED = (
    # errors
    "error:", "internal server error", "http 4", "http 5", "400 bad", "401 ", "403 forbidden", "404 not", "404 –", "404 -",
    "500 internal", "502 bad", "503 service", "504 gateway", "bad gateway", "gateway time", "service unavailable",
    "service temporarily unavailable", "something went wrong", "an error occurred", "an unexpected error", "traceback (most recent",
    "warning: include", "fatal error", "keyerror", "nullreference", "typeerror", "error loading", "failed to load", "failed to open",
    "this service is temporarily", "this service is undergoing", "planned maintenance", "down for maintenance", "wegen wartungsarbeiten", "dieser dienst ist",
    "pour cause de maintenance", "en raison d'une maintenance", "ocr error", "could not open file", "we can't find that", "we couldn't find", "page not found", "the page you asked for",
    "the page you requested", "the page you are looking for", "the requested document", "the requested page", "this page could not be",
    "please try again later", "too many requests", "you do not have permission", "access denied", "request timed out", "undefined undefined",
    "[object object]", "seite nicht gefunden", "die angeforderte", "zugriff verweigert", "interner serverfehler", "fehlercode", "ein fehler ist",
    "page introuvable", "accès refusé", "erreur interne", "une erreur", "service momentanément", "la page demandée", "le document demandé",
    # notices that scripts, cookies, a check or a sign-in are needed
    "please enable javascript", "please enable cookies", "you need to turn on javascript", "you need to enable", "javascript is required",
    "javascript is disabled", "javascript must be", "this site needs scripts", "this site requires", "this page requires", "turn them on in your browser",
    "your browser does not support", "enable javascript and cookies", "activate scripting", "noscript:", "we use cookies", "accept all / reject",
    "this site uses cookies", "cookies must be", "checking that you are not", "checking your browser", "complete the puzzle", "verify you are human",
    "prove you are human", "please complete the captcha", "your session has expired", "please sign in", "sign in to", "please log in", "log in to",
    "subscribe or sign in", "subscribe to read", "this may take a few seconds", "loading opinion", "loading…", "loading...", "bitte aktivieren sie",
    "bitte melden sie sich", "ihre sitzung ist", "diese seite benötigt", "ihr browser", "veuillez activer", "veuillez vous connecter",
    "l'affichage de cette page", "votre session", "votre navigateur", "wait a few minutes",
    # filler
    "lorem ipsum dolor", "click to add", "text of judgment to follow", "text to follow", "replace this paragraph", "this is dummy", "dummy text",
    "sample text", "placeholder", "insert text here", "your text here", "type your text", "asdf", "qwerty", "blah blah", "bla bla", "bla blah",
    "blah bla", "blah, ", "bla, ", "to be completed", "content goes here", "coming soon", "tbd", "todo",
    # pages of a web site around them
    "go back | home", "home search help", "try the search box above", "contact the registry",
)

# The forms of placeholders left in a template.
PLACEHOLDER = re.compile(
    r"\{%\s*[\w.\- ]{1,60}\s*%\}|\{\{\s*[\w.\- ]{1,60}\s*\}\}|\$\{\s*[\w.\-]{1,60}\s*\}|%[^\W\d_][\w.]{1,60}%|__[^\W\d_][\w.]*?__|<<\s*[\w.\- ]{1,60}\s*>>|«[\w.]{1,60}»|@@[\w.]{1,60}@@"
    r"|#[^\W\d_][\w.]{1,60}#|(?<!\{)\{[^\W\d_][\w.]{0,60}\}(?!\})|<[^\W\d_][\w.]{0,60}>|\[(?i:insert|enter|add|your|type|fill in)\b[^\]\n]{0,60}\]|\[object [A-Z]\w{2,30}\]|\[[^\]\n]{1,60}(?i:to be completed|to follow|to be inserted|here)\]"
)
#: One of these is in every placeholder that is not in square brackets, and one of those in all that are.
_SIGNS = ("{", "$", "%", "__", "<", "«", "@@", "#")
_BRACKETED = ("[object", "[insert", "[enter", "[add", "[your", "[type", "[fill", "completed]", "follow]", "inserted]", "here]")
_QUOTE = re.compile(r"“[^”\n]{0,400}”|„[^“”\n]{0,400}[“”]|\"[^\"\n]{0,400}\"|« [^»\n]{0,400} »|‹[^›\n]{0,400}›")
_TOKEN = re.compile(r"[]|[^\W\d_]{2,}")
_BREAK = re.compile(r"[\r\n\x0b\x0c\x85  ]+|(?<=[.!?…])[\"”»]?\s+(?=\S)")
# Four or more words in a row of one letter typed over and over; single ones stand for judges, numerals and redactions.
_TYPED_OVER = re.compile(r"\b([^\W\d_])\1+\b(?:[\s.,;:]+\1\1+\b){3,}")
_WORD = re.compile(r"[^\W\d_]{2,}")

#: The characters that stand for a placeholder and for a run of words of one letter typed over and over.
PLACED, REPEATED = "\ue000", "\ue001"


def plain(text: str) -> str:
    """Lower case without soft hyphens."""
    return text.lower().replace("\xad", "")


def _marked(passage: str) -> str:
    """The passage in lower case, with placeholders and runs of typed-over words as one character each."""
    return _TYPED_OVER.sub(f" {REPEATED} ", plain(PLACEHOLDER.sub(f" {PLACED} ", passage)))


def passages(text: str) -> list[str]:
    return [p for p in (s.strip() for s in _BREAK.split(text)) if p]


def collapsed(low: str) -> str:
    return " ".join(low.split())


class Phrases:
    """Trusted phrases found in collapsed texts by one automaton. Those of several words are also words of the model."""

    def __init__(self, phrases: tuple[str, ...]):
        self.all = tuple(sorted({p.strip() for p in phrases}))
        self.automaton = None

    def __getstate__(self) -> dict:
        return {"all": self.all, "automaton": None}

    def found(self, text: str) -> list[tuple[int, str]]:
        """(end, phrase) of every occurrence in a collapsed text."""
        if not self.all:
            return []
        if self.automaton is None:  # made where it is used
            self.automaton = ahocorasick.Automaton()
            for p in self.all:
                self.automaton.add_word(p, p)
            self.automaton.make_automaton()
        return [(end + 1, p) for end, p in self.automaton.iter(text)]

    def features(self, text: str, found: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """Those of the phrases found that have several words and no letter or digit next to them."""
        return [(e, p) for e, p in found if is_run(p) and not text[e : e + 1].isalnum() and not text[max(e - len(p) - 1, 0) : e - len(p)].isalnum()]


def is_run(phrase: str) -> bool:
    """Whether a phrase is a run of words."""
    return " " in phrase and all(w.isalpha() for w in phrase.split())


def tokens(passage: str, phrases: Phrases) -> list[str]:
    """Words, marks and trusted phrases (after their last word) in order; a tilde stands for each word inside quotation marks."""
    found, at = [], 0

    def add(part: str) -> None:
        text = collapsed(_marked(part))
        words = _TOKEN.findall(text)
        for end, p in sorted(phrases.features(text, phrases.found(text)), reverse=True):
            words.insert(len(_TOKEN.findall(text[:end])), p)
        found.extend(words)

    for quote in _QUOTE.finditer(passage):
        add(passage[at : quote.start()])
        found.extend(["~"] * len(_TOKEN.findall(_marked(quote.group()))))
        at = quote.end()
    add(passage[at:])
    return found


def trusted(passage: str, phrases: tuple[str, ...] = TRUSTED) -> bool:
    low = collapsed(plain(passage)).lstrip(" #[(*-")
    return low.startswith(phrases) and not _QUOTE.match(passage)


def placed(low: str) -> bool:
    """Whether a lower-case text may hold a placeholder, by its signs."""
    return any(sign in low for sign in _SIGNS) or "[" in low and any(sign in low for sign in _BRACKETED)


#: Words of one letter: of the Latin, Greek and Cyrillic alphabets, from three times on.
_LONGEST = 40
_TYPED = frozenset(ch * n for ch in map(chr, range(0x61, 0x530)) if ch.isalpha() and ch == ch.lower() for n in range(3, _LONGEST + 1))


def typed_over(words: set[str], low: str) -> bool:
    """Whether a text may hold a run of typed-over words, by its words."""
    return (not _TYPED.isdisjoint(words) or max(map(len, words), default=0) > _LONGEST) and _TYPED_OVER.search(low) is not None


class ResidueModel:
    """Word weights (log odds of residue against content), the prior log odds and the margin that a verdict needs.

    A word that is in no residue has the weight of smoothing alone. A word counts for residue only where at least a
    share ``OWN`` of its occurrences is residue, so that the titles around an error page stay content.
    """

    #: Words for residue that a stretch must have to count by itself, unless it holds a mark: a placeholder, typed-over
    #: words or a trusted phrase.
    SHORTEST = 3
    OWN, SMOOTHING, QUOTED, BETWEEN = 0.1, 0.05, -2.0, -2.0

    def __init__(self, weights: dict[str, float], bias: float, margin: float = 2.5, phrases: tuple[str, ...] = TRUSTED, corpus: dict[str, int] | None = None):
        self.weights, self.bias, self.margin = weights, bias, margin
        self.phrases = Phrases(phrases)
        self.absent = math.log(self.SMOOTHING / (1 + self.SMOOTHING))
        #: No text without one of these words, a phrase that counts (looked for where its rarest word is), a placeholder or
        #: typed-over words can reach a verdict.
        self.strong = frozenset(w for w, x in weights.items() if x > 0 and " " not in w)
        often = corpus or {}
        self.phrases_by_word: dict[str, list[str]] = {}
        for p in sorted(w for w, x in weights.items() if x > 0 and " " in w):
            self.phrases_by_word.setdefault(min(p.split(), key=lambda v: (often.get(v, 0), v)), []).append(p)

    @classmethod
    def fit(cls, residue: dict[str, float], corpus: dict[str, int], total: int, margin: float = 2.5, phrases: tuple[str, ...] = TRUSTED) -> ResidueModel:
        """The maximization step. ``residue``: expected residue passages with each word; ``corpus``: occurrences of these
        words in all documents, of which there are ``total`` words. What is not residue is content."""
        p = sum(residue.values())
        n = max(total - p, 1.0)
        total = max(total, p + 1.0)
        weights = {}
        for w, k in residue.items():
            everywhere = max(corpus.get(w, 0), k)
            smooth = cls.SMOOTHING * everywhere / total
            x = math.log(k / p + smooth) - math.log((everywhere - k) / n + smooth)
            weights[w] = x if k >= cls.OWN * everywhere else min(x, 0.0)
        return cls(weights, math.log(p / n), margin, phrases, corpus)

    def whole(self, words: list[str]) -> float:
        """Log odds of a passage by its distinct words; quoted ones say nothing."""
        return self.bias + sum(self.weights.get(w, self.absent) for w in set(words) if w != "~")

    def stretch(self, words: list[str]) -> float:
        """The best sum over neighbouring words; a repeated word adds little."""
        best = run = 0.0
        seen: set[str] = set()
        length, mark = 0, False
        for w in words:
            x = self.QUOTED if w == "~" else self.weights.get(w, self.absent)
            x = x if x > 0 else min(x, self.BETWEEN)
            if w in seen:
                x = min(x, 1.5)
            run += x
            if run <= 0:
                run, seen, length, mark = 0.0, set(), 0, False
                continue
            seen.add(w)
            length += x > 0
            mark = mark or w in (PLACED, REPEATED) or " " in w and x > 0
            if length >= self.SHORTEST or mark:
                best = max(best, run)
        return best

    def decides(self, passage: str) -> bool:
        words = tokens(passage, self.phrases)
        return self.whole(words) > self.margin or self.stretch(words) > self.margin - self.bias

    def candidate(self, text: str) -> bool:
        """Whether anything in a text counts for residue; an upper bound, since all else only takes from a score."""
        low = plain(text)
        words = set(_WORD.findall(low))
        if not self.strong.isdisjoint(words) or placed(low) or typed_over(words, low):
            return True
        rare = self.phrases_by_word.keys() & words
        return bool(rare) and any(p in flat for flat in (collapsed(low),) for w in rare for p in self.phrases_by_word[w])

    def is_case(self, text: str) -> bool:
        return self.candidate(text) and any(self.candidate(p) and self.decides(p) for p in passages(text))


class Labeller:
    """Labels passages by trusted phrases and placeholders."""

    def __init__(self, phrases: tuple[str, ...] = TRUSTED, brief: int = 600):
        self.phrases, self.brief, self.runs = phrases, brief, Phrases(phrases)

    def count(self, text: str, residue: Counter, corpus: Counter) -> None:
        """Adds a text's words and phrases to ``corpus`` and the words of its labelled passages to ``residue``: those that
        are labelled, and by half those beside a trusted phrase in a brief text. A passage with a placeholder speaks for
        the placeholder only, since the rest of it is content."""
        low = plain(text)
        found = _WORD.findall(low)
        corpus.update(found)
        flat = collapsed(low)
        hits = self.runs.found(flat)
        if hits:
            corpus.update(p for _, p in self.runs.features(flat, hits))
        if not (hits or placed(low) or typed_over(set(found), low)):
            return
        each = [(p, trusted(p, self.phrases)) for p in passages(text)]
        beside = len(text) <= self.brief and any(t for _, t in each)
        for p, t in each:
            own = plain(p)
            if not (t or beside or placed(own) or typed_over(set(_WORD.findall(own)), own)):
                continue
            words = {w for w in tokens(p, self.runs) if w != "~"}
            if marks := words & {PLACED, REPEATED}:
                residue.update(marks)
            elif t or beside:
                for w in words:
                    residue[w] += 1.0 if t else 0.5


def _summed(source: DataFrame, count: Callable[[str, Counter, Counter], None]) -> DataFrame:
    """(word, residue, corpus) summed over all texts; ``count`` adds a text to the task's two counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            residue: Counter[str] = Counter()
            corpus: Counter[str] = Counter()
            for text in batch.column(1).to_pylist():
                if text:
                    count(text, residue, corpus)
            words = list(residue.keys() | corpus.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([float(residue[w]) for w in words], pa.float64()), pa.array([corpus[w] for w in words], pa.int64())],
                names=["word", "residue", "corpus"],
            )

    partial = source.mapInArrow(run, "word string, residue double, corpus bigint")
    return partial.groupBy("word").agg(F.sum("residue").alias("residue"), F.sum("corpus").alias("corpus"))


def fitted(source: DataFrame, rounds: int, vocabulary: int, least: float, phrases: tuple[str, ...] = TRUSTED, brief: int = 600) -> ResidueModel:
    """The model of a corpus (doc_id, text): one pass for labels and word counts, then one for each round.

    The driver gets the words of residue with their two sums, at most ``vocabulary`` of them, those with most residue
    first; a word must be in ``least`` residue passages. The trusted phrases themselves are labelled passages too.
    """
    labeller = Labeller(phrases, brief)

    counts = durable(_summed(source, labeller.count))
    total = counts.agg(F.coalesce(F.sum("corpus"), F.lit(0))).first()[0]

    def sums(residue: DataFrame) -> list:
        return residue.filter(F.col("residue") >= least).orderBy(F.desc("residue"), "word").limit(vocabulary).collect()

    own = Counter(w for p in phrases for w in set(tokens(p, labeller.runs)))
    own.update((PLACED, REPEATED))

    everywhere = {r["word"]: r["corpus"] for r in counts.filter(F.col("word").isin(*own)).collect()}

    def model(rows: list) -> ResidueModel:
        residue, corpus = {w: float(k) for w, k in own.items()}, dict(everywhere)
        for r in rows:
            residue[r["word"]] = residue.get(r["word"], 0.0) + r["residue"]
            corpus[r["word"]] = r["corpus"]
        return ResidueModel.fit(residue, corpus, total, phrases=phrases)

    now = model(sums(counts))
    for _ in range(rounds):
        current = now

        def expect(text: str, residue: Counter, corpus: Counter, current: ResidueModel = current) -> None:
            if not current.candidate(text):
                return
            for p in passages(text):
                if current.candidate(p):
                    words = {w for w in tokens(p, current.phrases) if w != "~"}
                    if marks := words & {PLACED, REPEATED}:
                        residue.update(marks)
                        continue
                    share = 1.0 if trusted(p, phrases) else 1 / (1 + math.exp(-max(-50.0, min(50.0, current.whole(list(words))))))
                    for w in words:
                        residue[w] += share

        expected = _summed(source, expect).select("word", "residue")
        now = model(sums(expected.join(counts.select("word", "corpus"), "word", "left")))
    return now


def residue(documents: DataFrame, doc: str, text: str, rounds: int = 1, vocabulary: int = 20_000, least: float = 2.0) -> DataFrame:
    """(doc_id): the documents with residue, wholly or in places.

    All counts and every round of the fit are taken over all documents, which are then scored whole. Null, empty and
    blank texts are no case. Repeated texts are judged alike; an empty table gives no row; other columns are not read.
    """
    source = documents.select(column(doc).cast("bigint").alias("doc_id"), column(text).alias("text")).filter(F.col("text").isNotNull())
    model = fitted(source, rounds, vocabulary, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [bool(t) and model.is_case(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], names=["doc_id"])

    return source.mapInArrow(run, "doc_id bigint")
