"""Subject areas of documents: a sentence model of terms, and a classifier chain over document features.

The sentence model learns what terms (sequences of one to four words) each subject uses from the labels of
whole documents: every sentence of a labelled document is shared out over the document's subjects, the other
subjects and a background of sentences on nothing, and the shares are refined by expectation maximisation.
A document's features are the shares of its on-subject sentences, its source and its structure; the chain
decides subject after subject with the earlier decisions as features, its scores are calibrated on held-out
documents, and the best combination of labels is found by beam search.

Texts are held as flat arrays of word numbers, so that terms are looked up and summed for many documents at once.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED_DOCUMENTS = 4_000  # the models are fitted on at most so many labelled documents
LABELLED_CHARACTERS = 20_000_000  # and so much of their text, in whole documents
UNLABELLED_CHARACTERS = 5_000_000  # and so much text of others
TERM_WORDS = 4
BEAM = 8
FOLDS = 3  # parts of the labelled documents whose features are taken from a model of the others
CHUNK_CHARACTERS = 2_000_000  # text that is scored together
COMMON_KIND = 0.01  # share of the fitted documents from which on a source or language is a feature of its own

_SENTENCE = re.compile(r"(?<=[.!?])[\"'”)]*\s+|\n\s*\n|\n(?=\s*(?:[#>*-]|\w+:))")
_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*")
_MARKED_LINE = re.compile(r"^[ \t]*[>*-]", re.M)


class _Numbers(dict):
    """Numbers of words; unknown ones get the next number, or -1 once closed."""

    closed = False

    def __missing__(self, word: str) -> int:
        if self.closed:
            return -1
        self[word] = number = len(self)
        return number


class Flat:
    """Texts as word numbers: word, and for each of them its sentence; for each sentence its document."""

    def __init__(self, texts: list[str], numbers: _Numbers) -> None:
        words, sizes, per_text = array("i"), array("q"), array("q")
        number = numbers.__getitem__
        for text in texts:
            text = text.replace("\r\n", "\n").replace("\r", "\n").lower()
            n = 0
            for part in _SENTENCE.split(text):
                if part and not part.isspace():
                    found = _WORD.findall(part)
                    words.extend(map(number, found))
                    sizes.append(len(found))
                    n += 1
            per_text.append(n)
        self.words = np.array(words, np.int64)
        self.parts = np.array(per_text, np.int64)  # sentences of each text
        self.sentence = np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64))
        self.document = np.repeat(np.arange(len(per_text)), self.parts)

    def chosen(self, texts: np.ndarray) -> Flat:
        """Only some of the texts, by a mask."""
        out = Flat.__new__(Flat)
        sentences = texts[self.document]
        out.words = self.words[sentences[self.sentence]]
        out.sentence = (np.cumsum(sentences) - 1)[self.sentence[sentences[self.sentence]]]
        out.document = (np.cumsum(texts) - 1)[self.document[sentences]]
        out.parts = self.parts[texts]
        return out


def languages(flat: Flat, given: list[str | None]) -> np.ndarray:
    """A language number for each text: naive Bayes on words, first learnt from the languages given.

    Names of languages count by their first two letters and with COMMON_KIND of the texts at least; the
    given names may be missing or wrong for some texts. Without any there is one language.
    """
    names = [(g or "").strip().lower()[:2] for g in given]
    kinds = [k for k, n in sorted(Counter(names).items()) if k.isalpha() and n >= max(2, COMMON_KIND * len(names))]
    if not kinds:
        return np.zeros(len(given), np.int64)
    own = np.array([kinds.index(k) if k in kinds else -1 for k in names], np.int64)
    doc, size = flat.document[flat.sentence], int(flat.words.max(initial=0)) + 1
    for _ in range(2):
        known = own[doc] >= 0
        counts = np.bincount(own[doc][known] * size + flat.words[known], minlength=len(kinds) * size).reshape(len(kinds), size) + 0.1
        logs = np.log(counts / counts.sum(1, keepdims=True))
        fit = np.stack([np.bincount(doc, row[flat.words], len(given)) for row in logs], 1)
        own = fit.argmax(1)
    return own


def _steps(flat: Flat, places: np.ndarray, n: int) -> np.ndarray:
    """Of the places, those after which n - 1 more words stand in the same sentence."""
    places = places[places + n - 1 < len(flat.words)]
    return places[flat.sentence[places] == flat.sentence[places + n - 1]]


class SentenceModel:
    """What each term says for each subject, learnt from labels of whole documents.

    A term's weight for a subject is the log of its share in sentences of that subject against the
    subject's share of all sentences in its language, drawn to nothing by SMOOTH documents. Every word of a
    sentence is read in the term around it that says most. In each round the sentences of a document are
    shared out over its subjects, in proportion to what the round before says of them.
    """

    SMOOTH, LEAST, SAYS, PURE, CERTAIN, ON_SUBJECT = 2.0, 2, 0.7, 0.5, 1.6, 0.8

    def __init__(self, flat: Flat, labels: list[set[int] | None], tongue: np.ndarray, classes: int, rounds: int = 6) -> None:
        self.classes = classes
        self._number_terms(flat)
        sentences, docs_n = len(flat.document), max(1, len(labels))
        place, term = self.place, self.term
        pair = np.unique(flat.sentence[place] * max(1, self.terms) + term)
        row, term_of = pair // max(1, self.terms), pair % max(1, self.terms)
        doc_of, tongue_of = flat.document, tongue[flat.document]
        known = np.array([labels[d] is not None for d in doc_of], bool)
        grid = np.full((docs_n, classes), 0.02)
        for d, own in enumerate(labels):
            if own is not None:
                grid[d, sorted(own)] = 1.0
        allowed = grid[doc_of]
        allowed[~known] = 0.02
        share = np.where(known[:, None], allowed / allowed.sum(1, keepdims=True), 0.0)
        # Which sentences of a document have a term: weights are counted in documents, as these are not independent.
        within, inverse, counts = np.unique(term_of * docs_n + doc_of[row], return_inverse=True, return_counts=True)
        within_term = within // docs_n
        kinds = int(tongue.max(initial=0)) + 1
        in_tongue = np.stack([np.bincount(term_of[tongue_of[row] == g], minlength=self.terms) for g in range(kinds)], 1).astype(float)
        smooth = (self.SMOOTH * self.length)[:, None]
        for k in range(rounds):
            if k:
                score = self._scores(place, term, flat.sentence, sentences)
                if k == 1:
                    score[~known] = 0
                share = np.exp(np.clip(score, -20, 20)) * allowed
                share /= share.sum(1, keepdims=True)
                share[~known] = 0
                if k > 1 and not known.all():
                    self._join(share, score, doc_of, known)
            table = np.stack([np.bincount(term_of, share[row, c], self.terms) for c in range(classes)], 1)
            bases = np.stack([share[tongue_of == g].sum(0) + 0.5 for g in range(kinds)])
            bases /= bases.sum(1, keepdims=True)
            base = in_tongue @ bases
            base /= np.maximum(base.sum(1, keepdims=True), 1e-9)
            self.weights = np.log((table + smooth * base) / (table.sum(1, keepdims=True) + smooth)) - np.log(np.maximum(base, 1e-300))
            docs = np.stack([np.bincount(within_term, np.bincount(inverse, share[row, c], len(within)) / counts, self.terms) for c in range(classes)], 1)
            total = docs.sum(1, keepdims=True)
            certain = (docs - total * base) / np.sqrt(total * base * (1 - base) + 1)
            best = self.weights.argmax(1) if self.terms else np.zeros(0, np.int64)
            at = np.arange(len(best))
            pure = table[at, best] >= self.PURE * table.sum(1)
            self.says = np.round(np.where(pure & (certain[at, best] >= self.CERTAIN), self.weights[at, best], 0), 9)
        del self.place, self.term
        self._keep_what_says()

    def _number_terms(self, flat: Flat) -> None:
        """Terms of LEAST documents, one more for each further word, and where they stand.

        A term's number is looked up by that of the term without its last word, and the last word.
        """
        doc, self.keys, found = flat.document[flat.sentence], [], []
        self.words_n = int(flat.words.max(initial=0)) + 1
        places, before, first, documents = np.arange(len(flat.words)), np.zeros(len(flat.words), np.int64), 0, int(doc.max(initial=0)) + 1
        lengths = []
        for n in range(1, TERM_WORDS + 1):
            live = _steps(flat, places, n)
            key = before[live] * self.words_n + flat.words[live + n - 1]
            keys, inverse = np.unique(key, return_inverse=True)
            spread = np.bincount(np.unique(inverse * documents + doc[live]) // documents, minlength=len(keys))
            kept = spread >= self.LEAST + n - 1
            number = np.where(kept, first + np.cumsum(kept) - 1, -1)
            self.keys.append((keys[kept], number[kept]))
            mine = number[inverse]
            found.append((live[mine >= 0], mine[mine >= 0], n))
            lengths.append(np.full(int(kept.sum()), n))
            places, before = found[-1][0], np.zeros(len(flat.words), np.int64)
            before[places] = found[-1][1]
            first += int(kept.sum())
        self.terms, self.length = first, np.concatenate(lengths)
        self.place, self.term = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _keep_what_says(self) -> None:
        """Only terms that say something stay, with the terms that lead to them."""
        lead, firsts = self.says > self.SAYS, []
        for keys, numbers in reversed(self.keys):
            on = lead[numbers]
            firsts.append((keys[on], numbers[on]))
            if len(firsts) < TERM_WORDS:
                lead[np.unique(keys[on] // self.words_n)] = True
        self.keys = firsts[::-1]
        kept = np.flatnonzero(lead)
        to = np.full(self.terms, -1)
        to[kept] = np.arange(len(kept))
        for i, (keys, numbers) in enumerate(self.keys):
            if i:
                keys = to[keys // self.words_n] * self.words_n + keys % self.words_n
            order = np.argsort(keys)
            self.keys[i] = (keys[order], to[numbers][order])
        self.says, self.weights, self.length, self.terms = self.says[kept], self.weights[kept], self.length[kept], len(kept)

    def _join(self, share: np.ndarray, score: np.ndarray, doc_of: np.ndarray, known: np.ndarray) -> None:
        """Shares for sentences of unlabelled documents in which the model finds one or two subjects."""
        own = np.where(score.max(1) >= self.ON_SUBJECT, score.argmax(1), -1)
        docs = int(doc_of.max()) + 1
        table = np.stack([np.bincount(doc_of[own == c], minlength=docs) for c in range(self.classes)], 1).astype(float)
        total = table.sum(1, keepdims=True)
        table[table * 3 < total] = 0
        table[total[:, 0] < 2] = 0
        mix = (table / np.maximum(table.sum(1, keepdims=True), 1))[doc_of]
        mix[mix > 0] += 0.02
        soft = np.exp(np.clip(score, -20, 20)) * (mix + 0.005 * (mix.sum(1, keepdims=True) > 0))
        size = soft.sum(1, keepdims=True)
        joined = ~known & (size[:, 0] > 0)
        share[joined] = soft[joined] / size[joined]

    def _scores(self, place: np.ndarray, term: np.ndarray, sentence: np.ndarray, sentences: int) -> np.ndarray:
        """For each sentence and subject, the sum of what its words say.

        place and term, shorter terms first, say where terms begin. A word takes the term around it that says
        most, of equal ones the shorter and then the earlier.
        """
        on = self.says[term] > self.SAYS
        place, term = place[on][::-1], term[on][::-1]
        order = np.argsort(self.says[term], kind="stable")
        place, term = place[order], term[order]
        length = self.length[term]
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        owner = np.full(len(sentence), -1)
        owner[np.repeat(place, length) + inside] = np.repeat(term, length)  # of repeated places the last one stays
        at = np.flatnonzero(owner >= 0)
        own = owner[at]
        return np.stack([np.bincount(sentence[at], self.weights[own, c] / self.length[own], sentences) for c in range(self.classes)], 1)

    def scores(self, flat: Flat) -> np.ndarray:
        places, before, found = np.flatnonzero(flat.words >= 0), np.zeros(len(flat.words), np.int64), []
        for n, (keys, numbers) in enumerate(self.keys, 1):
            live = _steps(flat, places, n)
            last = flat.words[live + n - 1]
            live, last = live[last >= 0], last[last >= 0]
            key = before[live] * self.words_n + last
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            places = live[hit]
            before[places] = numbers[at[hit]]
            found.append((places, before[places]))
        return self._scores(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), flat.sentence, len(flat.document))


def document_features(model: SentenceModel, flat: Flat, texts: list[str], sources: list[str | None], kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts with an on-subject sentence, their features): shares of the on-subject sentences, source and structure."""
    score = model.scores(flat)
    best = score.argmax(1)
    on = score[np.arange(len(best)), best] >= model.ON_SUBJECT
    n = model.classes
    counts = np.bincount(flat.document[on] * n + best[on], minlength=len(texts) * n).reshape(len(texts), n).astype(float)
    total = counts.sum(1)
    rows = np.flatnonzero(total)
    counts, total, parts = counts[rows], total[rows], flat.parts[rows]
    share = counts / total[:, None]
    origin = np.array([[float(_kind(sources[i]) == k) for k in kinds] for i in rows]).reshape(len(rows), len(kinds))
    lines = [(texts[i].count("\n") + 1, len(_MARKED_LINE.findall(texts[i])), texts[i].startswith("#") or "\n#" in texts[i]) for i in rows]
    line = np.array(lines, float).reshape(len(rows), 3)
    structure = np.stack([np.log1p(parts) / 5, total / np.maximum(parts, 1), line[:, 2], line[:, 1] / np.maximum(line[:, 0], 1), total < 3], 1)
    return rows, np.concatenate([share, share * 3 >= 1 - 1e-9, (counts == counts.max(1, initial=0, keepdims=True)) & (counts > 0), origin, structure], axis=1)


def _kind(source: str | None) -> str:
    return (source or "").split("/")[0]


class Chain:
    """One logistic decision for each subject, in order; earlier decisions are features of later ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 30) -> None:
        self.classes = y.shape[1]
        held = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
        self.weights = [self._fit(self._row(x[~held], y[~held], c), y[~held, c], penalty, steps) for c in range(self.classes)]
        self.sharp = [1.0] * self.classes
        if held.any():
            for c in range(self.classes):
                z, t = self._row(x[held], y[held], c) @ self.weights[c], y[held, c]
                losses = {a: np.logaddexp(0, np.where(t > 0, -a * z, a * z)).mean() for a in (0.5, 0.7, 1.0, 1.4, 2.0)}
                self.sharp[c] = min(losses, key=losses.get)

    def _row(self, x: np.ndarray, y: np.ndarray, c: int) -> np.ndarray:
        return np.concatenate([self._own(x, c), y[:, :c]], axis=1)

    def _own(self, x: np.ndarray, c: int) -> np.ndarray:
        n = self.classes
        own = x[:, [c, n + c, 2 * n + c]]
        return np.concatenate([np.ones((len(x), 1)), own, own[:, :1] * own[:, 1:2], x[:, 3 * n :]], axis=1)

    @staticmethod
    def _fit(x: np.ndarray, t: np.ndarray, penalty: float, steps: int) -> np.ndarray:
        w = np.zeros(x.shape[1])
        ridge = penalty * np.eye(len(w))
        ridge[0, 0] = ridge[2, 2] = 0.01
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - t) + ridge @ w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def decide(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The most likely combination of labels of each row, by beam search over the chain."""
        cost, paths = np.zeros((len(x), 1)), np.zeros((len(x), 1, self.classes))
        for c in range(self.classes):
            own = self._own(x, c)
            w = self.weights[c]
            z = ((own @ w[: own.shape[1]])[:, None] + paths[:, :, :c] @ w[own.shape[1] :]) * self.sharp[c]
            taken = paths.copy()
            taken[:, :, c] = 1
            cost = np.concatenate([cost + np.logaddexp(0, z), cost + np.logaddexp(0, -z)], axis=1)
            paths = np.concatenate([paths, taken], axis=1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :beam]
            cost, paths = np.take_along_axis(cost, best, 1), np.take_along_axis(paths, best[:, :, None], 1)
        return paths[:, 0]


class Fitted:
    """The sentence model and the chain, which sees features of documents that its sentence model was not fitted on."""

    def __init__(self, texts: list[str], sources: list[str | None], given: list[str | None], labels: list[set[int]], classes: int, unlabelled: int) -> None:
        """The last `unlabelled` of the texts have no labels."""
        numbers = _Numbers()
        flat = Flat(texts, numbers)
        n = len(texts) - unlabelled
        fold = np.array([zlib.crc32(t.encode()) % FOLDS for t in texts[:n]] + [FOLDS] * unlabelled, np.int64)  # repeated texts stay together
        tongue = languages(flat, given)
        self.kinds = sorted(k for k, m in Counter(map(_kind, sources[:n])).items() if m >= COMMON_KIND * n)
        rows, wanted = [], []
        for k in range(FOLDS):
            test, train = fold == k, (fold != k) & (fold != FOLDS)
            if not test.any() or not train.any():
                continue
            model = SentenceModel(flat.chosen(train), [labels[i] for i in np.flatnonzero(train)], tongue[train], classes, rounds=4)
            mine = np.flatnonzero(test)
            at, x = document_features(model, flat.chosen(test), [texts[i] for i in mine], [sources[i] for i in mine], self.kinds)
            rows.append(x)
            wanted += [[float(c in labels[i]) for c in range(classes)] for i in mine[at]]
        self.model = SentenceModel(flat, [*labels, *[None] * unlabelled], tongue, classes)
        x = np.concatenate(rows) if rows else np.zeros((0, 0))
        order = np.random.default_rng(3).permutation(len(x))
        self.chain = Chain(x[order], np.array(wanted)[order]) if len(x) else None
        leads = set((self.model.keys[0][0]).tolist()) | {int(w) for keys, _ in self.model.keys[1:] for w in keys % self.model.words_n}
        self.numbers = _Numbers((w, i) for w, i in numbers.items() if i in leads)
        self.numbers.closed = True

    def subjects(self, texts: list[str], sources: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, subject) numbers."""
        at, x = document_features(self.model, Flat(texts, self.numbers), texts, sources, self.kinds)
        row, subject = np.nonzero(self.chain.decide(x)) if len(at) else (np.zeros(0, np.int64),) * 2
        return at[row], subject


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= CHUNK_CHARACTERS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _predict(batches: Iterator[pd.DataFrame], sent, names: list[str]) -> Iterator[pd.DataFrame]:
    fitted = sent.value
    named = np.array(names, dtype=object)
    for pdf in batches:
        ids, texts, sources = pdf.doc_id.to_numpy(), pdf.text.tolist(), pdf.source.tolist()
        for a, b in _chunks([len(t) for t in texts]):
            doc, subject = fitted.subjects(texts[a:b], sources[a:b])
            yield pd.DataFrame({"doc_id": ids[a:b][doc], "subject": named[subject]})


def _first_by_hash(rows: DataFrame, most: int, characters: int) -> DataFrame:
    """The first documents by the hash of their id: at most `most`, until their text fills characters, but two at least."""
    key = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"))
    last, total = None, 0
    for n, row in enumerate(rows.select(key.alias("key"), F.length("text").alias("size")).orderBy("key").limit(most).collect()):
        if total >= characters and n >= 2:
            break
        last, total = row.key, total + row.size
    if last is None:
        return rows.limit(0)
    return rows.where((F.xxhash64("doc_id") < last.h) | ((F.xxhash64("doc_id") == last.h) & (F.col("doc_id") <= last.id)))


def document_subjects(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, most_labelled: int = LABELLED_DOCUMENTS, unlabelled: int = 1_000
) -> DataFrame:
    """(doc_id, subject): the subjects of every document, none for one without an on-subject sentence.

    Fitted on at most most_labelled labelled documents and `unlabelled` others, chosen by the hash of their
    id until their text fills LABELLED_CHARACTERS and UNLABELLED_CHARACTERS; the document that fills it is
    taken whole. Every document is then classified. Labels of unknown documents or subjects are ignored, null and
    empty texts have no subject, and without usable labels no document has one. A column lang, where there is
    one, tells the languages of the fitted documents, which are modelled apart; the list of subjects is held by
    the driver. Of a repeated doc_id every text counts.
    """
    spark = documents.sparkSession
    names = [r.subject for r in subjects.where("subject IS NOT NULL").groupBy("subject").agg(F.min("sort_no").alias("n")).orderBy("n", "subject").collect()]
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string").alias("lang")
    texts = documents.where("doc_id IS NOT NULL AND trim(text) <> ''").select("doc_id", "text", "source", lang)
    own = labels.where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    once = texts.dropDuplicates(["doc_id"])
    rows = _first_by_hash(once.join(chosen, "doc_id"), most_labelled, LABELLED_CHARACTERS).select("text", "source", "lang", "subjects").collect()
    empty = spark.createDataFrame([], "doc_id bigint, subject string")
    if not rows:
        return empty
    others = _first_by_hash(texts.join(own, "doc_id", "left_anti"), unlabelled, UNLABELLED_CHARACTERS).dropDuplicates(["doc_id"]).select("text", "source", "lang").collect()
    rows, others = sorted(rows, key=lambda r: r.text), sorted(others, key=lambda r: r.text)
    number = {name: i for i, name in enumerate(names)}
    both = rows + others
    fitted = Fitted(
        [r.text for r in both], [r.source for r in both], [r.lang for r in both], [{number[s] for s in r.subjects} for r in rows], len(names), len(others)
    )
    if fitted.chain is None:
        return empty
    sent = spark.sparkContext.broadcast(fitted)
    found = texts.select("doc_id", "text", "source").mapInPandas(lambda it: _predict(it, sent, names), "doc_id bigint, subject string")
    return found.distinct()
