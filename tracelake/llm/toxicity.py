"""Toxicity by a learned lexicon: Levenshtein automata over its trie find misspelled terms, context weighs them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import fresh, worker_cache

#: A term must be in so many toxic training documents, whatever their number, and so large a share of its documents must be toxic.
MIN_TOXIC, MIN_SHARE = 3, 0.75
#: So large must twice the log-likelihood ratio against the share of all documents be: one chance in 100,000 (chi-squared, one degree),
#: as very many terms are judged. Where a tenth is toxic, five documents are enough, in a table of any size.
MIN_RATIO = 19.51
#: The lexicon's size is bounded, as every task holds it; the terms with the most toxic documents stay.
MOST_TERMS = 20_000
#: Labelled rows that the classifier and its lexicon are fitted on, at most; drawn by hash of the id.
MOST_ROWS = 40_000
#: Terms of at least this many letters are also found with one edit; twice as long ones with two.
FUZZY_FROM = 5
#: States of the automaton that are kept; beyond that they are worked out anew.
MOST_STATES = 100_000
#: Words whose match a Python worker keeps, and the longest that are kept; longer ones are matched each time.
MOST_KINDS, LONGEST_KEPT = 500_000, 64
#: Words on either side that are looked at.
WINDOW = 6
#: Words that report speech, address somebody or deny, and marks that quote.
REPORTING = frozenset("said says wrote called quote quoted quotes quoting cited cites according term word slur insult example reported".split())
ADDRESS = frozenset("you your youre you're u ur he she they them all such these those".split())
QUOTES = "\"“”„«»‘’'"
FEATURES = ("exact", "stem", "fuzzy", "abuse", "quoted", "share", "distinct", "any", "length")


class Lexicon:
    """A trie of terms. ``kind`` of a term: 0 for whole words, 1 for stems, which match words that begin with them.

    Misspelled terms are found by a Levenshtein automaton that runs along the trie. Its states are sets of (node, edits so far,
    letter that a swap still expects); a set is worked out when a word first leads to it and then kept, so that most words cost
    a few look-ups until no term is near any more.
    """

    def __init__(self, terms: list[tuple[str, int]]):
        self.words = {t for t, kind in terms if kind == 0}
        self.stems = {t for t, kind in terms if kind == 1}
        self.lengths = sorted({len(t) for t in self.stems})
        # Nodes by number: children by letter, edits allowed below (0: none), length of the term that ends here (0: none).
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.ends = [0], [0]
        for term in sorted(self.words):
            if len(term) >= FUZZY_FROM:
                node, edits = 0, 2 if len(term) >= 2 * FUZZY_FROM else 1
                for c in term:
                    self.allowed[node] = max(self.allowed[node], edits)
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.allowed.append(0)
                        self.ends.append(0)
                    node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
                self.ends[node] = len(term)
        self._forget()

    def _forget(self) -> None:
        self.sets = [self._closed({(0, 0, "")})]
        self.numbers = {self.sets[0]: 0}
        self.steps: list[dict[str, int]] = [{}]
        self.accepts = [self._accepts(self.sets[0])]

    def _closed(self, states: set) -> frozenset:
        """With what a letter left out of the word leads to."""
        todo = list(states)
        while todo:
            node, edits, expected = todo.pop()
            if not expected:
                for child in self.children[node].values():
                    new = (child, edits + 1, "")
                    if edits < self.allowed[child] and new not in states:
                        states.add(new)
                        todo.append(new)
        return frozenset(states)

    def _accepts(self, states: frozenset) -> int:
        """The least length of a word that may end here: 1 for one edit at most, 10 for two; 0: none may."""
        found = [1 if edits < 2 else 2 * FUZZY_FROM for node, edits, expected in states if not expected and self.ends[node] and (edits < 2 or self.ends[node] >= 2 * FUZZY_FROM)]
        return min(found, default=0)

    def _step(self, number: int, letter: str) -> int:
        states = set()
        for node, edits, expected in self.sets[number]:
            if expected:
                if letter == expected:
                    states.add((node, edits, ""))
                continue
            same = self.children[node].get(letter)
            if same is not None:
                states.add((same, edits, ""))
            if edits < self.allowed[node]:
                states.add((node, edits + 1, ""))  # a letter too many
                for other, child in self.children[node].items():
                    if other != letter and edits < self.allowed[child]:
                        states.add((child, edits + 1, ""))  # another letter
                        swapped = self.children[child].get(letter)
                        if swapped is not None and edits < self.allowed[swapped]:
                            states.add((swapped, edits + 1, other))
        closed = self._closed(states)
        found = self.numbers.get(closed)
        if found is None:
            found = self.numbers[closed] = len(self.sets)
            self.sets.append(closed)
            self.steps.append({})
            self.accepts.append(self._accepts(closed))
        self.steps[number][letter] = found
        return found

    def match(self, word: str) -> int:
        """0: none, 1: a term, 2: a stem, 3: a term with edits."""
        if word in self.words:
            return 1
        for n in self.lengths:
            if n < len(word) and word[:n] in self.stems:
                return 2
        if len(word) < FUZZY_FROM - 1:
            return 0
        return 3 if self._near(word) else 0

    def _near(self, word: str) -> bool:
        if len(self.sets) > MOST_STATES:
            self._forget()
        number = 0
        for letter in word:
            following = self.steps[number].get(letter)
            number = self._step(number, letter) if following is None else following
            if not self.sets[number]:
                return False
        return 0 < self.accepts[number] <= len(word)


#: Signs that stand for letters.
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: A word: a run of letters and signs that stand for them, with the quote marks around it; marks between letters are none.
_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"(?:(?<!{_LETTER})[{QUOTES}])?(?:{_LETTER}|[013457@$!])+(?:[.,;:?]?[{QUOTES}](?!{_LETTER}))?")


def _letters(word: str) -> str:
    """The word in lower case without marks at its ends; signs between letters are read as letters."""
    bare = word.strip("\"“”„«»‘’'.,;:!?()[]{}<>*_~-#%&$|/\\").lower()
    return bare if bare.isalpha() else bare.translate(_SIGNS)


def features(text: str, lexicon: Lexicon, kinds: dict[str, int]) -> list[float]:
    """What a text says with the lexicon's terms, see ``FEATURES``. ``kinds`` keeps the match of words seen before."""
    from math import log1p

    words = _WORD.findall(text)
    found = list(map(kinds.get, words))
    if None in found:
        if len(kinds) > MOST_KINDS:
            kinds.clear()
        here = {word: lexicon.match(_letters(word)) for word, kind in zip(words, found) if kind is None}
        kinds.update((word, kind) for word, kind in here.items() if len(word) <= LONGEST_KEPT)
        found = [here[word] if kind is None else kind for word, kind in zip(words, found)]
    hits = [(i, kind) for i, kind in enumerate(found) if kind] if any(found) else []
    if not hits:
        return [0.0] * 8 + [log1p(len(words))]
    counts, abuse, quoted = [0, 0, 0], 0, 0
    for k, (i, kind) in enumerate(hits):
        counts[kind - 1] += 1
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        bare = {w.strip(".,;:!?\"'()").lower() for w in near}
        marked = sum(w[:1] in QUOTES or w[-1:] in QUOTES for w in near)
        if bare & REPORTING or marked >= 2 or words[i][:1] in QUOTES and words[i].rstrip(".,;:!?")[-1:] in QUOTES:
            quoted += 1
        elif bare & ADDRESS or any(abs(j - i) <= WINDOW for j, _ in (*hits[max(0, k - 1) : k], *hits[k + 1 : k + 2])):
            abuse += 1
    distinct = len({_letters(words[i]) for i, _ in hits})
    return [log1p(counts[0]), log1p(counts[1]), log1p(counts[2]), log1p(abuse), log1p(quoted), 100.0 * len(hits) / (len(words) + 20), log1p(distinct), 1.0, log1p(len(words))]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Labelled documents outside the held-out fifth, ``most`` of them at most: ``doc_id, text, toxic``.

    The ids and labels, bounded by ``most``, go to every task; texts stay where they are.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")


def _terms(rows: DataFrame) -> DataFrame:
    """``term, kind, n, fine``: in how many toxic and other rows a word (kind 0) or stem (kind 1) stands. Each row names a term once."""

    def named(batches):
        from collections import Counter

        import pyarrow as pa

        def counted(toxic, fine):
            found = list(toxic.keys() | fine.keys())
            terms, kinds = zip(*found) if found else ((), ())
            columns = [pa.array(terms, pa.string()), pa.array(kinds, pa.int32()), *(pa.array([c[f] for f in found], pa.int64()) for c in (toxic, fine))]
            return pa.RecordBatch.from_arrays(columns, ["term", "kind", "n", "fine"])

        both: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for w in map(_letters, set(_WORD.findall(t))) if w.isalpha() and 3 <= len(w) <= 30}
                both[0 if toxic else 1].update({(w, 0) for w in words} | {(w[:n], 1) for w in words for n in range(4, 8) if len(w) > n})
                if len(both[0]) + len(both[1]) > 200_000:
                    yield counted(*both)
                    both = (Counter(), Counter())
        yield counted(*both)

    return rows.select("text", (F.col("toxic") == 1).alias("toxic")).mapInArrow(named, "term string, kind int, n long, fine long").groupBy("term", "kind").agg(F.sum("n").alias("n"), F.sum("fine").alias("fine"))


def _unlikely(n: Column, fine: Column, share: float) -> Column:
    """Twice the log-likelihood ratio of a term's toxic share against that of all rows; high: no chance find."""
    total = n + fine
    return 2 * (n * F.log(n / (total * share)) + F.when(fine > 0, fine * F.log(fine / (total * (1 - share)))).otherwise(0.0))


def learn_terms(rows: DataFrame) -> list[tuple[str, int]]:
    """Words and word stems (4 to 7 letters) that toxic training documents have and others hardly ever: ``(term, kind)``.

    The bar is the same for tables of every size. A stem counts only if several words share it: one word alone must not explain most
    of its documents.
    """
    from tracelake.session import persist_table

    # Copies of a text tell no more than one of them.
    rows = rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    every, toxic = rows.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not toxic:
        return []
    counts = persist_table(_terms(rows).filter(F.col("n") >= MIN_TOXIC), "toxic-terms")
    stems = F.explode(F.transform(F.sequence(F.lit(4), F.lit(7)), lambda k: F.left("term", k)))
    alone = counts.filter("kind = 0").select(stems.alias("term"), F.lit(1).alias("kind"), "n").groupBy("term", "kind").agg(F.max("n").alias("alone"))
    pure = F.col("n") >= F.when(F.col("kind") == 0, MIN_SHARE).otherwise(0.9) * (F.col("n") + F.col("fine"))
    # Where all rows are toxic, none says what others do not say.
    chance = _unlikely(F.col("n"), F.col("fine"), toxic / every) >= MIN_RATIO if toxic < every else F.lit(True)
    shared = (F.col("kind") == 0) | (2 * F.col("n") >= 3 * F.coalesce("alone", F.lit(0)))
    good = counts.filter(pure & chance).join(alone, ["term", "kind"], "left").filter(shared)
    return [(r["term"], r["kind"]) for r in good.orderBy(F.desc("n"), "term", "kind").limit(MOST_TERMS).collect()]


def fit(rows: list[tuple[list[float], int]], rounds: int = 30) -> list[float]:
    """Weights of a logistic regression with a small ridge, by Newton steps; the last is the constant."""
    import numpy as np

    if not rows:
        return [0.0] * len(FEATURES) + [-3.0]
    x = np.array([f + [1.0] for f, _ in rows])
    y = np.array([float(t) for _, t in rows])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.5)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


class Model:
    """A lexicon and the weights of its features; small, and the same for every task."""

    def __init__(self, terms: list[tuple[str, int]], weights: list[float]):
        self.terms, self.weights = terms, weights


def _featured(rows: DataFrame, terms: list[tuple[str, int]]) -> DataFrame:
    key = f"toxic:{hash(tuple(terms))}"

    def run(batches):
        import pyarrow as pa

        lexicon, kinds = worker_cache(key, lambda: (Lexicon(terms), {}))
        for batch in batches:
            values = [features(t, lexicon, kinds) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["f", "toxic"])

    return rows.select("text", "toxic").mapInArrow(run, "f array<double>, toxic int")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows outside the held-out fifth; label, source, language and id are no inputs."""
    from tracelake.session import persist_table

    rows = persist_table(training_rows(docs, labels), "toxic-training")
    terms = learn_terms(rows)
    weights = fit([(r["f"], r["toxic"]) for r in _featured(rows, terms).collect()])
    return Model(terms, weights)


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """Adds ``name`` (0 to 1, higher: toxic likelier) to all rows; a missing or empty text is scored as one without terms."""
    terms, weights = model.terms, model.weights
    key = f"toxic:{hash(tuple(terms))}"

    @F.pandas_udf("double")
    def scored(texts):
        import numpy as np
        import pandas as pd

        lexicon, kinds = worker_cache(key, lambda: (Lexicon(terms), {}))
        x = np.array([features(t or "", lexicon, kinds) for t in texts]).reshape(len(texts), len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(weights[:-1]) + weights[-1], -30, 30))))

    return docs.withColumn(name, scored(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col("text"))
    scored = score(slim, train(docs, labels))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, with their own columns."""
    (name,) = fresh(docs, "_score")
    return score(docs, train(docs, labels), name).filter(F.col(name) < threshold).drop(name)
