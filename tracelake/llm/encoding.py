"""Whole texts to token ids with the ``tokenizers`` library.

The library spends most of its time on words it has met before. A word between two blanks or line ends is a unit of the
byte-level pattern: its ids depend on nothing but whether a blank stands in front of it. So do those of the white space
between two words: but for its last character, which goes to the word if it is a blank, it is one unit, and at the end of a
text all of it is. Units are encoded once and kept. Only texts with the special token's string or with the control characters
that mark units here go to the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import re
import string
from itertools import filterfalse

from tracelake.llm.common import worker_cache

#: Words kept by one Python worker; beyond that the tables start anew. It bounds memory, not results.
KEPT_WORDS = 1_200_000
#: Longer words are encoded each time they occur.
LONGEST_WORD = 200
_LAST_LATIN = "ɏ"

#: Marks of units that are more than a word behind a blank or a line end: a word without either, a run of white space.
BARE, RUN = "\x1d", "\x1e"
_MARKS = "\x1c\x1d\x1e\x1f"
#: White space that is more than one blank or one line end between two words.
_RUNS = re.compile(r"\s{2,}|[^\S \n]|\s\Z")
_HIDE = str.maketrans(" \n", "\x1f\x1c")
_SHOW = str.maketrans("\x1f\x1c", " \n")


def _run(match: re.Match) -> str:
    """White space as units behind blanks, so that the text can be split at its blanks."""
    run = match[0]
    if match.end() == len(match.string):
        return f" {RUN}{run.translate(_HIDE)}"
    head = f" {RUN}{run[:-1].translate(_HIDE)}" if len(run) > 1 else ""
    last = run[-1]
    if last in " \n":
        return head + last
    return f"{head} {RUN}{last} {BARE}"


def units(text: str) -> list[str]:
    """Units of a text without marks: words (behind a line end with ``\\n`` in front), ``BARE`` words and ``RUN``s."""
    parts = _RUNS.sub(_run, text).replace("\n", " \n").split(" ")
    if text[:1].isspace():
        return parts[1:]
    parts[0] = BARE + parts[0]
    return parts


class WordEncoder:
    """Ids as little-endian unsigned 32-bit numbers, joined to bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.np = np
        self.library = Tokenizer.from_file(path)
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.line_bytes = np.array(line, dtype="<u4").tobytes()
        self.whole_only = [t.content for t in self.library.get_added_tokens_decoder().values()] + list(_MARKS)
        self.words: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return self.np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a missing text counts as empty."""
        texts = [t or "" for t in texts]
        if self.line is None:
            return [self.whole(t) for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        if len(self.tails) > KEPT_WORDS // 10:
            self.tails.clear()
        out: list[bytes] = [b""] * len(texts)
        plain, marked = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(s in t for s in self.whole_only):
                out[i] = self.whole(t)
            elif "\n\n" in t or "  " in t or "\t" in t or "\r" in t:
                marked.append(i)
            else:  # A line end becomes a word that starts with it; the one put before the first word is cut off again.
                plain.append((i, ("\n" + t).replace("\n", " \n").split(" ")[1:]))
        for (i, _), found in zip(plain, self._found([words for _, words in plain])):
            try:
                out[i] = b"".join(found)[4:]
            except TypeError:  # a word that is no unit of its own, or a long one
                marked.append(i)
        split = [units(texts[i]) for i in marked]
        for i, words, found in zip(marked, split, self._found(split)):
            try:
                out[i] = b"".join(found)
            except TypeError:
                out[i] = b"".join(self._alone(w) if ids is None else ids for w, ids in zip(words, found))
        return out

    def _found(self, parts: list[list[str]]) -> list[list[bytes | None]]:
        """Ids of each unit, ``None`` for those that are not kept. Units met before are looked up once."""
        get, known = self.words.get, self.words
        found = [list(map(get, words)) for words in parts]
        gaps = [[i for i, ids in enumerate(row) if ids is None] for row in found]
        self._learn({words[i] for words, gap in zip(parts, gaps) for i in gap})
        for words, row, gap in zip(parts, found, gaps):
            for i in gap:
                row[i] = known[words[i]]
        return found

    def _alone(self, word: str) -> bytes:
        """Ids of a unit that is not kept."""
        if word[0] == RUN:
            return self.whole(word[1:].translate(_SHOW))
        if word[0] == BARE:
            return self.whole(word[1:])
        return self.whole(word if word[0] == "\n" else " " + word)

    def _learn(self, fresh: set[str]) -> None:
        known = self.words
        cut, wanted, letters = [], set(), set(filter(str.isalpha, fresh))  # letters behind a blank are what the library encodes
        for word in [w for w in letters if len(w) > LONGEST_WORD]:
            letters.remove(word)
            known[word] = None
        for word in filterfalse(str.isalpha, fresh):
            head = word[:1]
            if head == RUN:
                known[word] = self._alone(word) if len(word) <= LONGEST_WORD else None
                continue
            front = "\n" if head in ("\n", BARE) else ""
            body = word[1:] if front else word
            if not body or len(body) > LONGEST_WORD or body.strip() != body:
                known[word] = None
                continue
            core = body.rstrip(string.punctuation)
            if core == body or not core or core[-1] > _LAST_LATIN or not core[-1].isalpha():
                core, tail = body, ""
            else:  # letters end before punctuation in every case
                tail = body[len(core) :]
                if tail not in self.tails:
                    self.tails[tail] = self.whole(tail)
            core = front + core
            wanted.add(core)
            if tail or head == BARE:
                cut.append((word, core, tail))
        self._encode_cores([*letters, *(c for c in wanted if c not in known and c not in letters)])
        for word, core, tail in cut:
            if word[:1] == BARE:
                known[word] = known[core][4:] + (self.tails[tail] if tail else b"")
            else:
                known[word] = known[core] + self.tails[tail]

    def _encode_cores(self, cores: list[str], step: int = 100) -> None:
        """Many cores in one call, each behind a line end, whose id marks where the one before ends.

        Calls of some hundred words cost less for each than longer ones, whose offsets no cache holds.

        A core that starts a line has no blank in front; every other one has.
        """
        np, known = self.np, self.words
        for i in range(0, len(cores), step):
            some = cores[i : i + step]
            joined = "".join(c if c[0] == "\n" else "\n " + c for c in some)
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(ids == self.line).tolist()
            if len(starts) != len(some):  # the special token's string is part of a word
                known.update((c, self.whole(c if c[0] == "\n" else " " + c)) for c in some)
                continue
            raw = ids.tobytes()
            for core, start, end in zip(some, starts, [*starts[1:], len(ids)]):
                known[core] = raw[4 * (start if core[0] == "\n" else start + 1) : 4 * end]


def encoder(path: str) -> WordEncoder:
    return worker_cache(f"encoder:{path}", lambda: WordEncoder(path))


def slices(texts: list, most: int = 2_000_000):
    """Ranges of a batch with about ``most`` characters each, so that a batch's words are never all held at once."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
