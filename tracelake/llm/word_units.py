"""Whole texts to token ids where the tokenizer drops white space: each word is a unit of its own, encoded once and kept."""

from __future__ import annotations

import re
import string

from tracelake.llm.common import worker_cache

#: Words kept by one Python worker; beyond that the table starts anew. It bounds memory, not results.
KEPT_WORDS = 1_500_000
#: Longer words are encoded where they stand and not kept.
LONGEST_WORD = 64
#: Characters whose words are held at a time.
SLICE = 2_000_000
MARK = "|"
_LAST_LATIN = "ɏ"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[\t-\r ]+")


class UnitEncoder:
    """Ids as little-endian unsigned 32-bit numbers, joined to bytes.

    For tokenizers that split at white space and drop it: no id depends on a neighbouring word, so texts with paragraphs, tabs
    and indents cost what others cost. A word's closing punctuation is a unit too (letters end before it), and so are its letters,
    in lower case.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.np = np
        self.library = Tokenizer.from_file(path)
        if self._library(["a b"]) != [b"".join(self._library(["a", "\n b\t"]))]:
            raise ValueError("a tokenizer that keeps white space")
        (self.mark,) = self.library.encode(MARK, add_special_tokens=False).ids
        self.words: dict[str, bytes] = {}

    def _library(self, units: list[str]) -> list[bytes]:
        return [self.np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a missing text counts as empty."""
        # The control characters among Python's white space are none to the tokenizer.
        split = [(_BLANKS.split(t) if _SEPARATORS.search(t) else t.split()) if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        known = self.words
        fresh: set[str] = set()
        for words in split:
            fresh.update(words)
        fresh.difference_update(known)
        long = self._learn(fresh)
        out = []
        for words in split:
            out.append(b"".join([known[w] if w in known else long[w] for w in words]) if long else b"".join(map(known.__getitem__, words)))
        return out

    def _learn(self, fresh: set[str]) -> dict[str, bytes]:
        """Adds the words to the table; returns those too long to be kept."""
        known, parts, cores, others, long = self.words, [], set(), set(), []
        for word in fresh:
            core = word.rstrip(string.punctuation)
            if not core.isalpha() or len(word) > LONGEST_WORD or (core != word and core[-1] > _LAST_LATIN):
                if len(word) > LONGEST_WORD:
                    long.append(word)
                else:
                    others.add(word)
                continue
            lower = core.lower() if core.isascii() else core
            cores.add(lower)
            tail = word[len(core) :]
            if tail:
                others.add(tail)
            if tail or lower is not word:
                parts.append((word, lower, tail))
        self._learn_letters([c for c in cores if c not in known])
        others = [u for u in others if u not in known]
        known.update(zip(others, self._library(others)))
        for word, lower, tail in parts:
            known[word] = known[lower] + known[tail] if tail else known[lower]
        return dict(zip(long, self._library(long))) if long else {}

    def _learn_letters(self, cores: list[str], step: int = 2000) -> None:
        """Many words of letters in one call, each before a mark whose id tells where it ends."""
        np = self.np
        for at in range(0, len(cores), step):
            some = cores[at : at + step]
            ids = np.frombuffer(self._library([f" {MARK} ".join([*some, ""])])[0], dtype="<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            raw, start = ids.tobytes(), 0
            for core, end in zip(some, ends):
                self.words[core] = raw[4 * start : 4 * end]
                start = end + 1

    def encode_each(self, column):
        """Ids of the texts of an Arrow column, a slice of it at a time."""
        texts, held = [], 0
        for text in column:
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held > SLICE:
                yield from self.encode(texts)
                texts, held = [], 0
        yield from self.encode(texts)


def unit_encoder(path: str) -> UnitEncoder:
    return worker_cache(f"units:{path}", lambda: UnitEncoder(path))
