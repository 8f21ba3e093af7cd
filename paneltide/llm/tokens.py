"""Token ids of texts by a public tokenizer file, with a bounded cache of words.

White space only separates words for the tokenizers this module accepts (it is removed
before the merges), so the ids of a text are those of its words one after another.  A
word's ids come from the tokenizers library once and are then looked up.
"""

from __future__ import annotations

import json
import os

import numpy as np

from paneltide.llm.common import worker_state

#: A worker keeps between one and two times so many words (about 140 bytes each), those
#: seen last.  Results do not depend on it.
KEPT_WORDS = 700_000
#: Stems encoded in one call of the library.
STEMS_A_CALL = 256
#: ASCII signs that the pre-tokenizer always cuts off a run of letters.
TAIL = b".,;:!?#*$%&|<>()"
#: First bytes of the marks that may join with a letter before them (U+0300 to U+036F).
MARKS = (b"\xcc", b"\xcd")


def _lowers(normalizer: dict | None) -> bool:
    """Does a tokenizer's normalizer lower all text?"""
    if not normalizer:
        return False
    return normalizer["type"] == "Lowercase" or any(map(_lowers, normalizer.get("normalizers") or []))


class WordEncoder:
    """Ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if not parts or parts[0].get("behavior") != "Removed" or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("this encoder needs a tokenizer that drops white space and marks word ends")
        self.tokenizer = Tokenizer.from_file(path)
        # Only then may a text be lowered before the library sees it.
        self.lowers = _lowers(spec.get("normalizer"))
        # Added tokens are matched on the raw text, in their own case.
        self.added = [t["content"].encode().lower() for t in spec.get("added_tokens") or [] if t["content"]]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _stems(self, stems: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs of letters; exactly one token of each ends a word, so many go in one call."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(stems), STEMS_A_CALL):
            part = stems[at : at + STEMS_A_CALL]
            text = b" ".join(part).decode()
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):
                out.update((s, self._whole(s)) for s in part)
                continue
            raw, begin = ids.tobytes(), 0
            for stem, cut in zip(part, cuts):
                out[stem] = raw[4 * begin : 4 * cut]
                begin = cut
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Bring words into ``young``: from ``old``, by their stem and tail, or by the library."""
        young, old = self.young, self.old
        new = []
        for word in words:
            ids = old.get(word)
            if ids is None:
                new.append(word)
            else:
                young[word] = ids
        stems, tailed = [], []
        for word in new:
            stem = word.rstrip(TAIL)
            if not (stem.isalpha() or stem.decode().isalpha()):
                young[word] = self._whole(word)
            elif len(stem) == len(word):
                stems.append(word)
            else:
                tailed.append((word, stem))
        asked = {s for _, s in tailed if s not in young}
        asked.update(stems)
        young.update(self._stems([s for s in asked if s not in old]))
        for word, stem in tailed:
            tail = word[len(stem) :]
            if tail not in young:
                young[tail] = self._whole(tail)
            young[word] = (young.get(stem) or old[stem]) + young[tail]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; none for NULL and empty texts."""
        raw = (text or "").encode()
        low = raw.lower()
        if any(token in low for token in self.added):
            return self._whole(raw)
        # If the tokenizer lowers all texts, doing it early makes fewer words.  It is left to the
        # library where a letter may join with a mark, since that comes before lowering.
        if self.lowers and MARKS[0] not in raw and MARKS[1] not in raw:
            raw = low
        words = raw.replace(b"\n", b" ").split(b" ")
        missing = set(words).difference(self.young)
        if missing:
            if len(self.young) > KEPT_WORDS:
                self.old, self.young = self.young, {b"": b""}
                missing = set(words)
            self._learn(missing)
        return b"".join(map(self.young.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; loaded once per process."""
    kept = worker_state().__dict__.setdefault("encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
