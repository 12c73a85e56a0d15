"""Whole texts to token ids and token places, through a memory of words.

For a tokenizer that drops white space before anything else looks at the text (a normaliser and a
pre-tokenizer that work inside words), the ids of a text are those of its words in turn. Words come back
all the time, so most are looked up and only new ones are encoded, many at once. The tokenizer itself says
whether it is of that kind (``by_words``); others encode each text as a whole. A word's letters and the
punctuation after them are remembered apart only where the tokenizer's own rules part that very word there.
"""

from __future__ import annotations

import contextlib
import json
import os
from array import array
from itertools import filterfalse

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already

from tokenizers import Tokenizer  # noqa: E402

_MARKS = b".,;:!?*&%$#|"
_LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _keeps_to_words(normalizer: dict) -> bool:
    """Whether a normaliser's rule does the same to a text as to its words one by one."""
    if normalizer["type"] != "Replace":
        return normalizer["type"] in ("NFC", "Lowercase")
    # of replacements, only that of white space by white space is known to stay between words
    return normalizer["pattern"] in ({"Regex": r"\s+"}, {"Regex": r"\s"}) and normalizer["content"] == " "


def drops_space(spec: dict) -> bool:
    """Whether no token and no rule of this tokenizer looks across ASCII white space. In doubt: no."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    removes = first.get("type") in ("Whitespace", "WhitespaceSplit") or (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"\s" not in first["pattern"].get("Regex", r"\s").replace(r"^\s", ""))
    norm = spec.get("normalizer") or {}
    norms = norm.get("normalizers", [norm]) if norm else []
    prefix = any(p.get("add_prefix_space") for p in pre.get("pretokenizers", [pre]))
    return bool(removes) and all(map(_keeps_to_words, norms)) and not prefix and not spec.get("post_processor")


class Encoder:
    """Encodes with one tokenizer file. limit: words remembered before the memory starts afresh."""

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        # strings that the tokenizer takes out of a text before it looks at words; one of them can part words in a batch
        added = [t for t in spec.get("added_tokens", []) if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        self.by_words = drops_space(spec) and bool(added) and len(added) == len(spec["added_tokens"])
        # no two words that differ in the case of ASCII letters only have different ids
        norm = spec.get("normalizer") or {}
        self.folds = "Lowercase" in {n["type"] for n in norm.get("normalizers", [norm]) if n}
        self.heads = sorted({t["content"][:2].encode() for t in added})
        if self.by_words:
            self.between, self.between_id = added[0]["content"], added[0]["id"]
        pre = spec.get("pre_tokenizer") or {}
        first, *others = pre.get("pretokenizers") or [pre]
        # this rule takes all letters there are, and all that follows them but letters, digits and white space: marks after an ASCII letter are a piece
        self.parts_marks = first.get("pattern") == {"Regex": _LETTERS_APART}
        # with it, and bytes for characters at most, a word of ASCII letters comes to the model as it is: one piece, which no normaliser has changed
        self.letters_whole = self.by_words and self.parts_marks and all(p["type"] == "ByteLevel" and not p.get("use_regex", True) for p in others)
        self.limit = limit
        self.marks: dict[str, list[str]] = {}
        self.ids: dict[bytes, bytes] = {}
        self.places: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Empty the memory of words."""
        self.ids, self.places, self.marks = {}, {}, {}

    def _split(self, text: str | None) -> list[bytes] | None:
        """The words, or None if the text may hold special strings and must be encoded as it is."""
        data = (text or "").encode()
        for head in self.heads:
            if head in data:
                return None
        return (data.lower() if self.folds else data).split()

    def _known(self, memory: dict[bytes, bytes], split: list[list[bytes] | None]) -> list[list[bytes] | None]:
        """What is remembered of each word, after what was missing has been learnt."""
        if len(memory) > self.limit:
            memory.clear()
        get, out, gaps, new = memory.get, [], [], set()
        for words in split:
            got = None if words is None else list(map(get, words))
            out.append(got)
            gap = [i for i, g in enumerate(got) if g is None] if got and None in got else []
            gaps.append(gap)
            new.update([words[i] for i in gap])
        if new:
            self._learn(memory, new)
            for words, got, gap in zip(split, out, gaps, strict=True):
                for i in gap:
                    got[i] = memory[words[i]]
        return out

    def _learn(self, memory: dict[bytes, bytes], new: set[bytes]) -> None:
        plain, parted = [], []
        for w in new:
            core = w.rstrip(_MARKS)
            ends = core[-1:].isalpha()
            if core and len(core) < len(w) and (self.parts_marks and ends or (ends or core[-8:].decode(errors="ignore")[-1:].isalpha()) and self._parts(w.decode(), core.decode())):
                parted.append((w, core, w[len(core) :]))
            else:
                plain.append(w)
        parts = {p for _, core, marks in parted for p in (core, marks)}
        plain += parts.difference(memory, plain)
        learn = self._learn_places if memory is self.places else self._learn_ids
        for i in range(0, len(plain), 4000):
            learn(plain[i : i + 4000])
        for w, core, marks in parted:
            tail = memory[marks]
            if memory is self.places:
                tail = (np.frombuffer(tail, "<u4").reshape(-1, 3) + np.array([0, n := len(core.decode()), n], "<u4")).tobytes()
            memory[w] = memory[core] + tail

    def _pieces(self, word: str) -> list[tuple[str, tuple[int, int]]]:
        """What the model sees of a word, piece by piece."""
        if self.tokenizer.normalizer is not None:
            word = self.tokenizer.normalizer.normalize_str(word)
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(word)

    def _parts(self, word: str, core: str) -> bool:
        """Whether the pieces of ``word`` are those of ``core`` and then those of what follows it."""
        marks = word[len(core) :]
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = [p for p, _ in self._pieces(marks)]
        whole, head = self._pieces(word), self._pieces(core)
        return whole[: len(head)] == head and [p for p, _ in whole[len(head) :]] == self.marks[marks]

    def _learn_ids(self, words: list[bytes]) -> None:
        if self.letters_whole:
            pieces, ids = self.tokenizer.model.tokenize, self.ids
            for w in filter(bytes.isalpha, words):
                ids[w] = array("I", [t.id for t in pieces(w.decode())]).tobytes()
            words = list(filterfalse(bytes.isalpha, words))
            if not words:
                return
        (out,) = self.tokenizer.encode_batch_fast([self.between.join([w.decode() for w in words])], add_special_tokens=False)
        ids = np.array(out.ids, "<u4")
        cut = np.flatnonzero(ids == self.between_id)
        data = ids.tobytes()
        for w, a, b in zip(words, [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(data)], strict=True):
            self.ids[w] = data[a:b]

    def _learn_places(self, words: list[bytes]) -> None:
        """id, begin and end of each token, in code points of the word."""
        texts = [w.decode() for w in words]
        (out,) = self.tokenizer.encode_batch([self.between.join(texts)], add_special_tokens=False)
        rows = np.empty((len(out), 3), "<u4")
        rows[:, 0], rows[:, 1:] = out.ids, out.offsets
        cut = np.flatnonzero(rows[:, 0] == self.between_id)
        rows[cut] = 0
        first = np.cumsum([0, *(len(t) + len(self.between) for t in texts[:-1])])
        rows[:, 1:] -= np.repeat(first, np.diff([0, *(cut + 1), len(rows)])).astype("<u4")[:, None]
        data = rows.tobytes()
        for w, a, b in zip(words, [0, *(12 * cut + 12).tolist()], [*(12 * cut).tolist(), len(data)], strict=True):
            self.places[w] = data[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit numbers. Null: none."""
        split = [self._split(t) if self.by_words else None for t in texts]
        known = self._known(self.ids, split)
        return [b"".join(got) if got is not None else array("I", self.tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes() for t, got in zip(texts, known, strict=True)]

    def encode_with_places(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, places) of each text; places: first code point and the one after the last, a row for each token."""
        split = [self._split(t) if self.by_words else None for t in texts]
        out = []
        for text, got in zip(texts, self._known(self.places, split), strict=True):
            if got is None:
                e = self.tokenizer.encode(text or "", add_special_tokens=False)
                out.append((np.array(e.ids, "<u4"), np.array(e.offsets, np.int64).reshape(-1, 2)))
                continue
            rows = np.frombuffer(b"".join(got), "<u4").reshape(-1, 3).astype(np.int64)
            points = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
            space = np.ones(len(points) + 1, bool)
            space[1:] = (points < 128) & _SPACE[np.minimum(points, 127)]
            starts = np.flatnonzero(space[:-1] & ~space[1:])
            out.append((rows[:, 0].astype("<u4"), rows[:, 1:] + np.repeat(starts, [len(g) // 12 for g in got])[:, None]))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a file; Python workers live on between tasks, and so does the loaded tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@contextlib.contextmanager
def encoding(path: str):
    """The encoder for one task. Its memory of words goes at the end: an idle worker would hold it through later stages of other work."""
    held = encoder(path)
    try:
        yield held
    finally:
        held.forget()
