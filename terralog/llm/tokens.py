"""Token ids of whole texts by a given tokenizer file, with the ids of words remembered between texts.

The tokenizers library encodes each distinct word once a worker; a text's ids are its words' ids in order. That is exact
where words never share a token: after single spaces and line ends in a byte-level tokenizer without a normaliser, and at
any white space in one that drops it. Other texts, those with a special token's string, and files of another kind, are
encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Words remembered at most; then the memory is emptied. Characters of text worked on at once.
MOST_WORDS = 1_000_000
STEP_CHARS = 4_000_000
#: Unseen words joined into one call of the tokenizer.
JOINED = 1000

#: A word of Latin letters, then punctuation that no tokenizer rule joins to letters.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!*$&%#;:?|]*)")
ODD_SPACE = re.compile(r"[^\S \n\t\r]")


def _spaces_drop(text: str) -> bool:
    """Whether all white space is of the kinds on which Python and the tokenizer agree; printable text has no other."""
    return text.replace("\n", "").isprintable() or not ODD_SPACE.search(text)


def _single_spaces(text: str) -> bool:
    """Whether all white space is single spaces and line ends between other characters."""
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
        return False
    return text.replace("\n", "").isprintable() or not (ODD_SPACE.search(text) or "\t" in text or "\r" in text)


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write a byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        kinds = [x.get("type") for x in norm.get("normalizers", [])]
        self.kind = "whole"
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "spaced"
        elif kinds == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("invert") and pre["pretokenizers"][0].get("behavior") == "Removed":
            self.kind = "dropped"
        added = spec.get("added_tokens") or []
        self.marks = [t["content"] for t in added]  # the library turns these strings into one id wherever a text has them
        if any(t.get("normalized") for t in added):
            self.kind = "whole"
        self.words = Tokenizer(self.whole.model)  # for single words, already in byte letters
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if hasattr(self.words.model, "_resize_cache"):  # words come once, and keeping them costs more than it saves
            self.words.model._resize_cache(0)
        self.table = _byte_letters()
        self.tails: dict[str, bytes] = {}
        self.forget()
        self.line_end = self._encode(["\n"])[0] if self.kind == "spaced" else b""

    def _encode_words(self, words: list[str], space: str) -> list[bytes]:
        """Words of letters, each after ``space``; many to a call, as each call costs more than a word. Line ends stand between."""
        stop = self.table[10]
        (mark,) = self.words.encode(stop, add_special_tokens=False).ids
        joined = []
        for i in range(0, len(words), JOINED):
            raw = space + f"\n{space}".join(words[i : i + JOINED]) + "\n"
            joined.append(raw.encode().decode("latin-1").translate(self.table).replace(stop, f" {stop} "))
        out: list[bytes] = []
        for e in self.words.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == mark)
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *((ends[:-1] + 1) * 4).tolist()], (ends * 4).tolist(), strict=True)]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, ids)]) * 4
        raw = np.fromiter((x for i in ids for x in i), dtype="<u4", count=int(ends[-1] // 4)).tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def forget(self) -> None:
        """Empties the memory: words as an Arrow array, and of each the place and number of its ids among all."""
        self.known = pa.array([""], pa.string())
        self.flat, self.first, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of new words. One that starts with a line end stands first in its line, the others after a space."""
        space = " " if self.kind == "spaced" else ""
        match, memory = PLAIN.fullmatch, {}
        plain: tuple[set[str], set[str]] = set(), set()  # after a space, after a line end
        split: list[tuple[str, str, str]] = []
        other: list[str] = []
        for w in words:
            line = w[0] == "\n"
            if m := match(w, line):
                if tail := m[2]:
                    core = w[: m.end(1)]
                    split.append((w, core, tail))
                    plain[line].add(core)
                else:
                    plain[line].add(w)
            else:
                other.append(w)
        for line in (False, True):
            cores = list(plain[line])
            bare = [c[1:] for c in cores] if line else [c.lower() for c in cores] if self.kind == "dropped" else cores
            ids = self._encode_words(bare, "" if line else space)
            memory.update(zip(cores, (self.line_end + i for i in ids) if line else ids, strict=True))
        memory.update(zip(other, self._encode([w if w[:1] == "\n" else space + w for w in other]), strict=True))
        new = {t for *_, t in split if t not in self.tails}
        self.tails.update(zip(new, self._encode(list(new)), strict=True))
        memory.update((w, memory[c] + self.tails[t]) for w, c, t in split)
        return [memory[w] for w in words]

    def _places(self, words: pa.StringArray) -> np.ndarray:
        """Where in the memory each of some different words is; unknown ones are learnt first."""
        at = pc.index_in(words, value_set=self.known)
        if not at.null_count:
            return at.to_numpy()
        new = words.filter(at.is_null())
        ids = self._learn(new.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = at.fill_null(-1).to_numpy().copy()
        place[place < 0] = len(self.known) + np.arange(len(new))
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(size) - size]
        self.size, self.flat = np.r_[self.size, size], np.r_[self.flat, np.frombuffer(b"".join(ids), "<u4")]
        self.known = pa.concat_arrays([self.known, new])
        return place

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        """Arrow numbers the words of all texts and finds those that are known, and numpy lays out their ids."""
        if not texts:
            return
        if self.kind == "spaced":
            lists = pc.split_pattern(pa.array([f"\n{t}".replace("\n", " \n") for t in texts], pa.string()), " ")
        else:
            lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        words = lists.values.dictionary_encode()
        place = self._places(words.dictionary)[words.indices.to_numpy()]
        n = self.size[place]
        ends = np.cumsum(n)
        at = np.repeat(self.first[place] - (ends - n), n)
        at += np.arange(len(at))
        raw = self.flat[at].tobytes()
        bounds = 4 * np.r_[0, ends][lists.offsets.to_numpy()]
        skip = len(self.line_end) if self.kind == "spaced" else 0  # each text was given a line end before it
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield raw[x + skip : y]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            step, size = [], 0
            while at < len(texts) and (size < STEP_CHARS or not step):
                size += len(texts[at])
                step.append(texts[at])
                at += 1
            if len(self.known) > MOST_WORDS:
                self.forget()
            by_words = {"spaced": _single_spaces, "dropped": _spaces_drop}.get(self.kind, lambda _: False)
            fast = [i for i, t in enumerate(step) if t and not any(x in t for x in self.marks) and by_words(t)]
            slow = sorted({i for i, t in enumerate(step) if t} - set(fast))
            out = [b""] * len(step)
            for i, x in zip(fast, self._by_words([step[i] for i in fast]), strict=True):
                out[i] = x
            for i, x in zip(slow, self._encode([step[i] for i in slow]) if slow else [], strict=True):
                out[i] = x
            yield from out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)
