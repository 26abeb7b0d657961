"""Token ids and counts by a word-level BPE vocabulary file (operators 3 and 10 use this).

A text is cut at white space; each chunk goes through a table of chunks already
resolved. A chunk not in the table is cut into pre-tokens, and a pre-token that is proven to
be one whole token takes its id from the proof; only the others are merged by the library.
Texts with code points outside a plain range (where Python's and the library's case folding,
normal forms or white space could differ) go through the library as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
import regex

from .holding import held

#: Fixed value: the vocabulary's own pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Anything but plain Latin text; U+0130 is out since its lower case has two code points.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-įı-ɏ‐-‧€]")
#: Entries of a worker's table before it becomes the older one (memory bound, not a limit on words).
TABLE_ENTRIES = 150_000


def load(vocabulary: str):
    """The library's tokenizer from the text of a vocabulary file, without padding or truncation."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def prove_whole(vocabulary: str) -> dict[str, int]:
    """Vocabulary strings that, alone, are one pre-token and encode as their own single id.

    Every entry is tried with the library itself, so the table is a proof by exhaustion: pre-tokens
    are merged independently of their neighbours, so what holds alone holds in any text.
    """
    tokenizer = load(vocabulary)
    described = json.loads(vocabulary)
    suffix = described["model"].get("end_of_word_suffix") or ""
    special = {x["content"] for x in described["added_tokens"]}
    pattern = regex.compile(PRE_TOKEN)
    byte_of = {c: b for b, c in byte_alphabet().items()}
    words: list[str] = []
    for entry in described["model"]["vocab"]:
        if entry in special or not entry.endswith(suffix):
            continue
        raw = entry[: len(entry) - len(suffix)]
        try:
            word = bytes(byte_of[c] for c in raw).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if word and word == word.lower() and not UNUSUAL.search(word) and pattern.findall(word) == [word]:
            words.append(word)
    return {w: e.ids[0] for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False)) if len(e.ids) == 1}


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as byte-level vocabularies write bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, equal to the library's."""

    def __init__(self, vocabulary: str, whole: dict[str, int], entries: int = TABLE_ENTRIES):
        self.entries = entries
        self.tokenizer = load(vocabulary)
        self.pattern = regex.compile(PRE_TOKEN)
        described = json.loads(vocabulary)
        special = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.special = {s: i.to_bytes(4, "little") for s, i in special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.whole = {w: i.to_bytes(4, "little") for w, i in whole.items()}
        self.letters = byte_alphabet()
        self.four = [i.to_bytes(4, "little") for i in range(1 + max([*described["model"]["vocab"].values(), *special.values()], default=0))]
        # what was resolved lately, and what it replaced: a table that is full becomes the older one, and what is met again is taken over from there
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}

    def merged(self, word: str) -> bytes:
        """The ids of a pre-token: proven whole, resolved before, or by the library's merges, whose model takes bytes as characters."""
        known = self.whole.get(word) or self.words.get(word)
        if known is None:
            known = self.older_words.get(word)
            if known is None:
                four, raw = self.four, word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
                known = b"".join([four[x.id] for x in self.tokenizer.model.tokenize(raw)])
            self.words[word] = known
        return known

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of each of the chunks, which the table then has too."""
        if len(self.words) > self.entries:
            self.words, self.older_words = {}, self.words
        merged, whole, older, learned = self.merged, self.whole, self.older_chunks, {}
        for c in chunks:
            known = older.get(c)
            if known is not None:
                learned[c] = known
            elif c.isalpha():  # letters alone are one pre-token
                learned[c] = whole.get(c) or merged(c)
            elif c[:-1].isalpha():  # and so is one other character after them
                learned[c] = merged(c[:-1]) + merged(c[-1])
            else:
                learned[c] = b"".join([merged(w) for w in self.pattern.findall(c)])
        if len(self.chunks) + len(learned) > self.entries:
            self.chunks, self.older_chunks = dict(learned), self.chunks
        else:
            self.chunks.update(learned)
        return learned

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        parts: list[tuple[int, list[str]]] = []
        odd: list[int] = []
        unknown: set[str] = set()
        get = self.chunks.get
        kept: list[tuple[int, list[str], list[bytes | None]]] = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
                continue
            if (not text.isascii() and UNUSUAL.search(text)) or (text.isascii() and any(c in text for c in "\x00\x0b\x0c\x1c\x1d\x1e\x1f") and UNUSUAL.search(text)):
                odd.append(i)
                continue
            if self.at_special and "<|" in text and self.at_special.search(text):
                parts.append((i, self.at_special.split(text)))
                continue
            chunks = text.lower().split()
            ids = list(map(get, chunks))
            if None in ids:
                unknown.update([c for c, b in zip(chunks, ids) if b is None])
                kept.append((i, chunks, ids))
            else:
                out[i] = b"".join(ids)
        learned = self.learn(unknown) if unknown else {}
        for i, chunks, ids in kept:
            out[i] = b"".join([learned[c] if b is None else b for c, b in zip(chunks, ids)])
        for i, pieces in parts:
            done = []
            for p in pieces:
                if p in self.special:
                    done.append(self.special[p])
                    continue
                chunks = p.lower().split()
                ids = self.learn(set(chunks))
                done += [ids[c] for c in chunks]
            out[i] = b"".join(done)
        for i in odd:  # one at a time: a text's encoding is several times its size
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


def encoder(key: int, vocabulary: str, whole: dict[str, int], entries: int = TABLE_ENTRIES) -> Encoder:
    """One encoder per Python worker, so that later tasks of that worker start with a filled table."""
    return held(("encoder", key, entries), lambda: Encoder(vocabulary, whole, entries))


def slices(texts: Iterable[str | None], most_chars: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of consecutive texts of bounded size; a longer text is a range of its own."""
    lo = size = n = 0
    for n, t in enumerate(texts):
        size += len(t or "")
        if size > most_chars and n > lo:
            yield lo, n
            lo, size = n, len(t or "")
        n += 1
    if n > lo:
        yield lo, n


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file's text; its place is a parameter and it is read where the driver runs."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
