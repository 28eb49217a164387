"""Encoding whole texts with the `tokenizers` library, with a bounded cache of space-separated chunks.

A text's ids are the ids of its chunks put together when no pre-token crosses a cut. Both vocabularies used here allow cuts at white space:
the word-level one drops it; the byte-level one attaches one space to the word after it and keeps other single white-space characters as
pre-tokens of their own, while of a run before a word the last character stands apart and the rest is one pre-token.
Chunks that are new are encoded together, with a separator between them that forms a token of its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse
from string import ascii_uppercase

import numpy as np

from tracewright.llm.common import KEPT

#: Chunks kept per Python worker before the cache starts afresh; bounds memory at about 200 MB.
CACHE_ENTRIES = 1_000_000
#: New chunks encoded in one call.
LEARN = 20_000
#: Characters of texts whose new chunks are gathered before encoding.
BLOCK = 2_000_000
#: The characters with Unicode's White_Space property, as the vocabularies' patterns understand \\s.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f"([{WHITE}]{{2,}})")
ANY = re.compile(f"[{WHITE}]")
#: A key that ends in a Latin letter and one stop, which no pattern puts into one pre-token.
CLOSED = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f][.,]\\Z")
#: A text without any of these has no run of white space, and no white space but spaces and line breaks.
UNUSUAL = ["  ", "\n\n", "\n ", " \n", *(chr(c) for c in range(0x3001) if ANY.match(chr(c)) and chr(c) not in " \n")]


class Numbers(dict):
    """Keys numbered from 0 as they are met; `new` holds those whose ids are not known yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class Encoder:
    """ids(text) gives the ids as little-endian unsigned 32-bit integers, as Tokenizer.encode(text, add_special_tokens=False) would.

    Keys of the cache are words after a space. A key that begins with a line break stands for that and the word after it, one that begins with a null
    character for the literal characters after it. Texts that contain an added token of the vocabulary are encoded in one piece. Where the vocabulary does not
    tell A-Z from a-z, texts of ASCII characters are lower-cased first, so that a word has one key.
    """

    def __init__(self, path: str, keeps_space: bool, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space, self.entries = keeps_space, entries
        self.folds = not keeps_space and all(self.whole(c) == self.whole(c.lower()) for c in ascii_uppercase)
        #: ids of the stops that stand apart from a word before them.
        self.stops = {c: self.whole(c) for c in ".," if all(self.whole(w + c) == self.whole(w) + self.whole(c) for w in ("a", " a", "\xe9", " \xe9"))}
        self._forget()
        self.separator = "\n" if keeps_space else "|"
        self.newline = self.whole("\n")
        self.mark = int(np.frombuffer(self.whole(self.separator), "<u4")[0])

    def _forget(self) -> None:
        """An empty cache: numbered keys; `held` has the ids of all keys one after the other, `sizes` and `starts` say which are a key's."""
        self.cache, self.used = Numbers(), 0
        self.held, self.sizes, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return next(self.batch([text]))

    def words(self, text: str) -> list[str] | None:
        """The keys that a text is made of; None if it has to be encoded in one piece."""
        if self.folds and text.isascii():
            text = text.lower()
        if any(token in text for token in self.added) or "\0" in text:
            return None
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        if not text:
            return []
        if not any(x in text for x in UNUSUAL) and text[0] not in " \n":
            keys = text.replace("\n", " \n").split(" ")
            keys[0] = "\0" + keys[0]
            return keys
        out, held, parts = [], "", RUN.split(text)
        for k in range(0, len(parts), 2):
            out += self._lines(held + parts[k])
            run, held = parts[k + 1] if k + 1 < len(parts) else "", ""
            if run and k + 2 < len(parts) and parts[k + 2]:
                out.append("\0" + run[:-1])
                if run[-1] == " ":
                    held = " "
                else:
                    out.append("\0" + run[-1])
            elif run:
                out.append("\0" + run)
        return out

    def _lines(self, text: str) -> list[str]:
        """Keys of a text without runs of white space."""
        if not text:
            return []
        if text[0] in " \n":
            return text.replace("\n", " \n").split(" ")[1:]
        if ANY.match(text):
            return ["\0" + text[0], *self._lines(text[1:])]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\0" + keys[0]
        return keys

    def _literal(self, key: str) -> str:
        """The characters that a key stands for."""
        if not self.keeps_space or key.startswith("\n"):
            return key
        return key[1:] if key.startswith("\0") else " " + key

    def learn(self) -> None:
        """Adds the ids of the new keys to the cache. Those whose word has no white space within are encoded together, each after a separator; a word with
        a stop behind it takes the ids of the word."""
        known = len(self.sizes)
        closed = [(key, self.cache[key[:-1]]) for key in self.cache.new[:] if key[-1:] in self.stops and CLOSED.search(key)]
        keys, self.cache.new = self.cache.new, []
        found, plain, pieces = {key: b"" for key, _ in closed}, [], []
        for key in filterfalse(found.__contains__, keys):
            body = key[1:] if self.keeps_space and key[:1] in ("\0", "\n") else key
            if body and not ANY.search(body) and (self.keeps_space or "|" not in body):
                plain.append(key)
                pieces.append(body if body is not key else " " + body if self.keeps_space else f" {body} ")
            else:
                found[key] = self.whole(self._literal(key))
        for start in range(0, len(plain), LEARN):
            part = plain[start : start + LEARN]
            text = self.separator + self.separator.join(pieces[start : start + LEARN])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts, raw = (4 * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes()
            if len(cuts) == len(part):
                pairs = zip(part, [raw[a + 4 : b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)], strict=True)
                found.update((key, self.newline + x if key[0] == "\n" else x) for key, x in pairs)
            else:
                found.update((key, self.whole(self._literal(key))) for key in part)
        for key, n in closed:
            word = found[key[:-1]] if n >= known else self.held[self.starts[n] : self.starts[n] + self.sizes[n]].tobytes()
            found[key] = word + self.stops[key[-1]]
        ordered = [found[key] for key in keys]
        ids = np.frombuffer(b"".join(ordered), "<u4")
        if self.used + len(ids) > len(self.held):
            self.held = np.concatenate([self.held[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.held[self.used : self.used + len(ids)] = ids
        sizes = np.fromiter(map(len, ordered), np.int64, len(ordered)) // 4
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(ids)

    def batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """ids of each text; the new chunks of a block of texts are encoded together."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size > BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.cache) > self.entries:
            self._forget()
        split = [self.words(text) for text in texts]
        counts = np.fromiter((len(keys or ()) for keys in split), np.int64, len(split))
        numbers = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(keys for keys in split if keys)), np.int64, int(counts.sum()))
        if self.cache.new:
            self.learn()
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.held[np.repeat(self.starts[numbers] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        for text, keys, a, b in zip(texts, split, cuts, cuts[1:], strict=False):
            yield self.whole(text) if keys is None else ids[a:b].astype("<u4", copy=False).tobytes()


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = (path, keeps_space)
    if key not in KEPT:
        KEPT[key] = Encoder(path, keeps_space)
    return KEPT[key]
