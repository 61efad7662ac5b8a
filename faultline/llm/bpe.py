"""Exact byte-level BPE through the tokenizers library, with bounded memory.

``Encoder`` cuts a text before single spaces between visible characters.  No pre-token and no special
token can span such a place, so the pieces' encodings, joined, are the encoding of the whole text.
Words are remembered, up to a bound, and only new ones reach the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

REMEMBERED = 500_000     # words kept, about 110 MB a worker process
LONGEST = 64             # longer words are not kept
RENEWED = 1 << 31        # characters after which the memory is emptied, so that it follows the data


def vocabulary_path() -> str:
    """The default vocabulary (a parameter everywhere)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id.  Byte-level vocabularies write a byte as itself where it is printable
    and as the next unused character from 256 on otherwise; special tokens stand for their text."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    of_char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table: dict[int, bytes] = {i: bytes(of_char[c] for c in t) for t, i in spec["model"]["vocab"].items()
                               if all(c in of_char for c in t)}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    return np.array([len(b) for b in byte_table(path)], dtype=np.int64)


def pieces(text: str) -> list[str]:
    """Cut before every single space that stands between two visible characters."""
    parts = text.split(" ")
    out, held = [], parts[0]
    for p in parts[1:]:
        if p and held and not p[0].isspace() and not held[-1].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    out.append(held)
    return out


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lengths = byte_lengths(path)
        self.known: dict[str, bytes] = {}   # word -> ids of the word with a space before it
        self.seen = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of ``" " + word`` for visible words: encoded as one text, then cut at the words' ends."""
        out: list[bytes] = []
        for at in range(0, len(words), 512):
            spaced = [" " + w for w in words[at:at + 512]]
            # The batch call leaves out the offsets of tokens in the text, which nobody asks for.
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in spaced])
            reach = np.cumsum(self.lengths[ids])
            cut = np.searchsorted(reach, ends)
            if len(reach) == 0 or cut[-1] >= len(reach) or not np.array_equal(reach[cut], ends):
                out += self._library(spaced)
                continue
            raw, stop = ids.tobytes(), (4 * (cut + 1)).tolist()
            out += [raw[a:b] for a, b in zip([0, *stop], stop)]
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text as an array of unsigned 32-bit integers."""
        self.seen += sum(map(len, texts))
        if self.seen > RENEWED:
            self.known.clear()
            self.seen = 0
        heads, cut = [], []
        for t in texts:
            if t[:1] == " " and not t[1:2].isspace():
                heads.append("")
                cut.append(t[1:].split(" "))
            else:
                head, *words = t.split(" ")
                heads.append(head)
                cut.append(words)
        known = self.known
        unknown = set().union(*cut).difference(known)
        odd = {w for w in unknown if not w or w[0].isspace() or w[-1].isspace()}
        new = list(unknown - odd)
        known.update(zip(new, self._words(new)))
        odd_heads = {h for h in heads if h and h[-1].isspace()}
        by_piece = {}
        if odd or odd_heads:
            by_piece = {i: pieces(t) for i, (t, h, words) in enumerate(zip(texts, heads, cut))
                        if h in odd_heads or not odd.isdisjoint(words)}
        rest = {h for i, h in enumerate(heads) if i not in by_piece}
        rest.update(p for ps in by_piece.values() for p in ps if p[:1] != " " or p[1:] not in known)
        todo = [p for p in rest if p]
        other = {"": b"", **dict(zip(todo, self._library(todo)))}
        get = known.__getitem__
        out = []
        for i, (head, words) in enumerate(zip(heads, cut)):
            if i in by_piece:
                raw = b"".join(other[p] if p in other else known[p[1:]] for p in by_piece[i])
            else:
                raw = other[head] + b"".join(map(get, words))
            out.append(np.frombuffer(raw, dtype="<u4"))
        full = len(known) > REMEMBERED
        for w in new:
            if full or len(w) > LONGEST:
                del known[w]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes that the ids stand for, special tokens included."""
    return b"".join(map(table.__getitem__, ids.tolist()))


def text_groups(texts: Iterable, chars: int = 1 << 22) -> Iterable[list[str]]:
    """Whole texts (null: empty) in groups of about ``chars`` characters, to bound what is held at once."""
    group, size = [], 0
    for t in texts:
        t = t.as_py() if hasattr(t, "as_py") else t
        group.append(t or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group
