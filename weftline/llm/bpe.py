"""Byte-level BPE as a streaming transducer with a bounded lookahead.

Whether two neighbouring symbols merge can depend on what follows, but only
through a chain of merges of ever lower rank. The longest such chain, in bytes,
is worked out from the merge list: a token that lies further than that from the
end of what has been read can no longer change and is emitted. Memory is the
lookahead, however long a text or a word is. Decoding feeds the tokens' bytes to
an incremental UTF-8 machine.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a text before merging (fixed value: the vocabulary's own pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Text that is read at once, in characters; a piece that reaches its end waits for more.
SEGMENT = 1 << 14

#: Where single blanks part a text, no piece crosses them. Found: a blank beside other white space, or at the end.
_UNEVEN = re.compile(r"\s | \s| $")

_PIECES = regex.compile(PATTERN)
_SAME = {kind: regex.compile(p) for kind, p in (("letter", r"\p{L}+"), ("digit", r"\p{N}+"), ("space", r"\s+"), ("other", r"[^\s\p{L}\p{N}]+"))}


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


#: A merge as one number: its rank above the id that it makes; and the number of a pair that doesn't merge.
_IDS, _NONE = (1 << 24) - 1, 1 << 62


class Vocabulary:
    """A byte-level BPE vocabulary file: token ids, merge ranks, added tokens, and the lookahead that its merges need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, names = spec["model"], byte_names()
        as_bytes = lambda token: bytes(names[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: as_bytes(t) for t, i in model["vocab"].items() if t not in self.added}
        self.token |= {i: bytes(names[c] for c in t) if all(c in names for c in t) else t.encode() for t, i in self.added.items()}
        ids = model["vocab"]
        self.of_byte = [ids.get(c, -1) for c, _ in sorted(names.items(), key=lambda x: x[1])]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.packed = {pair: rank << 24 | made for pair, (rank, made) in self.merge.items()}
        self.lookahead = self._lookahead()
        self.split_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def _lookahead(self) -> int:
        """Bytes beyond a token's end that can still decide about it.

        A merge (x, y) can be prevented only if y, or the right part of what
        made y at the rank that made it, merges to its right earlier. So the
        reach of a merge is the furthest reach of the earlier merges whose left
        part is y, or of those that could have broken y up; ranks only fall
        along a chain. from_left[s]: furthest reach of the merges so far with s
        on the left; inner[s]: what could have kept s from being made.
        """
        from_left: dict[int, int] = {}
        inner: dict[int, int] = {}
        for (a, b), (_, made) in sorted(self.merge.items(), key=lambda x: x[1][0]):
            reach = max(from_left.get(b, 0), inner.get(b, 0))
            inner[made] = max(inner.get(made, 0), reach)
            from_left[a] = max(from_left.get(a, 0), len(self.token[b]) + reach)
        return max([0, *from_left.values(), *inner.values()])


class Transducer:
    """Feeds bytes of one piece and emits the ids that are final; flush() ends the piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.open = b""
        self.window = 2 * vocabulary.lookahead + 1

    def merged(self, data: bytes) -> list[int]:
        """Ids of data on its own: the lowest rank first, the leftmost of equals."""
        get, none = self.v.packed.get, _NONE
        ids = [self.v.of_byte[b] for b in data]
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            ids[i] = made = best & _IDS
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], made), none)
            if i < len(pairs):
                pairs[i] = get((made, ids[i + 1]), none)
        return ids

    def feed(self, data: bytes) -> Iterator[int]:
        for a in range(0, len(data), self.window):
            self.open += data[a : a + self.window]
            if len(self.open) >= self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        at, size = 0, len(self.open)
        for i in self.merged(self.open):
            end = at + len(self.v.token[i])
            if size - end < self.v.lookahead:
                break
            yield i
            at = end
        self.open = self.open[at:]

    def flush(self) -> list[int]:
        ids = self.merged(self.open)
        self.open = b""
        return ids


class _Memo(dict):
    """Remembers what it has made for keys that are letters only or short. When it is full, what was not used since it was last full is forgotten."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= 48 and (key.isalpha() or len(key) <= 3):
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


def _packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Encodes texts. Ids, four bytes each, of short pieces are remembered within a bounded memory."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 400_000):
        self.v = vocabulary
        self.transducer = Transducer(vocabulary)
        self.known = _Memo(self._piece, limit // 4)
        self.blanked = _Memo(self._blanked, limit)

    def _piece(self, piece: str) -> bytes:
        """Ids of one whole piece, which the transducer takes in and ends."""
        return _packed([*self.transducer.feed(piece.encode("utf-8", "surrogatepass")), *self.transducer.flush()])

    def _blanked(self, word: str) -> bytes:
        """Ids of a blank and a run without blanks; words of letters, or with one mark behind, need no splitting."""
        if word.isalpha():
            return self._piece(" " + word)
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.blanked[word[:-1]] + self.known[word[-1]]
        return b"".join([self.known[p] for p in _PIECES.findall(" " + word)])

    def piece(self, piece: str) -> Iterable[int]:
        return np.frombuffer(self.known[piece], dtype=np.uint32).tolist()

    def plain(self, segments: Iterable[str]) -> Iterator[int]:
        """Ids of a text without added tokens that arrives in segments, cut anywhere."""
        held, run = "", None
        for segment in segments:
            text = held + segment
            if run is not None:  # inside a piece that is longer than a segment
                m = _SAME[run].match(text)
                same = m.end() if m else 0
                if same == len(text):
                    keep = 1 if run == "space" else 0
                    yield from self.transducer.feed(text[: len(text) - keep].encode("utf-8", "surrogatepass"))
                    held = text[len(text) - keep :]
                    continue
                if run == "space":  # the last blank belongs to what follows
                    same = max(0, same - 1)
                yield from self.transducer.feed(text[:same].encode("utf-8", "surrogatepass"))
                yield from self.transducer.flush()
                text, run = text[same:], None
            found = _PIECES.findall(text)
            # the last piece may go on, and what precedes it may have been cut by it
            tail = found[-2:] if len(found) > 1 else found
            for p in found[: len(found) - len(tail)]:
                yield from self.piece(p)
            held = "".join(tail)
            if len(held) >= max(SEGMENT, 16):
                yield from (i for p in tail[:-1] for i in self.piece(p))
                held = last = tail[-1]
                if len(last) >= 8:  # longer than any contraction, whose mark and letters may lie apart
                    run = next(k for k, c in _SAME.items() if c.fullmatch(last[-1]))
                    keep = 1 if run == "space" else 0
                    yield from self.transducer.feed(last[: len(last) - keep].encode("utf-8", "surrogatepass"))
                    held = last[len(last) - keep :]
        if run is not None:
            yield from self.transducer.feed(held.encode("utf-8", "surrogatepass"))
            yield from self.transducer.flush()
        else:
            for p in _PIECES.findall(held):
                yield from self.piece(p)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of added tokens become their ids."""
        return np.frombuffer(b"".join(self.chunks(text)), dtype=np.uint32).tolist()

    def chunks(self, text: str) -> Iterator[bytes]:
        """Ids of a text as they become final, four bytes per id in the machine's order, at most a few segments' worth at once."""
        at = 0
        for m in self.v.split_added.finditer(text) if self.v.split_added else ():
            yield from self._between(text, at, m.start())
            yield _packed([self.v.added[m[0]]])
            at = m.end()
        yield from self._between(text, at, len(text))

    def _between(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Chunks of text[at:end], which holds no added token. Read in segments that end before a single blank; where there is none, cut anywhere."""
        while at < end:
            cut = _cut(text, at, min(end, at + SEGMENT)) if end - at > SEGMENT else end
            if cut > at:
                yield self._segment(text[at:cut])
                at = cut
                continue
            stop = at + SEGMENT  # no blank to cut at: pieces may be longer than a segment
            while stop < end and (cut := _cut(text, stop - 1, min(end, stop + SEGMENT), False)) <= stop - 1:
                stop = min(end, stop + SEGMENT)
            stop = max(cut, stop) if stop < end else end
            some: list[int] = []
            for i in self.plain(text[k : min(stop, k + SEGMENT)] for k in range(at, stop, SEGMENT)):
                some.append(i)
                if len(some) >= SEGMENT:
                    yield _packed(some)
                    some = []
            yield _packed(some)
            at = stop

    def _segment(self, text: str) -> bytes:
        known, blanked = self.known, self.blanked
        if _UNEVEN.search(text):
            return b"".join([known[p] for p in _PIECES.findall(text)])
        first, *rest = text.split(" ")
        return b"".join([*[known[p] for p in _PIECES.findall(first)], *[blanked[w] for w in rest]])


def _cut(text: str, low: int, high: int, last: bool = True) -> int:
    """The last place in (low, high), or the first, where a single blank stands between characters that aren't white space; low if there is none."""
    at = high - 1 if last else low
    while True:
        at = text.rfind(" ", low + 1, at) if last else text.find(" ", at + 1, high - 1)
        if at < 0:
            return low
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            return at


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> Iterator[str]:
    """Text of ids, token by token; bytes that are not UTF-8 become U+FFFD. An id that is not known is skipped."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    token = vocabulary.token
    for i in ids:
        if text := machine.decode(token.get(i, b"")):
            yield text
    if text := machine.decode(b"", True):
        yield text


class Digests:
    """Takes in a text's ids as they are emitted: their number, their digest and that of the text that they decode to."""

    def __init__(self, token: dict[int, bytes]):
        self.token, self.n = token, 0
        self.ids, self.shown = hashlib.sha256(), hashlib.sha256()
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def take(self, chunk: bytes) -> None:
        ids = np.frombuffer(chunk, dtype=np.uint32)
        self.n += len(ids)
        self.ids.update(ids.astype("<u4", copy=False).tobytes())
        token = self.token
        self.shown.update(self.machine.decode(b"".join([token[i] for i in ids.tolist()])).encode())

    def end(self) -> tuple[int, str, str]:
        self.shown.update(self.machine.decode(b"", True).encode())
        return self.n, self.ids.hexdigest(), self.shown.hexdigest()


def round_trip(text: Column, path: str, with_ids: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256[, ids]) of a text; a null text is empty. path must exist on every executor."""
    ids_type = ", ids array<int>" if with_ids else ""

    @F.pandas_udf(f"n_tokens bigint, ids_sha256 string, decoded_sha256 string{ids_type}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(path)
        encoder = Encoder(vocabulary)
        token = vocabulary.token
        for texts in batches:
            rows = []
            for text in texts:
                digests, all_ids = Digests(token), []
                for chunk in encoder.chunks(text or ""):
                    digests.take(chunk)
                    if with_ids:
                        all_ids.append(chunk)
                rows.append((*digests.end(), np.frombuffer(b"".join(all_ids), dtype=np.uint32).astype(np.int32)) if with_ids else digests.end())
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return run(text)
