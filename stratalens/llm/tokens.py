"""Token counts and ids of whole texts as a byte-level BPE tokenizer's library gives them.

Huge documents are encoded in overlapping chunks and spliced where both encodings have a pre-token boundary that no
later text can move.  Of other documents each distinct pre-token is encoded by the library once and remembered; what is
remembered is compared with the text, letter by letter, before its ids are used.
"""

from __future__ import annotations

import json
import os
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import prepare

#: Texts of at least so many characters are encoded in overlapping chunks.
LONG_CHARS = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: The pattern looks at most so far past the end of a match.
LOOK_AHEAD = 3
BATCH_CHARS = 1 << 19
#: Distinct pre-tokens, and characters of them, that are remembered at once; then the memory is emptied and filled anew.
REMEMBERED, REMEMBERED_CHARS = 1_200_000, 1 << 24
#: Words that the library gets at once.
WORDS_AT_ONCE = 2048
#: A text with a longer pre-token goes to the library whole.
LONGEST = 128
SPACE, LETTER, NUMBER, OTHER, END, UNSURE = 1, 2, 3, 4, 0, 255


@lru_cache(1)
def _classes() -> np.ndarray:
    """Classes of the code points of Latin scripts and general punctuation; of others the library decides."""
    out = np.full(0x2070, UNSURE, np.uint8)
    for c in [*range(0x250), *range(0x2000, 0x2070)]:
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
        if c in (9, 10, 11, 12, 13, 32, 0xA0, 0x2028, 0x2029, 0x202F, 0x205F) or 0x2000 <= c <= 0x200A:
            out[c] = SPACE
        if 0x1C <= c <= 0x1F or c == 0x85 or kind == "Cn":
            out[c] = UNSURE
    return out


@lru_cache(1)
def _random() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 0x2070, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pretoken_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the byte-level pattern start; points ends with three END marks, one stands after each text."""
    first = np.empty(len(points), bool)
    first[0] = True
    np.not_equal(classes[1:], classes[:-1], out=first[1:])
    first |= classes == END
    starts = first.copy()
    last_space = np.flatnonzero((classes[:-1] == SPACE) & (classes[1:] != SPACE) & (classes[1:] != END))
    starts[last_space] = True  # a run of white space leaves its last character to what follows
    starts[last_space[points[last_space] == 32] + 1] = False
    quote = np.flatnonzero(points == 39)
    quote = quote[starts[quote] & first[quote] & (classes[quote + 1] == LETTER)]
    one, two = points[quote + 1], points[quote + 2]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, length in ((quote[short], 2), (quote[long & ~short], 3)):
        starts[at + 1] = False
        starts[at + length] = True
    return np.flatnonzero(starts)


class Chunk:
    """An encoded chunk: its ids, where its pre-tokens start, and the index of the id there."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, first: np.ndarray):
        self.ids, self.starts, self.first = ids, starts, first

    def boundaries(self, low: int, high: int, backward: bool) -> dict[int, int]:
        a, b = np.searchsorted(self.starts, [low, high + 1])
        return dict(zip(self.starts[a:b].tolist(), self.first[a:b].tolist(), strict=True))

    def index(self, at: int) -> int:
        """The index of the id at a boundary."""
        return int(self.first[np.searchsorted(self.starts, at)])


class LibraryChunk:
    """A chunk as the library encodes it; boundaries are looked for from one end of it, as far as they are asked for."""

    def __init__(self, library, text: str):
        self.encoding = library.encode(text, add_special_tokens=False)
        self.ids = np.array(self.encoding.ids, np.uint32)

    def boundaries(self, low: int, high: int, backward: bool) -> dict[int, int]:
        e, n = self.encoding, len(self.encoding)
        out, offsets = {}, None
        for i in range(n - 1, -1, -1) if backward else range(n):
            if (chars := e.token_to_chars(i)) is None:
                offsets = offsets or e.offsets
                chars = offsets[i]
            at = chars[0]
            if at < low if backward else at > high:
                break
            if low <= at <= high and (i == 0 or (word := e.token_to_word(i)) is None or word != e.token_to_word(i - 1)):
                out[at] = i
        return out

    def index(self, at: int) -> int:
        return self.encoding.char_to_token(at)


class Encoder:
    """The library's tokenizer with a memory of pre-tokens, and what splicing may rely on.

    `known` tells whether the file has no normaliser and splits by the byte-level pattern alone, which pre-tokens and
    stable boundaries are derived from; with any other file each text goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.specials = [t.content for t in added]
        self.known = _is_byte_level(json.loads(self.library.to_str())) and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        #: Characters before the end of a chunk in which a longer match or a special token may still reach over a boundary.
        self.margin = max([LOOK_AHEAD, *map(len, self.specials)]) + 1
        self.forget()

    def forget(self) -> None:
        """Keys in order with their rows; by row the count of ids and their place in `flat`, and the pre-token itself."""
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.counts, self.at, self.sizes, self.spelt = (np.zeros(1 << 12, np.int32) for _ in range(4))
        self.flat, self.letters = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint16)
        self.used = self.written = self.n = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), self.n - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def _remember(self, keys: np.ndarray, words: list[str]) -> None:
        """keys: in order, none known."""
        counts, parts = [], []
        for i in range(0, len(words), WORDS_AT_ONCE):
            ids = [e.ids for e in self.library.encode_batch_fast(words[i : i + WORDS_AT_ONCE], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            parts.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        letters = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
        counts, sizes = np.concatenate(counts), np.fromiter(map(len, words), np.int64, len(words))
        new = slice(self.n, self.n + len(words))
        for name, end in (("counts", new.stop), ("at", new.stop), ("sizes", new.stop), ("spelt", new.stop), ("flat", self.used + int(counts.sum())), ("letters", self.written + len(letters))):
            while end > len(held := getattr(self, name)):
                setattr(self, name, np.resize(held, 2 * len(held)))
        self.counts[new], self.at[new] = counts, self.used + np.cumsum(counts) - counts
        self.sizes[new], self.spelt[new] = sizes, self.written + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + int(counts.sum())] = np.concatenate(parts)
        self.letters[self.written : self.written + len(letters)] = letters
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, np.arange(new.start, new.stop, dtype=np.int32))
        self.used, self.written, self.n = self.used + int(counts.sum()), self.written + len(letters), new.stop

    def _memo(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the texts' pre-tokens; each text's first and one past its last; which texts have a pre-token that is too
        long or not the one that is remembered under its key; where pre-tokens start.  The END mark stands after each text.
        """
        joined = "\U0010ffff".join(texts) + "\U0010ffff" * 3
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        known = np.minimum(points, 0x206F)
        classes = _classes()[known]
        classes[points > 0x206F] = END
        starts = pretoken_starts(points, classes)
        sizes = np.diff(starts, append=len(points))
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        value = _random()[known]
        value *= powers[place]
        keys = np.add.reduceat(value, starts)
        keys ^= keys >> np.uint64(29)
        mark, long = classes[starts] == END, sizes > LONGEST
        marks = np.flatnonzero(mark)[: len(texts)]
        words = np.flatnonzero(~mark & ~long)
        rows = np.full(len(starts), -1)
        unique, first, inverse = np.unique(keys[words], return_index=True, return_inverse=True)
        if self.n + len(unique) > REMEMBERED or self.written + len(joined) > REMEMBERED_CHARS:
            self.forget()
        found = self._find(unique)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            at = words[first[missing]]
            self._remember(unique[missing], [joined[a:b] for a, b in zip(starts[at].tolist(), (starts[at] + sizes[at]).tolist(), strict=True)])
            found[missing] = np.arange(self.n - len(missing), self.n)
        rows[words] = found[inverse]
        same = rows >= 0
        same[same] = self.sizes[rows[same]] == sizes[same]
        spelt = np.repeat(np.where(same, self.spelt[rows], 0) - starts, sizes) + np.arange(len(points))
        unlike = np.flatnonzero((np.take(self.letters, spelt, mode="clip") != known) & np.repeat(same, sizes))
        same[np.searchsorted(starts, unlike, "right") - 1] = False
        bad = ~mark & ~same
        bad_texts = np.zeros(len(texts), bool)
        bad_texts[np.searchsorted(marks, np.flatnonzero(bad))] = True
        rows[bad] = -1
        return rows, np.concatenate([[0], marks[:-1] + 1]), marks, bad_texts, starts

    def sure(self, text: str) -> bool:
        """Whether the pre-tokens of a text can be told here."""
        if not self.known:
            return False
        if text.isascii():
            bad = any(c in text for c in "\x1c\x1d\x1e\x1f")
        else:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            bad = points.max() > 0x206F or bool((_classes()[points] == UNSURE).any())
        return not bad and not any(s in text for s in self.specials)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def counts_of(self, texts: list[str]) -> list[int]:
        rows, first, last, bad, _ = self._memo(texts)
        total = np.concatenate([[0], np.cumsum(np.where(rows < 0, 0, self.counts[rows]))])
        out = (total[last] - total[first]).tolist()
        for i in np.flatnonzero(bad).tolist():
            out[i] = len(self.ids(texts[i]))
        return out

    def _spelt(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows one after another, and how many there are before each."""
        counts = np.where(rows < 0, 0, self.counts[rows])
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[np.repeat(self.at[rows] - total[:-1], counts) + np.arange(total[-1])], total

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        rows, first, last, bad, _ = self._memo(texts)
        ids, total = self._spelt(rows)
        return [self.ids(t) if b else ids[x:y] for t, b, x, y in zip(texts, bad.tolist(), total[first], total[last], strict=True)]

    def chunk(self, text: str) -> Chunk:
        """The encoding of a chunk whose pre-tokens can be told here, with all of its boundaries."""
        rows, _, last, bad, starts = self._memo([text])
        if bad[0]:
            return LibraryChunk(self.library, text)
        ids, total = self._spelt(rows[: last[0]])
        return Chunk(ids, starts[: last[0]], total[:-1])

    def spliced(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a huge text, piece by piece; whole if the tokenizer isn't known."""
        if not self.known:
            return iter([self.ids(text)])
        return spliced(self.chunk if self.sure(text) else partial(LibraryChunk, self.library), text, margin=self.margin)


def _is_byte_level(file: dict) -> bool:
    """Whether a tokenizer file has no normaliser, splits by the byte-level pattern alone, and merges without chance."""
    split, model = file["pre_tokenizer"] or {}, file["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return bool(plain and file["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout"))


def cached(kind, *key):
    """An object that a Python worker keeps over tasks, until it is asked for another one, so that it holds one at most."""
    held = sys.modules.setdefault("_stratalens_cache", types.ModuleType("_stratalens_cache"))
    name = (kind.__name__, *key)
    if getattr(held, "name", None) != name:
        held.made = None
        held.name, held.made = name, kind(*key)
    return held.made


def spliced(encode: Callable[[str], Chunk | LibraryChunk], text: str, *, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = 64) -> Iterator[np.ndarray]:
    """The ids of a huge text, piece by piece.

    The pattern looks at no text before the place where it stands, so once two encodings share a boundary they agree
    from there on.  A boundary of the left chunk is stable if it lies `margin` before the chunk's end: no longer match
    and no special token can reach over it.  Where the overlap holds no common stable boundary it is doubled.
    """
    n, start, entry, first = len(text), 0, 0, 0  # the left chunk counts from its id `first`, at the place `entry`
    end = min(n, chunk + overlap)
    left = encode(text[:end])
    while end < n:
        wider, common = overlap, {}
        while not common:
            begin = (max(end - wider, entry) // chunk) * chunk
            begin = begin if begin > entry else entry + max(1, (end - entry) // 2)
            right_end = min(n, max(begin + chunk, end) + wider)
            right = encode(text[begin:right_end])
            stable = left.boundaries(max(begin, entry + 1) - start, end - margin - start, True)
            meeting = right.boundaries(0, end - margin - begin, False) if stable else {}
            common = {p + begin: i for p, i in meeting.items() if p + begin - start in stable}
            if not common:
                wider *= 2
                end = min(n, end + wider)
                left = encode(text[start:end])
                first = left.index(entry - start)
                if end == n:
                    break
        if not common:
            break
        nxt = max(common)
        yield left.ids[first : stable[nxt - start]]
        left, start, entry, first, end = right, begin, nxt, common[nxt], right_end
    yield left.ids[first:]


def in_batches(rows: Iterator[tuple], text_at: int, limit: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Lists of rows with about `limit` characters of text."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[text_at]) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text) of each row; a null text is empty."""
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield i, text.as_py() or ""


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int, long_chars: int) -> Iterator[pa.RecordBatch]:
    enc = cached(Encoder, path)
    for rows in in_batches(rows_of(batches), 1):
        counts: list[int] = [0] * len(rows)
        short = []
        for i, (_, text) in enumerate(rows):
            if len(text) >= long_chars:
                counts[i] = sum(map(len, enc.spliced(text)))
            elif enc.sure(text):
                short.append(i)
            else:
                counts[i] = len(enc.library.encode(text, add_special_tokens=False).ids)
        if short:
            for i, n in zip(short, enc.counts_of([rows[i][1] for i in short]), strict=True):
                counts[i] = n
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1].encode()) for r in rows], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, long_chars: int = LONG_CHARS) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens).

    `tokenizer` is the path of a tokenizer file of the tokenizers library, which each executor has; one that isn't
    byte-level as assumed here encodes each text whole.  A null or empty text has no bytes and no tokens; a text of
    `long_chars` or more is spliced from chunks; a null id stays null; repeated rows are counted each; other columns
    are dropped, whatever their names; an empty table gives an empty result.  No shuffle: a map over the scan.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(partial(_count, path=tokenizer, limit=limit, long_chars=long_chars), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
