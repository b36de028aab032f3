"""Secrets in texts: assigned values, access keys, long hexadecimal strings, and strings that a tokenizer finds random."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import prepare
from stratalens.llm.tokens import cached, in_batches, rows_of

# The kinds in the order of the report, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Lengths of the usual digests in hexadecimal; longer strings of these are known, as are UUIDs.
DIGESTS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: The shape of an identifier or path: words of letters, each with digits after it at most, joined by signs; the first
#: word has three small letters in a row.  No part may give back what it took, so the time is linear in the length.
IDENTIFIER = re.compile(r"[_/+=-]*+([A-Za-z]++)[0-9]{0,4}+(?:[_/+=-]++(?:[A-Za-z]++[0-9]{0,4}+|[0-9]++))*+[_/+=-]*+")
SMALL = re.compile(r"[a-z]{3}")

#: A candidate for the token test has so many characters, and fewer than RATIO of them to a token.
LEAST_RANDOM = 20
RATIO = 2.0
#: Parts of a run between signs, and what may be known in it; a short word or version may stand beside a secret in a path.
SIGN, PART, SHORT = re.compile(r"[+/_=-]"), re.compile(r"[A-Za-z0-9]+"), re.compile(r"[a-z]{1,4}[0-9]{0,2}")
PADDING = re.compile(r"(?:={1,2}(?![A-Za-z0-9=]))?")
KNOWN = re.compile(rf"(?<![0-9A-Za-z])(?:{UUID.pattern}|{DIGEST.pattern})(?![0-9A-Za-z])")
#: Without letters only digits in a row are a candidate, not dates and numbers that signs join.
NUMBER = re.compile(r"[0-9]{%d,}" % LEAST_RANDOM)
#: The words of an identifier, by case; one of LEAST_WORD letters is readable with at least WORD_RATIO of them to a token.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LEAST_WORD, WORD_RATIO = 4, 3

_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_WORDS = bytes(120 if (chr(i).isascii() and chr(i).isalnum()) or chr(i) in "+/_=-" else 32 for i in range(256))
_RUN_HEX, _RUN_RANDOM = re.compile(b"x{%d,}" % LEAST_HEX), re.compile(b"x{%d,}" % LEAST_RANDOM)


class Vocabulary:
    """A tiktoken vocabulary file of `base64 rank` lines."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def readable(self, text: str) -> bool:
        """Whether words that the vocabulary knows have half of the letters at least."""
        known = 0
        for w in WORD.findall(text):
            if len(w) >= LEAST_WORD and any(len(w) >= WORD_RATIO * len(self.encode(x)) for x in (w, " " + w.lower())):
                known += len(w)
        return known > 0 and 2 * known >= sum(map(str.isalpha, text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches of the fixed patterns, leftmost and without overlap in each kind."""
    out = []
    small = text.lower()
    if "passw" in small or "secret" in small or "token" in small or "key" in small:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    flat = text.encode("latin-1", "replace").translate(_HEX)
    if b"x" * LEAST_HEX in flat:
        out += [(m.start(), 2, m.end()) for m in _RUN_HEX.finditer(flat)]
    return sorted(out)


def _known(word: str) -> bool:
    return bool(len(word) in DIGESTS and DIGEST.fullmatch(word) or UUID.fullmatch(word))


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Where the spans begin and end, in order, those that meet as one."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def _pieces(begin: int, end: int, gone: tuple[list[int], list[int]]) -> Iterator[tuple[int, int]]:
    """(begin, end) of what is left between joined spans that are gone."""
    begins, ends = gone
    i = bisect_right(ends, begin)
    while i < len(begins) and begins[i] < end:
        if begin < begins[i]:
            yield begin, begins[i]
        begin = ends[i]
        i += 1
    if begin < end:
        yield begin, end


def _is_identifier(word: str) -> bool:
    m = IDENTIFIER.fullmatch(word)
    return bool(m and SMALL.search(m[1]))


def _stretches(run: str, vocabulary: Vocabulary) -> Iterator[list[tuple[int, int]]]:
    """The parts of a run, (begin, end) each, in stretches that no readable part and no '=' is in, without the short
    words of a path at their ends."""
    held: list[tuple[int, int]] = []
    for a, b in [*(m.span() for m in PART.finditer(run)), (len(run), len(run))]:
        word = run[a:b]
        readable = vocabulary.readable(word)
        if held and (readable or not word or run[a - 1] == "="):
            i, j = 0, len(held) - 1
            while i < j and SHORT.fullmatch(run, *held[i]) and run[held[i][1]] == "/":
                i += 1
            while i < j and SHORT.fullmatch(run, *held[j]) and run[held[j][0] - 1] == "/":
                j -= 1
            yield held[i : j + 1]
            held = []
        if word and not readable:
            held.append((a, b))


def _random_in(run: str, parts: list[tuple[int, int]], low: Callable[[str], bool]) -> list[tuple[int, int]]:
    """(begin, end) of a stretch if it is random, or else of the parts of it that are; with the padding of base64."""
    found = [(parts[0][0], parts[-1][1])]
    if not low(run[slice(*found[0])]):
        found = [x for x in parts if low(run[slice(*x)])]
    elif not PART.search(run[: found[0][0]] + run[found[0][1] :]):
        return [(0, len(run))]
    return [(a, PADDING.match(run, b).end()) for a, b in found]


def random_spans(text: str, taken: list[tuple[int, int, int]], vocabulary: Vocabulary, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Long strings of letters and digits, off the base spans, with few characters to a token; digests are known, and so
    are identifiers of readable words.

    The stretches of a run between readable parts are tested on their own, the whole run if none of them is random."""
    flat = text.encode("latin-1", "replace").translate(_WORDS)
    out = []
    if b"x" * LEAST_RANDOM in flat:

        def low(word: str) -> bool:
            return len(word) >= LEAST_RANDOM and (any(c.isalpha() for c in word) or bool(NUMBER.search(word))) and not _known(word) and len(word) < ratio * len(vocabulary.encode(word))

        gone = _joined([(x, y) for x, _, y in taken])
        for m in _RUN_RANDOM.finditer(flat):
            for a, b in _pieces(*m.span(), gone):
                word = text[a:b]
                if len(word) < LEAST_RANDOM:
                    continue
                found = []
                if SIGN.search(word):
                    for x, y in _pieces(a, b, _joined([k.span() for k in KNOWN.finditer(text, a, b) if _known(k[0])])):
                        part = text[x:y]
                        if len(part) >= LEAST_RANDOM:
                            found += [(x + i, 3, x + j) for s in _stretches(part, vocabulary) for i, j in _random_in(part, s, low)]
                if not found and low(word) and not (_is_identifier(word) and vocabulary.readable(word)):
                    found = [(a, 3, b)]
                out += found
    return out


def find(text: str, vocabulary: Vocabulary, ratio: float = RATIO) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans in order."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, vocabulary, ratio))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch], path: str, pattern: str, ratio: float) -> Iterator[pa.RecordBatch]:
    vocabulary = cached(Vocabulary, path, pattern)
    for rows in in_batches(rows_of(batches), 1):
        found = [find(text, vocabulary, ratio) for _, text in rows]
        counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                *[pa.array(c, pa.int64()) for c in counts],
                pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]),
                pa.array([listed(every) for _, every in found]),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end in code points).

    `vocabulary` is the path of a tiktoken vocabulary that each executor has.  A null or empty text has no spans; a text
    or a word of any length is scanned whole, in time that grows with its length; a null id stays null; repeated rows
    are scanned each; other columns are dropped, whatever their names; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(partial(_scan, path=vocabulary, pattern=pattern, ratio=ratio), schema)


def _redact(batches: Iterator[pa.RecordBatch], path: str, pattern: str, ratio: float, at: int, mark: str) -> Iterator[pa.RecordBatch]:
    vocabulary = cached(Vocabulary, path, pattern)
    for b in batches:
        texts = [None if (t := x.as_py()) is None else redacted(t, find(t, vocabulary, ratio)[1], mark) for x in b.column(at)]
        yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))


def redact(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text", ratio: float = RATIO, mark: str = "[secret]") -> DataFrame:
    """`docs` with each secret of the text replaced by `mark`; null texts stay null, and other columns stay as they are."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(partial(_redact, path=vocabulary, pattern=pattern, ratio=ratio, at=at, mark=mark), docs.schema)
