"""Secrets in texts, with linking of credentials that come in parts.

Strong spans are reported wherever they stand: assigned secrets, access keys,
long hexadecimal strings. Weak candidates are user names, endpoints and
random-looking tokens. Each of them is only reported when the parts it needs
stand close by: candidates of one document are joined as intervals (those of each
role, sorted, that overlap the range of a candidate plus ``reach`` bytes)
inside a scope, which is a stretch without an empty line. A line of blanks alone is
empty.
A random token needs an identifier (user or access key), a user a secret (of any
kind), an endpoint both.

Everything is local to a document, so there is one pass and no shuffle; the
memory is that of a few megabytes of text or of the longest document.

Defined results. A null text is empty. Each row of ``documents`` gives one row;
only ``doc_id`` and ``text`` are read. Spans count code points, the end is
exclusive. Base spans of one kind don't overlap; a random token that overlaps a
base span is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as tx

#: Kinds in the order of equal starts; the first three are the base.
KINDS = ["assign", "access", "hex", "user", "endpoint", "random"]
#: Key words of an assignment, in lower case, and the forms of spans.
KEY_WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
USER_WORDS = [b"user", b"login", b"account", b"client_id"]
USER = re.compile(rb"(?:user|login|account|client_id)(?:_?name|_?id)?[\"']?\x20*[:=]\x20*[\"']?[a-z0-9@._-]{3,}")
ENDPOINT = re.compile(rb"://[^\s\"'<>]+")
SCHEME = re.compile(rb"[a-z][a-z0-9+.-]{1,15}$")
HEX = tx._class([(0x30, 0x39), (0x61, 0x66)])
TOKEN = tx._class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x5F, 0x5F)])
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 8, 16, 32, 20


def _places(body: bytes, literals: list[bytes]) -> list[int]:
    out = []
    for literal in literals:
        i = body.find(literal)
        while i >= 0:
            out.append(i)
            i = body.find(literal, i + 1)
    return sorted(set(out))


def _matches(body: bytes, places: list[int], form: re.Pattern) -> Iterator[re.Match]:
    """Leftmost matches that don't overlap; every match begins at one of the places."""
    end = 0
    for i in places:
        if i >= end and (m := form.match(body, i)):
            end = m.end()
            yield m


def _runs(mask: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    starts, ends = tx.contiguous_runs(mask)
    long = ends - starts >= least
    return zip(starts[long].tolist(), ends[long].tolist())


def looks_random(token: bytes) -> bool:
    """Digits, capitals and small letters, with at least 3.5 bits a character."""
    c = np.unique(np.frombuffer(token, np.uint8), return_counts=True)[1] / len(token)
    kinds = [any(48 <= b <= 57 for b in token), any(65 <= b <= 90 for b in token), any(97 <= b <= 122 for b in token)]
    return all(kinds) and float(-(c * np.log2(c)).sum()) >= 3.5


def candidates(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, over a buffer in which newlines part the texts."""
    raw, low = data.tobytes(), tx.LOWER[data].tobytes()
    out = [(m.start(), 0, m.end()) for m in _matches(low, _places(low, KEY_WORDS), ASSIGN) if len(m[1]) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in _matches(raw, _places(raw, [b"AKIA"]), ACCESS) if len(m[0]) >= MIN_ACCESS]
    out += [(s, 2, e) for s, e in _runs(HEX[data], MIN_HEX)]
    out += [(m.start(), 3, m.end()) for m in _matches(low, _places(low, USER_WORDS), USER)]
    for m in _matches(low, _places(low, [b"://"]), ENDPOINT):
        if scheme := SCHEME.search(low[max(0, m.start() - 16):m.start()]):
            out.append((m.start() - len(scheme[0]), 4, m.end()))
    out += [(s, 5, e) for s, e in _runs(TOKEN[data], MIN_RANDOM) if looks_random(raw[s:e])]
    return sorted(out)


def linked(parts: list[tuple[int, int, int]], borders: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """The base spans of one text, and the weak candidates whose complements stand in reach and scope."""
    base = sorted((s, e) for s, k, e in parts if k < 3)
    starts = np.array([s for s, _ in base], dtype=np.int64)
    furthest = np.maximum.accumulate(np.array([e for _, e in base], dtype=np.int64)) if base else starts

    def covered(s: int, e: int) -> bool:
        i = int(np.searchsorted(starts, e)) - 1
        return i >= 0 and furthest[i] > s

    parts = [p for p in parts if p[1] != 5 or not covered(p[0], p[2])]
    at = {}
    for role, kinds in {"identifier": (1, 3), "secret": (0, 2, 5)}.items():
        own = sorted((s, e) for s, k, e in parts if k in kinds)
        at[role] = (np.array([s for s, _ in own], np.int64), np.maximum.accumulate(np.array([e for _, e in own], np.int64)))

    def near(role: str, s: int, e: int) -> bool:
        scope = int(np.searchsorted(borders, s, side="right"))
        low = max(s - reach, int(borders[scope - 1]) if scope else 0)
        high = min(e + reach, int(borders[scope]) if scope < len(borders) else e + reach)
        begins, ends = at[role]
        before = int(np.searchsorted(begins, high))
        return before > 0 and int(ends[before - 1]) > low

    needs = {3: ("secret",), 4: ("identifier", "secret"), 5: ("identifier",)}
    return [p for p in parts if p[1] < 3 or all(near(role, p[0], p[2]) for role in needs[p[1]])]


def scope_borders(body: np.ndarray) -> np.ndarray:
    """The newlines that an empty line follows."""
    newlines = np.flatnonzero(body == 10)
    written = np.cumsum(tx.NOT_BLANK[body])[newlines]
    return newlines[:-1][written[1:] == written[:-1]]


def _listed(parts: list[tuple[int, int, int]], char: np.ndarray) -> str:
    return ",".join(f"{KINDS[k]}:{char[s]}:{char[e]}" for s, k, e in parts)


def _scan(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in tx.pieces(tx.column(batch, "text")):
                n = len(offsets) - 1
                data = np.insert(raw, offsets[1:], 10)  # a newline ends every text
                offsets = offsets + np.arange(n + 1)
                found = candidates(data)
                text = np.searchsorted(offsets, [s for s, _, _ in found], side="right") - 1
                counts, base, spans = np.zeros((3, n), np.int64), [""] * n, [""] * n
                for i in np.unique(text):
                    body = data[offsets[i]:offsets[i + 1]]
                    own = found[np.searchsorted(text, i):np.searchsorted(text, i, side="right")]
                    parts = [(s - offsets[i], k, e - offsets[i]) for s, k, e in own]
                    kept = linked(parts, scope_borders(body), reach)
                    char = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
                    strong = [p for p in kept if p[1] < 3]
                    for _, k, _ in strong:
                        counts[k, i] += 1
                    base[i], spans[i] = _listed(strong, char), _listed(kept, char)
                ids = batch.column(0).slice(first, n)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in counts], pa.array(base), pa.array(spans)],
                                                 ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])
    return run


def scan(documents: DataFrame, reach: int = 300) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans), one row per row of ``documents``.

    ``base`` and ``spans`` list kind:start:end by start, then by kind.
    """
    docs = documents.select("doc_id", "text")
    return docs.transform(tx.in_arrow, _scan(reach), f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign bigint, n_access bigint, "
                                         "n_hex bigint, base string, spans string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
