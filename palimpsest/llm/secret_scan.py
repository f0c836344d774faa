"""Secret scans: base patterns, and novelty against dictionaries primed with the surrounding text.

A candidate is a long unbroken string near a sensitive word. It is compressed with zstandard twice,
primed with a raw dictionary of its surroundings and of common identifiers: the frame with the
candidate less the frame without it is its marginal size. Names, words and repeats compress well
against such a dictionary; random secrets don't, and are reported as `novel`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api.?key|private.?key|credential|bearer|authorization", re.I | re.A)
#: Common identifiers that prime the dictionary.
IDENTIFIERS = " ".join(f"{a}{b}" for a in ("access_", "auth_", "client_", "secret_", "session_", "user_", "api_", "private_", "public_", "refresh_") for b in ("key", "token", "id", "name", "password", "value", "url", "path", "config", "example")).encode()
HEADER = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind: leftmost non-overlapping matches of each kind, failing ones dropped without retries."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that the candidate adds to an empty frame, given its surroundings and common identifiers."""
    prime = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=9, dict_data=prime, write_content_size=False, write_checksum=False).compress
    return len(squeeze(candidate.encode())) - len(squeeze(b""))


def novel_spans(text: str, near: int = 80, around: int = 400, ratio: float = 0.7) -> list[tuple[str, int, int]]:
    """Candidates with a sensitive word at most `near` characters before, with at least two classes of characters, whose marginal bytes are at least `ratio` of their own."""
    words = [m.end() for m in SENSITIVE.finditer(text)]
    out, k = [], 0
    for m in CANDIDATE.finditer(text) if words else ():
        s, e = m.span()
        while k + 1 < len(words) and words[k + 1] <= s:
            k += 1
        found = m.group()
        if not (words[k] <= s and s - words[k] <= near) or sum(bool(re.search(c, found)) for c in ("[a-z]", "[A-Z]", "[0-9]")) < 2:
            continue
        if marginal_bytes(found, text[max(0, s - around) : s] + text[e : e + around]) >= ratio * len(found):
            out.append(("novel", s, e))
    return out


def all_spans(text: str, **settings) -> list[tuple[str, int, int]]:
    """Base spans and those that the novelty adds beside them (none inside a base span)."""
    base = base_spans(text)
    last, more = 0, []
    covered = iter([*base, ("", len(text), len(text))])
    _, start, end = next(covered)
    for x in novel_spans(text, **settings):  # both in the order of their starts
        while start < x[2] and start < len(text):
            last = max(last, end)
            _, start, end = next(covered)
        if x[1] >= last:
            more.append(x)
    return sorted([*base, *more], key=lambda x: (x[1], [*KINDS, "novel"].index(x[0])))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and kind. Null texts count as
    empty: no spans, the digest of the empty string. Repeated rows are scanned each; other columns
    are ignored; an empty table gives an empty result. A text is scanned whole in one task, with
    memory for one Arrow batch and its matches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base = base_spans(text)
                spans = all_spans(text, **settings)
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy() if pdf["doc_id"].isna().any() else pdf["doc_id"].to_numpy())
            yield out

    return documents(docs).mapInPandas(run, HEADER)


def redact_secrets(docs: DataFrame, mark: str = "[secret]", **settings) -> DataFrame:
    """docs with every span of its texts replaced by `mark` and n_chars counted anew; all else, nulls included, is as it was.

    Every row stays, repeated ones and those with a null id too; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda x: None if x is None else _redact(x, all_spans(x, **settings), mark))

    names = docs.columns
    out = docs.withColumn("text", redacted("text"))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out).select(*names)


def _redact(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]
