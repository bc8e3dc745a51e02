"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Base kinds are regular expressions. The novelty kind looks at strings of 16 or more key characters
that stand behind a sensitive word (credential, bearer, private, ...). It measures the candidate's
marginal compressed bytes: the size of the surrounding text with it, less the size without it, under
a zstandard dictionary of code and identifiers. Readable identifiers compress well against
dictionary and context; strings that need nearly all of their entropy are reported. Between the sensitive word and
the string may stand up to 16 letters of an identifier, quotes, and a colon or equals sign with up to three blanks.

Defined results: a null text is empty and has no spans; positions count code points, ends are
exclusive; repeated rows are scanned each by itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelmill.llm.common import text_or_empty

#: The base kinds, in their order, with the least length of what is kept.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs of 24 or more: the same spans as runs of any length, then filtered
KINDS = {"assign": 0, "access": 1, "hex": 2, "novel": 3}
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

SENSITIVE = re.compile(r"(?:credential|bearer|authorization|private|auth|signature|cookie|session|access|client|webhook|passphrase|key|secret|token|pwd)[a-z_]{0,16}[\"']?\x20{0,3}[:=]?\x20{0,3}[\"']?([A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9+/_=-])", re.I | re.A)
#: Context on either side of a candidate, in characters, and bytes per character from which it is novel.
CONTEXT, NOVEL = 160, 0.62
#: A longer candidate is novel if the whole or one of its pieces of up to this many characters is; it is reported whole.
PIECE = 512
DICTIONARY = " ".join(
    """
    import from return public private static final class function const let var self this null true false None
    def if else for while try except raise with as in not and or lambda yield async await export default
    username user_id user_name account_id client_id client_name request response session_id configuration
    authorization authentication credential permission password secret token api_key access_key private_key
    public_key certificate signature http https www example com org net localhost application json content type
    accept encoding charset utf connection database host port table column index select insert update delete
    where order group limit offset string integer boolean float double long short byte array list map set
    createElement getElementById addEventListener documentation description identifier placeholder environment
    production development staging deployment service container kubernetes namespace cluster region instance
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 ffffffff deadbeef
    the of and to in is that it for was with as be on by this from have which would their there about other
    """.split()
).encode()
SCANNED = "doc_id long, kinds array<string>, begins array<long>, ends array<long>"


class Novelty:
    """Marginal compressed bytes of a candidate, given what surrounds it."""

    def __init__(self, dictionary: bytes = DICTIONARY, level: int = 9):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False)

    def rate(self, text: str, begin: int, end: int) -> float:
        """Marginal bytes per character of text[begin:end]."""
        before, after = text[max(0, begin - CONTEXT) : begin], text[end : end + CONTEXT]
        without = len(self.compressor.compress((before + after).encode()))
        with_it = len(self.compressor.compress((before + text[begin:end] + after).encode()))
        return (with_it - without) / max(1, end - begin)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def novel(text: str, begin: int, end: int, novelty: Novelty) -> bool:
    if novelty.rate(text, begin, end) >= NOVEL:
        return True
    pieces = -(-(end - begin) // PIECE)
    edges = [begin + (end - begin) * i // pieces for i in range(pieces + 1)]
    return pieces > 1 and any(novelty.rate(text, a, b) >= NOVEL for a, b in zip(edges[:-1], edges[1:], strict=True))


def novel_spans(text: str, novelty: Novelty, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Incompressible strings in sensitive context that no base span covers."""
    found, known = [], sorted(known)
    begins, reach = [b for b, _, _ in known], list(accumulate((e for _, e, _ in known), max))
    for m in SENSITIVE.finditer(text):
        begin, end = m.span(1)
        before = bisect_right(begins, begin)
        if not (before and reach[before - 1] >= end) and novel(text, begin, end, novelty):
            found.append((begin, end, "novel"))
    return found


def scan(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, novelty, base), key=lambda s: (s[0], KINDS[s[2]], s[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for batch in batches:
        spans = [scan(t, novelty) for t in batch.column("text").to_pylist()]
        columns = [pa.array([[s[i] for s in row] for row in spans], pa.list_(k)) for i, k in ((2, pa.string()), (0, pa.int64()), (1, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "kinds", "begins", "ends"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its spans as parallel arrays kinds, begins, ends, in order of begin."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_scan, SCANNED)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, overlapping ones merged, replaced by a marker."""
    out, at = [], 0
    for begin, end, kind in spans:
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redacted(texts):
    novelty = Novelty()
    return [t if t is None or not (spans := scan(t, novelty)) else redact(t, spans) for t in texts]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with the secrets in ``text`` replaced by markers; null texts stay null."""
    @pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return pd.Series(_redacted(texts), index=texts.index, dtype=object)

    return docs.withColumn("text", redacted("text"))


def _joined(kinds: str, base_only: bool):
    spans = F.arrays_zip("kinds", "begins", "ends")
    if base_only:
        spans = F.filter(spans, lambda s: s["kinds"] != "novel")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["begins"].cast("string"), s["ends"].cast("string"))), ",")


def span_digests(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        count("novel").alias("n_novel"),
        F.sha2(_joined("kinds", True).cast("binary"), 256).alias("base_sha256"),
        _joined("kinds", False).alias("spans"),
    )


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{b}:{e}" for b, e, k in spans if k != "novel").encode()).hexdigest()
