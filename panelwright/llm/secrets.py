"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns only at hits, checksums.

A text is looked at as one byte per code point (what is not ASCII cannot be part of a secret),
so offsets are code points.  The automaton finds keywords in the lower-cased text; a pattern is
tried only where its keyword stands.  Hex runs have no keyword: there the text is mapped to
classes, and the keyword is 24 times "hex digit".  Token formats that embed a checksum are
reported only if it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Keywords, patterns and least lengths.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Tokens of 30 random characters and 6 characters of checksum: CRC-32 of the 30, in base 62.
CHECKED = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
CHECKED_BODY = re.compile(rb"[A-Za-z0-9]{36}(?![A-Za-z0-9_])")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ["assign", "access", "hex", "github", "npm"]
HEX_CLASS = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
HEX_KEYWORD = b"\x01" * HEX_LEAST
OUT_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def keyword_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        found.add_word(w, ("assign", len(w)))
    found.add_word("akia", ("access", 4))
    for w in CHECKED:
        found.add_word(w, (w, len(w)))
    found.make_automaton()
    return found


def checksum62(body: bytes) -> bytes:
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r : r + 1] + out
    return out


def secret_spans(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then kind as listed; the end is exclusive."""
    if not text:
        return []
    data = text.encode("ascii", "replace")
    out: list[tuple[int, int, str]] = []
    done = {"assign": 0, "access": 0}
    for last, (what, size) in automaton.iter(data.lower().decode("ascii")):
        start = last - size + 1
        if what in done:
            # leftmost and non-overlapping: a match that fails its length still uses up its text
            if start < done[what]:
                continue
            m = (ASSIGN if what == "assign" else ACCESS).match(data, start)
            if m:
                done[what] = m.end()
                if (len(m[2]) >= ASSIGN_LEAST) if what == "assign" else (m.end() - start >= ACCESS_LEAST):
                    out.append((start, m.end(), what))
        elif data.startswith(what.encode(), start):
            m = CHECKED_BODY.match(data, last + 1)
            if m and checksum62(m[0][:30]) == m[0][30:]:
                out.append((start, m.end(), CHECKED[what]))
    classes = data.translate(HEX_CLASS)
    at = classes.find(HEX_KEYWORD)
    while at >= 0:
        end = HEX.match(data, at).end()
        out.append((at, end, "hex"))
        at = classes.find(HEX_KEYWORD, end)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]], s[1]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts of base secrets, the SHA-256 of their ``kind:start:end`` list and
    all spans as such a list.  Null and empty texts have none (an empty list); null ids and
    repeated rows stay, one result row each; very long texts are scanned whole; other columns are ignored; an empty table gives no
    rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans = secret_spans(text.as_py(), automaton)
                base = [s for s in spans if s[2] in ("assign", "access", "hex")]
                said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
                rows.append((i, *(sum(s[2] == k for s in base) for k in ("assign", "access", "hex")), hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in spans)))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, OUT_SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
