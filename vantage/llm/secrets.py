"""Secret scan: keyword automaton, anchored patterns near its hits, checksums.

1. One Aho-Corasick pass over the lower-cased text finds the keywords that
   every kind but ``hex`` begins with.
2. At a hit, and only there, the kind's pattern is matched anchored on the
   original text.  A hit inside an earlier match of its kind is passed over, so
   the matches are the leftmost non-overlapping ones of a full scan.
3. Added kinds carry a checksum in their last six characters (CRC-32 in base
   62, as the public token formats of code and package hosts define it); a
   match with a wrong checksum is dropped.

``hex`` has no keyword to begin with; its maximal runs are scanned for directly.

Kinds: ``assign``, ``access``, ``hex`` (base) and ``host_token``,
``package_token`` (added).  A span is the whole match, in code points, end
exclusive; spans are ordered by start, then by kind as listed here.

Results for odd input: null and empty texts have no spans and the digest of the
empty string; repeated rows are scanned one by one; a null ``doc_id`` is kept;
other columns are not read.  Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.text import small_batches

KINDS = ("assign", "access", "hex", "host_token", "package_token")

# fixed values: the kinds' patterns, least lengths and keywords
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HOST = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_PACKAGE = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_PREFIXES = {"assign": _NAMES, "access": ("akia",), "host_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
             "package_token": ("npm_",)}
_ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def _checked(m: re.Match) -> bool:
    return checksum(m[1]) == m[2]


#: kind -> (anchored pattern, test a match must pass)
_RULES = {"assign": (_ASSIGN, lambda m: len(m[2]) >= 12), "access": (_ACCESS, lambda m: len(m[0]) >= 18),
          "host_token": (_HOST, _checked), "package_token": (_PACKAGE, _checked)}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, prefixes in _PREFIXES.items():
        for p in prefixes:
            a.add_word(p, (kind, len(p)))
    a.make_automaton()
    return a


def find(text: str | None, keywords) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every span of ``text``, in order."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer would move the positions
        low = text.translate(_ASCII_LOWER)
    out, past = [], dict.fromkeys(_RULES, 0)
    # hits come by end; of one kind, a longer keyword can begin before a shorter one that ended first
    for start, kind in sorted({(end - n + 1, kind) for end, (kind, n) in keywords.iter(low)}):
        if start < past[kind]:
            continue
        pattern, passes = _RULES[kind]
        if m := pattern.match(text, start):
            past[kind] = m.end()
            if passes(m):
                out.append((start, KINDS.index(kind), m.end()))
    out += [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_checked long, base string, spans string")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keywords = automaton()
        for batch in texts:
            rows = []
            for t in batch:
                found = find(t, keywords)
                kinds = [k for _, k, _ in found]
                said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), sum(k > 2 for k in kinds),
                             ",".join(x for x, k in zip(said, kinds, strict=True) if k < 3), ",".join(said)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_checked", "base", "spans"])

    return (docs.select("doc_id", scan(F.coalesce(F.col("text"), F.lit(""))).alias("found"))
            .select("doc_id", "found.n_assign", "found.n_access", "found.n_hex", "found.n_checked",
                    F.sha2("found.base", 256).alias("base_sha256"), "found.spans"))
