"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword bit vector, a state a bit (Shift-And with self
loops): reading a byte moves each state whose literal accepts it one bit on and keeps each state
whose wildcard accepts it.  Numpy runs the automaton over all URLs of a batch at once, a byte
position at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host suffix and path prefix of the fixed rules, with their verdicts.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Globs over ``.host/path``: ``*`` stays within a slash-free part, ``**`` crosses slashes, ``?`` is one byte.
GLOBS = tuple((f"*.{name}.**", "block") for name in ("ads-track", "adult-*", "casino-*", "cheap-pills", "free-bets", "spam-farm"))


def rule_glob(rule: str) -> str:
    """The glob of a rule ``host/path``: the host and its subdomains, and all paths that begin so."""
    return f"*.{rule}**"


class GlobAutomaton:
    """Shift-And automaton of many globs; ``match`` tells for each text which globs fit all of it."""

    def __init__(self, globs: Sequence[str]) -> None:
        steps: list[tuple[int, int | None, int]] = []  # state, literal byte or None for any, kind of its loop
        self.starts, self.ends = [], []
        state = 0
        loops: dict[int, int] = {}
        for glob in globs:
            self.starts.append(state)
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    loops[state] = 2
                    i += 2
                elif data[i : i + 1] == b"*":
                    loops[state] = max(loops.get(state, 0), 1)
                    i += 1
                else:
                    steps.append((state, None if data[i : i + 1] == b"?" else data[i], 0))
                    state += 1
                    i += 1
            self.ends.append(state)
            state += 1
        self.words = max(1, -(-state // 64))
        self.go = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for at, byte, _ in steps:
            self.go[slice(None) if byte is None else byte, at // 64] |= np.uint64(1 << at % 64)
        for at, kind in loops.items():
            self.stay[:, at // 64] |= np.uint64(1 << at % 64)
            if kind == 1:
                self.stay[ord("/"), at // 64] &= ~np.uint64(1 << at % 64)
        self.first = np.zeros(self.words, np.uint64)
        for at in self.starts:
            self.first[at // 64] |= np.uint64(1 << at % 64)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix, a row a text, a column a glob."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        ends = lengths[order]
        states = np.tile(self.first, (n, 1))
        alive = n
        for at in range(int(ends[0]) if n else 0):
            while ends[alive - 1] <= at:
                alive -= 1
            byte = data[begin[:alive] + at]
            now = states[:alive]
            moved = now & self.go[byte]
            shifted = moved << np.uint64(1)
            shifted[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            states[:alive] = shifted | (now & self.stay[byte])
        out = np.zeros((n, len(self.ends)), bool)
        for k, at in enumerate(self.ends):
            out[order, k] = (states[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1) == 1
        return out


def host_column(url: str = "url") -> Column:
    host = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_column(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = HOST_RULES, globs: Sequence[tuple[str, str]] = GLOBS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    The longest host rule that fits decides (ties: the earlier).  Where none fits, the first glob
    that fits decides, else ``default``.  Null url or one without ``://``: host and path are
    empty, no rule fits, the verdict is ``default``.  Repeated rows are each judged.
    """
    names = [r for r, _ in rules]
    verdicts = [v for _, v in rules] + [v for _, v in globs]
    ranks = sorted(range(len(names)), key=lambda k: (-len(names[k].encode()), k)) + list(range(len(names), len(verdicts)))
    patterns = [rule_glob(r) for r in names] + [g for g, _ in globs]

    @F.pandas_udf("int")
    def winner(canonical: pd.Series) -> pd.Series:
        """Place of the deciding pattern, or -1."""
        automaton = GlobAutomaton(patterns)
        found = automaton.match([x.encode() for x in canonical])[:, ranks]
        return pd.Series(np.where(found.any(axis=1), np.asarray(ranks, np.int32)[found.argmax(axis=1)], -1).astype(np.int32))

    parsed = pages.select("page_id", host_column().alias("host"), path_column().alias("path"))
    judged = parsed.withColumn("k", winner(F.concat(F.lit("."), "host", "path")))
    rule = F.get(F.array(*[F.lit(x) for x in names]), F.when(F.col("k").between(0, len(names) - 1), F.col("k")))
    verdict = F.coalesce(F.get(F.array(*[F.lit(x) for x in verdicts]), F.when(F.col("k") >= 0, F.col("k"))), F.lit(default))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
