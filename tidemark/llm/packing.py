"""Best-fit packing by bin completion.

Sequences are filled for classes of equal length: the driver sees how many pieces have each length
(at most ``capacity`` numbers, whatever the data), not the pieces.  A branch and bound completes a
bin around the longest length left with an undominated filling, as often as the counts allow or
less often, and prunes by the waste that any better solution could still afford; best-fit
decreasing gives the first incumbent.  Pieces then find their places by their rank among those of
equal length.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import arrow_schema, gapless_rank, map_arrow, written

#: A space, or a line break, behind anything but white space, or what some tables of characters call so: a token starts here.
WORD_START, LINE_START = (re.compile(f"{c}(?<=[^\\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]{c})") for c in (" ", "\n"))

#: White space, or what some tables of characters call so, beside spaces and line breaks.  Where a text has none, and no two of those in a row, it is cut at each of them.
ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")

#: Pieces of one length that a window numbers together, about.
RANKED_TOGETHER = 100_000

#: What some tables of characters, beside Python's, call white space.
MAYBE_SPACE = frozenset("\u180e\u200b\u2060\ufeff")

#: Bytes of words and their ids, about, that a worker remembers before the older half goes.
KNOWN_BYTES = 256 << 20

#: Neither letters nor numbers nor white space, for all tables of characters.
MARKS = string.punctuation

#: Runs of marks that a worker remembers.
MARKS_KNOWN = 10_000

#: Words of a batch that go to the tokenizer as one text.
WORDS_TOGETHER = 8192

_tokenizers: dict[str, ByteTokenizer] = {}

Pattern = tuple[int, ...]

#: A word behind a space, or (line break, word).
Word = str | tuple[str, str]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class ByteTokenizer:
    """Ids of a byte-level BPE tokenizer file, computed by the ``tokenizers`` library.

    Its pre-tokenizer never lets a token go on over white space that follows something else, so that
    texts are cut at such spaces and line breaks and each word is encoded once and remembered.  New words of
    a batch are encoded as one text, which is cut where the bytes of its tokens say; a word that
    does not end with a token is encoded alone.  Texts that hold the string of an added token (it
    becomes that token, as the library has it) and all texts of other kinds of tokenizers are
    encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.by_words = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.by_words = self.by_words and not any(c.isspace() for x in self.added for c in x)
        vocabulary = spec["model"].get("vocab") if self.by_words else {}
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a character of a token stands for a byte
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)
        self.known: dict[Word, bytes] = {}
        self.older: dict[Word, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def shared(cls, path: str) -> ByteTokenizer:
        """The one of this worker process."""
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[Word]) -> dict[Word, bytes]:
        """Ids of words, with what they stand behind."""
        shown = [" " + w if isinstance(w, str) else w[0] + w[1] for w in words]
        ends = [x[-1:] for x in shown]
        spaced = {x for x in set(ends) if x.isspace() or x in MAYBE_SPACE}  # behind white space the next word would not start anew
        alone = [k for k, x in enumerate(ends) if x in spaced] if spaced else []
        fit = [k for k, x in enumerate(ends) if x not in spaced] if spaced else range(len(ends))
        found: dict[Word, bytes] = {}
        for lo in range(0, len(fit), WORDS_TOGETHER):
            part = fit[lo : lo + WORDS_TOGETHER]
            texts = [shown[k] for k in part]
            (text,) = self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)
            ids = np.array(text.ids, "<u4")
            stops = np.concatenate([[0], np.cumsum(self.sizes[ids])])
            cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, map(str.encode, texts)), np.int64, len(texts)))])
            at = np.searchsorted(stops, cuts)
            clean = stops[np.minimum(at, len(stops) - 1)] == cuts
            raw, at = ids.tobytes(), (4 * at).tolist()
            found.update(zip([words[k] for k in part], map(raw.__getitem__, map(slice, at, at[1:])), strict=False))
            alone += [part[k] for k in np.flatnonzero(~(clean[:-1] & clean[1:])).tolist()]
        found.update(zip([words[k] for k in alone], self.whole([shown[k] for k in alone]), strict=True))
        return found

    def _learn(self, new: set[Word]) -> None:
        """Have the ids of words that are not known.

        Letters before marks are a word of their own, whose ids may be known: a token never goes
        on from a letter to a mark.
        """
        known, marks = self.known, self.marks
        marked = [w for w in new if w and isinstance(w, str) and w[-1] in MARKS]  # words behind line breaks stay whole
        letters = [w.rstrip(MARKS) for w in marked]
        parts = {w: x for w, x in zip(marked, letters, strict=True) if x.isalpha() and (x.isascii() or max(x) <= "\xff")}
        plain = new.difference(parts)
        plain.update(set(parts.values()).difference(known))
        again = plain.intersection(self.older)
        known.update((w, self.older[w]) for w in again)
        known.update(self._words(list(plain - again)))
        ends = {w: w[len(x) :] for w, x in parts.items()}
        if len(marks) > MARKS_KNOWN:
            marks.clear()
        unseen = list(set(ends.values()).difference(marks))
        marks.update(zip(unseen, self.whole(unseen), strict=True))
        known.update({w: known[x] + marks[ends[w]] for w, x in parts.items()})
        for own in (plain, parts):
            self.held += sum(map(len, own)) + sum(map(len, map(known.__getitem__, own))) + 200 * len(own)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_words:
            return self.whole(texts)
        whole = [k for k, t in enumerate(texts) if any(x in t for x in self.added)]
        if whole:
            found = dict(zip(whole, self.whole([texts[k] for k in whole]), strict=True))
            rest = iter(self.ids([t for k, t in enumerate(texts) if k not in found]))
            return [found[k] if k in found else next(rest) for k in range(len(texts))]
        words = [_cut(x) for x in texts]
        first = self.whole([x.pop(0) for x in words])
        known = self.known
        self._learn(set().union(*words).difference(known))
        out = [a + b"".join(map(known.__getitem__, x)) for a, x in zip(first, words, strict=True)]
        if self.held > KNOWN_BYTES // 2:
            self.known, self.older, self.held = {}, known, 0
        return out


def _cut(text: str) -> list[Word]:
    """The words of a text; the first stands behind nothing."""
    simple = not ODD_SPACE.search(text) and "  " not in text and " \n" not in text and "\n " not in text and "\n\n" not in text
    words: list[Word] = []
    for line in text.split("\n") if simple else LINE_START.split(text):
        at = len(words)
        words += line.split(" ") if simple else WORD_START.split(line)
        if at:
            words[at] = ("\n", words[at])
    return words


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and ``end_id``, cut where longer than ``capacity``.

    Only the first piece of a cut document may be shorter than ``capacity``.  Null text: as empty.
    """
    path = tokenizer_path or default_tokenizer()
    schema = T.StructType.fromDDL(PIECES + (", ids array<int>" if keep_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, target = ByteTokenizer.shared(path), arrow_schema(schema)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                encoded = tokenizer.ids(part.column("text").to_pylist())
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += np.array([end_id], "<u4").tobytes()
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n, capacity), n]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = ids[4 * a : 4 * b]
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(own), *([np.frombuffer(own, "<i4")] if keep_ids else ())))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return map_arrow(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, schema)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; the lengths in descending order go to the fullest bins that take them."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            rooms = [r for r in open_ if r >= length and open_[r]]
            if rooms:
                room = min(rooms)
                pattern, bins = open_[room].pop()
                used = min(bins, left)
                if bins > used:
                    open_[room].append((pattern, bins - used))
                open_.setdefault(room - length, []).append(((*pattern, length), used))
                left -= used
            else:
                each = capacity // length
                for bins, n in ((left // each, each), (1 if left % each else 0, left % each)):
                    if bins:
                        open_.setdefault(capacity - n * length, []).append(((length,) * n, bins))
                left = 0
    return [x for bins in open_.values() for x in bins]


def fillings(room: int, counts: dict[int, int], budget: list[int]) -> Iterator[tuple[Pattern, int]]:
    """Undominated fillings of ``room`` and their waste, least waste first; each partial filling takes one of the budget.

    Undominated: no unused piece fits beside the members, or fits in place of a shorter one.
    """
    lengths = sorted((k for k, n in counts.items() if n and k <= room), reverse=True)
    rising = lengths[::-1]
    behind = np.cumsum([0] + [k * counts[k] for k in rising])[::-1].tolist()  # bytes of the lengths from each place on

    def exact(left: int, at: int) -> Iterator[Pattern]:
        if budget[0] <= 0:
            return
        budget[0] -= 1
        if not left:
            yield ()
            return
        for j in range(max(at, len(rising) - bisect_left(rising, left + 1)), len(lengths)):
            if behind[j] < left or budget[0] <= 0:
                return
            k = lengths[j]
            for n in range(min(counts[k], left // k), 0, -1):
                for rest in exact(left - n * k, j + 1):
                    yield (k,) * n + rest

    for waste in range(room + 1):
        for own in exact(room - waste, 0):
            used = Counter(own)
            spare = [y for y in rising if counts[y] > used[y]] if waste else []
            if spare and (spare[0] <= waste or any(x < y <= x + waste for x in used for y in spare)):
                continue
            yield own, waste
        if budget[0] <= 0:
            return


def bin_completion(counts: dict[int, int], capacity: int, steps: int = 2_000_000) -> tuple[list[tuple[Pattern, int]], bool]:
    """Patterns (lengths that share a sequence) and how often each is used; and whether no packing has fewer sequences.

    The search ends at the lower bound, when it has tried everything that could be better, or
    after ``steps`` partial fillings, with the best packing so far.
    """
    left = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in left.items())
    least = -(-total // capacity)
    best = best_fit_decreasing(left, capacity)
    incumbent = sum(n for _, n in best)
    if incumbent == least:
        return best, True
    budget = [steps]

    def options() -> Iterator[tuple[Pattern, int, int]]:
        longest = max(left)
        left[longest] -= 1
        rest = dict(left)
        left[longest] += 1
        for own, waste in fillings(capacity - longest, rest, budget):
            pattern = (longest, *own)
            for times in range(min(left[k] // n for k, n in Counter(pattern).items()), 0, -1):
                yield pattern, times, waste

    def put(pattern: Pattern, times: int) -> None:
        for k in pattern:
            left[k] = left.get(k, 0) + times
            if not left[k]:
                del left[k]

    frames, chosen, wasted = [options()], [], 0
    while frames and budget[0] > 0:
        affordable = (incumbent - 1) * capacity - total - wasted
        step = next(frames[-1], None)
        if step is None or step[2] > affordable:  # fillings come by their waste: the others waste more
            frames.pop()
            if chosen:
                pattern, times, waste = chosen.pop()
                wasted -= times * waste
                put(pattern, times)
            continue
        pattern, times, waste = step
        if times * waste > affordable:
            continue
        put(pattern, -times)
        if left:
            chosen.append(step)
            wasted += times * waste
            frames.append(options())
            continue
        best = [(p, n) for p, n, _ in [*chosen, step]]
        incumbent = sum(n for _, n in best)
        put(pattern, times)
        if incumbent == least:
            return best, True
    return best, budget[0] > 0


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (any columns, among them length) with sequence_id and offset."""
    rows = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length, at most ``capacity``
    counts = {r["length"]: r["n"] for r in rows}
    plan, _ = bin_completion({k: v for k, v in counts.items() if k < capacity}, capacity)
    at: dict[int, list[tuple[int, int, int]]] = {}  # by length: first rank, sequence less rank, offset
    taken = dict.fromkeys(counts, 0)
    sequences = 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            at.setdefault(length, []).append((taken[length], sequences - taken[length], offset))
            taken[length] += times
            offset += length
        sequences += times
    at[capacity] = [(0, sequences, 0)]
    tables = {k: np.array(v, np.int64) for k, v in at.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            table = tables[int(lengths[part[0]])]
            row = table[np.searchsorted(table[:, 0], ranks[part], side="right") - 1]
            out[part, 0], out[part, 1] = ranks[part] + row[:, 1], row[:, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    salts = max(64, max(counts.values(), default=0) // RANKED_TOGETHER)
    ranked = gapless_rank(pieces, ["length"], order, "__rank", salts)
    seated = ranked.withColumn("__seat", seat("length", "__rank"))
    return seated.select(*[F.col(c) for c in pieces.columns], "__seat.sequence_id", "__seat.offset")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every piece of every row is placed; repeated rows are packed as often as they stand there.
    Null doc_id: packed as any other.  Empty table: no rows.
    """
    return place(written(token_pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids)), capacity)
