"""Token counts of every prefix of a text, by prefix dynamic programming over a public BPE vocabulary.

The vocabulary is one of words: text is normalised, white space goes, each word is merged by itself
and its last character carries a mark. The last token of the encoding of a prefix is the only one
that may follow the last token of what is left of it, so one step over the tokens that end at a place
gives that place's count from an earlier one; whether a token may follow another depends on these two
alone. Counts are kept as steps from one code point to the next, 16 bits each, from which any
question about truncation or a budget is answered without encoding again.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate
from operator import sub
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from .common import arrow, table

MODEL = "word_bpe_49k.json"
LIMIT = 2048
#: What marks the last character of a word, and the most code points of a pretoken's kept tail.
END, TAIL = "</w>", 64
#: Words whose steps a worker remembers before it starts anew, their most code points, the code points looked at and the bytes of steps returned at a time.
REMEMBERED, SHORT, PART, BATCH_BYTES = 400_000, 64, 1 << 20, 16_000_000
#: Beginnings of words of so many characters, which many words share, are kept too.
ROOT = 8
LETTER, NUMBER, OTHER = "letter", "number", "other"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on, in turn."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Which tokens there are and which may follow each other."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.split = {a + b: (a, b, i) for i, (a, b) in enumerate(pairs)}
        self.onto: dict[str, dict[str, int]] = {}
        for (a, b), i in self.rank.items():
            self.onto.setdefault(a, {})[b] = i
        if len(self.split) < len(pairs) or any(self.split[x][2] >= i for i, p in enumerate(pairs) for x in p if x in self.split):
            raise ValueError("tokens must be made by one merge each, of tokens made before")
        self._edges: dict[tuple[str, int], list[tuple[str, float]]] = {}
        #: By what a word's last token ends with ("" or END): the tokens that are the encoding of their own characters, without that end.
        self.whole: dict[str, set[str]] = {"": set(), END: set()}
        for t in vocabulary:
            if t not in self.split:
                self._keep(t)
        for t, (x, y, _) in self.split.items():  # by rank
            if self._kept(x) and self._kept(y) and not any(m < self.rank[x, y] for m in self._crossing(x, y)):
                self._keep(t)
        #: Of every end of such a token: 1 if it is one itself where the word goes on, 2 if it is one where it ends.
        self.kinds: dict[str, int] = {}
        for bit, tokens in ((1, self.whole[""]), (2, self.whole[END])):
            for t in tokens:
                for i in range(len(t)):
                    self.kinds[t[i:]] = self.kinds.get(t[i:], 0) | (bit if not i else 0)
        self.known: dict[tuple[str, str], bool] = {}

    def _kept(self, token: str) -> bool:
        return token.removesuffix(END) in self.whole[END if self._last(token) else ""]

    @staticmethod
    def _last(token: str) -> bool:
        return len(token) > len(END) and token.endswith(END)

    def _keep(self, token: str) -> None:
        last = self._last(token)
        self.whole[END if last else ""].add(token.removesuffix(END) if last else token)

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The symbols that stand at a token's end (side 1) or start (0) while it is merged, each with the rank of the merge that takes it in."""
        key = token, side
        if key not in self._edges:
            out, until = [(token, float("inf"))], None
            while token in self.split:
                until, token = self.split[token][2], self.split[token][side]
                out.append((token, until))
            self._edges[key] = out
        return self._edges[key]

    def _crossing(self, left: str, right: str) -> list[int]:
        """Ranks of merges that cross the border of two tokens before either has taken in what they need. One of equal rank within the left token comes first, one within the right token later."""
        out, ends = [], self.edge(right, 0)
        for a, before in self.edge(left, 1):
            then = self.onto.get(a)
            if then is not None:
                for b, after in ends:
                    m = then.get(b)
                    if m is not None and m < before and m <= after:
                        out.append(m)
        return out

    def follows(self, left: str, right: str) -> bool:
        """Whether two tokens in turn are the encoding of their characters: no merge crosses their border."""
        key = left, right
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= 2 * REMEMBERED:
                self.known.clear()
            got = self.known[key] = not self._crossing(left, right)
        return got


    def step(self, text: str, before: Callable) -> tuple[str, int, int]:
        """The last token of a part of a word and the number of tokens, if the word goes on; the number if it ends here.

        ``before`` gives the same of the first so many characters of the text. Exactly one of the tokens that
        end here may follow; ever longer ends are looked up until none of the tokens ends so.
        """
        kinds, known, at = self.kinds, self.known, len(text)
        last, count, total = None, 0, 0
        for start in range(at - 1, -1, -1):
            token = text[start:]
            kind = kinds.get(token)
            if kind is None:
                break
            if kind & 1 and last is None:
                left = before(start)
                ok = known.get((left[0], token)) if start else True
                if ok or (ok is None and self.follows(left[0], token)):
                    last, count = token, left[1] + 1
                    if total:
                        break
            if kind & 2 and not total:
                left = before(start)
                ok = known.get((left[0], token + END)) if start else True
                if ok or (ok is None and self.follows(left[0], token + END)):
                    total = left[1] + 1
                    if last is not None:
                        break
        return last, count, total


_START = ("", 0, 0)


class Run:
    """A growing word: what ``Merges.step`` gives for each of its prefixes, of a long one for the tail, on which the next steps depend."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.text, self.states = merges, "", [_START]

    def push(self, letters: str) -> None:
        for c in letters:
            self.text += c
            self.states.append(self.merges.step(self.text, self.states.__getitem__))

    def total(self) -> int:
        return self.states[-1][2]

    def cut(self, n: int) -> None:
        self.text = self.text[:n]
        del self.states[n + 1 :]

    def forget(self) -> None:
        if len(self.text) > 64 * TAIL:
            self.text, self.states = self.text[-TAIL:], self.states[-TAIL - 1 :]


class Counter:
    """Reads a text code point by code point and knows the tokens of what it has read, as if that were all.

    Words are runs of letters, single numbers, runs of others, and the short forms after an apostrophe
    that begins a word, of one or two letters; of the latter the first letter may turn out to begin a run.
    """

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.total, self.kind, self.run, self.apostrophe, self.before = 0, "", None, "", 0

    def _word(self, letters: str) -> int:
        run = Run(self.merges)
        run.push(letters)
        return run.total()

    def feed(self, c: str, kind: str, letters: str) -> None:
        was = self.apostrophe
        if (was == "'" and c in ("s", "t", "m", "d")) or was + c in ("'re", "'ve", "'ll"):
            self.total = self.before + self._word(was + c)
            self.kind, self.run, self.apostrophe = "", None, ""
            return
        starts = kind != self.kind or kind == NUMBER
        if starts:
            if self.run is not None:
                self.total += self.run.total()
            self.kind, self.run = kind, Run(self.merges)
        self.run.push(letters)
        if starts and c == "'":
            self.apostrophe, self.before = "'", self.total
        else:
            self.apostrophe = was + c if was == "'" and c in ("r", "v", "l") else ""

    def tokens(self) -> int:
        return self.total + (self.run.total() if self.run is not None else 0)

    def state(self) -> tuple:
        return self.total, self.kind, self.run, self.apostrophe, self.before, len(self.run.text) if self.run is not None else 0

    def back(self, state: tuple) -> None:
        self.total, self.kind, self.run, self.apostrophe, self.before, n = state
        if self.run is not None:
            self.run.cut(n)


def joins(c: str) -> bool:
    """Whether a code point may merge with, or move among, those before it under normalisation."""
    return unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or "\ud7b0" <= c <= "\ud7ff"


def easy(c: str) -> bool:
    """Whether a code point is long known, by itself under normalisation, and has one in lower case of which the same holds."""
    low = c.lower()
    return all(len(x) == 1 and not joins(x) and unicodedata.ucd_3_2_0.category(x) == unicodedata.category(x) and unicodedata.category(x) not in ("Cn", "Cs", "Co") and unicodedata.normalize("NFC", x) == x for x in (c, low)) and c != "\u03a3"


def ranges(chars: list[str]) -> str:
    """A class of a regular expression, without brackets."""
    out, codes = [], sorted(map(ord, chars))
    for x in codes:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


#: A step, as stored.
STEP = struct.Struct("<h")


def _bytes_of(counts: list[int]) -> bytes:
    return array("h", map(sub, counts, [0, *counts])).tobytes()


class Steps:
    """A vocabulary: the steps of the token count from each code point of a text to the next."""

    def __init__(self, model: bytes) -> None:
        spec = json.loads(model)
        self.tokenizer = Tokenizer.from_str(model.decode())
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.letters = byte_letters()
        self.compose, self.lower = normalizers.NFC(), normalizers.Lowercase()
        every = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
        blank = ranges([c for c in every if unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc", "Cf") and not self.words(c)])
        simple = [c for c in every if easy(c)]
        special = "|".join(sorted((re.escape(t["content"]) for t in spec["added_tokens"]), key=len, reverse=True)) or "(?!)"
        letter, number = (ranges([c for c in simple if unicodedata.category(c)[0] == k]) for k in "LN")
        self.special, self.blank, self.hard = re.compile(special), re.compile(f"[{blank}]"), re.compile(f"{special}|[^{ranges(simple)}]")
        self.parts = re.compile(f"[{blank}]?[^{blank}]+|[{blank}]+")
        self.pretokens = re.compile(f"'(?:[stmd]|re|ve|ll)|[{blank}]?[{letter}]+|[{number}]|[^{blank}{letter}{number}]+|[{blank}]+")
        self._one: dict[str, tuple[str, str]] = {}
        self._alone: dict[str, list | None] = {}
        self._known: dict[str, bytes] = {}
        self._nodes: dict[str, tuple] = {}

    def words(self, text: str) -> list:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(text)

    def _bytes(self, c: str) -> str:
        return "".join([self.letters[b] for b in c.encode("utf-8", "surrogatepass")])

    def _kind(self, c: str) -> tuple[str, str]:
        """What a normalised code point is, as the library's own splitting has it, and its bytes' characters."""
        if c not in self._one:
            kind = LETTER if len(self.words("a" + c)) == 1 else OTHER if len(self.words("!" + c)) == 1 else NUMBER
            self._one[c] = kind, self._bytes(c)
        return self._one[c]

    def _normal(self, text: str) -> list[tuple[str, str, str]]:
        return [(c, *self._kind(c)) for c in self.lower.normalize_str(self.compose.normalize_str(text))]

    def _single(self, c: str) -> list | None:
        """A code point's normalised ones; none for one that joins those before it."""
        if c not in self._alone:
            self._alone[c] = None if joins(c) else self._normal(c)
        return self._alone[c]

    def _read(self, text: str) -> list[int]:
        """The tokens of each prefix of a text without white space, special strings taken as ordinary ones."""
        counter, out, at = Counter(self.merges), [], 0
        while at < len(text):
            end = at + 1
            while end < len(text) and self._single(text[end]) is None:
                end += 1
            mark = counter.state()
            for k in range(at + 1, end + 1):  # nearly always one round: marks change what stands before them
                if k > at + 1:
                    counter.back(mark)
                for x in (self._single(text[at]) if k == at + 1 else None) or self._normal(text[at:k]):
                    counter.feed(*x)
                out.append(counter.tokens())
            if counter.run is not None:
                counter.run.forget()
            at = end
        return out

    def counts(self, text: str) -> list[int]:
        """The tokens of each prefix of any text without white space; a special string is one token once it is complete."""
        out, base, at = [], 0, 0
        for m in self.special.finditer(text):
            plain = self._read(text[at : m.end() - 1])
            out.extend(base + n for n in plain)
            base += (plain[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        out.extend(base + n for n in self._read(text[at:]))
        return out

    def _of_word(self, word: str) -> bytes:
        """The steps of a pretoken of easy, lower-cased code points; those of each prefix are kept for the words that begin so."""
        if word[0] == "'" and len(word) > 1 and word[1] in "stmdrvl":
            return _bytes_of(self.counts(word))
        if len(word) > SHORT:
            run, counts = Run(self.merges), []
            for c in word:
                run.push(self._bytes(c))
                counts.append(run.total())
                run.forget()
            return _bytes_of(counts)
        nodes = self._nodes
        if len(nodes) >= REMEMBERED:
            nodes.clear()
        letters = word if word.isascii() and word.isprintable() else self._bytes(word)
        done = min(len(letters), ROOT)
        while done and letters[:done] not in nodes:
            done -= 1
        states = [_START, *(nodes[letters[:k]] for k in range(1, done + 1))]
        ends = () if letters is word else set(accumulate(len(c.encode()) for c in word))
        total, steps = (states[-1][2], states[-1][3]) if done else (0, b"")  # within a code point: those of the ones before it
        step, get = self.merges.step, states.__getitem__
        for at in range(done + 1, len(letters) + 1):
            text = letters[:at]
            last, count, final = step(text, get)
            if not ends or at in ends:
                steps += STEP.pack(final - total)
                total = final
            states.append((last, count, total, steps))
            if at <= ROOT:
                nodes[text] = states[-1]
        return steps

    def _remember(self, part: str, read: Callable) -> bytes:
        """The steps of a part: white space, or at most one such code point and what ``read`` gives for the rest."""
        lead = len(part) if self.blank.match(part[-1]) else 1 if self.blank.match(part) else 0
        got = bytes(2 * lead) + (read(part[lead:]) if lead < len(part) else b"")
        if len(part) <= SHORT:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[part] = got
        return got

    def steps(self, text: str) -> np.ndarray:
        """The change of the token count at each code point: the sum of the first n is the count of the first n code points.

        Code points of white space add nothing and part what stands around them. Texts of easy code points
        split into pretokens whose steps are looked up; of others each part between white space is read
        code point by code point. A text goes through in parts that end before white space.
        """
        out, at = [], 0
        while at < len(text):
            stop = len(text)
            if stop - at > PART and (m := self.blank.search(text, at + PART)):
                stop = m.start()
            part = text[at:stop]
            out.append(self._easy(part) if not self.hard.search(part) else b"".join([self._mixed(p) for p in self.parts.findall(part)]))
            at = stop
        return np.frombuffer(b"".join(out), np.int16)

    def _easy(self, text: str) -> bytes:
        known, read = self._known, self._of_word
        return b"".join([known.get(p) or self._remember(p, read) for p in self.pretokens.findall(text.lower())])

    def _mixed(self, part: str) -> bytes:
        if not self.hard.search(part):
            return self._easy(part)
        return self._known.get(part) or self._remember(part, lambda rest: _bytes_of(self.counts(rest)))


_LOADED: dict[str, Steps] = {}


def loaded(model: bytes) -> Steps:
    """The vocabulary, built once in a worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Steps(model)
    return _LOADED[key]


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_tokens and ``steps`` (array of smallint, one for each code point) of every row; see ``tokens_before`` and ``longest_prefix``.

    A null or empty text has no steps and no tokens. Rows are independent: repeated rows repeat, an empty
    table gives no rows, and other columns aren't looked at. A very long text goes through in parts, its
    steps (two bytes a code point) in one row; of an unbroken word only the tail is held. The vocabulary's
    file, of bounded size, is read on the driver and sent to workers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(public_tokenizers.path(model)).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = loaded(sent.value)
        keys, sizes, tokens, steps, held = [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, steps)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(steps)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), lists], ["doc_id", "n_bytes", "n_tokens", "steps"])

        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = value.as_py() or ""
                x = s.steps(text)
                keys.append(key)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                tokens.append(int(x.sum(dtype=np.int64)))
                steps.append(x)
                held += x.nbytes
                if held > BATCH_BYTES:
                    yield batch()
                    keys, sizes, tokens, steps, held = [], [], [], [], 0
        if keys:
            yield batch()

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long, steps array<smallint>")


def tokens_before(steps: Column, n_chars: Column | int) -> Column:
    """The tokens of a text's first so many code points."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.aggregate(F.slice(steps, 1, n.cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)


def longest_prefix(steps: Column, budget: Column | int) -> Column:
    """The most leading code points whose tokens fit a budget: counts may fall again as a word goes on, so the last place that fits is taken."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("fits"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + x
        return F.struct((acc["at"] + 1).alias("at"), n.alias("n"), F.when(n <= most, acc["at"] + 1).otherwise(acc["fits"]).alias("fits"))

    return F.aggregate(steps, zero, step)["fits"]


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds fit_chars, the most leading code points within the limit."""
    out = token_counts(table(spark, sf_dir, "documents"))
    over = F.col("n_tokens") > LIMIT
    return out.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"), F.when(over, longest_prefix(F.col("steps"), LIMIT)).otherwise(F.size("steps")).cast("long").alias("fit_chars"))
