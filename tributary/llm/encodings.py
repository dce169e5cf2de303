"""Garbled text from wrong character encodings: found, and restored where possible.

A multinomial classifier on hashed byte bigrams predicts the encoding chain that garbled a word. It is
trained on all words of the corpus that are looked at, garbled synthetically through every chain of ``CHAINS``;
words that one model finds garbled are left out of the next, for ``ROUNDS`` rounds. Words are counted, garbled and
judged once each, in tasks; the driver holds counts by class and bucket and by character, but no words. A predicted
chain is inverted and must decode strictly and give the same word when garbled again. Chains out of multi-byte encodings, whose strict decoding is hard to meet by chance,
may convict by one word; chains between single-byte encodings need words whose restored forms the corpus
knows better than the given ones.

Only words with characters beyond ASCII are looked at, all of them, outside passages quoted between single
backquotes on one line. The replacement character means a loss that cannot be undone: no chain explains it and the
classifier takes no part, so such texts are marked ``lost`` apart from the chains. Chains that agree on all words that
one of them restores in a text cannot be told apart there; the first of them in ``CHAINS`` is named.

Defined results
* NULL and empty texts, and plain ASCII, are never garbled. Texts are read whole, whatever their length.
* A text with words garbled by several chains has each word restored by its own chain.
* Repeated rows are judged alike, each row gives a row. Empty tables give empty results.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.runtime import broadcast_within, materialise

BUCKETS = 1 << 13
SMOOTHING = 0.02
#: Log odds that one word must reach: by itself, or summed up in a text for chains of single-byte encodings.
ONE_WORD, WHOLE_TEXT, PRIOR = 3.0, 8.0, -5.0
#: Log odds against a chain up to which its restored word is still compared; rounds of cleaning the words.
DOUBT, ROUNDS = 12.0, 3
#: Letters of a word that may speak for a chain between single-byte encodings.
SHORTEST = 3
#: Remembered verdicts of a model, and the longest word remembered.
MEMORY, LONGEST_WORD = 100_000, 60
#: Characters of words that a task garbles at once; rows and bytes of tables that may be broadcast.
GARBLED, MAX_ROWS, MAX_BYTES = 1 << 18, 200_000, 32 << 20
#: Rows of the batches that tasks give.
ROWS = 20_000

#: Encoding steps (written in, read in) of each chain.
CHAINS = {
    "utf_8>cp1252": [("utf_8", "cp1252")], "utf_8>latin_1": [("utf_8", "latin_1")],
    "utf_8>cp1252 twice": [("utf_8", "cp1252")] * 2, "utf_8>latin_1 twice": [("utf_8", "latin_1")] * 2,
    "utf_8>cp437": [("utf_8", "cp437")], "utf_8>cp850": [("utf_8", "cp850")], "utf_8>cp866": [("utf_8", "cp866")],
    "utf_8>mac_roman": [("utf_8", "mac_roman")], "utf_8>cp1250": [("utf_8", "cp1250")], "utf_8>iso8859_2": [("utf_8", "iso8859_2")],
    "utf_8>cp1251": [("utf_8", "cp1251")], "utf_8>cp1251 twice": [("utf_8", "cp1251")] * 2, "utf_8>koi8_r": [("utf_8", "koi8_r")],
    "utf_8>cp1253": [("utf_8", "cp1253")], "utf_8>cp1254": [("utf_8", "cp1254")], "utf_8>iso8859_15": [("utf_8", "iso8859_15")],
    "utf_8>shift_jis": [("utf_8", "cp932")], "utf_8>gbk": [("utf_8", "gbk")],
    "cp932>cp1252": [("cp932", "cp1252")], "cp932>latin_1": [("cp932", "latin_1")], "cp932>cp437": [("cp932", "cp437")],
    "euc_jp>cp1252": [("euc_jp", "cp1252")], "euc_jp>latin_1": [("euc_jp", "latin_1")], "gbk>latin_1": [("gbk", "latin_1")],
    "cp1251>cp1252": [("cp1251", "cp1252")], "cp1251>latin_1": [("cp1251", "latin_1")], "cp1251>koi8_r": [("cp1251", "koi8_r")],
    "cp1251>cp866": [("cp1251", "cp866")], "cp866>cp1251": [("cp866", "cp1251")], "koi8_r>cp1251": [("koi8_r", "cp1251")],
    "koi8_r>cp1252": [("koi8_r", "cp1252")], "koi8_r>latin_1": [("koi8_r", "latin_1")], "cp866>cp1252": [("cp866", "cp1252")],
    "cp1250>cp1252": [("cp1250", "cp1252")], "cp1250>latin_1": [("cp1250", "latin_1")], "iso8859_2>cp1252": [("iso8859_2", "cp1252")],
    "iso8859_2>latin_1": [("iso8859_2", "latin_1")], "cp1250>iso8859_2": [("cp1250", "iso8859_2")],
    "cp1252>cp1250": [("cp1252", "cp1250")], "cp1252>cp1251": [("cp1252", "cp1251")], "cp1252>cp437": [("cp1252", "cp437")],
    "cp1252>cp850": [("cp1252", "cp850")], "cp1252>mac_roman": [("cp1252", "mac_roman")], "cp437>cp1252": [("cp437", "cp1252")],
    "cp850>cp1252": [("cp850", "cp1252")], "mac_roman>cp1252": [("mac_roman", "cp1252")],
}
NAMES = list(CHAINS)
_MULTI = ("utf_8", "cp932", "euc_jp", "gbk")
LOST, LOSS = "lost", "\ufffd"

_QUOTED = re.compile(r"(?<!`)`(?!`)[^`\n]*`(?!`)")
#: Words with a character beyond ASCII; a word is tried from its beginning only, so the search is linear.
_WORD = re.compile(r"(?<![^ \t\n\r])[\x00-\x08\x0b\x0c\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^ \t\n\r]*+")


def core(word: str) -> str:
    """A word without what is no letter at its ends."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def _table(name: str) -> tuple[list[str], dict[str, int]]:
    """A single-byte encoding in which bytes without a character stand for the control of the same number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


_tables: dict = {}


def _single(name: str):
    if name not in _tables:
        _tables[name] = None if codecs.lookup(name).name in ("utf-8", "cp932", "euc_jp", "gbk") else _table(name)
    return _tables[name]


def _to_bytes(text: str, name: str) -> bytes | None:
    table = _single(name)
    if table is None:
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    try:
        return bytes([table[1][c] for c in text])
    except KeyError:
        return None


def _to_text(data: bytes, name: str) -> str | None:
    table = _single(name)
    if table is None:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            return None
    return "".join([table[0][b] for b in data])


def garble(text: str, chain: str) -> str | None:
    """``text`` as it comes out of ``chain``; NULL where it cannot be written in the chain's encodings."""
    for written, read in CHAINS[chain]:
        data = _to_bytes(text, written)
        text = None if data is None else _to_text(data, read)
        if text is None:
            return None
    return text


def restore(text: str, chain: str) -> str | None:
    """The text that ``chain`` garbled into ``text``, if it decodes strictly and garbles back to it."""
    original = text
    for written, read in reversed(CHAINS[chain]):
        data = _to_bytes(text, read)
        text = None if data is None else _to_text(data, written)
        if text is None:
            return None
    return text if text != original and garble(text, chain) == original else None


def _bucket(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    pairs = first * 256 + second
    return (pairs * 40503 + (pairs >> 7)) % BUCKETS


def features(word: str) -> np.ndarray:
    """Buckets of the byte bigrams with a byte beyond ASCII, word ends included."""
    data = np.frombuffer(b" " + word.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.int64)
    beyond = (data[:-1] > 127) | (data[1:] > 127)
    return _bucket(data[:-1], data[1:])[beyond]


def _bigrams(owned: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every bigram that ``features`` gives, over all words at once."""
    coded = [w.encode("utf-8", "surrogatepass") for _, w in owned]
    data = np.frombuffer(b" " + b"".join(c + b" " for c in coded), dtype=np.uint8).astype(np.int64)
    owners = np.repeat(np.array([i for i, _ in owned], dtype=np.int64), np.array([len(c) + 1 for c in coded], dtype=np.int64))
    beyond = (data[:-1] > 127) | (data[1:] > 127)
    return owners[beyond], _bucket(data[:-1], data[1:])[beyond]


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Where the words with characters beyond ASCII begin and end, without what is quoted."""
    quoted, at = [m.span() for m in _QUOTED.finditer(text)] if "`" in text else [], 0
    for m in _WORD.finditer(text):
        while at < len(quoted) and quoted[at][1] <= m.start():
            at += 1
        if at < len(quoted) and quoted[at][0] < m.end():
            pieces, start = [], m.start()
            for a, b in quoted[at:]:
                if a >= m.end():
                    break
                pieces.append((start, max(start, a)))
                start = max(start, b)
            pieces.append((start, m.end()))
        else:
            pieces = [m.span()]
        yield from ((a, b) for a, b in pieces if not text[a:b].isascii())


class _Judge:
    """Judges texts by what ``judge`` and ``follows`` say of their words."""

    def text(self, text: str) -> tuple[list[str], str] | None:
        """Chains that garbled ``text`` and the text restored, or NULL for a clean text."""
        if not text or text.isascii():
            return None
        found, spans, clean, sums, alone = [], [], [], defaultdict(float), set()
        for a, b in _pieces(text):
            if (v := self.judge(text[a:b])) is None:
                clean.append((a, b))
            else:
                found.append((text[a:b], v))
                spans.append((a, b))
        if not found:
            return None
        found = _one_story(found)
        for _, v in found:
            sums[v[0]] += v[1]
            if v[3] and v[1] > ONE_WORD:
                alone.add(v[0])
        chains = sorted(c for c in sums if c in alone or sums[c] > WHOLE_TEXT)
        if not chains:
            return None
        convicted = [(a, b, v[0], v[2]) for (a, b), (_, v) in zip(spans, found) if v[0] in chains]
        words = defaultdict(set)
        for a, b, chain, back in convicted:
            words[chain].add((text[a:b], back))
        # words that say too little by themselves go by the chain with most evidence in their text
        ranked = sorted((c for c in chains if c != LOST), key=lambda c: (-sums[c], NAMES.index(c)))
        open_ = clean + [s for s, (_, v) in zip(spans, found) if v[0] not in chains]
        for a, b in open_ if ranked else []:
            if (back := self.follows(text[a:b], ranked[0])) is not None:
                convicted.append((a, b, ranked[0], back))
        out, done = [], 0
        for a, b, _, back in sorted(convicted):
            out += [text[done:a], back]
            done = b
        return sorted({_first_alike(c, words[c]) for c in chains}), "".join([*out, text[done:]])


class Model(_Judge):
    """Log probabilities of the buckets by class (the first is clean text), and the corpus's words and characters.

    ``table`` has the words' letters with their counts (``core, n``); ``cores`` has them in memory, which only judging
    texts outside tables needs.
    """

    def __init__(self, counts: np.ndarray, chars: Counter, table: DataFrame | None = None):
        self.chars, self.table = {c for c, n in chars.items() if n > 0}, table
        self.used = counts.sum(axis=1) > 0
        counts = counts + SMOOTHING
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        self.memory: dict = {}

    @cached_property
    def cores(self) -> dict[str, int]:
        return {r["core"]: r["n"] for r in self.table.collect()}

    def state(self) -> dict:
        """Plain values, to be given to ``from_state``."""
        return {"log": self.log, "used": self.used, "chars": self.chars, "cores": self.cores}

    @classmethod
    def from_state(cls, state: dict) -> Model:
        model = cls.__new__(cls)
        model.__dict__.update(state, memory={}, table=None)
        return model

    def known(self, word: str) -> int:
        letters = core(word).lower()
        return self.cores.get(letters, 0) if letters else 0

    def judge(self, word: str) -> tuple[str, float, str, bool] | None:
        """``chain, evidence, restored, may convict alone`` of a word, or NULL for a clean one.

        Evidence is the classifier's log odds against clean text plus how much better the corpus knows the
        restored word than the given one.
        """
        if word in self.memory:
            return self.memory[word]
        found = self._judge(word)
        if len(word) > LONGEST_WORD:
            return found
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        self.memory[word] = found
        return found

    def _judge(self, word: str):
        if LOSS in word:
            return LOST, 99.0, word, True
        best = None
        for i, odds, _, back, alone in self.options(word, -DOUBT):
            support = float(np.log((self.known(back) + 0.1) / (self.known(word) + 0.1)))
            total = odds + support
            if total > 0 and (alone or (support > 0 and len(core(word)) >= SHORTEST)) and (best is None or total > best[1]):
                best = NAMES[i], total, back, alone
        return best

    def options(self, word: str, least: float) -> Iterator[tuple[int, float, float, str, bool]]:
        """``chain, odds, odds without prior, restored, may convict alone`` of the chains that may have garbled ``word``, with odds beyond ``least``."""
        scores = self.log[:, features(word)].sum(axis=1)
        odds = scores[1:] - scores[0] + PRIOR
        for i in np.flatnonzero((odds > least) & self.used[1:]):
            back = restore(word, NAMES[i])
            if back is None:
                continue
            beyond = [c for c in back if ord(c) > 127]
            if not beyond or sum(c in self.chars for c in beyond) < 0.9 * len(beyond):
                continue
            written = CHAINS[NAMES[i]][0][0]
            alone = written == "utf_8" or (written in _MULTI and len(beyond) > 1 and all(ord(c) > 0x2FFF for c in beyond))
            yield int(i), float(odds[i]), float(scores[i + 1] - scores[0]), back, alone

    def follows(self, word: str, chain: str) -> str | None:
        """``word`` restored, if in a text that ``chain`` has garbled it is likelier garbled than not; neither prior nor length count here."""
        back = restore(word, chain)
        if back is None:
            return None
        beyond = [c for c in back if ord(c) > 127]
        if not beyond or sum(c in self.chars for c in beyond) < 0.9 * len(beyond):
            return None
        scores = self.log[[0, NAMES.index(chain) + 1]][:, features(word)].sum(axis=1)
        return back if scores[1] - scores[0] + np.log((self.known(back) + 0.1) / (self.known(word) + 0.1)) > 0 else None


def _first_alike(chain: str, words: set[tuple[str, str]]) -> str:
    """The first chain that restores all ``words`` (given, restored) as ``chain`` does."""
    return chain if chain == LOST else next(c for c in NAMES if c == chain or all(restore(w, c) == back for w, back in words))


def _one_story(found: list[tuple[str, tuple]]) -> list[tuple[str, tuple]]:
    """Words that several chains restore alike go to the chain with most evidence in the text."""
    sums: dict = defaultdict(float)
    for _, v in found:
        sums[v[0]] += v[1]
    ranked = sorted((c for c in sums if c != LOST), key=lambda c: (-sums[c], NAMES.index(c)))
    if len(ranked) < 2:
        return found
    out = []
    for piece, v in found:
        better = next((c for c in ranked if c == v[0] or restore(piece, c) == v[2]), v[0]) if v[0] != LOST else LOST
        out.append((piece, (better, *v[1:])))
    return out


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], k) for i, k in enumerate(kinds.values())], list(kinds))


class _Remembered(_Judge):
    """The words of a text as they were judged before: ``verdict, {chain: restored}`` by word."""

    def __init__(self, words: dict[str, tuple[tuple | None, dict[str, str]]]):
        self.words = words

    def judge(self, word: str) -> tuple[str, float, str, bool] | None:
        return (LOST, 99.0, word, True) if LOSS in word else self.words.get(word, (None,))[0]

    def follows(self, word: str, chain: str) -> str | None:
        return self.words[word][1].get(chain) if word in self.words else None


def _texts(docs: DataFrame, text: str, *columns) -> DataFrame:
    """The texts that may be garbled, ``t``, with a hash ``h``; texts of one hash do no harm, as only words are looked up by it."""
    return docs.select(*columns, F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]")).withColumn("h", F.xxhash64("t"))


def _words_of(texts: DataFrame) -> DataFrame:
    """``h, w, n``: the words of every text that are looked at, without those with a loss."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h, w, n) for batch in batches for h, t in zip(*(c.to_pylist() for c in batch.columns)) for w, n in Counter(t[a:b] for a, b in _pieces(t)).items() if LOSS not in w)
        yield from _batches(rows, {"h": pa.int64(), "w": pa.string(), "n": pa.int64()})

    return materialise(texts.select("h", "t").mapInArrow(scan, "h long, w string, n long"), "pieces")


def _vocabulary(pieces: DataFrame) -> DataFrame:
    """``w, core, n``: all different words with their letters and counts."""

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([core(w).lower() for w in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["w", "core", "n"])

    words = pieces.groupBy("w").agg(F.sum("n").alias("n"))
    # few bytes, but much work a word: left alone, or dealt by the words themselves as they are grouped, they would end up in one task
    words = words.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("w"))
    return materialise(words.mapInArrow(letters, "w string, core string, n long"), "words")


def _tally(words: DataFrame) -> tuple[np.ndarray, Counter]:
    """Counts of the buckets by class, over the words as they are and garbled through every chain, and of the characters."""
    size = (1 + len(NAMES)) * BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, chars = np.zeros((1 + len(NAMES), BUCKETS)), Counter()

        def add(words: list[str], counts: list[int]) -> None:
            weights = np.array(counts, dtype=np.float64)
            for k, chain in enumerate([None, *NAMES]):
                bad = ((i, w if chain is None else garble(w, chain)) for i, w in enumerate(words))
                owners, buckets = _bigrams([(i, b) for i, b in bad if b is not None and (chain is None or (b != words[i] and "\n" not in b))])
                sums[k] += np.bincount(buckets, weights[owners], BUCKETS)
            for w, n in zip(words, counts):
                for c in w:
                    chars[c] += n

        some, counts, long = [], [], 0
        for batch in batches:
            for w, n in zip(*(c.to_pylist() for c in batch.columns)):
                some.append(w)
                counts.append(n)
                long += len(w)
                if long > GARBLED:
                    add(some, counts)
                    some, counts, long = [], [], 0
        add(some, counts)
        flat = sums.ravel()
        at = np.flatnonzero(flat)
        cells = np.concatenate([at, np.array([size + ord(c) for c in chars], dtype=np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.concatenate([flat[at], np.array(list(chars.values()), dtype=np.float64)]))], ["cell", "n"])

    found = words.select("w", "n").mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, counts, sums = found["cell"].to_numpy(), found["n"].to_numpy(), np.zeros(size)
    inside = cells < size
    sums[cells[inside]] = counts[inside]
    return sums.reshape(-1, BUCKETS), Counter({chr(c - size): n for c, n in zip(cells[~inside].tolist(), counts[~inside].tolist())})


def _known(words: DataFrame) -> DataFrame:
    """``core, n``: how often the corpus has the letters of its words."""
    return words.where("core <> ''").groupBy("core").agg(F.sum("n").alias("n"))


def _judged(words: DataFrame, model: Model, known: DataFrame, least: float) -> DataFrame:
    """``w, n, best, follows`` of the words that some chain may have garbled: what ``Model.judge`` says of each (``total, rank, chain, back,
    alone``), and every chain that ``Model.follows`` grants with the word restored. ``least``: odds below which no chain is tried."""
    shared = words.sparkSession.sparkContext.broadcast({"log": model.log, "used": model.used, "chars": model.chars, "cores": {}})
    kinds = {"w": pa.string(), "core": pa.string(), "n": pa.int64(), "chain": pa.int32(), "odds": pa.float64(), "gain": pa.float64(), "back": pa.string(), "letters": pa.string(), "alone": pa.bool_(), "long": pa.bool_()}

    def options(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_state(shared.value)
        each = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns)))
        rows = ((w, c, n, i, odds, gain, back, core(back).lower(), alone, len(core(w)) >= SHORTEST) for w, c, n in each for i, odds, gain, back, alone in own.options(w, least))
        yield from _batches(rows, kinds)

    found = words.select("w", "core", "n").mapInArrow(options, "w string, core string, n long, chain int, odds double, gain double, back string, letters string, alone boolean, long boolean")
    found = found.join(known.select("core", F.col("n").alias("given")), "core", "left")
    found = found.join(known.select(F.col("core").alias("letters"), F.col("n").alias("restored")), "letters", "left")
    support = F.log((F.coalesce("restored", F.lit(0)) + 0.1) / (F.coalesce("given", F.lit(0)) + 0.1))
    found = found.withColumn("support", support).withColumn("total", F.col("odds") + F.col("support"))
    wins = (F.col("odds") > -DOUBT) & (F.col("total") > 0) & (F.col("alone") | ((F.col("support") > 0) & F.col("long")))
    best = F.max(F.when(wins, F.struct("total", (-F.col("chain")).alias("rank"), "chain", "back", "alone")))
    follows = F.collect_list(F.when(F.col("gain") + F.col("support") > 0, F.struct("chain", "back")))
    per = found.groupBy("w").agg(F.first("n").alias("n"), best.alias("best"), follows.alias("follows"))
    return per.where("best is not null or size(follows) > 0")


def _fit(words: DataFrame) -> Model:
    """Fit on all words; those found garbled are taken out of the counts, round by round."""
    (counts, chars), kept, gone = _tally(words), words, None
    for _ in range(ROUNDS):
        bad = _judged(kept, Model(counts, chars), _known(kept), -DOUBT).where(F.col("best.total") >= WHOLE_TEXT / 2)
        bad = materialise(bad.select("w", "n"), "garbled")
        if bad.isEmpty():
            break
        less, fewer = _tally(bad)
        counts = counts - less
        chars.subtract(fewer)
        gone = bad if gone is None else gone.unionByName(bad)
        kept = words.join(broadcast_within(gone, MAX_ROWS, MAX_BYTES), "w", "left_anti")
    return Model(counts, chars, materialise(_known(kept), "known"))


def train(docs: DataFrame, text: str) -> Model:
    """Fit on all words with characters beyond ASCII of all texts, outside quotes."""
    return _fit(_vocabulary(_words_of(_texts(docs, text))))


def find_garbled(docs: DataFrame, doc_id: str, text: str, model: Model | None = None) -> DataFrame:
    """``doc_id, chains, restored, lost`` of the garbled texts; the model's counts (about 2 MB) are broadcast.

    ``lost`` texts hold the replacement character; ``chains`` are those the classifier found, none if it found none.
    Every different word is judged once; texts without a word that is found garbled are not read again in Python.
    """
    texts = _texts(docs, text, F.col(doc_id).cast("long").alias("id"))
    pieces = _words_of(texts)
    words = _vocabulary(pieces)
    fitted = _fit(words) if model is None else model
    known = docs.sparkSession.createDataFrame(list(fitted.cores.items()), "core string, n long") if fitted.table is None else fitted.table
    most = known.agg(F.max("n")).first()[0] or 0
    # no word known as often as the most frequent one is granted below these odds
    least = min(-DOUBT, PRIOR - math.log((most + 0.1) / 0.1) - 0.01)
    judged = materialise(_judged(words, fitted, known, least), "judged")
    here = pieces.select("h", "w").join(broadcast_within(judged.drop("n"), MAX_ROWS, MAX_BYTES), "w").groupBy("h").agg(F.collect_set(F.struct("w", "best", "follows")).alias("judged"))
    here = materialise(here.where(F.exists("judged", lambda x: x["best"].isNotNull())), "suspects")
    suspects = texts.join(broadcast_within(here, MAX_ROWS, MAX_BYTES), "h", "left").where(F.col("judged").isNotNull() | F.col("t").contains(LOSS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, t, judged in zip(*(c.to_pylist() for c in batch.columns)):
                words = {}
                for x in judged or []:
                    best = (v := x["best"]) and (NAMES[v["chain"]], v["total"], v["back"], v["alone"])
                    words[x["w"]] = best, {NAMES[f["chain"]]: f["back"] for f in x["follows"]}
                found = _Remembered(words).text(t)
                if found is not None:
                    rows.append((name, [c for c in found[0] if c != LOST], found[1], LOST in found[0]))
            kinds = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["id", "chains", "restored", "lost"])

    return suspects.select("id", "t", "judged").mapInArrow(scan, "id long, chains array<string>, restored string, lost boolean").withColumnRenamed("id", doc_id)
