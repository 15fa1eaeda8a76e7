"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score the restored text.

Fitting. Labels are read on a sample of at most MOST_LABELLED labelled rows, drawn by a hash of the id, and of documents
that share a MinHash value only one counts, so words of a copied document don't look frequent. The lexicon are words,
and beginnings of words (written with * at the end), whose share of toxic documents is higher than the sample's beyond
chance (a likelihood ratio test over all tried); of related ones only the most telling stays, and a ridge logistic
regression weighs them. The character model counts runs of ORDER + 1 letters in all documents.

Scoring. A token that may hide letters (digits, signs or a repeated letter in it, letters set apart) becomes a
lattice: every sign offers the letters it may stand for, or nothing, every run of a letter one copy or two. The Viterbi
path is the likeliest under the channel and the character model, which mixes the corpus with the lexicon. Only tokens
with a path that the lexicon holds are decoded: of no other could the result match. Restored
words that are in the lexicon add their weight, once a document, however often they occur.

Defined cases: a null or blank text has no words and the base score; a null id counts as '' in the fold; without
labelled rows every score is 0; rows of labels without a document or a label are left out, of several for one document
the highest counts; every row is scored, repeated ones too; very long texts are scored whole; of features with equal
gain the longer, then the first by name goes before; an empty table gives an empty result; other columns may have any
names, drop_toxic returns them as they are.

Parameters of the model, not of the data: a lexicon of at most MOST_CANDIDATES features, and LONGEST, up to which a
token is decoded in one piece. Longer ones are decoded from every start that can reach the lexicon (Tree.pieces).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, WordHashes, ascii_words, broadcast_if_small, shingle_hashes, worker_task
from veilspark.llm.near_dedup import signature

THRESHOLD = 0.3
MOST_LABELLED = 20_000  # labelled rows that the classifier is fitted on
MOST_CANDIDATES = 3000
CHANCE = 0.05  # how likely one word or more may be in the lexicon by chance
BEGINNINGS = range(4, 9)  # letters of the beginnings of words that may be in the lexicon
FAMILY_HASHES = 4  # MinHash values by which copies in the sample are told
RIDGE = 0.02
ORDER = 3
SYMBOLS = 28  # 0: anything but a letter; 1-26: a-z; 27: other letters' bytes
LEXICON_SHARE = 0.5  # of the lexicon in the character model
CACHED = 200_000  # distinct tokens whose word a worker remembers; emptied when full
LONGEST = 48  # longer tokens, runs shortened, are decoded in pieces from where a word may start

# Letters that a sign may stand for, and how likely (the rest of the probability: the sign is a mere separator).
STANDS_FOR = {"0": {"o": 0.9}, "1": {"i": 0.5, "l": 0.4}, "2": {"z": 0.6}, "3": {"e": 0.9}, "4": {"a": 0.9}, "5": {"s": 0.9}, "6": {"g": 0.5, "b": 0.3}, "7": {"t": 0.9}, "8": {"b": 0.8}, "9": {"g": 0.8}, "@": {"a": 0.9}, "$": {"s": 0.9}, "!": {"i": 0.6, "l": 0.1}, "|": {"l": 0.4, "i": 0.4}, "+": {"t": 0.6}, "(": {"c": 0.6}, "<": {"c": 0.5}, "€": {"e": 0.9}, "£": {"l": 0.7}}
WILD = "*"  # may stand for any letter
WILD_SHARE = 0.5
MOST_WILD = 2  # more of them in one token are separators for the lattice, and letters for Tree.masked
KEPT_TWICE = 0.1  # how likely a longer run of a letter meant two of them

SET_APART = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){2,}(?!\S)")
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
SIGN_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
HIDDEN = re.compile(r"[^a-z]|(.)\1", re.S)
STRETCHED = re.compile(r"([^*])\1{3,}", re.S)  # the lattice tells no more than three of a character, but for wild signs
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYMBOL = np.full(256, 27, np.uint8)
SYMBOL[:128] = 0
for _i, _c in enumerate(LETTERS):
    SYMBOL[ord(_c)] = SYMBOL[ord(_c.upper())] = _i + 1


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def core(token: str) -> str:
    """The token without signs and digits at its ends."""
    return EDGES.sub("", token)


def plain_words(text: str | None) -> set[str]:
    return {w for w in map(core, (text or "").lower().split()) if w}


def character_counts(texts: list[str]) -> np.ndarray:
    """Counts of ORDER + 1 symbols in a row; a word is preceded by ORDER symbols 0."""
    data = SYMBOL[np.frombuffer((" ".join(texts) or " ").encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int64)
    run = np.arange(len(data)) - np.maximum.accumulate(np.where(data == 0, np.arange(len(data)), -1))  # letters in a row up to here
    before_run = np.concatenate([[0], run[:-1]])
    index = data.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros_like(data)
        before[k:] = data[:-k]
        index += np.where(before_run >= k, before, 0) * SYMBOLS**k  # what stands before a word counts as 0, whatever it is
    return np.bincount(index[(data > 0) | (before_run > 0)], minlength=SYMBOLS ** (ORDER + 1))


class CharacterModel:
    """log p(symbol | ORDER symbols before it), from counts of the corpus and of the lexicon."""

    def __init__(self, corpus: np.ndarray, lexicon: list[str]):
        own = character_counts([f"{w} " for w in lexicon]) if lexicon else np.zeros_like(corpus)
        parts = []
        for counts in (corpus, own):
            p = np.full((1, SYMBOLS), 1 / SYMBOLS)
            for k in range(1, ORDER + 2):  # shorter contexts back the longer ones
                table = counts.reshape(-1, SYMBOLS**k).sum(axis=0).reshape(-1, SYMBOLS).astype(float)
                lower = np.tile(p, (len(table) // len(p), 1))
                p = (table + 2 * lower) / (table.sum(axis=1, keepdims=True) + 2)
            parts.append(p)
        share = LEXICON_SHARE if lexicon else 0.0
        self.log = np.log((1 - share) * parts[0] + share * parts[1]).astype(np.float32)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of one character, what it may have meant and the log of how likely."""
    wild = token.count(WILD) <= MOST_WILD
    for run in re.finditer(r"(.)\1*", token, re.S):
        c, n = run.group(1), len(run.group())
        if c in LETTERS:
            yield [(c, 0.0)] if n == 1 else [(c, math.log(1 - KEPT_TWICE)), (c * 2, math.log(KEPT_TWICE if n > 2 else 0.5))]
        elif c == WILD and wild:
            yield from [[("", math.log(1 - WILD_SHARE)), *((x, math.log(WILD_SHARE / 26)) for x in LETTERS)]] * n
        elif c in STANDS_FOR:
            options = STANDS_FOR[c]
            yield [("", math.log(max(1e-3, 1 - sum(options.values())))), *((x, math.log(p)) for x, p in options.items())]
        elif c.isalpha():
            yield [(folded(c) or "", 0.0)]
        else:
            yield [("", 0.0)]


def folded(text: str) -> str:
    """Letters without their accents, as far as they are a-z then."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if c in LETTERS)


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest letters behind a token: Viterbi over states of the last ORDER symbols."""
    log, size = model.log, SYMBOLS**ORDER
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    for options in lattice(token):
        new: dict[int, tuple[float, str]] = {}
        for state, (score, path) in states.items():
            for letters, cost in options:
                s, total = state, score + cost
                for c in letters:
                    symbol = ord(c) - 96
                    total += float(log[s, symbol])
                    s = (s * SYMBOLS + symbol) % size
                if s not in new or total > new[s][0]:
                    new[s] = (total, path + letters)
        states = new
    return max((score + float(log[s, 0]), path) for s, (score, path) in states.items())[1]


class Lexicon:
    """Numbers, from 1, of the words and beginnings of words in a lexicon."""

    def __init__(self, features: list[str]):
        self.words = {f: i + 1 for i, f in enumerate(features) if not f.endswith("*")}
        self.beginnings = {f[:-1]: i + 1 for i, f in enumerate(features) if f.endswith("*")}
        self.lengths = sorted({len(x) for x in self.beginnings}, reverse=True)

    def match(self, word: str) -> int:
        """The word's number, else the number of its longest beginning, else 0."""
        found = self.words.get(word, 0)
        if not found:
            for k in self.lengths:
                if found := self.beginnings.get(word[:k], 0):
                    break
        return found


class Tree:
    """The lexicon by letters: nodes lead to nodes; which of them end a word or a beginning."""

    def __init__(self, lexicon: Lexicon):
        self.next: list[dict[str, int]] = [{}]
        self.words = {self.node(w): i for w, i in lexicon.words.items()}
        self.beginnings = {self.node(w): i for w, i in lexicon.beginnings.items()}

    def node(self, word: str) -> int:
        at = 0
        for c in word:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
            at = self.next[at][c]
        return at

    def step(self, node: int | None, letters: str) -> int | None:
        for c in letters:
            if node is not None:
                node = self.next[node].get(c)
        return node

    def reached(self, token: str) -> bool:
        """Whether any path of the token's lattice is a lexicon word or starts with a beginning; if none is, no decoding can match."""
        nodes = {0}
        for options in lattice(token):
            nodes = {to for x, _ in options for at in nodes if (to := self.step(at, x)) is not None}
            if not nodes:
                return False
            if not nodes.isdisjoint(self.beginnings):
                return True
        return not nodes.isdisjoint(self.words)

    def pieces(self, token: str) -> Iterator[str]:
        """Of a long token, what follows those starts (its own, and behind any sign) from which a path reaches an entry."""
        wild = token.count(WILD) <= MOST_WILD
        nodes: dict[int, int] = {}  # node -> the last start that leads there
        seen = set()
        for run in re.finditer(r"\*|([^*])\1*", token, re.S):
            at, end = run.span()
            if not at or not token[at - 1].isalnum():
                nodes[0] = at
            options = [x for x, _ in next(lattice(run.group()))] if wild or run.group() != WILD else [""]
            new: dict[int, int] = {}
            for node, start in nodes.items():
                for x in options:
                    if (to := self.step(node, x)) is not None and new.get(to, -1) < start:
                        new[to] = start
            nodes = new
            for node, start in nodes.items():
                if (node, start) in seen:
                    continue
                if node in self.beginnings:
                    seen.add((node, start))
                    yield token[start : max(end, start + LONGEST)]
                elif node in self.words and not token[end : end + 1].isalnum():
                    seen.add((node, start))
                    yield token[start:end]

    def masked(self, token: str) -> int:
        """The entry that fits a token's length and fixed letters, each wild sign being one letter, or 0.

        At least two letters have to be fixed. Wild signs at the ends may be decoration too, and are where another sign
        parts them from the letters. Read as letters they count where the token ends with the entry, all of them are
        read and fewer letters of the entry are masked than fixed, or where only one is masked. Of several entries the
        one with the most fixed letters counts, then the more telling.
        """
        solid = [i for i, c in enumerate(token) if c.isalnum() or c in STANDS_FOR and c != "!"]
        if not solid:
            return 0
        first, last = solid[0], solid[-1]
        states = {(0, 0, 0, False, False)}  # node, fixed letters, masked ones; whether any wild sign at an end was read, was passed over
        best = (0, 0)
        for run in re.finditer(r"\*|([^*])\1*", token, re.S):
            at = run.start()
            if run.group() != WILD:
                options = [x for x, _ in next(lattice(run.group()))]
                states = {(to, fixed + len(x), *rest) for node, fixed, *rest in states for x in options if (to := self.step(node, x)) is not None}
            else:
                inside = first < at < last
                read = {(to, fixed, hidden + 1, edge or not inside, passed) for node, fixed, hidden, edge, passed in states for to in self.next[node].values()}
                if inside:
                    states = read
                else:
                    touches = set(token[at:first] or token[last + 1 : at]) <= {WILD}
                    states = {(*state[:4], True) for state in states} | (read if touches else set())
            if not states:
                break
            best = max([best, *(self.rank(state, self.beginnings, run.end() == len(token)) for state in states)])
        return -max([best, *(self.rank(state, self.words, True) for state in states)])[1]

    @staticmethod
    def rank(state: tuple[int, int, int, bool, bool], ends: dict[int, int], whole: bool) -> tuple[int, int]:
        node, fixed, hidden, edge, passed = state
        fits = not edge or hidden <= 1 or whole and not passed and fixed > hidden
        return (fixed, -ends[node]) if node in ends and fixed >= 2 and fits else (0, 0)


class Scorer(dict):
    """token -> its lexicon word's number and 1, or 0; with the rule that adds a document's words up."""

    def __init__(self, features: list[str], weights: list[float], base: float, corpus: np.ndarray):
        super().__init__()
        self.lexicon, self.weights, self.base = Lexicon(features), weights, base
        stems = [f.rstrip("*") for f in features]
        self.stems = {s: i + 1 for i, s in enumerate(stems)}
        self.model = CharacterModel(corpus, stems)
        self.tree = Tree(self.lexicon)

    def __missing__(self, token: str) -> int:
        found = self.word(token)
        if len(token) <= 4 * LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[token] = found
        return found

    def word(self, token: str) -> int:
        inner = core(token)
        found = self.lexicon.match(inner)
        if found or not self.stems:
            return found
        if not token.isascii() and (found := self.lexicon.match(folded(token))):
            return found
        if not HIDDEN.search(token):
            return 0
        token = STRETCHED.sub(r"\1\1\1", token)
        if len(token) > LONGEST:
            return self.within(token)
        if self.tree.reached(token):
            for form in filter(None, dict.fromkeys((token, SIGN_EDGES.sub("", token), core(token)))):  # signs at the ends may be letters or not
                if found := self.lexicon.match(decode(form, self.model)):
                    return found
        return self.tree.masked(token) if WILD in token else 0

    def within(self, token: str) -> int:
        """The first lexicon word in a long token: between its signs, masked by wild signs, or set apart by signs."""
        for part in filter(None, re.split(r"[\W_]+", token)):
            if part != token and (found := self.word(part)):
                return found
        for part in re.split(r"(?:[^\w*]|_)+", token):
            if WILD in part and (found := self.tree.masked(part)):
                return found
        return next(filter(None, (self.lexicon.match(decode(x, self.model)) for x in self.tree.pieces(token))), 0)

    def apart(self, run: str) -> Iterator[int]:
        """Lexicon words in letters that were set apart."""
        letters = "".join(run.split())
        for at in range(0, len(letters), LONGEST // 2):
            text = decode(letters[at : at + LONGEST], self.model)
            yield from (i for s, i in self.stems.items() if s in text)

    def score(self, text: str | None) -> float:
        if self.base == -math.inf:
            return 0.0
        text = (text or "").lower()
        found = set(filter(None, map(self.__getitem__, set(text.split()))))
        for run in SET_APART.finditer(text):
            found.update(self.apart(run.group()))
        return 1 / (1 + math.exp(-min(30.0, self.base + sum(self.weights[i - 1] for i in found))))


@worker_task
def _character_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS ** (ORDER + 1), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            total += character_counts([x or "" for x in batch.column(0).slice(at, 100).to_pylist()])
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["i", "n"])


@worker_task
def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            texts = batch.column(0).slice(at, 500).to_pylist()
            shingles = [shingle_hashes(ascii_words(x), hashes, 3) for x in texts]
            family = [signature(x, FAMILY_HASHES).view(np.int64) if len(x) else [] for x in shingles]
            words = [sorted(plain_words(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(family, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string())), batch.column(1).slice(at, 500)], ["family", "words", "toxic"])


@worker_task
def _feature_rows(batches: Iterator[pa.RecordBatch], kept: set[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """How many of the kept documents hold each word and each beginning of a word, and how many of these are toxic."""
    n, toxic = Counter(), Counter()

    def out() -> pa.RecordBatch:
        names = list(n)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([n[x] for x in names], pa.int64())], ["word", "toxic", "n"])

    for batch in batches:
        for family, words, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not family or tuple(family) in kept:
                features = {w for w in words} | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) >= k}
                n.update(features)
                if label:
                    toxic.update(features)
        if len(n) > CACHED:
            yield out()
            n, toxic = Counter(), Counter()
    yield out()


@worker_task
def _matched_rows(batches: Iterator[pa.RecordBatch], kept: set[tuple[int, ...]], lexicon: list[str]) -> Iterator[pa.RecordBatch]:
    scorer = Lexicon(lexicon)
    for batch in batches:
        rows = [(sorted({scorer.match(w) - 1 for w in words} - {-1}), label) for family, words, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if not family or tuple(family) in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int32())], ["words", "toxic"])


def most_telling(features: list[str]) -> list[str]:
    """Of features in order of what they tell, those that aren't a beginning of a better one, nor begin with one."""
    chosen: list[str] = []
    stems, beginnings = set(), set()
    for f in features:
        stem = f.rstrip("*")
        if stem not in beginnings and stems.isdisjoint(stem[:k] for k in range(len(stem) + 1)):
            chosen.append(f)
            stems.add(stem)
            beginnings.update(f[:k] for k in range(len(f) + 1))
    return chosen


def one_of_each(families: list[tuple[int, ...]]) -> set[tuple[int, ...]]:
    """The families that share no value with one kept before them."""
    seen: set[int] = set()
    kept = set()
    for family in sorted(families):
        if not seen.intersection(family):
            kept.add(family)
        seen.update(family)
    return kept


def weigh(rows: list[tuple[list[int], int, int]], chosen: list[int]) -> tuple[list[float], float]:
    """Weights of the chosen words and the base, by ridge logistic regression, from rows (words, toxic, how many)."""
    at = {w: k for k, w in enumerate(chosen)}
    kinds: Counter = Counter()
    for words, toxic, n in rows:
        kinds[tuple(sorted(at[w] for w in words if w in at)), toxic] += n
    x = np.zeros((len(kinds), len(chosen) + 1))
    x[:, -1] = 1
    y, n = np.zeros(len(kinds)), np.zeros(len(kinds))
    for k, ((words, toxic), count) in enumerate(kinds.items()):
        x[k, list(words)] = 1
        y[k], n[k] = toxic, count
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1].tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2, most_labelled: int = MOST_LABELLED) -> tuple[list[str], list[float], float, np.ndarray]:
    """(lexicon, weights, base, character counts) from the rows outside the held fold; the character counts from all rows."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~in_fold(F.col(id_col), folds, held))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_toxic"))
    n = known.count()
    parts = 1 << 20
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) < int(parts * min(1.0, most_labelled / max(n, 1))))
    known = broadcast_if_small(known, min(n, most_labelled), 24)
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text")).join(known, F.col("_key") == F.col("_id")).select("text", F.col("_toxic").alias("toxic"))
    drawn = Scratch(docs.sparkSession, "toxicity").put(rows.mapInArrow(_sample_rows, "family array<bigint>, words array<string>, toxic int"), "sample")
    kept = one_of_each([tuple(x) for x in drawn.select("family").toArrow().column(0).to_pylist()])  # at most about most_labelled rows
    one = drawn.dropDuplicates(["family"])
    counts = one.mapInArrow(lambda it: _feature_rows(it, kept), "word string, toxic bigint, n bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("n > 1")
    labelled = one.mapInArrow(lambda it: _matched_rows(it, kept, []), "words array<int>, toxic int")
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = min(max(sizes.get(1, 0) / max(sum(sizes.values()), 1), 1e-6), 1 - 1e-6)
    n_clean, ratio = F.col("n") - F.col("toxic"), F.col("toxic") / (F.col("n") * rate)
    gain = F.col("toxic") * F.log(ratio) + F.when(n_clean > 0, n_clean * F.log(n_clean / (F.col("n") * (1 - rate)))).otherwise(0.0)
    tried = counts.count()
    likely = counts.where((F.col("toxic") > 1) & (ratio > 2)).withColumn("gain", gain).where(F.col("gain") >= math.log(max(tried, 1) / CHANCE))
    best = likely.orderBy(F.col("gain").desc(), F.char_length("word").desc(), "word").limit(MOST_CANDIDATES).collect()
    words = most_telling([r["word"] for r in best])
    matched = one.mapInArrow(lambda it: _matched_rows(it, kept, words), "words array<int>, toxic int").groupBy("words", "toxic").agg(F.count("*").alias("n"))
    sampled = [(list(r["words"]), r["toxic"], r["n"]) for r in matched.collect()]  # equal rows once
    corpus = np.zeros(SYMBOLS ** (ORDER + 1), np.int64)
    grams = docs.select(F.col(text_col).alias("text")).mapInArrow(_character_rows, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS ** (ORDER + 1) rows
    corpus[grams.column("i").to_numpy()] = grams.column("n").to_numpy()
    if not sampled:
        return [], [], -math.inf, corpus
    weights, base = weigh(sampled, list(range(len(words))))
    return words, weights, base, corpus


@worker_task
def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(*shared.value)
    for batch in batches:
        scores = pa.array([scorer.score(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], "score"])


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, held=held))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), in_fold(F.col(id_col), folds, held).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lambda it: _scored(it, shared), f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, held=held))

    @worker_task
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array([scorer.score(x.as_py()) < threshold for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
