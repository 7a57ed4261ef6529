"""Language identification by cross parsing against suffix automata.

For each language a suffix automaton of labelled text knows every substring of it.  A text is parsed from left to right into the longest phrases
that the automaton knows; the fewer phrases a language needs, the closer the text is to it.  Phrases are weighed by the logarithm of
the learned text's length and divided by the characters parsed, which gives a cross entropy; the smallest wins.

The automata are unrolled into transition tables in which a failing step already holds the state after the restart, so that thousands of
stretches of many texts advance together, one character a step.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import give_back
from tessera.llm.mixing import uniform
from tessera.operators.spread import top_n

#: The fit is bounded: so many characters a language from so many rows, so many languages, the most frequent ones, and so many characters in all (their
#: tables take about 370 bytes a character in every worker).
FIT_CHARS, FIT_ROWS = 40_000, 4096
FIT_LANGUAGES = 64
FIT_TOTAL = 640_000
UNKNOWN = "und"
ALPHABET = 64
#: Characters of a stretch that is parsed on its own, and of a group of stretches that advance together.
STRETCH, GROUP = 512, 1 << 21
#: Table entries: phrases that a step ends above bit 30, the next state below.
_PHRASE, _STATE = 1 << 30, (1 << 30) - 1
_LOADED: dict[str, "Tables"] = {}


def automaton(seq: np.ndarray, alphabet: int = ALPHABET) -> np.ndarray:
    """Suffix automaton of a sequence of classes as a table [state, class] -> phrases ended and next state.

    A step that the automaton does not know ends the phrase and begins one with its class; a class that it does not know at all is a phrase alone.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = twin
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
        last = cur
    root = np.full(alphabet, 2 * _PHRASE, np.uint32)
    for c, s in nxt[0].items():
        root[c] = _PHRASE | s
    table = np.tile(root, (len(nxt), 1))
    table[0] = _PHRASE
    for s, row in enumerate(nxt):
        if row:
            table[s, list(row)] = list(row.values())
    return table.ravel()


class Model:
    """What the driver learned: an alphabet (most frequent first) and the learned text of each language, both of bounded size."""

    def __init__(self, texts: dict[str, str]):
        seen = Counter()
        for t in texts.values():
            seen.update(c for c in t.lower() if c.isalpha())
        self.letters = "".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET - 2])
        self.texts = dict(sorted(texts.items()))
        self.name = hashlib.md5(repr((self.letters, self.texts)).encode()).hexdigest()

    def tables(self) -> "Tables":
        if self.name not in _LOADED:
            _LOADED.clear()  # one model at a time per worker
            _LOADED[self.name] = Tables(self)
        return _LOADED[self.name]


class Tables:
    def __init__(self, model: Model):
        # class 0: all but letters; 1: letters outside the alphabet
        self.classes = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.uint8).copy()
        for i, c in enumerate(model.letters):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.classes[ord(form)] = i + 2
        self.names = list(model.texts)
        self.tables, self.weights = [], []
        for text in model.texts.values():
            seq = self.coded(text)
            self.tables.append(automaton(seq))
            self.weights.append(np.log2(len(seq) + 2))

    def coded(self, text: str) -> np.ndarray:
        """Classes of a text; a run of other characters than letters counts once."""
        c = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        return c[keep]

    def phrases(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Phrases that each sequence needs, by language.  A sequence is parsed in stretches of ``STRETCH`` characters."""
        n = np.array([len(s) for s in seqs])
        many = -(-n // STRETCH)
        owner = np.repeat(np.arange(len(seqs)), many)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        begin = np.repeat(np.cumsum(n) - n, many) + place * STRETCH
        size = np.minimum(STRETCH, np.repeat(n, many) - place * STRETCH)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        flat = np.append(np.concatenate(seqs) if len(seqs) else np.zeros(0, np.uint8), np.zeros(STRETCH, np.uint8))
        grid = flat[begin[:, None] + np.arange(STRETCH)].T.astype(np.int64) if len(owner) else np.zeros((STRETCH, 0), np.int64)
        active = np.searchsorted(-size, -np.arange(STRETCH), side="left")  # stretches longer than each step
        out = np.zeros((len(seqs), len(self.names)))
        for k, table in enumerate(self.tables):
            state, ended = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
            for t in range(STRETCH):
                a = active[t]
                if not a:
                    break
                step = table.take(state[:a] * ALPHABET + grid[t, :a])
                ended[:a] += step >> 30
                state[:a] = step & _STATE
            out[:, k] = np.bincount(owner, ended + (state > 0), len(seqs))
        return out

    def best(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text of a group."""
        seqs, of = [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), 1 << 20):
                seqs.append(self.coded(t[at:at + (1 << 20)]))
                of.append(i)
        if not seqs or not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts, chars, letters = np.zeros((len(texts), len(self.names))), np.zeros(len(texts)), np.zeros(len(texts))
        np.add.at(counts, of, self.phrases(seqs))
        np.add.at(chars, of, [len(s) for s in seqs])
        np.add.at(letters, of, [np.count_nonzero(s) for s in seqs])
        cost = counts * np.array(self.weights) / np.maximum(chars, 1)[:, None]
        first = cost.argmin(axis=1)
        low = cost[np.arange(len(texts)), first]
        rest = cost.copy()
        rest[np.arange(len(texts)), first] = np.inf
        second = rest.min(axis=1)
        score = np.where(np.isfinite(second), 1 - low / np.maximum(second, 1e-12), 1.0).clip(0, 1)
        return [(self.names[f], float(s)) if n else (UNKNOWN, 0.0) for f, s, n in zip(first, score, letters)]


def held_out(key: Column) -> Column:
    """Rows that are kept from learning: crc32 of the key as text leaves 2 by 4 (a null key counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", fit_chars: int = FIT_CHARS,
        fit_languages: int = FIT_LANGUAGES, fit_total: int = FIT_TOTAL) -> Model:
    """Learn from rows that are not held out and have both text and label.

    The sample is bounded: the ``fit_languages`` most frequent labels, ``fit_chars`` characters for each or its share of ``fit_total``, from ``FIT_ROWS``
    rows at most.  Rows are taken in the order of a number drawn from the key (ties: shorter texts first) until the characters suffice, so every one of these labels is learned; the
    last row, or one longer than the bound, is learned up to the bound.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).filter(
        ~held_out(F.col("key")) & F.col("text").rlike(r"\p{L}") & F.col("label").isNotNull() & (F.col("label") != UNKNOWN))
    names = [r["label"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(fit_languages).collect()]
    if not names:
        return Model({})
    fit_chars = min(fit_chars, max(1, fit_total // len(names)))
    some = rows.filter(F.col("label").isin(names)).select("label", uniform(F.col("key")).alias("u"), F.least(F.length("text"), F.lit(fit_chars)).alias("size"),
                                                        F.substring("text", 1, fit_chars).alias("text"))
    # first without texts: how many rows of each label it takes
    order = [F.asc("u"), F.asc("size")]
    light = some.drop("text").withColumn("_part", F.pmod(F.xxhash64("u"), F.lit(256)))
    first = top_n(top_n(light, ["label", "_part"], order, FIT_ROWS).drop("rank"), ["label"], order, FIT_ROWS)
    held = F.sum("size").over(Window.partitionBy("label").orderBy("rank")) - F.col("size")
    need = {r["label"]: (r["u"], r["rank"]) for r in first.withColumn("_before", held).filter(F.col("_before") < fit_chars)
            .groupBy("label").agg(F.max("u").alias("u"), F.max("rank").alias("rank")).collect()}
    last = F.lit(-1.0)
    for name, (u, _) in need.items():
        last = F.when(F.col("label") == name, F.lit(u)).otherwise(last)
    most = F.lit(0)
    for name, (_, rank) in need.items():
        most = F.when(F.col("label") == name, F.lit(rank)).otherwise(most)
    got: dict[str, list] = {name: [] for name in need}
    for r in top_n(some.filter(F.col("u") <= last), ["label"], order, FIT_ROWS).filter(F.col("rank") <= most).collect():
        got[r["label"]].append((r["rank"], r["text"]))
    return Model({name: " ".join(t for _, t in sorted(found))[:fit_chars] for name, found in got.items()})


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (0 to 1: how far the runner-up's cost lies above the winner's), one row per row.

    ``und`` with score 0 for null texts, texts without a letter, and if no language was learned.  Whole texts are parsed, whatever
    their length.  Ties go to the smaller name.  Keys may be null or repeat; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            names, scores, held, chars = [], [], [], 0
            for at in range(0, batch.num_rows, 64):
                for t in batch.column(1).slice(at, 64).to_pylist():
                    held.append(t or "")
                    chars += len(held[-1])
                    if chars >= GROUP:
                        for name, score in tables.best(held):
                            names.append(name)
                            scores.append(score)
                        held, chars = [], 0
            for name, score in tables.best(held):
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id", label: str = "lang") -> DataFrame:
    """Rows whose text some learned language accounts for; those found ``und`` go.  Where the label is null it becomes the language found.

    Null and empty texts and texts without a letter go, whatever their label.  If no row has a label, no language is learned: then rows with letters stay
    and keep their null label.  Repeated rows and null keys are judged by their texts like any other.  All other columns stay as they are.
    """
    model = model or fit(docs, key, text, label)
    names = docs.columns
    at, told = names.index(text), names.index(label)
    if not model.texts:
        return docs.filter(F.col(text).rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [name for name, _ in tables.best([t or "" for t in part.column(at).to_pylist()])]
                columns = list(part.columns)
                columns[told] = pc.coalesce(columns[told], pa.array(found, columns[told].type))
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array([name != UNKNOWN for name in found], pa.bool_()))
        give_back()

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(run, rows.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
