"""Byte-pair encoding and decoding of whole texts, long ones by tree concatenation.

Short texts are encoded where they lie.  A long text is cut into halves of halves, wherever the middle falls; other tasks encode the leaves, and
they are joined pair by pair up the tree.  At a join the last k chunks of the left and the first k of the right, chunks being what white space
parts, are encoded anew as one window, with k doubling until the window starts with the left's token and ends with the right's token at its
rim (or reaches the ends).  No token reaches across white space, so what lies outside the window is as it was.

A text with a very long stretch free of white space is cut at white space around it.  The stretch is cut into halves of halves as well, and there the
windows are counted in tokens.  A sequence of tokens of one stretch is its encoding if and only if each two neighbours are the encoding of their
joint text; within the halves and the window neighbours are, and at the rims the neighbours are those of the halves.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows

#: Texts of more characters are cut into halves of halves until none has more.
PIECE = 1 << 15
#: Unsplit stretches of more symbols are cut into halves until they are no longer.
LEAF = 1 << 11
#: Chunks that a worker keeps, and the characters of the longest that it keeps.
KNOWN, CHUNK = 200_000, 64
#: Python takes these for white space, the tokenizer files do not.
_ODD = re.compile("[\x1c-\x1f]")
_TRAILING = ".,!?;:%&*#$()"
_LOADED: dict[str, "Bpe"] = {}


def _latin(text: str) -> bool:
    """All characters are below U+0100: nothing composes, and lower case is one character for one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Bpe:
    """A tokenizer file: the library encodes pieces, ``merge`` encodes symbols of one unsplit stretch."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain = spec["added_tokens"] == [] or all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        self.words = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.special.items()}
        steps = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        if not self.suffix or '"Removed"' not in steps:
            raise ValueError("the tokenizer file must drop white space and mark the ends of words")
        self.lower = '"Lowercase"' in steps and '"Strip' not in steps
        self.known: dict[str, bytes] = {}
        self.long: list[str] = []
        self.rank = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a], self.vocab[b]] = (i, self.vocab[a + b])
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def at(path: str) -> "Bpe":
        if path not in _LOADED:
            _LOADED[path] = Bpe(path)
        return _LOADED[path]

    def symbols(self, text: str, final: bool) -> list[int]:
        """Start symbols of a byte-level stretch; the last one carries the end-of-word mark if the word ends there."""
        out = [self.vocab[c] for c in text]
        if final and self.suffix and text:
            out[-1] = self.vocab[text[-1] + self.suffix]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges by rank, leftmost first, through a heap."""
        n = len(ids)
        ids, nxt, prev = list(ids), [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if r := self.rank.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := prev[i]) >= 0 and (r := self.rank.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def window(self, ids: list[int]) -> list[int]:
        """Encode anew the stretch that these neighbouring tokens of one word stand for."""
        text = "".join(self.words[x] for x in ids)
        final = bool(self.suffix) and text.endswith(self.suffix)
        return self.merge(self.symbols(text.removesuffix(self.suffix) if final else text, final))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            mid = self.window(left[a:] + right[:b])
            if (a == 0 or mid[0] == left[a]) and (b == len(right) or mid[-1] == right[b - 1]):
                return left[:a] + mid + right[b:]
            k *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Join encoded leaves pair by pair until one is left."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def join_texts(self, left: tuple[str, bytes], right: tuple[str, bytes]) -> tuple[str, bytes]:
        """(text, packed ids) of two neighbouring texts -> those of the joint one."""
        (t, x), (u, y), k = left, right, 1
        while t and u:
            a, b = _chunks_back(t, k), _chunks_ahead(u, k)
            old, new, mid = self.encode([t[a:], u[:b], t[a:] + u[:b]])
            if (a == 0 or mid[:4] == old[:4]) and (b == len(u) or mid[-4:] == new[-4:]):
                return t + u, x[:len(x) - len(old)] + mid + y[len(new):]
            k *= 2
        return t + u, x + y

    def tree_of_texts(self, parts: list[tuple[str, bytes]]) -> bytes:
        """Join encoded leaves of one text pair by pair until one is left."""
        while len(parts) > 1:
            parts = [self.join_texts(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1] if parts else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, packed as little-endian 32-bit integers.

        No token reaches across white space, so a text is the sequence of its chunks, and the library encodes each chunk once.
        """
        chunks = [[t] if _ODD.search(t) else self.folded(t).split() for t in texts]
        known = self.learned(set(chain.from_iterable(chunks)))
        out = [b"".join(map(known.__getitem__, c)) for c in chunks]
        for w in self.long:
            known.pop(w, None)
        return out

    def text(self, ids: list[int]) -> str:
        """Tokens, special ones included, joined by single blanks, as a tokenizer file without a decoder has it."""
        return " ".join(map(self.words.__getitem__, ids))

    def folded(self, text: str) -> str:
        """Lower case where that is all the normalizer does, so that more chunks are the same; else the text as it is."""
        if not self.lower or not (text.isascii() or _latin(text)):
            return text
        low = text.lower()
        return text if any(s in low for s in self.special) else low

    def learned(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of at least these chunks.  Up to ``KNOWN`` chunks stay for later texts; long ones are listed to be dropped."""
        known = self.known
        new = words - known.keys()
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = words
        # punctuation behind a letter or digit that normalizing leaves one character makes tokens of its own
        parts = {w: (b, w[len(b):]) for w in new if (b := w.rstrip(_TRAILING)) and b != w and b[-1] < "\u0100" and b[-1].isalnum()}
        single = [w for w in {*chain.from_iterable(parts.values()), *(new - parts.keys())} if w not in known]
        for at in range(0, len(single), 1 << 12):
            some = single[at:at + (1 << 12)]
            for w, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False)):
                known[w] = struct.pack(f"<{len(e)}I", *e.ids)
        for w, (b, tail) in parts.items():
            known[w] = known[b] + known[tail]
        self.long = [w for w in (*single, *parts) if len(w) > CHUNK]
        return known


def pieces(bpe: Bpe, text: str, size: int = PIECE, leaf: int = LEAF) -> Iterator[tuple[int, bool, str]]:
    """(stretch, final, text) in order; stretch -1 is a piece for the library, else leaves of one unsplit stretch share a number."""
    at, number = 0, 0
    gap = re.compile(r"(?<=\S)[ \n]")
    while at < len(text):
        stop = len(text) if len(text) - at <= size else at + size
        if stop < len(text):
            # the last break before the mark, or else the first one behind it
            back = max(text.rfind(" ", at + 1, stop), text.rfind("\n", at + 1, stop))
            while back > at and text[back - 1].isspace():
                back -= 1
            ahead = None if back > at else gap.search(text, stop)
            stop = back if back > at else ahead.start() if ahead else len(text)
        part = text[at:stop]
        at = stop
        if len(part) <= size * 2 or not bpe.plain:
            yield -1, True, part
            continue
        for bit in bpe.marks.split(part) if bpe.marks else [part]:
            if bit in bpe.special or not bit:
                if bit:
                    yield -1, True, bit
                continue
            for token, _ in bpe.lib.pre_tokenizer.pre_tokenize_str(bpe.lib.normalizer.normalize_str(bit)):
                cuts = halves(0, len(token), leaf)
                for a, b in zip(cuts, cuts[1:]):
                    yield number, b == len(token), token[a:b]
                number += 1


def _blank(c: str) -> bool:
    return c.isspace() and not _ODD.match(c)


def _chunks_back(text: str, k: int) -> int:
    """Where the last ``k`` chunks begin."""
    at = len(text)
    for _ in range(k):
        while at and _blank(text[at - 1]):
            at -= 1
        while at and not _blank(text[at - 1]):
            at -= 1
    return at


def _chunks_ahead(text: str, k: int) -> int:
    """Where the first ``k`` chunks end."""
    at, n = 0, len(text)
    for _ in range(k):
        while at < n and _blank(text[at]):
            at += 1
        while at < n and not _blank(text[at]):
            at += 1
    return at


#: Number of the stretch that marks leaves of a text cut anywhere.
ANYWHERE = -2


def leaves_of(bpe: Bpe, text: str, size: int = PIECE, leaf: int = LEAF) -> Iterator[tuple[int, bool, str]]:
    """(stretch, final, text) in order: halves of halves of the text, unless a stretch free of white space asks for ``pieces``."""
    if max(map(len, text.split()), default=0) > size * 2:
        yield from pieces(bpe, text, size, leaf)
        return
    cuts = halves(0, len(text), size)
    for a, b in zip(cuts, cuts[1:]):
        yield ANYWHERE, True, text[a:b]


def halves(a: int, b: int, leaf: int) -> list[int]:
    """Cut points of a stretch halved until no part is longer than ``leaf``."""
    if b - a <= leaf:
        return [a, b]
    mid = (a + b) // 2
    return halves(a, mid, leaf)[:-1] + halves(mid, b, leaf)


def encoded(docs: DataFrame, path: str, columns: str, finish: Callable[[bytes], tuple], key: str = "doc_id", text: str = "text", size: int = PIECE,
            leaf: int = LEAF) -> DataFrame:
    """key and ``columns``: what ``finish`` makes of each whole text's ids (packed, little-endian 32-bit integers), in the task that has them.

    Ids are those of the tokenizer file, without special tokens added around them.  Null and empty texts give no ids, with any key, null
    included.  Texts of any length are encoded whole.  Repeated rows are returned as often as they come; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def whole(items):
        bpe = Bpe.at(path)
        for block in _blocks(items, 256):
            for (k, _), ids in zip(block, bpe.encode([t for _, t in block])):
                yield k, *finish(ids)

    def cut_up(items):
        bpe = Bpe.at(path)
        for k, t in items:
            digest = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
            for seq, (stretch, final, part) in enumerate(leaves_of(bpe, t, size, leaf)):
                yield k, digest, seq, stretch, final, part

    def leaves(items):
        bpe = Bpe.at(path)
        for k, digest, seq, stretch, final, part in items:
            ids = bpe.encode([part])[0] if stretch < 0 else _packed(bpe.merge(bpe.symbols(part, final)))
            yield k, digest, seq, stretch, ids, part if stretch == ANYWHERE else None

    def up(items):
        bpe, held, last = Bpe.at(path), [], None
        for k, digest, seq, stretch, ids, part in chain(items, [(None, b"", -1, -1, b"", None)]):
            if (k, digest) != last:
                if held:
                    for one, all_ids in _assembled(bpe, last[0], held):
                        yield one, *finish(all_ids)
                held, last = [], (k, digest)
            held.append((seq, stretch, ids) if part is None else (seq, stretch, ids, part))

    long_ = F.length("text") > size
    short = map_rows(rows.filter(~long_), f"key {kind}, {columns}", whole)
    parts = map_rows(rows.filter(long_), f"key {kind}, digest binary, seq int, stretch int, final boolean, part string", cut_up)
    coded = map_rows(parts.repartition("key", "digest", "seq"), f"key {kind}, digest binary, seq int, stretch int, ids binary, part string", leaves)
    joined = map_rows(coded.repartition("key", "digest").sortWithinPartitions("key", "digest", "seq"), f"key {kind}, {columns}", up, block=64)
    return short.unionByName(joined).withColumnRenamed("key", key)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, ids (array<int>): see ``encoded``."""
    return encoded(docs, path, "ids array<int>", lambda x: (np.frombuffer(x, "<u4").tolist(),), key, text, **options)


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _blocks(items: Iterator[tuple], n: int) -> Iterator[list[tuple]]:
    block = []
    for x in items:
        block.append(x)
        if len(block) == n:
            yield block
            block = []
    if block:
        yield block


def _assembled(bpe: Bpe, key, held: list[tuple]) -> Iterator[tuple]:
    """A document's pieces in order -> its ids, once for each copy of the row."""
    copies = sum(h[0] == held[0][0] for h in held)
    if held[0][1] == ANYWHERE:
        ids = bpe.tree_of_texts([(part, ids) for _, _, ids, part in held[::copies]])
        for _ in range(copies):
            yield key, ids
        return
    out, run, at = [], [], -1
    for _, stretch, ids in held[::copies]:
        if stretch != at or stretch < 0:
            out.append(_packed(bpe.tree(run)))
            run, at = [], stretch
        if stretch < 0:
            out.append(ids)
        else:
            run.append(np.frombuffer(ids, "<u4").tolist())
    out.append(_packed(bpe.tree(run)))
    for _ in range(copies):
        yield key, b"".join(out)


def decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: the tokens of ``ids``, special ones included, joined by single blanks as a tokenizer file without a decoder has it.

    Null and empty lists give an empty text; ids outside the vocabulary are passed over.
    """
    def work(items):
        bpe = Bpe.at(path)
        for k, x in items:
            yield k, bpe.text([i for i in x or () if i in bpe.words])

    return map_rows(coded.select(F.col(key), F.col(ids)), f"{key} {coded.schema[key].dataType.simpleString()}, text string", work)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 of each whole text encoded and decoded again."""
    def finish(raw: bytes) -> tuple:
        back = Bpe.at(path).text(np.frombuffer(raw, "<u4").tolist())
        return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    return encoded(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish, key, text, **options)
