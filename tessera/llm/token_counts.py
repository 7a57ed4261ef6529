"""Token counts of documents that follow edits without encoding whole texts again.

A document's text is cut into leaves of about ``LEAF`` characters, only before white space that follows a visible character: there the
pre-tokenizer always starts a new token, so counts of leaves add up to the count of the text.  The counts sit in the lower half of an
array-shaped segment tree whose upper nodes hold subtree sums.  An edit touches a run of leaves; the run grows by a neighbour
wherever the edit has spoilt its rim as a cut.  Only that run is encoded again, and sums are updated along the paths above it.
"""

from __future__ import annotations

import base64
import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows

LEAF = 256
_CUT = re.compile(r"(?<=\S)\s")
#: What the sample edit of the query masks: mail addresses and runs of seven or more digits.
MASK = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}|[0-9]{7,}")
_LOADED: dict[str, object] = {}


def encoder(path: str):
    """A rank file (base64 token, rank a line) as a byte-level encoder, loaded once per worker."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Leaf lengths; a leaf ends at the first safe cut after ``leaf`` characters, so unbroken text is one leaf."""
    out, at = [], 0
    while at < len(text):
        found = _CUT.search(text, at + leaf) if at + leaf < len(text) else None
        end = found.start() if found else len(text)
        out.append(end - at)
        at = end
    return out


def grown(counts: list[int]) -> list[int]:
    """Segment tree as an array: node i has the children 2i and 2i + 1, the leaves are the last half, node 1 is the root."""
    n = 1
    while n < len(counts):
        n *= 2
    tree = [0] * n + counts + [0] * (n - len(counts))
    for i in range(n - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def edited(text: str, sizes: list[int], tree: list[int], edits: list[tuple[int, int, str]], count) -> tuple[str, list[int], list[int], int]:
    """Apply edits (start, end, replacement; code points of the old text, not overlapping) and return the new state and the characters encoded."""
    edits = sorted(((max(0, s), min(len(text), max(s, e)), r or "") for s, e, r in edits if s <= len(text)), key=lambda x: x[:2])
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append(at)
    sizes, tree, leaves = list(sizes), list(tree), len(sizes)
    if not leaves:
        new = "".join(r for _, _, r in edits)
        sizes = cuts(new)
        marks = [0, *accumulate(sizes)]
        return new, sizes, grown([count(new[a:b]) for a, b in zip(marks, marks[1:])]), len(new)
    # runs of touched leaves; touching the rim of a leaf counts for both sides
    runs: list[list] = []
    leaf = 0
    last = 0
    for s, e, r in edits:
        if s < last:
            raise ValueError("edits overlap")
        last = e
        while leaf < leaves - 1 and ends[leaf] < s:
            leaf += 1
        hi = leaf
        while hi < leaves - 1 and ends[hi] <= e:
            hi += 1
        if runs and leaf <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], hi)
            runs[-1][2].append((s, e, r))
        else:
            runs.append([leaf, hi, [(s, e, r)]])
    done: list[tuple[int, int, list, str]] = []  # runs with safe rims: first and last leaf, edits, new text
    todo = runs[::-1]
    while todo:
        lo, hi, own = todo.pop()
        while True:
            if todo and todo[-1][0] <= hi + 1:
                hi = max(hi, todo[-1][1])
                own = own + todo.pop()[2]
                continue
            if done and done[-1][1] >= lo:
                lo, _, before, _ = done.pop()
                own = before + own
                continue
            begin, end = (ends[lo - 1] if lo else 0), ends[hi]
            new, p = [], begin
            for s, e, r in own:
                new += [text[p:s], r]
                p = e
            new = "".join([*new, text[p:end]])
            # boundary context: the rims must still be safe cuts in the new text
            if end < len(text) and not (new and not new[-1].isspace() and text[end].isspace()):
                hi += 1
            elif begin and not (new and new[0].isspace() and not _char_before(done, text, ends, begin).isspace()):
                lo -= 1
            else:
                break
        done.append((lo, hi, own, new))
    out, at, worked = [], 0, 0
    base = len(tree) // 2
    fresh: list[tuple[int, int, list[int], list[int]]] = []  # runs: first and last leaf, new sizes and counts
    for lo, hi, _, new in done:
        parts = cuts(new)
        marks = [0, *accumulate(parts)]
        fresh.append((lo, hi, parts, [count(new[a:b]) for a, b in zip(marks, marks[1:])]))
        worked += len(new)
        out += [text[at:ends[lo - 1] if lo else 0], new]
        at = ends[hi]
    text = "".join([*out, text[at:]])
    if any(len(parts) > hi - lo + 1 for lo, hi, parts, _ in fresh):
        # a run that has grown gets leaves of its own: the tree is laid out anew from known counts, nothing else is encoded
        counts, grown_sizes, grown_counts, at = tree[base:base + leaves], [], [], 0
        for lo, hi, parts, found in fresh:
            grown_sizes += [*sizes[at:lo], *parts]
            grown_counts += [*counts[at:lo], *found]
            at = hi + 1
        return text, [*grown_sizes, *sizes[at:]], grown([*grown_counts, *counts[at:]]), worked
    for lo, hi, parts, found in fresh:
        slots = hi - lo + 1
        for i, (size, n) in enumerate(zip(parts + [0] * (slots - len(parts)), found + [0] * (slots - len(found)))):
            sizes[lo + i] = size
            node = base + lo + i
            change = n - tree[node]
            while node and change:
                tree[node] += change
                node //= 2
    return text, sizes, tree, worked


def _char_before(done: list[tuple[int, int, list, str]], text: str, ends: list[int], begin: int) -> str:
    """The character before position ``begin`` in the new text."""
    return done[-1][3][-1:] or " " if done and ends[done[-1][1]] == begin else text[begin - 1]


STATE = "key {}, text string, sizes array<int>, tree array<int>"


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """key, text, sizes (characters of each leaf), tree (sums; element 1 is the document's count), one row per row.

    Null texts count as empty and have no leaves and a tree of zeros.  Keys may be null or repeat; other columns are ignored.
    """
    def work(rows):
        coder = encoder(path)
        for k, t in rows:
            t = t or ""
            sizes = cuts(t, leaf)
            at, counts = 0, []
            for s in sizes:
                counts.append(len(coder.encode_ordinary(t[at:at + s])))
                at += s
            yield k, t, sizes, grown(counts)

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), F.col(text)), STATE.format(kind), work)


def apply_edits(trees: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """State rows with a column of edits (array of start, end, replacement) -> key, n_edits, n_tokens_before, n_tokens, n_chars, encoded_chars, text, sizes, tree.

    Null and empty edit lists leave the state as it is.  Edits must not overlap; they may touch, insert (start = end) or delete.
    """
    def work(rows):
        coder = encoder(path)
        for k, t, sizes, tree, todo in rows:
            todo = [(x["start"], x["end"], x["replacement"]) for x in todo or ()]
            before = tree[1]
            new, sizes, tree, worked = edited(t, sizes, tree, todo, lambda x: len(coder.encode_ordinary(x))) if todo else (t, sizes, tree, 0)
            yield k, len(todo), before, tree[1], len(new), worked, new, sizes, tree

    kind = trees.schema["key"].dataType.simpleString()
    return map_rows(trees.select("key", "text", "sizes", "tree", F.col(edits)),
                    f"key {kind}, n_edits long, n_tokens_before long, n_tokens long, n_chars long, encoded_chars long, text string, sizes array<int>, tree array<int>",
                    work)


def with_masks(trees: DataFrame) -> DataFrame:
    """Add an ``edits`` column that replaces every mail address and long number by a mark.

    A row without any, an empty text included, has an empty list.  Rows come back as often as they come, with any key; an empty table gives an empty result.
    """
    def work(rows):
        for k, t, sizes, tree in rows:
            yield k, t, sizes, tree, [{"start": m.start(), "end": m.end(), "replacement": "<masked>"} for m in MASK.finditer(t)]

    kind = trees.schema["key"].dataType.simpleString()
    return map_rows(trees, STATE.format(kind) + ", edits array<struct<start:int,end:int,replacement:string>>", work)
