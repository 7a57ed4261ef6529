"""Text operators against plain brute-force versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, line_dedup, mixing, near_copies, pii, simhash, token_counts
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, n_lines string, size string"


def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns whose names clash with those used inside."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "One two three four", "en", None, 18),
            (5, "one TWO three  four", "en", "a", 19), (5, "one TWO three  four", "en", "a", 19), (None, "one two three four", None, "b", 18),
            (None, None, None, "b", None), (6, "one", "en", "b", 3), (7, LONG, "en", "a", len(LONG)), (8, LONG + " end", "en", "a", len(LONG) + 4),
            (9, "x" * 90_000, "en", "a", 90_000)]
    return spark.createDataFrame([(*r, "k", "f", "l", "s") for r in rows], DOCS)


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def plain_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(codes: dict[int, int], bits: int = 3) -> dict[int, int]:
    label = {k: k for k in codes}
    keys = sorted(codes)
    todo = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if (codes[a] ^ codes[b]).bit_count() <= bits]
    changed = True
    while changed:
        changed = False
        for a, b in todo:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash_equals_brute_force(spark):
    codes = {k: plain_fingerprint(t) for k, t in documents(spark)}
    label = components(codes)
    got = simhash.near_duplicates(table(spark, SF, "documents")).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(k, f"{codes[k]:016x}", label[k]) for k in codes}


def five_words(text: str | None) -> frozenset:
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def edited(rnd, words: list[str], n: int) -> list[str]:
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return words


def copies() -> list[tuple[int, str]]:
    """Given documents, copies with more and more edits, a large group of copies of one text, unlike texts with a passage in common."""
    rnd = random.Random(3)
    fresh = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    rows = []
    for _ in range(25):
        base = fresh(rnd.randrange(12, 400))
        rows += [base, *(edited(rnd, base, max(1, len(base) * part // 1000)) for part in (5, 15, 22, 25, 35))]
    base, passage = fresh(150), fresh(60)
    rows += [edited(rnd, base, rnd.randrange(1, 6)) for _ in range(60)]
    rows += [passage + fresh(rnd.randrange(5, 60)) for _ in range(60)] + [passage[:50] + fresh(3) for _ in range(10)]
    rows += [[], [], ["one"], ["ONE"], ["one", "two"], base, base]
    rnd.shuffle(rows)
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


@pytest.mark.parametrize("crowd", [300, 8])
def test_near_copies_equal_brute_force(spark, crowd):
    rows = copies() + [(10_000 + k, t) for k, t in documents(spark)] if crowd == 300 else copies()
    sets = {k: five_words(t) for k, t in rows}
    label, keys, whole = {k: k for k in sets}, sorted(sets), []
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and both:
                whole.append((a, b))
    while (more := [(a, b) for a, b in whole if label[a] != label[b]]):
        for a, b in more:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.near_copies(docs, crowd=crowd).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label and len(got) == len(rows)
    if crowd == 300:  # what the pipeline's stage keeps
        assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()) == sorted(set(label.values()))


def test_sketches_differ_no_more_than_sets():
    rnd = random.Random(9)
    for _ in range(50):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(1, 900))]
        a, b = (near_copies.shingle_set(" ".join(w)) for w in (words, edited(rnd, words, rnd.randrange(1, 20))))
        x, y = (near_copies.sketch(s).view(np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_near_copies_list_each_class_once_in_an_order_that_is_settled_before(spark, monkeypatch):
    rnd = random.Random(5)
    phrase = "these nine words stand in every one of them"
    docs = spark.createDataFrame([(k, f"{phrase} " + " ".join(str(rnd.randrange(10 ** 6)) for _ in range(30))) for k in range(400)], "key long, text string")
    crowded = near_copies._crowded(docs, 5, 100)
    shared = set(near_copies.shingle_set(phrase).tolist())
    assert set(crowded) == shared and all(200 < n < 800 for n in crowded.values())
    listed = near_copies._sets(docs, 5, False, crowded).select(F.explode("shingles")).distinct()
    assert not shared & {r[0] for r in listed.collect()}
    keys = spark.createDataFrame([(7,), (None,), (399,), (10 ** 12,)], "_key long")
    both = docs.unionByName(spark.createDataFrame([(None, "x")], "key long, text string"))
    assert {r.key for r in near_copies._some(both, keys).collect()} == {7, 399, None}


def test_near_copies_edge_cases(spark):
    docs = odd_docs(spark)
    got = near_copies.near_copies(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9}
    assert sorted(r["component_id"] for r in got if r["doc_id"] is None) == [1, 4]
    stay = near_copies.keep_first(docs)
    assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == [1, 4, 6, 7, 9]
    assert near_copies.near_copies(docs.limit(0)).collect() == [] and near_copies.keep_first(docs.limit(0)).collect() == []


@pytest.mark.parametrize("cell", [4096, 8])
def test_simhash_forest_connects_what_links_connect(spark, cell):
    rnd = random.Random(5)
    codes = {}
    for centre in range(12):
        c = rnd.getrandbits(64)
        for i in range(40):
            x = c
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            codes.setdefault(x, len(codes))
    by_id = {i: x for x, i in codes.items()}
    label = components(by_id)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for x, i in codes.items()]
    edges = simhash.link_forest(spark.createDataFrame(rows, "fp long, node long"), cell=cell).collect()
    found = {i: i for i in by_id}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for e in edges:
        a, b = root(e["na"]), root(e["nb"])
        found[max(a, b)] = min(a, b)
    assert {i: root(i) for i in by_id} == label


def test_simhash_edge_cases(spark):
    docs = odd_docs(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert {x for k in (1, 2, 3) for x in by[k]} == {("0" * 16, 1)}
    assert by[4][0] == by[5][0] == by[5][1] and by[4][0][1] == 4
    assert sorted(c for _, c in by[None]) == [1, 4]
    assert by[7][0][1] == by[8][0][1] == 7 and by[9][0][1] == 9
    stay = simhash.keep_first(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 4, 6, 7, 9]
    repeated = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f g h"), (None, "q r s t"), (None, "q r s t")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_first(repeated).collect()) == [(0, "q r s t"), (1, "a b c"), (1, "d e f g h")]
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_first(docs.limit(0)).collect() == []


def coded(text: str):
    ids = bpe.Bpe.at(WORD_BPE).lib.encode(text, add_special_tokens=False).ids
    back = bpe.Bpe.at(WORD_BPE).lib.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_bpe_equals_library(spark):
    want = {(k, *coded(t)) for k, t in documents(spark)}
    assert {tuple(r) for r in bpe.digests(table(spark, SF, "documents"), WORD_BPE).collect()} == want


def test_bpe_pieces_and_joins_are_exact():
    coder, rnd = bpe.Bpe.at(WORD_BPE), random.Random(2)
    letters = ["ab", "aeinrst", "the ing", "'s!?<|endoftext|>", "éèê ñÉ", "abc  \n\t 12", "áë Σσς", "你好吗", "!!'s're"]
    for _ in range(400):
        some = rnd.choice(letters) + rnd.choice(letters)
        text = "".join(rnd.choice(some) for _ in range(rnd.choice([3, 20, 80, 300])))
        if rnd.random() < 0.3:
            text = text.replace(" ", "") + rnd.choice(["", "<|endoftext|>", "<|startoftext|>x"])
        for size, leaf in ((4, 1), (8, 3), (16, 5)):
            held = [(i, s, coder.encode([p])[0] if s < 0 else bpe._packed(coder.merge(coder.symbols(p, final))))
                    for i, (s, final, p) in enumerate(bpe.pieces(coder, text, size, leaf))]
            got = next(bpe._assembled(coder, None, held))[1] if held else b""
            want = bpe._packed(coder.lib.encode(text, add_special_tokens=False).ids)
            assert got == want == coder.encode([text])[0], (text, size, leaf)


def test_bpe_trees_of_texts_are_exact():
    coder, rnd, grown = bpe.Bpe.at(WORD_BPE), random.Random(4), 0
    letters = ["ab ", "aeinrst ", "the ing\n", "'s!?<|endoftext|> ", "éèê ñÉ\u0301 ", "abc  \n\t\u2003 12", "áë Σσς", "你好吗 。", "!!'s're ", "a\x1c b\x85"]
    for _ in range(600):
        some = rnd.choice(letters) + rnd.choice(letters)
        text = "".join(rnd.choice(some) for _ in range(rnd.choice([3, 20, 80, 300]))) + rnd.choice(["", "<|endoftext|>", " <|startoftext|>x"])
        want = bpe._packed(coder.lib.encode(text, add_special_tokens=False).ids)
        for size in (1, 3, 8, 40):
            cuts = bpe.halves(0, len(text), size)
            parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
            coded = coder.encode(parts)
            assert coder.tree_of_texts(list(zip(parts, coded))) == want, (text, size)
            grown += b"".join(coded) != want
    assert grown > 1000  # the cuts matter


def test_bpe_given_rows_take_the_tree(spark):
    """At the query's own parameters a given text is cut into leaves anywhere, and it is as the library has it."""
    coder, taken = bpe.Bpe.at(WORD_BPE), 0
    long_ = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.1", "documents").filter(F.length("text") > bpe.PIECE).collect()}
    for t in long_.values():
        leaves = list(bpe.leaves_of(coder, t))
        taken += len(leaves) > 1 and all(s == bpe.ANYWHERE for s, _, _ in leaves)
        assert "".join(p for _, _, p in leaves) == t
    assert taken == len(long_) > 0
    docs = spark.createDataFrame(list(long_.items()) * 2, "doc_id long, text string")
    got = [tuple(r) for r in bpe.digests(docs, WORD_BPE).collect()]
    assert sorted(got) == sorted((k, *coded(t)) for k, t in long_.items() for _ in range(2))


def test_bpe_chunks_hold_for_every_character():
    coder = bpe.Bpe.at(WORD_BPE)
    texts = [f"a{chr(i)}b A{chr(i)}. {chr(i)}B, x{chr(i)}" for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3100 or i % 37 == 0 or i > 0x1E0000)]
    texts += ["<|ENDOFTEXT|> A", "A<|endoftext|>B!", "T\u0308 A\u030a", "a\x1cb \x1f c", "it's. '!s $'s x!'re"]
    want = [e.ids for e in coder.lib.encode_batch_fast(texts, add_special_tokens=False)]
    assert [bpe._packed(x) for x in want] == coder.encode(texts)


def test_bpe_edge_cases(spark):
    docs = odd_docs(spark)
    got = sorted(map(tuple, bpe.digests(docs, WORD_BPE, size=1 << 12, leaf=1 << 9).collect()), key=str)
    assert got == sorted([(r["doc_id"], *coded(r["text"] or "")) for r in docs.collect()], key=str)
    assert bpe.digests(docs.limit(0), WORD_BPE).collect() == []
    ids = bpe.encode(docs, WORD_BPE)
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(ids, WORD_BPE).collect()}
    assert (6, "one</w>") in back and (2, "") in back
    odd = spark.createDataFrame([(1, None), (2, [99999999, 0])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, bpe.decode(odd, WORD_BPE).collect())) == [(1, ""), (2, "!")]


def count(text: str) -> int:
    return len(token_counts.encoder(BYTE_BPE).encode_ordinary(text))


def test_token_counts_follow_random_edits():
    rnd = random.Random(9)
    for _ in range(1500):
        some = rnd.choice(["ab  c\n", "word 's 12.  ", "a \n", "éx !?  "])
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 200)))
        sizes = token_counts.cuts(text, rnd.choice([1, 4, 16]))
        assert sum(sizes) == len(text)
        at, counts = 0, []
        for s in sizes:
            counts.append(count(text[at:at + s]))
            at += s
        tree = token_counts.grown(counts)
        for _ in range(3):  # edits on edited states
            points = sorted(rnd.randint(0, len(text)) for _ in range(2 * rnd.randint(1, 4)))
            edits = [(a, b, "".join(rnd.choice(some) for _ in range(rnd.randint(0, 8)))) for a, b in zip(points[::2], points[1::2])]
            want, p = [], 0
            for a, b, r in edits:
                want += [text[p:a], r]
                p = b
            want = "".join([*want, text[p:]])
            text, sizes, tree, worked = token_counts.edited(text, sizes, tree, edits, count)
            assert text == want and sum(sizes) == len(text)
            assert tree[1] == count(text), (text, edits)
            assert all(tree[i] == tree[2 * i] + tree[2 * i + 1] for i in range(1, len(tree) // 2))


def test_token_counts_stay_local_after_growth():
    text = "word " * 40
    sizes = token_counts.cuts(text)
    tree = token_counts.grown([count(text[:sizes[0]])] if len(sizes) == 1 else [count(text)])
    text, sizes, tree, worked = token_counts.edited(text, sizes, tree, [(100, 100, "more words " * 9000)], count)
    assert tree[1] == count(text) and max(sizes) < 2 * token_counts.LEAF
    text, sizes, tree, worked = token_counts.edited(text, sizes, tree, [(50_000, 50_002, "x")], count)
    assert tree[1] == count(text) and worked < 4 * token_counts.LEAF
    text, sizes, tree, worked = token_counts.edited(text, sizes, tree, [(500, 90_000, ""), (95_000, 95_000, " y " * 2000)], count)
    assert tree[1] == count(text) and sum(sizes) == len(text)


def test_token_counts_encode_little(spark):
    path = BYTE_BPE
    trees = token_counts.build(odd_docs(spark), path)
    edits = trees.withColumn("edits", F.when(F.length("text") > 100_000, F.expr("array(named_struct('start', 5000, 'end', 5010, 'replacement', 'new words'))")))
    got = {(r["key"], r["n_edits"]): r for r in token_counts.apply_edits(edits, path).collect()}
    r = got[7, 1]
    assert r["n_tokens"] == count(LONG[:5000] + "new words" + LONG[5010:]) and 0 < r["encoded_chars"] < 2000
    assert got[1, 0]["n_tokens"] == 0 and got[9, 0]["n_tokens"] == count("x" * 90_000)
    assert token_counts.apply_edits(token_counts.with_masks(trees.limit(0)), path).collect() == []
    with pytest.raises(ValueError):
        token_counts.edited("abc", [3], [0, 1], [(0, 2, ""), (1, 3, "")], count)


def test_token_counts_query_equals_full_encoding(spark):
    from tessera.llm.queries import op3_token_counts

    want = {(k, len(token_counts.MASK.findall(t)), count(t), count(token_counts.MASK.sub("<masked>", t))) for k, t in documents(spark)}
    assert {(r["doc_id"], r["n_edits"], r["n_tokens_before"], r["n_tokens"]) for r in op3_token_counts(spark, SF).collect()} == want


PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                 r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text: str):
    email, ip, card, phone = PLAIN
    out = [(*m.span(), 0) for m in email.finditer(text)]
    out += [(*m.span(), 1) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), 2) for m in card.finditer(text) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(*m.span(), 3) for m in phone.finditer(text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii_base_spans_equal_plain_patterns():
    rnd = random.Random(3)
    for _ in range(8000):
        some = rnd.choice(["a@.-b", "1.2@a", "12.5-3 ", "+1 (2)-.", "ab@@..c 1", "0123456789 -", "a.@+1é"])
        text = "".join(rnd.choice(some) for _ in range(rnd.choice([5, 20, 60])))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_query_keeps_base_and_adds_by_vote(spark):
    rows = [(1, None), (2, ""), (3, "mail jo@example.com or +1 (743) 555-3824"), (3, "mail jo@example.com or +1 (743) 555-3824"), (None, "card 4111 1111 1111 1111"),
            (4, "version 10.2.3.400 of 300.1.1.1"), (5, "x" * 200_000 + " 10.0.0.1"), (6, "9" * 6000 + "." + "9" * 20)]
    rows += [(100 + i, f"please call (743) 555-{1000 + i} or Dear Mr. David Smith") for i in range(40)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, found string")
    got = {}
    for r in pii.summary(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[3]) == 2 and got[3][0]["spans"] == "email:5:19,phone:23:40" and got[3][0] == got[3][1]
    assert (got[None][0]["n_card"], got[1][0]["spans"], got[4][0]["n_ip"], got[5][0]["n_ip"]) == (1, "", 0, 1)
    assert got[100][0]["spans"].startswith("phone:12:26") and got[100][0]["n_phone"] == 0
    assert got[2][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.summary(docs.limit(0)).collect() == []


def test_pii_query_over_documents(spark):
    texts = dict(documents(spark))
    for r in pii.summary(table(spark, SF, "documents")).collect():
        told = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in plain_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r["spans"].split(","))


def test_pii_finds_what_no_list_holds(spark):
    """Names outside the gazetteer, assigned secrets, local numbers and ids, among look-alikes: recall and precision on planted spans."""
    rnd, rows, want = random.Random(8), [], {}
    first = ["Zbigniew", "Ngozi", "Thuy", "Aoife", "Bjarni", "Oluwaseun", "Yevhenia", "Siobhán", "Kwabena", "Ragnheiður"]
    last = ["Kowalczyk", "Adeyemi-Okafor", "Nguyen", "O'Shaughnessy", "Gunnarsson", "Balogun", "Tkachenko", "Mensah", "Petrov", "Ivashchenko"]
    assert not set(first) & pii.FIRST_NAMES
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    prose = ["the river runs past an old mill", "we shall meet again in spring", "nothing in this line is private", "a quiet evening by the sea"]
    for k in range(400):
        kind = k % 5
        name = f"{rnd.choice(first)} {rnd.choice(last)}"
        head = rnd.choice(prose) + ". "
        if kind == 0:
            lead, span = head + rnd.choice(["Dear ", "Signed, ", "customer: ", "My name is ", "Author: "]), name
        elif kind == 1:
            lead, span = head + rnd.choice(["api_key = '", "token: ", 'export SECRET="', "db.password=>"]), hexes(32)
        elif kind == 2:
            lead, span = head + "call ", f"{rnd.randint(200, 999)}-{rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
        elif kind == 3:
            lead, span = head + "her ssn ", f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}"
        else:  # look-alikes
            rows.append((k, head + rnd.choice([f"sha checksum: {hexes(40)}", "name: River Mill, past the river and the mill", "The River Mill Society met",
                                               f"url = example.com/{'a' * 20}", "release 1.2.3 of Project Alpha", "class = aaaaaaaaaaaaaaaaaaaaaaaa"])))
            continue
        rows.append((k, lead + span + ", " + rnd.choice(prose) + "."))
        want[k] = f"{('name', 'secret', 'phone', 'national_id')[kind]}:{len(lead)}:{len(lead) + len(span)}"
    got = {r["doc_id"]: r for r in pii.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    told = {(k, s) for k, r in got.items() for s in r["spans"].split(",") if s}
    hits = told & set(want.items())
    print("recall", len(hits) / len(want), "precision", len(hits) / max(1, len(told)), sorted(told - hits)[:20], sorted(set(want.items()) - hits)[:20])
    assert len(hits) / len(want) >= 0.95 and len(hits) / len(told) >= 0.95
    assert all(r["n_spans"] == len([s for s in r["spans"].split(",") if s]) for r in got.values())


def test_pii_reliabilities_are_found():
    rnd = random.Random(1)
    counts: dict = {}
    for _ in range(4000):
        true = rnd.random() < 0.4
        v = tuple((1 if true else -1) * (1 if rnd.random() < p else -1) for p in (0.95, 0.9, 0.85, 0.6, 0.9))
        key = (3, v, 5)
        counts[key] = counts.get(key, 0) + 1
    model = pii.SpanModel([(*k, n) for k, n in counts.items()])
    assert model.right[0].min() > 0.9 and model.right[3].max() < 0.7
    assert model.probability(3, (1, 1, 1, 0, 1), 5) > 0.9 > 0.1 > model.probability(3, (-1, -1, -1, 0, -1), 5)


def plain_line_dedup(rows):
    keyed = [(k, [(x, x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()) for x in (t or "").split("\n")]) for k, t in rows]
    held: dict = {}
    for k, lines in keyed:
        for _, y in lines:
            if len(y) >= 20:
                held.setdefault(y, set()).add(k)
    gone = {y: max(v) for y, v in held.items() if len(v) >= 3}
    return sorted((k, len(lines), sum(y in gone and gone[y] != k for _, y in lines), "\n".join(x for x, y in lines if not (y in gone and gone[y] != k)))
                  for k, lines in keyed)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(4)
    lines = ["short", "a line that is long enough", "  A LINE that is long enough\t", "another line of some length \r", "x" * 20, "x" * 19, "", "é" * 20]
    rows = [(i, rnd.choice([None, "", "\n"]) if rnd.random() < 0.1 else "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, 3, "m") for r in rows], "doc_id long, text string, n_lines int, hash string")
    for batches, fan in ((1, 2), (4, 2), (5, 3)):
        got = line_dedup.drop_lines(docs, batches=batches, fan=fan)
        assert got.columns == ["doc_id", "text", "hash", "n_lines", "n_dropped"]
        assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()) == plain_line_dedup(rows)


def test_line_dedup_edge_cases(spark):
    docs = odd_docs(spark)
    got = line_dedup.drop_lines(docs)
    assert got.count() == docs.count() and got.filter("n_dropped > 0").count() == 0
    assert line_dedup.drop_lines(docs.limit(0)).collect() == []
    line = "this very line is repeated"
    rows = [(1, line), (1, line), (2, line), (3, line + "\nkept"), (None, line)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.drop_lines(some).collect()) == [(0, line), (1, ""), (1, ""), (2, ""), (3, line + "\nkept")]


def test_mix_targets_and_nearness(spark):
    docs = table(spark, SF, "documents")
    got = mixing.mix(docs).collect()
    sizes: dict = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    goal, left = {}, 1.5 * sum(sizes.values())
    open_ = set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            open_.discard(s)
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 * goal[s] + 1e-9 and 0 <= r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= 1
        # complete epochs come first
        epochs = int(goal[s] // sizes[s])
        assert all(epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"] for r in mine)


def test_mix_prefers_weight_and_handles_odd_rows(spark):
    rows = [(i, "one two three four", "a" if i % 10 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = spark.range(0, 3000, 2).select(F.col("id").alias("doc_id"), F.lit(8.0).alias("weight"))
    got = mixing.mix(docs, quality=quality, share=0.5, weights=(1.0,)).collect()
    good = sum(r["taken"] for r in got if r["source"] == "a" and r["doc_id"] % 2 == 0)
    bad = sum(r["taken"] for r in got if r["source"] == "a" and r["doc_id"] % 2)
    assert good > 2 * bad
    odd = odd_docs(spark)
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == odd.count() and {r["size"] for r in mixed if r["doc_id"] in (1, 2, 3)} == {0}
    drawn = mixing.draw(odd)
    assert drawn.columns == odd.columns and drawn.count() > 0
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mix(odd.limit(0)).collect() == [] and mixing.draw(odd.limit(0)).collect() == []
