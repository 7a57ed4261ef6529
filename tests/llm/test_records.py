"""Vectors, archives, languages and the pipeline against plain versions, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, embedding_dedup, language, warc
from tessera.llm.common import table
from tessera.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.01]), (8, [2.0, 0.01]),
            (9, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1e200, 1e198]), (13, [1e-200, 0.0]), (100, [0.9, 0.1])]
    return spark.createDataFrame([(*r, 0, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, key string, dim int")


def clustered(seed: int, n: int, d: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d))
    v[: n // 3] = v[0] + 0.08 * rng.standard_normal((n // 3, d))
    v[n // 3: n // 2] = v[rng.integers(0, n, n // 2 - n // 3)] + 0.15 * rng.standard_normal((n // 2 - n // 3, d))
    return v


@pytest.mark.parametrize("d, tile", [(24, 64), (3, 2048)])
def test_embedding_links_equal_brute_force(spark, d, tile):
    v = clustered(d, 500, d)
    v[490:] = v[480:490]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(500)
    for _ in range(500):
        new = np.minimum(label, np.where(near, label[None], 1000).min(axis=1))
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
    assert got == {i: (int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(500)}


def test_embedding_edge_cases(spark):
    got = {}
    df = odd_vectors(spark)
    for r in embedding_dedup.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert all(got[i] == [(0, i, True)] for i in (1, 2, 3, 4, 5, 6, 10, 11))
    assert got[7] == [(7, 7, True)] and got[8] == [(7, 7, False)] * 2 and got[None] == [(7, 7, False)] and got[100][0][1] == 7
    assert got[12][0][1] == 7 and got[13][0][1] == 7
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def exact(ids: np.ndarray, v: np.ndarray, q: int, k: int = 10):
    far = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:k]
    return [(int(ids[i]), float(far[i])) for i in order]


def test_ann_recall_on_the_table(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got: dict = {}
    for r in QUERIES["op6_ann"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = []
    assert sorted(got) == sorted(ids[ids % 100 == 0].tolist())
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert all(abs(np.sqrt(((v[ids == r["vec_id"]][0] - v[ids == q][0]) ** 2).sum()) - r["score"]) < 1e-12 for r in found)
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        hits.append(len({r["vec_id"] for r in found} & {i for i, _ in exact(ids, v, q)}) / 10)
    assert np.mean(hits) >= 0.9


def test_ann_with_copies_and_crowded_buckets(spark):
    v = clustered(7, 900, 16)
    v[500:560] = v[0]
    ids = np.arange(0, 9000, 10)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, part=32).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    recall = np.mean([len({x for _, x in got[q]} & {i for i, _ in exact(ids, v, q)}) / 10 for q in got])
    assert recall >= 0.9 and len(got) == 90
    assert [x for _, x in sorted(got[0])] == [int(i) for i, _ in exact(ids, v, 0)]


def test_ann_edge_cases(spark):
    df = odd_vectors(spark)
    got = ann.search(df).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {100}
    assert [r["vec_id"] for r in got][:3] == [7, 9, 13] or {7, 9} <= {r["vec_id"] for r in got}
    assert sorted(r["vec_id"] for r in got) == [7, 8, 9, 10, 12, 13]
    assert ann.search(df.limit(0)).collect() == []


def sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_warc_round_trip_equals_plain(spark):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in table(spark, SF, "pages").collect()]
    rows += [(10_000 + i, h) for i, (_, h) in enumerate(rows[:9])] + [(20_000, None), (20_001, b""), (20_002, "é\r\n\r\nWARC/1.1\r\n".encode() * 3), (20_003, b"x" * 3_000_000)]
    df = spark.createDataFrame([(k, None if h is None else h.decode(), None if k % 2 else f"http://a/{k}\r\nX: y", 1, "p") for k, h in rows],
                               "page_id long, html string, url string, key int, path string")
    first: dict = {}
    for k, h in rows:
        first[h or b""] = min(first.get(h or b"", k), k)
    want = sorted((k, len(h or b""), sha(h or b""), "response" if first[h or b""] == k else "revisit", None if first[h or b""] == k else first[h or b""]) for k, h in rows)
    assert sorted(map(tuple, warc.round_trip(df).collect())) == want
    files = warc.write_archives(df, "/tmp/" + df.sparkSession.sparkContext.applicationId, file_bytes=20_000)
    assert files.count() > 2
    read = warc.read_archives(files)
    assert read.rdd.getNumPartitions() == files.count() and read.select(F.spark_partition_id()).distinct().count() > 1
    assert warc.read_archives(files.limit(0)).collect() == []
    back = {r["page"]: bytes(r["payload"]) for r in warc.read_archives(files).collect() if r["record_type"] == "response"}
    assert all(back[str(k)] == (h or b"") for k, h in rows if first[h or b""] == k)
    large = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, min_bytes=1).collect()}
    assert large[20_000] == large[20_001] == "response"


def test_warc_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, "a"), (None, None)], "page_id long, html string")
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert got == [(0, "response", None), (0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert warc.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_warc_reader_frames_and_verifies(block):
    bodies = [b"", b"abc" * 1000, random.Random(1).randbytes(200_000), b"\r\n\r\n"]
    data = b"".join(warc.member([("WARC-Type", "response"), ("WARC-Block-Digest", f"sha1:{sha(b)}")], b) for b in bodies)
    if block == 1:
        data, bodies = b"".join(warc.member([("A", "b")], b) for b in (b"", b"xy")), [b"", b"xy"]
    assert [b for _, b in warc.read_records(io.BytesIO(data), block)] == bodies
    wrong = warc.member([("WARC-Block-Digest", f"sha1:{sha(b'other')}")], b"this")
    for bad in (data[:-3], data + b"junk", wrong, b"plain text", warc.member([], b"x")[:-9]):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(bad), block))


def test_automaton_parses_like_brute_force():
    model = language.Model({"a": "the cat sat on the mat with the hat", "b": "le chat est sur la table avec le chapeau"})
    tables = model.tables()
    rnd = random.Random(6)
    for _ in range(60):
        text = "".join(rnd.choice("the catsonmlbup zé!") for _ in range(rnd.randint(0, 1300)))
        seq = tables.coded(text)
        for k, learned in enumerate(model.texts.values()):
            known, want = bytes(tables.coded(learned)), 0
            for at in range(0, len(seq), language.STRETCH):
                part, i = bytes(seq[at:at + language.STRETCH]), 0
                while i < len(part):
                    j = i + 1
                    while j <= len(part) and part[i:j] in known:
                        j += 1
                    want, i = want + 1, i + max(1, j - 1 - i)
            assert tables.phrases([seq])[0, k] == want if len(seq) else True


def test_language_held_out_accuracy(spark):
    true = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op10_language_id"](spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(true) and len(held) > 20
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat sat on the mat and the dog", "en"), ("der hund und die katze auf der matte", "de")] * 12)]
    odd = [(None, "the cat", None), (100, None, "en"), (101, "", "en"), (102, "123 !? \n", "en"), (103, "the dog " * 90_000, None), (104, "кот", None), (104, "кот", None)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows + odd], "doc_id long, text string, lang string, score int, key string")
    model = language.fit(df)
    got: dict = {}
    for r in language.identify(df, model).collect():
        got.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert got[None] == ["en"] and got[103] == ["en"] and got[100] == got[101] == got[102] == ["und"] and len(got[104]) == 2
    kept = language.keep_known(df)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert language.identify(df.limit(0), model).collect() == [] and language.keep_known(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.identify(df, language.Model({})).collect()} == {"und"}
    found = {(r["doc_id"], r["lang"]) for r in kept.collect()}
    assert (None, "en") in found and (103, "en") in found


def test_languages_of_few_long_texts_are_learned(spark):
    rows = [(i, "the cat sat on the mat ", "en") for i in range(400)] + [(2900 + i, "zzyx qwvk jjxq " * 3000, "zz") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert sorted(model.texts) == ["en", "zz"] and len(model.texts["zz"]) == language.FIT_CHARS
    assert {r["lang_pred"] for r in language.identify(df.filter("lang = 'zz'"), model).collect()} == {"zz"}
    # more labels than the bound: the most frequent are learned, and all of them together stay within it
    many = spark.createDataFrame([(100 * k + i, chr(97 + k % 26) * 40 + f" {k}", f"l{k:02}") for k in range(70) for i in range(8 if k < 64 else 4)], "doc_id long, text string, lang string")
    small = language.fit(many, fit_total=6400)
    assert sorted(small.texts) == [f"l{k:02}" for k in range(64)] and all(0 < len(t) <= 100 for t in small.texts.values())


def test_language_without_labels_keeps_rows_with_letters(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(["the cat", "", None, "12", "un chat"])], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language.keep_known(df).collect()) == [0, 4]


def test_pipeline_follows_its_stages(spark):
    docs = table(spark, SF, "documents")
    folder = f"/tmp/{spark.sparkContext.applicationId}-pipeline"
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5]
    assert corpus_pipeline.ORACLE_SQL is None
    again = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert again == sorted(map(tuple, docs.collect())) and again
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/3").collect()}
    assert all(r[1] == len(coder.encode(texts[r[0]], add_special_tokens=False).ids) for r in again)


def test_pipeline_stages_take_odd_documents(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, fp string"
    rows = [(None, "the cat sat", "en", None, None, "x"), (1, None, None, "a", None, "x"), (2, "", "en", "a", 0, "x"), (3, "the cat sat", "en", "a", 11, "x"), (3, "the cat sat", "en", "a", 11, "x")]
    for some in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        docs = some
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
