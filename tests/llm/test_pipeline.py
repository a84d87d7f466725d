"""The pipeline against plain Python, stage by stage, on a table with nulls, copies, personal data and extra columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from lodestone.llm import bpe, quality, simhash
from tests.llm.test_pii import base


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(rng.randint(30, 90))) + "."
    bad = lambda: " ".join(rng.choices(["BUY", "NOW!!!", "$$$", "CLICK"], k=rng.randint(20, 60)))
    rows, marks = [], []
    for i in range(320):
        fine = i % 3 > 0
        text = good() if fine else bad()
        if fine and i % 7 == 0:
            text += f" write to me{i}@mail.example.com or +1 (212) 555-{1000 + i} ok"
        rows.append((i, text, "en", f"s{i % 4}", len(text), "extra"))
        if i % 4 < 3:
            marks.append((i, int(fine), 0))
    rows += [(400 + k, rows[3 * k + 1][1], "en", "s1", rows[3 * k + 1][4], "extra") for k in range(20)]
    rows += [(500, None, None, None, None, None), (501, "", "en", None, 0, None), (502, rows[1][1], "en", "s0", rows[1][4], None), (502, rows[1][1], "en", "s0", rows[1][4], None)]
    other = [good(), good(), good()]
    rows += [(503, other[0], "en", "s1", len(other[0]), None), (503, other[1], "en", "s1", len(other[1]), None), (None, other[2], "en", "s2", len(other[2]), None)]
    d = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _copies string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_and_run(spark, folder):
    docs = given = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, folder), name)
        seen.append(docs.collect())
        if name != "encode":
            assert docs.columns == given.columns
    kept, single, clean, mixed, out = seen
    model = quality.train(given, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [r for r in given.collect() if model.score(r.text or "", r.n_chars) >= quality.THRESHOLD]
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in want)
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sum(i < 320 and i % 3 > 0 for i in ids) > 190 and not any(i < 320 and i % 3 == 0 for i in ids)
    name = lambda r: (r.doc_id if r.doc_id is not None else 10**9, r.text or "")
    prints = {name(r): simhash.fingerprint(r.text or "") for r in kept}
    root = {i: i for i in prints}
    for _ in root:
        moved = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if moved == root:
            break
        root = moved
    assert sorted(map(name, single)) == sorted({*root.values()})  # a document a group, two texts of one id and one without among them
    assert {t for _, t in map(name, single)} >= {r.text for r in given.collect() if r.doc_id in (None, 503)}
    assert [r.doc_id for r in clean if base(r.text)] == [] and sorted(str(r.doc_id) for r in clean) == sorted(str(r.doc_id) for r in single)
    assert any("[EMAIL]" in r.text and "[PHONE]" in r.text for r in clean) and all(r.n_chars == len(r.text) for r in clean if r.text is not None)
    copies = Counter(map(name, mixed))
    assert set(copies) <= set(map(name, clean)) and max(copies.values()) <= 2
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(mixed) / (1.5 * words(clean)) - 1) < 0.02
    c = bpe.Codec(cp.RANKS, cp.public_tokenizers.PATTERN)
    assert sorted((*name(r), bytes(r.ids)) for r in out) == sorted((*name(r), next(c.encode([r.text or ""]))) for r in mixed)
    assert sorted((name(r)[0], bytes(r.ids)) for r in cp.run(spark, folder).collect()) == sorted((name(r)[0], bytes(r.ids)) for r in out)


def test_an_empty_table_passes_through(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_a_very_long_text_goes_through_whole(spark, tmp_path):
    long = "Wörter und words, many of them. " * 40_000 + "mail me@x.example.org"
    rows = [(1, long, "en", "a", len(long)), (2, "some short text", "en", "a", 15), (3, "another one of these", "de", None, 20), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.text for r in cp.run(spark, str(tmp_path)).collect()]
    assert {t for t in got if len(t) > 100} <= {long.replace("me@x.example.org", "[EMAIL]")} and len(got) <= 8
    assert got
