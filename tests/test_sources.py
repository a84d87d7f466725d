import gzip
import io
import json
import sqlite3
import tarfile

import pytest

from lodestone.sources import articles, files


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_tables_with_aliases(spark, tmp_path):
    path = put(tmp_path / "a.csv", "Formula,TC (K),other\nMgB2,39,x\nNb,,y\n")
    df = files.csv_aliased(spark, path, {"formula": ["name", "formula"], "tc": ["Tc", "tc (k)"]}, ["formula", "tc"])
    assert df.columns == ["formula", "tc"] and [tuple(r) for r in df.collect()] == [("MgB2", "39"), ("Nb", None)]
    with pytest.raises(ValueError, match="year"):
        files.csv_aliased(spark, path, {"formula": ["formula"]}, ["year"])


def test_manifests(spark, tmp_path):
    put(tmp_path / "m.txt", "# list\n10.1103/PhysRevB.1\naps:10.1103/physrevb.1\nhttps://doi.org/10.1103/PhysRevB.2.\n\narxiv:2301.00001\n")
    assert sorted(r.doi for r in files.manifest(spark, str(tmp_path / "m.txt")).collect()) == ["10.1103/PhysRevB.1", "10.1103/PhysRevB.2"]
    kinds = {(r.kind, r.value) for r in files.id_manifest(spark, str(tmp_path / "m.txt")).collect()}
    assert ("doi", "10.1103/PhysRevB.1") in kinds and ("id", "arxiv:2301.00001") in kinds
    put(tmp_path / "p.json", json.dumps({"message": {"total-results": 2, "items": [{"DOI": "a"}, {"DOI": "b"}]}}))
    assert files.pages_of_items(spark, str(tmp_path / "p.json")).count() == 2
    put(tmp_path / "f.json", json.dumps({"a": 1}))
    assert files.feed(spark, str(tmp_path / "f.json"), {"a": 0, "b": "x"}).first().asDict() == {"a": 1, "b": "x"}


def test_oai(spark, tmp_path):
    rec = lambda i, cat, st="": f"<record><header{st}><identifier>{i}</identifier></header><metadata><arXiv><id>{i}</id><title>A\n b</title><abstract>c</abstract><categories>{cat}</categories><created>2024-01-02</created></arXiv></metadata></record>"
    path = put(tmp_path / "o.xml", "<r>" + rec("1", "cond-mat.supr-con hep") + rec("2", "hep cond-mat.supr-con") + rec("3", "cond-mat.supr-con", ' status="deleted"') + "</r>")
    got = files.oai_records(spark, path, "cond-mat.supr-con").collect()
    assert [(r.id, r.title, r.categories) for r in got] == [("arxiv:1", "A b", ["cond-mat.supr-con", "hep"])]


JATS = """<?xml version="1.0"?><!DOCTYPE article><article><front/><body><sec><title>Intro</title><p>One &alpha; two<xref>1</xref>.</p><sec><title>Sub</title><p>Three</p></sec></sec>
<sec><title>Method</title><p>Four <disp-formula>x</disp-formula></p><table-wrap><table/></table-wrap></sec></body></article>"""


def test_articles(spark, tmp_path):
    d = tmp_path / "j"
    d.mkdir()
    put(d / "a.xml", JATS)
    put(d / "b.xml", "<article><body><p>Only</p></body></article>")
    put(d / "c.xml", "<article><bod")
    rows = {(r.path.rsplit("/", 1)[1], r.section): r for r in articles.read_articles(spark, str(d), "jats").collect()}
    assert rows["a.xml", 0].text == "One α two. Sub Three" and rows["a.xml", 1].has_equation and rows["a.xml", 1].has_table and rows["b.xml", 0].text == "Only" and rows["c.xml", 0].error
    o = tmp_path / "o"
    o.mkdir()
    put(o / "a.txt", "12\nCopy­right © X\nI. Introduction\n" + "super-\nconductor words here. " * 20 + "\nReferences\n[1] gone")
    put(o / "b.txt", "short")
    got = {r.path.rsplit("/", 1)[1]: r for r in articles.read_articles(spark, str(o), "ocr").collect()}
    assert got["a.txt"].name == "I. Introduction" and got["a.txt"].text.startswith("superconductor words") and "gone" not in got["a.txt"].text and got["b.txt"].error == "too short"


def test_latex(spark, tmp_path):
    main = r"\documentclass{a}\begin{document}Front % note" + "\n" + r"\section{One}Text \cite{x} \textbf{bold} \input{two} \section{Eq}\begin{equation}a\end{equation}end\begin{thebibliography}{9}gone\end{thebibliography}\end{document}"
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as tar:
        for name, data in (("main.tex", main), ("two.tex", "inlined")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data.encode()))
    d = tmp_path / "x"
    d.mkdir()
    put(d / "a.gz", gzip.compress(buf.getvalue()))
    put(d / "b.gz", gzip.compress(main.encode()))
    put(d / "c.gz", b"%PDF-1.4")
    rows = {(r.path.rsplit("/", 1)[1], r.name): r for r in articles.read_articles(spark, str(d), "latex").collect()}
    assert rows["a.gz", "One"].text == "Text bold inlined" and rows["a.gz", "Eq"].has_equation and rows["a.gz", "Eq"].text == "end" and rows["b.gz", "Front"].text == "Front" and rows["c.gz", None].error == "pdf"


def test_chunks_and_batches(spark):
    text = "\n\n".join(" ".join(f"w{p}.{k}" for k in range(40)) for p in range(10)) + "\n\n" + "long sentence here. " * 60
    df = spark.createDataFrame([(1, "a", text), (2, "a", ""), (3, "a", None)], "doc_id long, name string, text string")
    got = articles.chunks(df, 100, 20).orderBy("chunk").collect()
    assert {r.doc_id for r in got} == {1} and max(r.tokens for r in got) <= 100 and set(text.split()) == {w for r in got for w in r.text.split()}
    assert got[1].text.split()[:5] == got[0].text.split()[-20:][:5]
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([5000, 9000, 1, 20000, 3])], "i int, n int").coalesce(1)
    out = [r.batch.split("-")[1] for r in articles.batches(sizes, "n").orderBy("i").collect()]
    assert out == ["0", "0", "1", "2", "3"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    files.write_csv(df, f"{tmp_path}/c", ["k"])
    assert [r.k for r in spark.read.csv(f"{tmp_path}/c", header=True, inferSchema=True).collect()] == [1, 2]
    files.write_jsonl(df, f"{tmp_path}/j")
    assert files.jsonl(spark, f"{tmp_path}/j", "k int, v string").count() == 2
    assert spark.read.parquet(files.write_version(df, f"{tmp_path}/t", "v2024.01.01")).count() == 2


def test_tsv_keeps_quoted_empty_apart_from_null(spark, tmp_path):
    path = put(tmp_path / "t.tsv", 'a\tb\n1\t""\n2\t\n3\tx\n')
    assert [(r.a, r.b) for r in files.tsv(spark, path).orderBy("a").collect()] == [("1", ""), ("2", None), ("3", "x")]


def test_lines(spark, tmp_path):
    files.write_lines(spark.createDataFrame([(1,), (2,)], "k int"), "k", f"{tmp_path}/l")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/l").collect()) == ["1", "2"]


def test_sqlite_files(spark, tmp_path):
    for k in range(3):
        db = sqlite3.connect(tmp_path / f"{k}.db")
        db.execute("create table ratings (model text, score real)")
        db.executemany("insert into ratings values (?, ?)", [(f"m{k}", i / 2) for i in range(k * 3)])
        db.commit()
        db.close()
    got = files.sqlite(spark, f"{tmp_path}/*.db", "select model, score from ratings order by score", "model string, score double").collect()
    assert sorted(map(tuple, got)) == sorted((f"m{k}", i / 2) for k in range(3) for i in range(k * 3))


def test_paged_harvests(spark, tmp_path):
    page = lambda n, token, error="": f'<OAI-PMH>{error}<ListRecords>' + "".join(f'<record><header{" status=" + chr(34) + "deleted" + chr(34) if i == 0 else ""}><identifier>{i}</identifier></header></record>' for i in range(n)) + f"<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"
    put(tmp_path / "1.xml", page(3, "next"))
    put(tmp_path / "2.xml", page(2, ""))
    put(tmp_path / "3.xml", '<OAI-PMH><error code="noRecordsMatch">none</error></OAI-PMH>')
    got = {r.file: (r.records, r.deleted, r.token, r.error) for r in files.oai_pages(spark, f"{tmp_path}/*.xml").collect()}
    assert got == {"1.xml": (3, 1, "next", None), "2.xml": (2, 1, None, None), "3.xml": (0, 0, None, "noRecordsMatch")}
    for q, total, sizes in (("a", 5, (2, 2)), ("b", 3, (2, 1))):
        (tmp_path / q).mkdir()
        for k, n in enumerate(sizes):
            put(tmp_path / q / f"{k}.json", json.dumps({"message": {"total-results": total, "items": [{"DOI": f"{q}{k}{i}"} for i in range(n)]}}))
    told = {r["query"]: (r.reported_total, r.pages, r["items"], r.truncated) for r in files.query_summary(spark, f"{tmp_path}/[ab]/*.json").collect()}
    assert told == {"a": (5, 2, 4, True), "b": (3, 2, 3, False)}


def test_dumps_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    for day in ("2024-01-01", "2024-01-10", "2024-01-16"):
        kept = files.dump(df, str(tmp_path / "d"), day)
    assert kept == ["2024-01-10", "2024-01-16"]
    assert spark.read.json(str(tmp_path / "d")).count() == 2


def test_a_report_in_markdown(spark, tmp_path):
    df = spark.createDataFrame([(2, "a|b", None), (1, "x\ny", 1.5), (3, "z", 0.0)], "k int, name string, v double")
    files.write_markdown(df, str(tmp_path / "all"), "Report", ["k"])
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "all")).collect())
    assert text == "# Report\n\n| k | name | v |\n|-|-|-|\n| 1 | x y | 1.5 |\n| 2 | a\\|b |  |\n| 3 | z | 0.0 |"
    lines = {r.place: r.line for r in files.markdown(df, "R", ["k"], 2).collect()}
    assert len(lines) == 7 and lines[8] == "\n1 more rows"


def unit_sizes(text, size):
    """Word counts of what may not be parted: paragraphs, of longer ones sentences, of longer sentences runs of `size` words."""
    import re

    for paragraph in re.split(r"\n\s*\n", text or ""):
        n = len(paragraph.split())
        for part in [paragraph] if n <= size else re.split(r"(?<=[.!?])\s+", paragraph):
            n = len(part.split())
            yield from [size] * (n // size) + [n % size] * (n % size > 0)


@pytest.mark.parametrize(("size", "overlap"), [(512, 64), (60, 20), (7, 0)])
def test_every_chunk_of_every_document(spark, size, overlap):
    """Chunks hold all words in order, end where a unit ends, take all units that fit, and start with the end of the chunk before."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {}
    for r in articles.chunks(docs.withColumn("name", docs.lang), size, overlap).collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.text.split(" "), r.tokens))
    for d in docs.collect():
        words, units, at, before = (d.text or "").split(), list(unit_sizes(d.text, size)), 0, []
        for k, (number, chunk, tokens) in enumerate(sorted(got.pop(d.doc_id, []))):
            assert number == k and tokens == len(chunk) <= size
            lead = min(overlap, len(before), max(0, size - units[0])) if k else 0
            fresh = 0
            while units and lead + fresh + units[0] <= size:
                fresh += units.pop(0)
            assert chunk == (before[len(before) - lead :] if lead else []) + words[at : at + fresh]
            at, before = at + fresh, chunk
        assert at == len(words) and not units
    assert not got


def test_chunks_leave_in_pieces(spark, monkeypatch):
    """Chunks of one batch leave a task as several batches, and are the same ones."""
    df = spark.createDataFrame([(i, "x", f"w{i} " * 50) for i in range(200)] + [(200, None, None), (201, "y", " "), (None, "z", "ab cd")], "doc_id long, name string, text string").coalesce(1)
    whole = sorted(articles.chunks(df, 10, 2).collect(), key=str)
    monkeypatch.setattr(articles, "PIECE", 5_000)
    out = articles.chunks(df, 10, 2)
    assert sorted(out.collect(), key=str) == whole and len(whole) > 1_000
    got = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: got.update(f=f))
    articles.chunks(df, 10, 2)
    sizes = [b.num_rows for b in got["f"](iter(df.select("doc_id", "name", "text").toArrow().to_batches()))]
    assert sum(sizes) == len(whole) and max(sizes) < 200
