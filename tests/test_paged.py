"""Paged sources with token pages, deleted records, failures and restarts; upserts that survive a job killed between write and commit."""

import json
import os

import pytest

from lodestone.sources import paged
from lodestone.streaming.versions import Conflict, VersionedTable
from pyspark.sql import functions as F


def service(folder, size=3):
    """A fetch over the records of a file, `size` a page, that notes its calls and fails while a file `down` lists the token."""

    def fetch(request, token):
        import json as j
        import os as o

        with open(o.path.join(folder, "calls"), "a") as f:
            f.write(j.dumps([request.get("from"), request.get("set"), token]) + "\n")
        down = o.path.join(folder, "down")
        if o.path.exists(down) and str(token) in open(down).read().split():
            raise OSError("unreachable")
        rows = [r for r in j.load(open(o.path.join(folder, "records"))) if r["stamp"] >= (request.get("from") or "") and r.get("set") == request.get("set")]
        if not rows:
            return {"records": [], "token": None, "total": None, "error": "noRecordsMatch"}
        at = int(token.split(":")[1]) if token else 0
        after = at + size
        return {"records": rows[at:after], "token": f"{request.get('from')}:{after}" if after < len(rows) else None, "total": len(rows) + request.get("missing", 0), "error": None}

    return fetch


def put(folder, rows):
    with open(os.path.join(folder, "records"), "w") as f:
        json.dump([{"id": i, "stamp": s, "deleted": d, "payload": p, "set": g} for i, s, d, p, g in rows], f)


def calls(folder):
    return [json.loads(x) for x in open(os.path.join(folder, "calls"))]


def test_batches_follow_tokens_request_by_request(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(f"a{k}", f"2024-01-{k + 1:02d}", k == 2, f"p{k}", "one") for k in range(8)] + [(f"b{k}", "2024-02-01", False, None, "two") for k in range(3)]
    put(folder, rows)
    spark.dataSource.register(paged.paged_source("pages_a", service(folder)))
    asked = [{"set": "one"}, {"set": "two", "missing": 4}, {"set": "none"}, {"set": "one", "from": "2024-01-07"}]
    got = spark.read.format("pages_a").option("requests", json.dumps(asked)).option("pause", "0").load()
    assert got.rdd.getNumPartitions() == 4
    told = sorted((r.id, r.deleted, r.payload, r.page) for r in got.where("id is not null").collect())
    want = [(i, d, p, k // 3) for k, (i, _, d, p, _) in enumerate(rows[:8])] + [(i, d, p, 0) for i, _, d, p, _ in rows[8:]] + [(i, d, p, 0) for i, _, d, p, _ in rows[6:8]]
    assert told == sorted(want, key=lambda r: (r[0], r[1], r[2] or "", r[3]))
    one = {json.loads(r.request)["set"] + json.loads(r.request).get("from", ""): r for r in paged.harvested(got).collect()}
    assert [(one[k].pages, one[k].records, one[k].deleted, one[k].truncated) for k in ("one", "two", "none", "one2024-01-07")] == [(3, 8, 1, False), (1, 3, 0, True), (1, 0, 0, False), (1, 2, 0, False)]


def test_failures_are_tried_again_and_errors_are_told(spark, tmp_path):
    folder = str(tmp_path)
    put(folder, [("a", "2024-01-01", False, "p", None)])
    fetch, left = service(folder), [2]

    def shaky(request, token):
        left[0] -= 1
        if left[0] >= 0:
            raise TimeoutError
        return fetch(request, token)

    assert paged._asked(shaky, {}, None, 0)["records"][0]["id"] == "a"
    with pytest.raises(ValueError, match="badToken"):
        paged._asked(lambda r, t: {"error": "badToken"}, {}, "x", 0)
    with open(f"{folder}/down", "w") as f:
        f.write("None")
    with pytest.raises(OSError):
        paged._asked(fetch, {}, None, 0)


def run(spark, name, table, checkpoint, **more):
    stream = spark.readStream.format(name).option("pages", "2").option("pause", "0").load()
    rows = stream.select("id", "deleted", "stamp", "payload")
    query = rows.writeStream.foreachBatch(table.sink("harvest", ["stamp", "payload"], **more)).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def told(table):
    return {r.id: (r.deleted, r.payload) for r in table.read().collect()}


def test_a_stream_goes_on_at_its_token_after_a_restart(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "s"), str(tmp_path / "c")
    os.mkdir(folder)
    rows = [(f"a{k:02d}", f"2024-01-{k // 2 + 1:02d}", False, f"p{k}", None) for k in range(20)]
    put(folder, rows)
    spark.dataSource.register(paged.paged_source("pages_b", service(folder)))
    table = VersionedTable(spark, str(tmp_path / "t"), "id string, deleted boolean, stamp string, payload string", ["id"])
    with open(f"{folder}/down", "w") as f:
        f.write(":12")
    with pytest.raises(Exception, match="unreachable|OSError"):
        run(spark, "pages_b", table, checkpoint)
    some = told(table)
    assert 6 <= len(some) <= 12  # whole batches only
    os.remove(f"{folder}/down")
    before = len(calls(folder))
    run(spark, "pages_b", table, checkpoint)
    assert told(table) == {i: (False, p) for i, _, _, p, _ in rows}
    later = calls(folder)[before:]
    assert [None, None, None] not in [c for c in later if c[2] is None and c[0] == ""] and any(c[2] == ":12" for c in later)
    assert not any(c[0] == "" and c[2] is None for c in later)  # the first page isn't asked for again
    # the next round starts at the cursor: a changed record, a deleted one, a new one of the very last stamp
    put(folder, rows[:18] + [("a18", "2024-01-10", True, None, None), ("a19", "2024-01-10", False, "p19", None), ("a20", "2024-01-10", False, "p20", None), ("a03", "2024-02-01", False, "new", None)])
    run(spark, "pages_b", table, checkpoint)
    assert told(table) == {i: (False, p) for i, _, _, p, _ in rows} | {"a18": (True, None), "a20": (False, "p20"), "a03": (False, "new")}
    version = table.commit_of()["version"]
    run(spark, "pages_b", table, checkpoint)
    assert table.commit_of()["version"] == version  # nothing new, no batch


def test_a_job_killed_between_write_and_commit_leaves_no_trace_and_a_replay_no_second_effect(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id int, status string, tries int, first string", ["id"], update=["status", "tries"], status="status", terminal=("gone", "ok"))
    batch = lambda *rows: spark.createDataFrame(rows, "id int, status string, tries int, first string")

    def dies():
        raise KeyboardInterrupt

    assert table.read().count() == 0
    with pytest.raises(KeyboardInterrupt):
        table.upsert(batch((1, "open", 1, "a")), 0, "s", before_commit=dies)
    assert table.read().count() == 0 and table.versions() == []
    assert table.upsert(batch((1, "open", 1, "a"), (2, "open", 1, "b"), (2, "ok", 2, "c")), 0, "s", order=["tries"])
    assert not table.upsert(batch((1, "open", 9, "z")), 0, "s")  # replayed
    rows = lambda: {r.id: (r.status, r.tries, r.first) for r in table.read().collect()}
    assert rows() == {1: ("open", 1, "a"), 2: ("ok", 2, "c")}
    assert table.upsert(batch((1, "failed", None, "q"), (2, "open", 5, "q"), (3, None, 1, None)), 1, "s")
    assert rows() == {1: ("failed", None, "a"), 2: ("ok", 2, "c"), 3: (None, 1, None)}  # terminal statuses stay, a null is a value
    assert table.upsert(batch((1, "gone", 7, "q")), 0, "other")  # another stream counts its own batches
    table.compact()
    assert table.upsert(batch((1, "open", 8, "q"), (3, "open", 2, "q")), 2, "s") and not table.upsert(batch((4, "x", 1, "x")), 1, "s")
    assert rows() == {1: ("gone", 7, "a"), 2: ("ok", 2, "c"), 3: ("open", 2, None)}
    assert {r.id for r in table.read(1).collect()} == {1, 2}
    gone = table.vacuum()
    assert len(gone) == 4 and rows()[1] == ("gone", 7, "a")


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id int, v int", ["id"])
    one = spark.createDataFrame([(1, 1)], "id int, v int")

    def other():
        VersionedTable(spark, table.path, "id int, v int", ["id"]).upsert(one.withColumn("v", F.lit(5)), 0, "b")

    with pytest.raises(Conflict):
        table.upsert(one, 0, "a", before_commit=other)
    assert table.read().first().v == 5 and table.upsert(one, 0, "a") and table.read().first().v == 1


def test_pages_of_two_protocols():
    xml = """<OAI-PMH xmlns="http://x/"><ListRecords><record><header><identifier>oai:1</identifier><datestamp>2024-01-02</datestamp></header>
    <metadata><r><id>1</id></r></metadata></record><record><header status="deleted"><identifier>oai:2</identifier><datestamp>2024-01-03</datestamp></header></record>
    <resumptionToken completeListSize="5">t1</resumptionToken></ListRecords></OAI-PMH>"""
    page = paged.oai_page(xml)
    assert [(r["id"], r["deleted"], r["stamp"]) for r in page["records"]] == [("oai:1", False, "2024-01-02"), ("oai:2", True, "2024-01-03")]
    assert (page["token"], page["total"], page["error"]) == ("t1", 5, None) and "<" in page["records"][0]["payload"]
    assert paged.oai_page("<OAI-PMH><error code='noRecordsMatch'/></OAI-PMH>")["error"] == "noRecordsMatch"
    works = paged.works_page(json.dumps({"message": {"items": [{"DOI": "10.1/x", "indexed": {"date-time": "2024"}}], "next-cursor": "c", "total-results": 9}}))
    assert (works["records"][0]["id"], works["token"], works["total"]) == ("10.1/x", "c", 9)
    assert paged.works_page('{"message": {"items": [], "next-cursor": "c"}}')["token"] is None
