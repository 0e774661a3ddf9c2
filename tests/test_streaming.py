import json

import pytest

from trendloom.sources import tables
from trendloom.streaming import ingest as streams


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def record(number, date, categories="a.B c"):
    return {
        "id": f"{number:04d}", "title": "T", "abstract": " " + "Word " * 20, "categories": categories,
        "versions": [{"version": "v1", "created": "Mon, 2 Apr 2007 19:18:42 GMT"}], "update_date": date,
    }


def test_files_arrive_once_and_late_records_go(spark, tmp_path):
    arrivals, root = tmp_path / "in", str(tmp_path / "store")
    arrivals.mkdir()
    write(arrivals, "one.json", [record(1, "2010-01-01"), record(2, "2010-01-02"), record(1, "2010-01-03")])

    def run():
        stream = streams.snapshot_stream(spark, str(arrivals))
        streams.stream_ingest(stream, root, str(tmp_path / "offsets")).awaitTermination()

    run()
    assert tables.read_table(spark, root, "paper").count() == 2
    assert tables.read_mark(spark, root, "1990-01-01") == "2010-01-03"
    # one new record, one late, one known with another category
    write(arrivals, "two.json", [record(3, "2010-01-04"), record(4, "2010-01-03"), record(2, "2010-01-05", "c x")])
    run()
    papers = tables.read_table(spark, root, "paper").collect()
    assert sorted(p.source_id for p in papers) == ["0001", "0002", "0003"]
    assert sorted(p.id for p in papers) == [1, 2, 3]
    counts = {c.name: c.paper_count for c in tables.read_table(spark, root, "category").collect()}
    assert counts == {"a.B": 3, "c": 3, "x": 1}


def contents(spark, root):
    found = {
        name: sorted(map(str, tables.read_table(spark, root, name).collect()))
        for name in ("paper", "category", "paper_categories")
    }
    return found | {"mark": tables.read_mark(spark, root, "1990-01-01")}


@pytest.mark.parametrize("writes", [1, 2, 3, 4])
def test_a_batch_runs_again_after_each_of_its_writes(spark, tmp_path, monkeypatch, writes):
    """A stream that fails after some writes and starts anew leaves what an unbroken one does."""
    arrivals = tmp_path / "in"
    arrivals.mkdir()

    def run(root):
        stream = streams.snapshot_stream(spark, str(arrivals))
        streams.stream_ingest(stream, root, f"{root}-offsets").awaitTermination()

    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    write(arrivals, "one.json", [record(1, "2010-01-01"), record(2, "2010-01-02")])
    run(whole)
    run(broken)
    write(arrivals, "two.json", [record(3, "2010-01-04"), record(2, "2010-01-05", "c x"), record(4, "2010-01-02")])
    run(whole)
    done = []

    def breaking(write_one):
        def wrapped(*args, **kwargs):
            write_one(*args, **kwargs)
            done.append(write_one.__name__)
            if len(done) == writes:
                raise OSError("lost")

        return wrapped

    with monkeypatch.context() as patched:
        for name in ("add_rows", "write_table", "write_mark"):
            patched.setattr(tables, name, breaking(getattr(tables, name)))
        with pytest.raises(Exception, match="lost"):
            run(broken)
    assert len(done) == writes
    run(broken)
    assert contents(spark, broken) == contents(spark, whole)
    assert [p.source_id for p in tables.read_table(spark, whole, "paper").orderBy("id").collect()] == ["0001", "0002", "0003"]


def test_keys_leave_the_state_and_are_dropped_when_they_return(spark, tmp_path):
    arrivals, out = tmp_path / "in", str(tmp_path / "out")
    arrivals.mkdir()

    def run(lifetime="1 millisecond"):
        stream = streams.snapshot_stream(spark, str(arrivals), 1)
        query = streams.stream_dedup(stream, out, str(tmp_path / "offsets"), lifetime=lifetime)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    for number in range(4):
        ids = range(10 * number, 10 * number + 10)
        write(arrivals, f"{number}.json", [record(i, "2010-01-01") for i in (*ids, *ids)])
    assert run() <= 20  # of 40 keys
    write(arrivals, "4.json", [record(i, "2010-01-02") for i in (3, 17, 50)] + [{**record(0, "2010-01-02"), "id": None}] * 2)
    assert run() <= 20
    write(arrivals, "5.json", [{**record(0, "2010-01-03"), "id": None}, record(50, "2010-01-03")])
    run()
    kept = streams.unique_records(spark, out)
    assert kept.columns == [f.name for f in streams.SNAPSHOT]
    found = kept.collect()
    assert sorted(r.id or "" for r in found) == ["", *(f"{i:04d}" for i in range(40)), "0050"]
    assert {r.update_date for r in found if r.id == "0003"} == {"2010-01-01"}
