"""Resumed runs, session-wise writes, the stream of stages, and bibliography files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quillspark.plans import stages
from quillspark.plans.stages import Stage, run_stages, stage_metrics
from quillspark.sources import session_tables as st


class Killed(Exception):
    pass


def files(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def chain(calls, broken=None, versions=None):
    def step(name, make):
        def run(*tables):
            calls.append(name)
            if name == broken:
                raise Killed(name)
            return make(*tables)

        return run

    versions = versions or {}
    return [
        Stage("words", ("docs",), step("words", lambda d: d.select("id", F.explode(F.split("text", " ")).alias("w"))), versions.get("words", "1"), {"long": F.length("w") > 3}),
        Stage("lower", ("words",), step("lower", lambda w: w.select("id", F.lower("w").alias("w"))), versions.get("lower", "1")),
        Stage("known", ("lower", "list"), step("known", lambda w, k: w.join(k, "w", "left")), versions.get("known", "1"), {"unresolved": F.col("ref").isNull()}),
        Stage("counts", ("known",), step("counts", lambda k: k.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))), versions.get("counts", "1")),
        Stage("top", ("counts", "list"), step("top", lambda c, k: c.join(k, "ref")), versions.get("top", "1")),
    ]


@pytest.fixture
def inputs(spark):
    docs = spark.createDataFrame([(1, "Zinc binds copper"), (2, "iron AND zinc"), (3, "")], "id int, text string")
    return {"docs": docs, "list": spark.createDataFrame([("zinc", 1), ("iron", 2)], "w string, ref int")}


def test_a_killed_run_resumes(spark, tmp_path, inputs):
    folder, calls = str(tmp_path / "run"), []
    with pytest.raises(Killed):
        run_stages(spark, folder, inputs, chain(calls, broken="counts"))
    assert calls == ["words", "lower", "known", "counts"]
    before = files(folder)
    calls.clear()
    out = run_stages(spark, folder, inputs, chain(calls))
    assert calls == ["counts", "top"]
    assert before.items() <= files(folder).items()
    whole = run_stages(spark, str(tmp_path / "other"), inputs, chain([]))
    for name, table in out.items():
        assert table.schema == whole[name].schema and sorted(map(str, table.collect())) == sorted(map(str, whole[name].collect()))


def test_changes_make_what_follows_again(spark, tmp_path, inputs):
    folder, calls = str(tmp_path / "run"), []
    run_stages(spark, folder, inputs, chain(calls))
    calls.clear()
    run_stages(spark, folder, {**inputs, "docs": inputs["docs"].orderBy(F.desc("id"))}, chain(calls))
    assert calls == []  # the order of rows is no change
    run_stages(spark, folder, inputs, chain(calls, versions={"known": "2"}))
    assert calls == ["known", "counts", "top"]
    calls.clear()
    more = {**inputs, "list": inputs["list"].union(spark.createDataFrame([("copper", 3)]))}
    out = run_stages(spark, folder, more, chain(calls))
    assert calls == ["known", "counts", "top"] and out["top"].count() == 3
    calls.clear()
    run_stages(spark, folder, inputs, chain(calls))
    assert calls == []  # the tables of the earlier inputs are still there


def test_a_damaged_table_is_made_again(spark, tmp_path, inputs):
    folder, calls = str(tmp_path / "run"), []
    run_stages(spark, folder, inputs, chain(calls))
    line = stages.read_manifest(spark, folder).filter("stage = 'lower'").first()
    kept = sorted(glob.glob(f"{line.path}/*.parquet"), key=os.path.getsize, reverse=True)
    os.rename(kept[0], f"{line.path}/_gone")
    calls.clear()
    run_stages(spark, folder, inputs, chain(calls))
    assert calls == ["lower"]


def test_counts_come_with_the_run(spark, tmp_path, inputs):
    folder = str(tmp_path / "run")
    run_stages(spark, folder, inputs, chain([]))
    got = {(r.stage, r.name): (r.rows_in, r.rows, r.n, r.percent) for r in stage_metrics(spark, folder).collect()}
    assert got["words", "long"] == (3, 7, 5, 71.4) and got["known", "unresolved"] == (7, 7, 4, 57.1) and got["lower", None] == (7, 7, None, None)


def test_sessions_are_written_one_by_one(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c d/e", 1, "w"), (None, 7, "n")], "session_id string, k int, v string")
    st.save_sessions(spark, folder, "claims", rows)
    assert sorted(map(str, st.read_sessions(spark, folder, "claims").collect())) == sorted(map(str, rows.collect()))
    before = files(f"{folder}/claims")
    st.save_sessions(spark, folder, "claims", spark.createDataFrame([("b", 5, "new"), ("f", 1, "first")], rows.schema))
    after = files(f"{folder}/claims")
    untouched = {p for p in before if "session_part=b" not in p}
    assert {p: before[p] for p in untouched}.items() <= after.items() and not any(p in after for p in before if "session_part=b" in p)
    assert sorted(r.k for r in st.read_sessions(spark, folder, "claims").collect()) == [1, 1, 1, 2, 5, 7]
    changes = spark.createDataFrame([("a", 1, None, 1), ("a", 2, "changed", 2), ("a", 2, "lost", 1)], "session_id string, k int, v string, seq int")
    st.upsert_sessions(spark, folder, "claims", changes, ["session_id", "k"], "seq")
    assert {(r.k, r.v) for r in st.sessions_of(spark, folder, "claims", ["a"]).collect()} == {(1, "x"), (2, "changed")}
    st.delete_sessions(spark, folder, ["claims"], spark.createDataFrame([("a",), ("zz",)], "session_id string"))
    assert {r.session_id for r in st.read_sessions(spark, folder, "claims").collect()} == {"b", "c d/e", "f", None}


def test_a_broken_write_is_finished(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "session_id string, k int")
    st.save_sessions(spark, folder, "t", rows)
    real = st._apply

    def fails(*_):
        raise Killed

    monkeypatch.setattr(st, "_apply", fails)
    with pytest.raises(Killed):
        st.save_sessions(spark, folder, "t", spark.createDataFrame([("b", 2)], rows.schema))
    assert sorted(r.k for r in st.read_sessions(spark, folder, "t").collect()) == [1, 1]
    monkeypatch.setattr(st, "_apply", real)
    assert st.recover(spark, folder) == 1 and st.recover(spark, folder) == 0
    assert {(r.session_id, r.k) for r in st.read_sessions(spark, folder, "t").collect()} == {("a", 1), ("b", 2)}


def events(seed):
    import random

    rng = random.Random(seed)
    rows = []
    for s in range(6):
        t = 1_000_000 + rng.randrange(1000)
        for n in range(rng.randrange(3, 15)):
            t += rng.randrange(1, 400)
            kind = rng.choice(["running", "complete", "needs_input", "error"])
            rows.append((f"s{s}", len(rows), t, rng.choice([None, 0, 1, 2, 3]) if kind != "error" else rng.randrange(1, 4), kind, rng.choice([None, 1.5, 2.0]), rng.choice([None, "m1", "m2"])))
        if s % 3 == 0:
            rows.append((f"s{s}", len(rows), t + 5, 0, "pipeline_complete" if s else "error", None, None))
    return rows


EVENTS = "session_id string, event_id long, t long, stage int, status string, elapsed double, message string"


def write_events(spark, folder, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(f"{folder}/in/{n:03}")
        for p in glob.glob(f"{folder}/in/{n:03}/*.parquet"):
            os.utime(p, (1_700_000_000 + n, 1_700_000_000 + n))


def read_stream(spark, folder):
    return spark.readStream.schema(f"{EVENTS}, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stream_says_what_the_batch_says(spark, tmp_path, seed):
    """Shuffled and replayed events, in several files, within the watermark."""
    import random

    from quillspark.streaming import events as ev
    from quillspark.streaming import sessions

    rng = random.Random(seed)
    rows = events(seed)
    again = rows + rng.sample(rows, 15)
    rng.shuffle(again)
    folder = str(tmp_path)
    write_events(spark, folder, [again[i::4] for i in range(4)])
    query = sessions.write_states(sessions.stage_states(read_stream(spark, folder), "2 hours"), f"{folder}/out", f"{folder}/check")
    query.awaitTermination()
    got = sessions.present(spark.read.parquet(f"{folder}/out").drop("batch")).collect()
    table = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds("t"))
    want = {(r.session_id, r.stage): (r.status, r.elapsed, r.message, r.interventions) for r in ev.stage_status(table).collect()}
    assert {(r.session_id, r.stage): (r.status, r.elapsed, r.message, r.interventions) for r in got if r.stage is not None} == want
    states = {r.session_id: r.state for r in ev.session_state(table).collect()}
    assert {r.session_id: r.state for r in got} == states


def test_silent_sessions_stall_and_late_events_are_left_out(spark, tmp_path):
    from quillspark.streaming import sessions

    row = lambda s, n, t, status="running": (s, n, t + 1_000_000, 1, status, None, None)
    folder = str(tmp_path)
    write_events(spark, folder, [
        [row("quiet", 1, 0), row("done", 2, 0), ("done", 3, 1_000_001, 0, "pipeline_complete", None, None), row("busy", 4, 0)],
        [row("busy", 5, 4000)],
        [row("busy", 6, 8000), row("busy", 7, 10, "late")],
        [row("busy", 8, 8001)],
    ])
    query = sessions.write_states(sessions.stage_states(read_stream(spark, folder), "10 minutes", silent_ms=1_800_000), f"{folder}/out", f"{folder}/check")
    query.awaitTermination()
    got = {r.session_id: (r.state, r.status) for r in sessions.present(spark.read.parquet(f"{folder}/out").drop("batch")).collect()}
    assert got["quiet"] == ("stalled", "running") and got["done"] == ("complete", "running") and got["busy"][1] == "running"


BIB = """
free text
@string{jt = "J Test"}
@article{first, title = {The {Zinc} \\& copper}, author = "Smith, J. and {van der Berg}, A.", year = 2001,
  journal = jt # " B", doi = {10.1/a}}
@book{open, title = {never closed
@misc{second,
  title = {Over
     lines}, year = {c. 1999}, url = {https://x.org/{a}}
}
@misc{broken, title}
@comment{left out}
"""
RIS = """TY  - JOUR
AU  - Smith, J.
AU  - Doe, A.
TI  - A title
  that goes on
PY  - 2003/05//
JO  - J Test
DO  - 10.2/y
ER  -

TY  - BOOK
TI  - no end
TY  - CHAP
T1  - third
ER  -
"""


def test_bibliography_files(spark, tmp_path):
    from quillspark.sources import bibliography as b

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.bib").write_text(BIB)
    (tmp_path / "in" / "deep" / "b.RIS").write_text(RIS)
    (tmp_path / "in" / "c.txt").write_text(RIS)
    (tmp_path / "in" / "empty.bib").write_text("")
    spark.dataSource.register(b.BibliographySource)
    for table in (b.read_bibliography(spark, str(tmp_path / "in")), spark.read.format("bibliography").load(str(tmp_path / "in"))):
        rows = {(os.path.basename(r.path), r.ord): r for r in table.collect()}
        one, two, three = rows["a.bib", 0], rows["a.bib", 2], rows["b.RIS", 0]
        assert (one.cite_key, one.title, one.authors, one.year, one.journal, one.doi) == ("first", "The Zinc & copper", ["Smith, J.", "van der Berg, A."], 2001, "J Test B", "10.1/a")
        assert (two.title, two.year, two.url, two.authors) == ("Over lines", 1999, "https://x.org/a", [])
        assert (three.kind, three.title, three.authors, three.year, three.journal, three.doi) == ("jour", "A title that goes on", ["Smith, J.", "Doe, A."], 2003, "J Test", "10.2/y")
        assert [rows[k].malformed for k in (("a.bib", 1), ("a.bib", 3), ("b.RIS", 1))] == ["@book{open, title = {never closed", "@misc{broken, title}", "TY  - BOOK\nTI  - no end"]
        assert rows["b.RIS", 2].title == "third" and len(rows) == 7
        refs = b.to_references(table, "s").orderBy("ref_num").collect()
        assert [(r.ref_num, r.title) for r in refs] == [(1, one.title), (2, two.title), (3, three.title), (4, "third")]


def test_manuscripts_in_stages_are_those_of_one_chain(spark, tmp_path):
    from quillspark.plans import manuscripts
    from tests.conftest import SMALL

    whole = sorted(map(tuple, manuscripts.p01_manuscripts(spark, SMALL).collect()))
    out = manuscripts.staged(spark, SMALL, str(tmp_path / "run"))
    assert sorted(map(tuple, out["coverage"].collect())) == whole and out["claims"].count() == out["units"].count()
    before = files(str(tmp_path / "run"))
    again = manuscripts.staged(spark, SMALL, str(tmp_path / "run"))
    assert files(str(tmp_path / "run")) == before and again["claims"].count() == out["claims"].count()
    seen = {(r.stage, r.name): (r.rows, r.n) for r in stage_metrics(spark, str(tmp_path / "run")).collect()}
    assert seen["mapped", "unresolved"] == (out["mapped"].count(), out["mapped"].filter("method = 'unresolved'").count())
