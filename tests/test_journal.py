"""The commit journal: a writer may die at any step; seals grow by the right edge only."""

import json

import pytest
from pyspark.sql import functions as F

from textward.operators import audit as A
from textward.sources import journal as J
from textward.sources import sinks as S
from textward.operators.structured import sanitize_json


class Killed(RuntimeError):
    pass


def _write(spark, root, ids, mode="append"):
    rows = spark.createDataFrame([(i, f"text {i}; DROP TABLE x") for i in ids], "id int, t string")
    S.write_text(rows, "t", "out", f"{root}/audit", root=root, key="id", mode=mode)


def _state(spark, root):
    log = S.read_log(spark, f"{root}/audit")  # finishes what a writer left
    data = {r.id for r in spark.read.parquet(f"{root}/out").collect()}
    places = [(r.chain, r.seq) for r in log.collect()]
    assert len(places) == len(set(places)) and S.verify_audit(spark, f"{root}/audit").isEmpty()
    return data, len(places)


def _folder(path, **files):
    path.mkdir(parents=True)
    for name, text in files.items():
        (path / name).write_text(text)


def _killed_at(monkeypatch, step, run):
    """Let `run` die at the given move or deletion; whether it did."""
    left, make, delete = [step], J._move, J._delete

    def counted(fn):
        def call(*a):
            if left[0] == 0:
                raise Killed
            left[0] -= 1
            return fn(*a)
        return call

    monkeypatch.setattr(J, "_move", counted(make))
    monkeypatch.setattr(J, "_delete", counted(delete))
    try:
        run()
        return False
    except Killed:
        return True
    finally:
        monkeypatch.setattr(J, "_move", make)
        monkeypatch.setattr(J, "_delete", delete)


def test_moves_are_finished_wherever_a_writer_dies(spark, tmp_path, monkeypatch):
    """Every move and deletion of a commit fails in turn; recovery leaves the same folders each time."""
    for step in range(30):
        root = tmp_path / str(step)
        _folder(root / "data", old="o")
        _folder(root / "lines", l1="1")
        _folder(root / "new-data", a="a", b="b")
        _folder(root / "new-lines", l2="2", l3="3")
        moves = [J.replace(f"{root}/new-data", f"{root}/data"), J.append(f"{root}/new-lines", f"{root}/lines"), J.append(f"{root}/none", f"{root}/lines")]
        killed = _killed_at(monkeypatch, step, lambda moves=moves, root=root: J.commit(spark, f"{root}/journal", 0, moves))
        if killed:
            assert J._numbers(spark, f"{root}/journal") == [1]
        assert J.recover(spark, f"{root}/journal") == 1 and J.recover(spark, f"{root}/journal") == 1
        found = {str(f.relative_to(root)): f.read_text() for f in root.rglob("*") if f.is_file() and "journal" not in str(f) and not f.name.startswith(".")}
        assert found == {"data/a": "a", "data/b": "b", "lines/l1": "1", "lines/l2": "2", "lines/l3": "3"}, step
        if not killed:
            break
    assert not killed and step > 5
    with pytest.raises(J.Conflict):
        J.commit(spark, f"{root}/journal", 0, [])


@pytest.mark.parametrize("step", [0, 2])
def test_a_sink_that_dies_after_the_commit(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    _write(spark, root, range(3))
    assert _killed_at(monkeypatch, step, lambda: _write(spark, root, [10, 11]))
    assert _state(spark, root) == ({0, 1, 2, 10, 11}, 5)
    _write(spark, root, [12], "overwrite")
    assert _state(spark, root) == ({12}, 6)


def test_a_writer_that_dies_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    _write(spark, root, range(3))
    monkeypatch.setattr(J, "commit", lambda *a: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        _write(spark, root, [7])
    monkeypatch.undo()
    assert _state(spark, root) == ({0, 1, 2}, 3)
    _write(spark, root, [8])
    assert _state(spark, root) == ({0, 1, 2, 8}, 4)


def test_of_two_writers_the_second_goes_on_from_the_first(spark, tmp_path, monkeypatch):
    root, once = str(tmp_path), []
    _write(spark, root, range(2))
    commit = J.commit

    def late(*a):
        if not once:
            once.append(1)
            _write(spark, root, [5])  # another writer is faster
        return commit(*a)

    monkeypatch.setattr(J, "commit", late)
    _write(spark, root, [6])
    monkeypatch.undo()
    assert _state(spark, root) == ({0, 1, 5, 6}, 4)


def test_a_commit_that_breaks_off_is_void(spark, tmp_path):
    _folder(tmp_path / "new", a="a")
    J.commit(spark, f"{tmp_path}/journal", 0, [])
    (tmp_path / "journal" / "2").write_text('{"moves": [{"kind"')
    assert J.recover(spark, f"{tmp_path}/journal") == 2 and (tmp_path / "new" / "a").exists()
    J.commit(spark, f"{tmp_path}/journal", 2, [J.append(f"{tmp_path}/new", f"{tmp_path}/there")])
    assert (tmp_path / "there" / "a").read_text() == "a"


def _entries(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id int").select(
        "id", F.lit("2024-01-01T00:00:00.000000+00:00").alias("timestamp"), F.lit("d").alias("destination"), F.lit("general").alias("context"),
        F.lit("append").alias("action"), F.lit(1).alias("original_length"), F.lit(1).alias("cleaned_length"), F.lit(False).alias("threats_found"),
        F.lit(0).alias("threat_count"), F.array().cast(f"array<{A.DETECTION4}>").alias("detections"))


def test_an_append_reads_heads_only(spark, tmp_path, monkeypatch):
    """Seals over three levels, grown by appends of every size, equal those made at once; none of them is read to go on."""
    monkeypatch.setattr(A, "FAN", 3)
    monkeypatch.setattr(S, "COMPACT", 3)
    audit, at = str(tmp_path / "audit"), 0
    monkeypatch.setattr(S, "read_seals", lambda *a: pytest.fail("seals are read"))
    monkeypatch.setattr(S, "read_log", lambda *a: pytest.fail("the log is read"))
    for size in (5, 3, 44, 4):
        S.append_audit(_entries(spark, range(at, at + size)), audit, ["id"], rows_per_chain=2)
        at += size
    monkeypatch.undo()
    monkeypatch.setattr(A, "FAN", 3)
    log = S.read_log(spark, audit)
    assert log.count() == at == 56 and S.verify_audit(spark, audit, rows_per_chain=2).isEmpty()
    made, kept = ({tuple(r) for r in x.select("log", "level", "node", "n", "hash").collect()} for x in (A.seals(log), S.read_seals(spark, audit)))
    assert made == kept and max(r[1] for r in kept) == 4
    edges = S.read_heads(spark, audit).first().edge
    assert all(sum(e.level == k for e in edges) <= 3 for k in range(5))
    cut = log.where("chain <> 7")
    assert not A.verify_log(cut, S.read_heads(spark, audit).drop("edge"), S.read_seals(spark, audit), 2).isEmpty()


def test_broken_json_can_be_set_aside(spark):
    docs = ['{"a": "DROP TABLE x"}', '{"a": ', "1 2", '[1]]', '1,"b":2', None, '{"k":"a\\u0041\\n\\"q\\""}', '"x" "y"', "[" * 30 + "]" * 29, "!", '{"a":!}', "[nul]", "[01]"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, j string")
    got = {r.i: (r.bad, r.cleaned) for r in sanitize_json(df, "j", bad_rows="bad").select("i", "bad", "cleaned").collect()}
    assert {i for i, (bad, _) in got.items() if bad} == {1, 2, 3, 4, 7, 8, 9, 10, 11, 12}
    assert got[5] == (False, None) and "DROP" not in got[0][1] and json.loads(got[6][1]) == {"k": 'aA\n"q"'}
