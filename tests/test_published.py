import os

import pytest

from gradelake.sources import published as P
from gradelake.streaming import cycle as C


def rows(spark, folder):
    now = P.current(spark, folder)
    return None if now is None else sorted(x.a for x in spark.read.parquet(f"{now}/t").collect())


def put(spark, folder, *values, **kw):
    return P.publish_tables(spark, folder, {"t": spark.createDataFrame([(v,) for v in values], "a int")}, **kw)


def test_versions(spark, tmp_path):
    folder = f"{tmp_path}/x"
    assert P.current(spark, folder) is None and P.versions(spark, folder) == []
    for n in range(4):
        put(spark, folder, n, n + 1)
        assert rows(spark, folder) == [n, n + 1]
    assert len(P.versions(spark, folder)) == 2
    with pytest.raises(ValueError):
        put(spark, folder, 1, keep=0)


@pytest.mark.parametrize("step", ["write", "_write", "_switch", "rename"])
def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    folder = f"{tmp_path}/x"
    put(spark, folder, 1)
    with monkeypatch.context() as m:
        def die(*args):
            raise KeyboardInterrupt

        if step == "write":  # half a version is written
            with pytest.raises(KeyboardInterrupt):
                P.publish(spark, folder, lambda aside: (spark.range(3).write.parquet(f"{aside}/other"), die()))
        elif step == "rename":
            real = P._write
            m.setattr(P, "_write", lambda s, name, text: real(s, name, text) if P.POINTER not in name else (real(s, name, text), die()))
            with pytest.raises(KeyboardInterrupt):
                put(spark, folder, 2)
        else:
            m.setattr(P, step, die)
            with pytest.raises(KeyboardInterrupt):
                put(spark, folder, 2)
    assert rows(spark, folder) == [1]
    put(spark, folder, 3)
    assert rows(spark, folder) == [3]
    assert all(os.path.exists(f"{v}/{P.MARK}") for v in P.versions(spark, folder))


def test_a_broken_pointer(spark, tmp_path):
    folder = f"{tmp_path}/x"
    put(spark, folder, 1)
    put(spark, folder, 2)
    for text in ("v=99", "", "\x00"):
        P._write(spark, f"{folder}/{P.POINTER}", text)
        assert rows(spark, folder) == [2]
    os.remove(f"{folder}/{P.POINTER}")
    assert rows(spark, folder) == [2]
    P._write(spark, f"{folder}/{P.POINTER}", os.path.basename(P.versions(spark, folder)[1]))
    assert rows(spark, folder) == [1]  # the pointer decides, not the number


def test_state(spark, tmp_path):
    state = C.load(spark, f"{tmp_path}/s")
    assert state.results.count() == 0
    state = C.replace(state, strikes=spark.createDataFrame([("a", ["k"])], C.TABLES["strikes"]))
    C.save(state, f"{tmp_path}/s")
    again = C.load(spark, f"{tmp_path}/s")
    assert [(x.hotkey, x["keys"]) for x in again.strikes.collect()] == [("a", ["k"])] and again.pending.columns == C.NAMES["pending"]
