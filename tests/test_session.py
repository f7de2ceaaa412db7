from __future__ import annotations

import os
import shutil

from orebody import session


def test_relations_are_built_once_and_removed_with_their_last_holder(spark, tmp_path):
    spark.range(5).write.parquet(f"file://{tmp_path}/t")
    seen = session.fingerprint(spark, [f"file://{tmp_path}/t"])
    assert seen == session.fingerprint(spark, [f"file://{tmp_path}/t"])
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"file://{tmp_path}/t")

    a = session.reused(spark, "t", seen, {"least": 1}, build)
    b = session.reused(spark, "t", seen, {"least": 1}, build)
    assert len(built) == 1 and a.count() == b.count() == 5
    folder = os.path.dirname(a.inputFiles()[0]).removeprefix("file://")
    session.reused(spark, "t", seen, {"least": 2}, build)
    spark.range(7).write.mode("overwrite").parquet(f"file://{tmp_path}/t")
    other = session.fingerprint(spark, [f"file://{tmp_path}/t"])
    assert other != seen and session.reused(spark, "t", other, {"least": 1}, build).count() == 7 and len(built) == 3
    assert not session.release(spark, "t", seen, {"least": 1}) and os.path.isdir(folder)
    assert session.release(spark, "t", seen, {"least": 1}) and not os.path.exists(folder)
    assert not session.release(spark, "t", seen, {"least": 1})
    assert session.release(spark, "t", seen, {"least": 2}) and session.release(spark, "t", other, {"least": 1})


def test_a_kept_relation_whose_files_are_gone_is_built_again(spark):
    one = session.reused(spark, "gone", "x", {}, lambda: spark.range(4))
    shutil.rmtree(os.path.dirname(one.inputFiles()[0]).removeprefix("file://"))
    assert session.reused(spark, "gone", "x", {}, lambda: spark.range(4)).count() == 4
    assert not session.release(spark, "gone", "x", {}) and session.release(spark, "gone", "x", {})


def test_scratch_removes_what_was_cut_within(spark):
    with session.scratch(spark):
        folder = os.path.dirname(session.cut(spark.range(3)).inputFiles()[0]).removeprefix("file://")
        kept = session.reused(spark, "kept", "x", {}, lambda: spark.range(4))
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and kept.count() == 4
    assert session.release(spark, "kept", "x", {})
