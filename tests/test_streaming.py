from __future__ import annotations

from quire.operators import querygen
from quire.streaming import cache_stream


def test_cache_and_history_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.json").write_text('{"key":"k","response":"old"}\n{"key":"j","response":"x"}\nbroken\n')
    for k, text in enumerate((None, '{"key":"k","response":"new"}\n')):
        if text:
            (src / "b.json").write_text(text)
        cache_stream.cache_upserts(spark, str(src), str(out), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(out)).count() == 2 + k
    assert dict(querygen.load_cache(spark.read.parquet(str(out))).collect()) == {"k": "new", "j": "x"}
    log = tmp_path / "log"
    log.mkdir()
    (log / "h.json").write_text('{"book":"b","variant":"v","epoch":0,"dev_r1":1.5}\n{"book":"b","variant":"v","epoch":1,"dev_r1":1.0}\n')
    cache_stream.best_epochs(spark, str(log), "best_epochs", str(tmp_path / "c2")).awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT * FROM best_epochs").collect()] == [("b", "v", 1.5, 1)]
