import os

import pytest

from lodestone import __main__ as cli
from lodestone.operators.chunking import build_index
from lodestone.sources import handbook as H
from lodestone.streaming import append


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_chunks_and_vectors_append(spark, tmp_path):
    source, out, marks = (str(tmp_path / name) for name in ("in", "out", "marks"))
    docs = H.documents(spark)
    for part in ("vacation", "remote"):
        docs.where(f"doc_id = '{part}'").write.mode("append").parquet(source)
        stream = spark.readStream.schema(docs.schema).parquet(source)
        drain(append.append_chunks(stream, out, marks, 80))
    expected = build_index(docs.where("doc_id IN ('vacation', 'remote')"), 80)
    got = spark.read.parquet(out)
    assert got.count() == expected.count()
    assert got.select("doc_id", "text").exceptAll(expected.select("doc_id", "text")).count() == 0
    rows = spark.createDataFrame([(1, [3.0, 4.0])], "id bigint, vector array<float>")
    rows.write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "v"))
    drain(append.append_vectors(stream, str(tmp_path / "vo"), str(tmp_path / "vm"), 2))
    assert [round(x, 6) for x in spark.read.parquet(str(tmp_path / "vo")).first()["vector"]] == [0.6, 0.8]


def test_command_line(capsys):
    assert cli.main([]) == 0
    assert cli.main(["writeup"]) == 0
    assert "stand-ins" in capsys.readouterr().out


@pytest.mark.parametrize("command", [["ask", "what", "are", "the", "core", "hours"], ["index"]])
def test_commands_run(spark, capsys, command):
    assert cli.main(command) == 0
    out = capsys.readouterr().out
    assert "core hours" in out if command[0] == "ask" else "26" in out
