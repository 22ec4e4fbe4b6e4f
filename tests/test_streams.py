"""Streams that stop half-way and go on."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from corvane.streaming import appends


def written(path):
    return sorted(json.loads(x)["id"] for p in path.iterdir() if p.name.endswith(".json") and not p.name.startswith((".", "_")) for x in p.read_text().splitlines())


def put(folder, name, ids):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"id": i, "v": f"{name} {i}"}) + "\n" for i in ids))


class Stop(Exception):
    pass


class Broken:
    """A file system that stops after a rename, or before it marks a batch as done."""

    def __init__(self, fs, stop):
        self.fs, self.stop = fs, stop

    def __getattr__(self, name):
        def call(*args):
            if name == self.stop == "mkdirs":
                raise Stop
            out = getattr(self.fs, name)(*args)
            if name == self.stop == "rename":
                raise Stop
            return out

        return call


@pytest.mark.parametrize("stop", ["parts", "rename", "mkdirs", None])
def test_a_batch_that_stops_half_way(spark, tmp_path, monkeypatch, stop):
    source, out, check = tmp_path / "in", tmp_path / "out", str(tmp_path / "check")
    put(source, "0.json", [1, 2, 2, 3])
    put(out, "former.json", [3, 50])
    start = lambda check: appends.append_stream(spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).json(str(source)), "id", str(out), check)
    start(check).awaitTermination(120)
    assert written(out) == [1, 2, 3, 50]
    put(source, "1.json", [3, 4, 5, 4])
    put(source, "2.json", [5, 6, 50])

    def stopped(self, path):
        raise Stop

    def broken(self, rows, batch, write=appends.Ledger.write):
        self.here.fs, self.there.fs = Broken(self.here.fs, stop), Broken(self.there.fs, stop)
        write(self, rows, batch)

    if stop:
        monkeypatch.setattr(appends.Ledger, "write", broken)
        if stop == "parts":  # rows are written, none is in place
            monkeypatch.setattr(appends.Files, "parts", stopped)
        query = start(check)
        with pytest.raises(StreamingQueryException, match="Stop"):
            query.awaitTermination(120)
        monkeypatch.undo()
        assert written(out) == {"parts": [1, 2, 3, 50], "rename": [1, 2, 3, 4, 5, 50], "mkdirs": [1, 2, 3, 4, 5, 50]}[stop]
    start(check).awaitTermination(120)
    assert written(out) == [1, 2, 3, 4, 5, 6, 50]
    start(check).awaitTermination(120)
    other = str(tmp_path / "other")
    put(source, "3.json", [7, 1])
    start(other).awaitTermination(120)  # a run of its own: the same batch numbers, other files
    assert written(out) == [1, 2, 3, 4, 5, 6, 7, 50]
    assert not [p.name for p in out.iterdir() if p.name.startswith("_")]
    ledger = appends.Ledger(spark, "id", str(out), check)
    assert ledger.known().count() == 7 and ledger.known().columns == ["digest"]
