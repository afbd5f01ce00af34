"""The worklist job cuts a file of one row group on all cores."""

import json
import uuid

from jobs import embedding_worklist
from tests.test_spread import _one_group


def test_the_worklist_deals_a_file_of_one_row_group(spark, monkeypatch, tmp_path):
    where, seen = _one_group(spark, tmp_path), f"{tmp_path}/seen"
    cut = embedding_worklist.worklist
    monkeypatch.setattr(embedding_worklist, "worklist", lambda df: cut(df.mapInArrow(lambda batches: _told(batches, seen), df.schema)))
    (tmp_path / "seen").mkdir()
    assert embedding_worklist.run(spark, where, f"{tmp_path}/out", f"{tmp_path}/check")["read"] == 400
    parts = [json.loads(f.read_text()) for f in (tmp_path / "seen").iterdir()]
    assert sum(parts) == 400 and max(parts) < 400 / 4


def _told(batches, folder):
    n = 0
    for b in batches:
        n += b.num_rows
        yield b
    if n:
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(n))
