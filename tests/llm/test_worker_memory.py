"""What Python workers keep between tasks: an encoder is shared by the tasks of a stage and dropped when another stage begins."""

import pyarrow as pa
from pyspark import TaskContext

from tracewright.llm import common


def test_kept_for_one_stage_only(monkeypatch):
    monkeypatch.setattr(common, "_stage", None)
    common.KEPT.clear()
    seen, made = [], []

    def compute(batches):
        seen.append(common.KEPT.setdefault("encoder", object()))
        yield from batches

    for stage in (3, 3, 4):
        monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls, stage=stage: type("Context", (), {"stageId": lambda self: stage})()))
        made += list(common.frugal(compute)(iter([pa.record_batch({"x": [stage]})])))
    assert [b.column(0).to_pylist() for b in made] == [[3], [3], [4]]
    assert seen[0] is seen[1] and seen[2] is not seen[0]
    common.KEPT.clear()
