"""op9 stores the tensors and spans of all documents and takes its features from what was stored."""

import re

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import audio, queries
from tracewright.sources import shared


def test_query_stores_tensors_and_spans_of_all_documents(spark, sf_dir):
    media = audio.stored(queries.table(spark, sf_dir, "documents"))
    stored = audio.stored_features(media)
    assert all(path.startswith(shared.shared_dir(spark)) for path in stored.inputFiles())
    assert stored.where("tensor is null or segments is null").count() == 0 and stored.count() == media.count()
    want = {}
    for r in media.limit(40).collect():
        payload, rate = audio.wave_payload(bytes(r["media"]))
        want[r["doc_id"]] = audio.features(payload, rate)
    for r in stored.where(F.col("doc_id").isin(list(want))).collect():
        patches, spans, _ = want[r["doc_id"]]
        read = audio.read_tensors(bytes(r["tensor"]))
        assert np.array_equal(read.column("log_mel").combine_chunks().to_numpy_ndarray(), patches)
        assert np.array_equal(np.stack([read.column("start_s").to_numpy(), read.column("end_s").to_numpy()], axis=1), spans)
        assert len(r["segments"]) == r["n_segments"]
    shown = queries.op9_audio_features(spark, sf_dir).select("feature").collect()
    assert all(len(re.search("mean=([^;]*)", r["feature"])[1].split(",")) == audio.MELS and "tensor=" in r["feature"] for r in shown)
