"""The mixing classifier at two sizes of the label table: recall of each domain on held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import mixing


@pytest.mark.parametrize("size, poor, toxic", [("sf0.01", 0.6, 0.6), ("sf0.1", 0.85, 0.8)])
def test_recall_of_every_domain(spark, size, poor, toxic):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    seen = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = mixing.learn(docs, labels.where(seen))
    judged = docs.join(labels.where(~seen), "doc_id").select("quality", "toxic", mixing.memberships(F.col("text"), model).alias("m")).collect()
    found = [[], [], []]
    for r in judged:
        found[2 if r.toxic == 1 else 1 if r.quality == 0 else 0].append(int(np.argmax(r.m.p)))
    recall = [np.mean([g == k for g in got]) for k, got in enumerate(found)]
    print(size, len(model.number), [len(x) for x in found], recall)
    assert recall[0] > 0.97 and recall[1] > poor and recall[2] > toxic
    # posteriors differ between documents, so rates can
    assert len({round(r.m.p[0], 6) for r in judged}) > 3


def test_rare_domain_has_markers(spark):
    rows = [(i, f"plain words {i} of text " + ("vile" if i % 10 == 0 else "nice"), 1, int(i % 10 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    model = mixing.learn(docs.select("doc_id", "text"), docs.select("doc_id", "quality", "toxic"))
    assert b"vile" in model.number and int(np.argmax(model.posterior(b"plain vile text")[1])) == 2
    assert int(np.argmax(model.posterior(b"plain nice text")[1])) == 0
