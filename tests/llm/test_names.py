"""Stage functions keep columns whatever their names, and shared folders are asked for on clusters."""

import pytest
from pyspark.sql import functions as F

from skein.llm import common, jaccard, secrets, templates, toxicity

EXTRA = ["rid", "_rid", "state", "_state", "blob", "_blob", "spans", "_spans", "spots", "_new", "_found_rid", "found", "key", "v", "n", "root", "head", "score", "h", "item_id"]
TEXT = "the quick brown fox jumps over the lazy dog and runs far away from here token=abcdef12 now"


@pytest.mark.parametrize("name", ["toxicity", "jaccard", "templates", "secrets"])
def test_clashing_names_stay(spark, name):
    rows = [(1, TEXT), (2, TEXT), (3, "What has 12 legs and 3 heads when it walks over the old bridge at night?"), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in EXTRA})
    bench = spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    stage = {"toxicity": lambda d: toxicity.keep_clean(d, None), "jaccard": jaccard.keep_one, "templates": lambda d: templates.clean(d, bench), "secrets": secrets.without_secrets}[name]
    out = stage(docs)
    assert out.schema.names == docs.schema.names
    got = {r.doc_id: r for r in out.collect()}
    gone = {"jaccard": {2}, "templates": {3}}.get(name, set())
    assert set(got) == {1, 2, 3, 4, None} - gone
    for k, r in got.items():
        assert all(r[c] == f"own {c} {'-' if k is None else k}" for c in EXTRA)
        assert r.text == (dict(rows)[k].replace("token=abcdef12", "[SECRET]") if name == "secrets" and k in (1, 2) else dict(rows)[k])


def test_shared_folder_is_required_off_local_masters(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    assert common.unused(spark.range(1).withColumn("ID_", F.lit(1)), "id") == "id__"
