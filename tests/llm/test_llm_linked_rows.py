"""Only rows with a link leave the pipeline as near duplicates."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_rows_of_one_doc_id_stay_unless_linked(spark):
    texts = [
        (7, words(0, 60)), (7, words(100, 160)), (7, words(100, 160)),  # other texts, and a copy
        (8, words(200, 260)), (9, words(200, 259) + " x"), (9, words(300, 360)),  # one of two rows is linked
        (-3, words(400, 460)), (10, words(400, 460)), (11, ""), (11, ""), (11, None), (11, words(500, 510)), (None, words(0, 60)),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts], SCHEMA)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = [
        (7, words(0, 60)), (7, words(100, 160)), (8, words(200, 260)), (9, words(300, 360)),
        (-3, words(400, 460)), (11, ""), (11, ""), (11, None), (11, words(500, 510)), (None, words(0, 60)),
    ]
    assert sorted(out, key=repr) == sorted(want, key=repr)
