"""An embedder never sees more than TEXTS texts at once, however large a batch is."""

from tessera.functions import vectors as V


def test_texts_are_embedded_in_parts(spark):
    plain = V.hashing_embedder(8)

    def embed(texts):
        if len(texts) > 256:
            raise ValueError(len(texts))
        return plain(texts)

    texts = [None if k % 7 == 0 else f"a{k} b{k % 3}" for k in range(1000)]
    rows = V.embedded(spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1), "text", embed).orderBy("k").collect()
    wanted = plain([t or "" for t in texts])
    assert [[round(x, 5) for x in r.embedding] for r in rows] == [[round(x, 5) for x in v] for v in wanted]


def test_a_filter_on_vectors_does_not_make_them_twice(spark, sf):
    from tessera.plans import extraction

    plan = extraction.QUERIES["search_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
