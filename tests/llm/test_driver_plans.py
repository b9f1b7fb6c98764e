"""Plans stay small: the driver runs all exchanges of a plan at once, each with a thread and memory of its own."""

from tidemark.llm import components, minhash


def test_near_duplicates_has_no_large_plan(spark, monkeypatch):
    seen = []

    def counted(f):
        def run(df, name):
            seen.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange"), name))
            return f(df, name)

        return run

    for module in (minhash, components):
        monkeypatch.setattr(module, "written", counted(module.written))
    texts = [" ".join(f"w{(i // 3 * 7 + k) % 40}" for k in range(20 + i % 3)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert len(out) == 30 and all(out[i] == i // 3 * 3 for i in range(3, 6))
    assert max(seen)[0] <= 20, max(seen)
