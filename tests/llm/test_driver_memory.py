"""Memory of training goes back to the system."""

from threadloom.llm import language, quality


def test_training_gives_its_memory_back(spark, monkeypatch):
    called = []
    for module in (quality, language):
        monkeypatch.setattr(module, "trimmed", lambda m=module: called.append(m))
    docs = spark.createDataFrame([(k, f"some text number {k}\nand a line", "en" if k % 2 else "de") for k in range(20)], "doc_id long, text string, lang string")
    quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), steps=2)
    language.fit(docs, epochs=1)
    assert called == [quality, language]
