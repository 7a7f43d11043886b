from __future__ import annotations

import pytest

from quire.llm import language


def test_every_label_is_a_hypothesis(spark):
    docs = spark.createDataFrame([(i, f"w{i % 70} text", f"l{i % 70}") for i in range(210)], "doc_id long, text string, lang string")
    assert len(language.train_text_model(docs).languages) == 70
    with pytest.raises(ValueError):
        language.train_text_model(docs, most_languages=69)
