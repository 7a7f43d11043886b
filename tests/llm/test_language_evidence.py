from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import language

TEXTS = ["the house and the garden of the king " * 5, "der hund und die katze in dem haus " * 5]


def test_rare_hosts_and_values_keep_their_evidence(spark):
    rows = [(i, TEXTS[i % 2], ("en", "de")[i % 2], "big", "big.org") for i in range(400)]
    rows += [(1000 + i, TEXTS[1], "xx", "small.de", "de.org") for i in range(20)]
    rows += [(2000, "", None, "small.de", "de.org"), (2001, "", "xx", None, None), (2002, "", None, None, "de.org"), (2003, "", None, "other.de", "de.org"), (2004, "", None, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, domain string")
    model = language.train_text_model(docs.filter("doc_id < 400"))
    sides = dict(text=F.col("text"), declared=F.col("lang"), host=F.col("host"), domain=F.col("domain"))
    every, few = ({r.doc_id: r for r in language.identify(docs, model, most_hosts=k, **sides).collect()} for k in (4096, 2))
    assert len(every) == len(few) == len(rows)
    for i, a in every.items():  # what is broadcast and what is joined is no matter of results
        assert (a.language, a.accepted) == (few[i].language, few[i].accepted) and abs(a.posterior - few[i].posterior) < 1e-8
    assert [few[k].language for k in (2000, 2001, 2002)] == ["de"] * 3 and few[2000].posterior > 0.6
    kept = language.identify(docs, model, most_hosts=2, keep=True, **sides)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, a in every.items() if a.accepted)
