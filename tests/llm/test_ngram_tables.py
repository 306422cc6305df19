"""Letter models as tables: exact at every size, over whole texts."""

from collections import Counter

import numpy as np

from seriloom.llm import kneser_ney, quality
from tests.llm.test_models import plain_model


def test_ngrams_never_share_counts(spark):
    text = "the quick brown fox the lazy dog The quicker foxes lazily dogged than then quite brownish"
    docs = spark.createDataFrame([(text, 0)], "text string, group int")
    model = kneser_ney.fit(kneser_ney.ngram_counts(docs, order=4, bits=5), order=4, bits=5)
    score, _, grams = plain_model(Counter(text.split()), 4)
    assert len(grams[4]) > 1 << 5
    asked = ["the", "brownish", "zzz"]
    assert np.allclose(model.word_scores(asked)[1][0], [score(w) for w in asked], rtol=1e-4)


def test_order_of_words_counts(spark):
    usual = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old tree near the river"
    words = usual.split()
    shuffled = " ".join(sorted(words))
    docs = spark.createDataFrame([(i, usual, "en") for i in range(20)] + [(20, shuffled, "en")], "doc_id long, text string, lang string")
    logs = {r.doc_id: r.log_perplexity for r in quality.judge(spark, docs).collect()}
    assert logs[20] > logs[0] + 0.05
