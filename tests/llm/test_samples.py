"""What the classifiers learn from: bounded however often a row is repeated, and gathered behind an exchange."""

import numpy as np

from talkframe.llm import language, toxicity


def test_only_unicode_letters_make_a_text_speak():
    net = language.Network(["en", "fr"])
    names, scores = language.answers(net, ["½ ² Ⅷ ① _ 12", "", None, "é", "１２ ٣", "ª"])
    assert [n == language.UNKNOWN for n in names] == [True, True, True, False, True, False] and scores[0] == 0.0


def test_repeated_rows_of_a_sampled_id_are_one_example(spark):
    words = ["calm day with friends", "you awful horrid fool"]
    rows = [(k, f"{words[k % 2]} number {k}", "en" if k % 3 else "fr") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, toxic int")
    docs = lambda more: spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string").repartition(7)
    repeated = [rows[9]] * 3000 + [(11, None, "en")] * 50
    plain, heavy = (toxicity.learn(docs(more), labels) for more in ([], repeated))
    assert plain[2] == heavy[2] and np.array_equal(plain[0], heavy[0]) and np.array_equal(plain[1], heavy[1])
    plain, heavy = (language.learn(docs(more)) for more in ([], repeated))
    assert all(np.array_equal(plain.arrays[n], heavy.arrays[n]) for n in language.NAMES)
