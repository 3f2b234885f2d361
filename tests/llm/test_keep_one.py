"""Rows without words pass near-duplicate removal, however often they occur."""

from matchlake.llm import minhash


def test_rows_without_words_all_stay(spark):
    rows = [(None, None, "a"), (None, None, "b"), (None, None, "b"), (7, "", "a"), (7, "", "c"), (8, " ", "a")]
    words = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "one two three four five six", "b"), (3, "seven eight nine ten eleven twelve", "a")]
    kept = minhash.keep_one(spark.createDataFrame(rows + words, "doc_id bigint, text string, source string").repartition(3)).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [*rows, words[0], words[3]]))
