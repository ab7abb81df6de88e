import numpy as np
import pytest

from palimpsest.llm.packing import LONG_BLANK, RANKS, TOKENIZER, encoder, pack


@pytest.mark.parametrize("blank", [" ", "\n", "\t ", "\u3000"])
def test_both_readers_agree_on_long_white_space(blank):
    slow, fast = encoder(TOKENIZER, None), encoder(TOKENIZER, RANKS)
    for n in (10, 3000, LONG_BLANK, 1_000_000):
        text = "a b" + blank * (n // len(blank)) + "z" + blank * 5
        assert np.array_equal(slow(text), fast(text))


def test_a_million_blanks_are_packed(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000 + "x"), (2, "words " * 20)], "doc_id long, text string")
    rows = pack(df).collect()
    assert {r.doc_id for r in rows} == {1, 2} and all(r.length <= 1024 for r in rows)
